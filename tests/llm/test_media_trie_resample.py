"""Media columns, the conversation trie and importance resampling against brute force, and on odd rows."""

import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.llm import media, resample, trie

LONG = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(330_000))  # some 3 MB
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEEDLESS = "height width channels tile dhash error n_bytes media key n text bucket words score rank may weight n_words cls pos a b mark size home"


@pytest.fixture(scope="module")
def texts():
    some = [None, "", " \t\n", "one", "One two", "é É ß l'été 3,5 — ok\x0bvt", "x" * 64, "y" * 65, LONG, "z" * 300_000, "A b c " * 30, "a b C " * 30, "a b c " * 30]
    return [*enumerate(some), *[(100 + i, f"number {i} of many words " * (i % 9 + 1)) for i in range(60)], (7, "again " * 25), (7, "again " * 25), (None, "no id " * 20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return df.select("*", *[F.lit(f"{n}!").alias(n) for n in NEEDLESS.split() if n != "text"])


# ---- media ----


def naive_means(x, rows, cols):
    h, w = x.shape
    out = np.zeros((rows, cols), int)
    for r in range(rows):
        for c in range(cols):
            total = Fraction(0)
            y0, y1, x0, x1 = Fraction(r * h, rows), Fraction((r + 1) * h, rows), Fraction(c * w, cols), Fraction((c + 1) * w, cols)
            for i in range(math.floor(y0), math.ceil(y1)):
                for j in range(math.floor(x0), math.ceil(x1)):
                    total += int(x[i, j]) * (min(y1, i + 1) - max(y0, i)) * (min(x1, j + 1) - max(x0, j))
            out[r, c] = math.floor(total / ((y1 - y0) * (x1 - x0)) + Fraction(1, 2))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 23), st.integers(1, 23), st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1), st.sampled_from([1, 40, 1 << 20]))
def test_area_means_are_exact(h, w, rows, cols, seed, band):
    x = np.random.Generator(np.random.PCG64(seed)).integers(0, 256, (h, w), dtype=np.uint8)
    held, media.BAND = media.BAND, band
    try:
        assert (media.resize(x, rows, cols) == naive_means(x, rows, cols)).all()
    finally:
        media.BAND = held


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(0, 2**32 - 1), st.sampled_from(["netpbm", "bmp"]))
def test_pictures_come_back_as_they_were(h, w, deep, seed, form):
    x = np.random.Generator(np.random.PCG64(seed)).integers(0, 256, (h, w, 3) if deep == 3 else (h, w), dtype=np.uint8)
    assert (media.decode(media.encode(x, form)) == x).all()


def test_formats_of_netpbm_and_bmp():
    p1 = b"P1\n# a comment\n3 2\n1 0 1\n010\n"
    assert media.decode(p1).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == media.decode(p1).tolist()
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 2 65535\n" + struct.pack(">HH", 65535, 257)).tolist() == [[255], [1]]
    assert media.decode(b"P6 1 1 255\n\x09\x08\x07").tolist() == [[[9, 8, 7]]]
    head = lambda w, h, bits, n, packed=0: struct.pack("<IIiiHHIIiiII", 54 + 4 * n, 40, w, h, 1, bits, packed, 0, 0, 0, n, 0)
    colours = bytes([0, 0, 0, 0, 3, 2, 1, 0])
    assert media.decode(b"BM" + b"\0" * 8 + head(3, 1, 1, 2) + colours + bytes([0b01000000, 0, 0, 0])).tolist() == [[[0, 0, 0], [1, 2, 3], [0, 0, 0]]]
    assert media.decode(b"BM" + b"\0" * 8 + head(3, -1, 4, 2) + colours + bytes([0x10, 0x10, 0, 0]))[0, :, 0].tolist() == [1, 0, 1]
    assert media.decode(b"BM" + b"\0" * 8 + head(1, 2, 32, 0) + bytes([1, 2, 3, 9, 4, 5, 6, 9])).tolist() == [[[6, 5, 4]], [[3, 2, 1]]]


BAD = [b"", b"GIF89a", b"P5", b"P5 3 3 255\n12", b"P5 0 3 255\n", b"P5 1 1 70000\n1", b"P2 1 1 3\n9", b"P2 1 1 3\nx", b"BM", b"BM" + b"\0" * 60, media.encode(np.ones((2, 2), np.uint8), "bmp")[:-1], b"P7 1 1 1 1"]


def test_tiles_keep_other_rows_when_some_are_unreadable(spark):
    x = np.random.Generator(np.random.PCG64(5)).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    rows = [(0, media.encode(x, "bmp")), (1, media.encode(x, "netpbm")), (2, None), *[(3 + i, b) for i, b in enumerate(BAD)]]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("tile", F.lit("mine"))
    got = {r.id: r for r in media.tiles(df, size=(5, 4)).collect()}
    want = naive_means(((x @ np.array(media.LIGHT) + 500) // 1000).astype(np.uint8), 5, 4)
    for i in (0, 1):
        assert (np.load(io.BytesIO(got[i].tile)) == want).all() and (got[i].height, got[i].width, got[i].channels, got[i].error) == (40, 30, 3, None) and got[i]["__tile"] == "mine"
    assert got[0].dhash == got[1].dhash and got[2].tile is None and got[2].error is None
    assert all(got[3 + i].tile is None and got[3 + i].error for i in range(len(BAD)))
    assert media.tiles(df.where("false")).count() == 0


def test_difference_hash():
    x = np.zeros((80, 90), np.uint8)
    x[:, 45:] = 200  # one step, which falls inside the middle column of nine
    assert media.difference_hash(x) == "18" * 8
    assert media.difference_hash(np.full((3, 3), 7, np.uint8)) == "0" * 16


def test_stored_texts(docs, texts):
    got = defaultdict(list)
    for r in media.digests(media.store(docs)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(texts)
    for i, t in texts:
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = np.frombuffer(full, np.uint8).reshape(-1, 64)
        form = "bmp" if zlib.crc32(raw) % 2 else "netpbm"
        stored = b"P5\n64 %d\n255\n" % len(x) + full if form == "netpbm" else media.encode(x, "bmp")
        want = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        same = [r for r in got[i] if (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want]
        assert same
        if len(x) < 60:
            s = naive_means(x, 16, 16).astype(np.uint8)
            assert same[0].feature.endswith(f"{zlib.crc32(media.npy(s)):08x}")
    assert len({r.feature for r in got[7]}) == 2  # the second and third row with this id are equal
    assert media.digests(media.store(docs.where("false"))).count() == 0


# ---- trie ----


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text), rebuilt by families of 5."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), x))
    own = {c: [(y[1], y[3]) for y in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


def talk():
    rng = np.random.Generator(np.random.PCG64(11))
    rows = []
    for c in [*range(-12, 300), 10**12, 10**12 + 3]:
        for t in range(int(rng.integers(1, 12))):
            hot = c % 3 == 0 and t < 6  # a third share their first turns
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "the prompt" * (t + 1) if hot else f"é{rng.integers(0, 3)}"))
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 9000, 7) for t in range(9)]  # copies
    rows += [(20_000, t, "user", f"turn {t}") for t in range(300)] + [(20_001, t, "user", f"turn {t}") for t in range(290)]  # one long, and a prefix of it
    rows += [(1, None, None, None), (1, None, "user", None), (2, 0, None, "x"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "lost"), (30_000, 0, "user", LONG)]
    return rows


@pytest.mark.parametrize(("limit", "bucket"), [(trie.LIMIT, trie.BUCKET), (2, 50), (40, 10)])
def test_trie_against_brute_force(spark, limit, bucket):
    rows = talk()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({n: F.lit("!") for n in ("pos", "mark", "cls", "size", "home", "n", "ka", "a")})
    got = trie.prefix_trie(*trie.rebuilt(trie.numbered(df)), limit=limit, bucket=bucket)
    assert got.schema.simpleString() == "struct<conv_id:bigint,depth:bigint,parent_conv_id:bigint,n_convs:bigint,n_children:bigint,n_leaves:bigint,saved_tokens:bigint,ends_sha256:string>"
    assert Counter(map(tuple, got.collect())) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn int, role string, text string"
    run = lambda rows: Counter(map(tuple, trie.prefix_trie(*trie.rebuilt(trie.numbered(spark.createDataFrame(rows, schema)))).collect()))
    assert not run([]) and not run([(None, 1, "user", "x")])
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # its own two turns go and its family has no first
    for rows in ([(turnless, 0, "user", "a"), (turnless, 1, "bot", "b")], [(5, 0, "", "")], [(5, 0, None, None), (6, 0, "", ""), (turnless, 0, "x", "y")]):
        assert run(rows) == brute_trie(rows)


# ---- resampling ----


def brute_draw(docs, bench, buckets=10_000, least=20, share=(25, 100), seed=7):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def feats(t):
        w = word.findall((t or "").translate(LOW))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    rows = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in bench for b in feats(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(may[: share[0] * len(may) // share[1]], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


BENCH = ["number of many words again", None, "", "One two é", "zz " * 40]


@pytest.mark.parametrize(("buckets", "hot"), [(10_000, 1000), (13, 10)])
def test_draw_against_brute_force(spark, docs, texts, buckets, hot, monkeypatch):
    monkeypatch.setattr(resample, "HOT", hot)
    target = spark.createDataFrame([(t,) for t in BENCH], "text string").withColumn("n", F.lit(5))
    assert Counter(map(tuple, resample.draw(docs, target, buckets=buckets).collect())) == brute_draw(texts, BENCH, buckets)


def test_drawn_rows_and_empty_tables(spark, docs, texts):
    target = spark.createDataFrame([(t,) for t in BENCH], "text string")
    want = Counter(r[0] for r, n in brute_draw(texts, BENCH, share=(50, 100), least=3).items() if r[4] for _ in range(n))
    got = resample.drawn(docs, target, share=(50, 100), least_words=3)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    with pytest.raises(TypeError):
        resample.drawn(docs, target, amount=1)
    assert resample.draw(docs.where("false"), target).count() == 0
    none = Counter(map(tuple, resample.draw(docs, target.where("false")).collect()))
    assert none == brute_draw(texts, [])


def test_long_texts_cut_between_words_keep_their_pairs(monkeypatch):
    text = " ".join(f"word{i}" + "y" * (i % 60) for i in range(3000)).encode()
    whole = Counter(np.concatenate([ids for ids, _, _ in resample.features([text], 10_007)]).tolist())
    monkeypatch.setattr(resample, "BLOCK", 500)
    import feedloom.llm.words as words

    monkeypatch.setattr(words, "BLOCK", 500)
    parts = list(resample.features([b"a b", text, None, b"c"], 10_007))
    assert Counter(np.concatenate([ids[text_ == 1] for ids, text_, _ in parts]).tolist()) == whole
    assert sum(n for _, _, n in parts).tolist() == [2, 3000, 0, 1]
