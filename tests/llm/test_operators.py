"""The ten operators against brute force, and on nulls, blanks, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, bpe, chat, decontam, lm, neardup, quality, sharding, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, rank int, score double, keep boolean"
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    None, "", "  \n\t ", "one", "One two three", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "A B C d e f g h i j k l m n o p q r s t", "x " * 300,
    PASSAGE, "before " + PASSAGE + " after", PASSAGE, "é É ß l'été 3,5 — ok\x0bvt", "l0ser s t u p i d", " ".join(f"w{i}" for i in range(3000)), "one",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 1, 0.5, True) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, PASSAGE, None, None, None, None, None, None, None)]  # a repeated row, and one without id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_sharding(docs, empty):
    got = sharding.shard(docs, 5, blocks=3).collect()
    assert len(got) == len(TEXTS) + 2 and got[0].block == 1 and got[0].rank == 1
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by[s] for s in range(5)) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert sharding.shard(empty).count() == 0


def test_communication_matrix_is_exact_and_uniform():
    m = sharding.communication_matrix([5, 0, 9, 7], [7, 7, 7], 1)
    assert m.sum(1).tolist() == [5, 0, 9, 7] and m.sum(0).tolist() == [7, 7, 7]
    rng = np.random.Generator(np.random.PCG64(2))
    x = np.array([sharding.hypergeometric(rng, 6, 10, 5) for _ in range(8000)])
    for k in range(6):
        p = math.comb(6, k) * math.comb(10, 5 - k) / math.comb(16, 5)
        assert abs((x == k).mean() - p) < 5 * math.sqrt(p / 8000) + 1e-3
    assert abs(sharding.hypergeometric(rng, 10**11, 10**12, 10**9) - 10**9 / 11) < 1e6


def brute_links(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("crowd", [128, 1])
def test_neardup(spark, docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 3 if crowd == 1 else 384)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    near = []
    for i in range(30):
        t = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 9)):
            t[j] = f"n{i}_{j}"
        near.append((100 + i, " ".join(t)))
    df = docs.select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame([(*r, 1) for r in near], "doc_id long, text string, n_chars long"))
    got = neardup.cluster(df, words=4).collect()
    want = brute_links([*enumerate(TEXTS), *near], 4, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert len(got) == df.count()
    assert neardup.cluster(empty).count() == 0


def test_uncrowded_buckets_lose_no_link(spark):
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:j], f"x{i}", *base[j + 1 :]])) for i, j in enumerate((3, 60, 150, 199))] + [(9, " ".join(f"z{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_rows = neardup.sketches(df, 4).select(F.col("doc_id").alias("rep"), "n", "regs", "bands").cache()
    at = all_rows.select(F.explode("bands").alias("key"), "rep", F.lit(0).alias("fame"), F.col("rep").alias("component"))
    got = neardup._uncrowded(at, all_rows, df.toDF("rep", "text"), 4, 80, neardup.LOWER).collect()
    assert sorted((r.u, r.v) for r in got) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for both in (900, 500, 100):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, 1000 - both, dtype=np.uint64)])
        k = neardup.registers([a, b, np.union1d(a, b)])
        assert (np.maximum(k[0], k[1]) == k[2]).all()  # mergeable
        j = both / (2000 - both)
        n = np.array([1000.0])
        assert neardup.log_ratio(k[:1], k[1:2], n, n, j)[0] > -1e9 and neardup.log_ratio(k[:1], k[1:2], n, n, min(0.95, j + 0.35))[0] > 3


@pytest.mark.parametrize("cut", [0, 1])
def test_katz(spark, docs, empty, cut):
    g = lm.grams(docs.select("doc_id", "text"))
    m = lm.train(g)
    got = lm.score(g, m, cut).collect()
    train = [w for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 5 != 1 for w in [[*words(t, True), b"</s>"]]]
    extra = [[*words(TEXTS[5], True), b"</s>"]] if zlib.crc32(b"5") % 5 != 1 else []
    c = Counter(w for t in train + extra for w in t)
    n, v = sum(c.values()), len(c)
    assert (m.n, m.v) == (n, v)
    two = Counter(p for t in train + extra for p in zip([b"<s>", *t], t))
    d = lm.discounts(Counter(x for x in two.values() if x <= lm.LAST + 1))
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    model = {}
    for u in {u for u, _ in two}:
        seen = {w: k for (a, w), k in two.items() if a == u}
        cu = sum(seen.values())
        p = {w: (d[k - 1] if k <= lm.LAST else 1.0) * k / cu for w, k in seen.items()}
        if 1 - sum(p.values()) < 1e-9:
            p = {w: x * cu / (cu + 1) for w, x in p.items()}
        a = (1 - sum(p.values())) / (1 - sum(map(p1, seen)))
        model[u] = (p, a)
        assert abs(sum(p.values()) + a * (1 - sum(map(p1, seen))) - 1) < 1e-9  # normalised over the vocabulary and the unknown class
    three = Counter((x, y, z) for t in train + extra for x, y, z in zip([b"<s>", *t], t, t[1:]))
    count_of = Counter(k for k in three.values() if k <= lm.LAST + 1)
    g3 = lm.turing(count_of, cut) if cut else lm.discounts(count_of)
    p2 = lambda u, w: model[u][0][w] if u in model and w in model[u][0] else (model[u][1] if u in model else 1) * p1(w)
    upper = {}
    for x, y in {k[:2] for k in three}:
        seen = {w: k for (a, b, w), k in three.items() if (a, b) == (x, y) and k > cut}
        if not seen:
            continue
        cu = two[x, y]
        p = {w: (g3[k - 1] if k <= lm.LAST else 1.0) * k / cu for w, k in seen.items()}
        if 1 - sum(p.values()) < 1e-9:
            p = {w: q * cu / (cu + 1) for w, q in p.items()}
        a = (1 - sum(p.values())) / (1 - sum(p2(y, w) for w in p))
        upper[x, y] = (p, a)
        every = [*c, None]
        low = {w: (p2(y, w) if w is not None else (model[y][1] if y in model else 1) * 0.5 / (n + 0.5 * (v + 1))) for w in every}
        assert abs(sum(p.get(w, a * low[w]) for w in every) - 1) < 1e-9  # exactly normalised at this order too
    assert any(p for p, _ in upper.values())
    for r in got:
        if r.doc_id is None:
            continue
        t = [*words(TEXTS[r.doc_id], True), b"</s>"]
        s = math.log10(p2(b"<s>", t[0]))
        for x, y, w in zip([b"<s>", *t], t, t[1:]):
            p, a = upper.get((x, y), ({}, 1.0))
            s += math.log10(p[w] if w in p else a * p2(y, w))
        assert r.score == pytest.approx(s) and r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in t))
        assert (r.n_tokens, r.n_known, r.held_out) == (len(t), sum(w in c for w in t), zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert len(got) == len(TEXTS) + 2
    e = lm.grams(empty.select("doc_id", "text"))
    assert lm.score(e, lm.train(e)).count() == 0


def test_a_range_of_many_copies_is_settled_in_parts(spark, monkeypatch):
    shared = [" ".join(f"s{j}w{i}" for i in range(70)) for j in range(3)]
    rows = [(i, f"own{i} a{i} b{i} " + shared[i % 3 if i % 4 else 0] + f" end{i}" + (f" {shared[1]}" if i % 7 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    monkeypatch.setattr(substring, "session", lambda s: s)  # small batches, so that copies meet in a range
    want = {(r.doc_id, r.n_removed, r.kept) for r in substring.repeats(df)[1].collect()}
    parts = []
    for size in (200, 40):
        monkeypatch.setattr(substring, "RANGE", size)
        real = substring._settled
        monkeypatch.setattr(substring, "_settled", lambda d, real=real: parts.append(d.groupBy("r").agg(F.sum(F.octet_length("h") / 8).alias("n")).where(F.col("n") > 4 * substring.RANGE).count()) or real(d))
        assert {(r.doc_id, r.n_removed, r.kept) for r in substring.repeats(df)[1].collect()} == want
        monkeypatch.setattr(substring, "_settled", real)
    assert all(parts) and len(want) > 200


def test_substring(docs, empty):
    rows, lost = substring.repeats(docs)
    gone = {r.doc_id: (r.n_removed, r.kept) for r in lost.collect()}
    start = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for j in range(len(w) - 49):
            start.setdefault(tuple(w[j : j + 50]), set()).add(i)
    for i, t in enumerate(TEXTS):
        w = words(t)
        out = {x for j in range(len(w) - 49) if min(start[tuple(w[j : j + 50])]) < i for x in range(j, j + 50)}
        kept = " ".join(x.decode() for j, x in enumerate(w) if j not in out)
        assert gone.get(i, (0, None)) == ((len(out), kept) if out else (0, None))
    assert rows.count() == len(TEXTS) + 2 and None not in gone
    assert substring.repeats(empty)[1].count() == 0


def test_substring_stage(spark, docs):
    got = {r.doc_id: r.text for r in substring.stage(spark, docs, "").where("doc_id is not null").collect()}
    assert got[10] == "before after" and 11 not in got and got[12] == TEXTS[12]


def test_bpe_is_the_library():
    from tokenizers import Tokenizer

    enc, lib = bpe.encoder(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    more = ["<|endoftext|>x<|endoftext|>", "it's  we'll\n\n  x", "  a", "日本語 ١٢٣ ²", "a" * 500, "\x1c\x85 '", "naïve 🙂🙂", "</|endof"]
    for t in [*(x or "" for x in TEXTS), *more]:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = enc.encode(t)
        assert np.frombuffer(ids, np.uint32).tolist() == want and enc.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_query(docs, empty):
    got = bpe.digests(docs).collect()
    assert len(got) == len(TEXTS) + 2
    blank = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, blank, blank) for r in got if r.doc_id in (0, 1))
    assert all(r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest() for r in got if r.doc_id is not None)
    assert bpe.digests(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "other"), (4, 0, "user", "other"), (5, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: (r.n_turns, r.n_snapshots) for r in chat.render(chat.collapse(df)).collect()}
    assert got == {2: (2, 3), 4: (1, 1), 5: (1, 1)}
    assert chat.render(chat.collapse(df.where("false"))).count() == 0


def test_decontam(spark, docs, empty):
    items = [(1, " ".join(f"P{i}" for i in range(5, 17))), (2, "one two three"), (3, None), (4, "..."), (None, PASSAGE), (1, " ".join(f"P{i}" for i in range(5, 17))), (6, "l été 3 5")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, span int")
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.hits(docs, bench).where("doc_id is not null").collect()}
    for i, t in enumerate(TEXTS):
        w, hit, ids = low(t), set(), set()
        for item, x in items:
            y = low(x)
            n = min(10, len(y))
            if item is None or not n:
                continue
            for a in range(len(y) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == y[a : a + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item))
        assert got.get(i, (0, [])) == (len(hit), sorted(ids)), i
    assert decontam.hits(empty, bench).count() == 0 and decontam.hits(docs, bench.where("false")).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16))
    x[100:400] = x[100]  # copies
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [1.0], 0), (9004, [None] * 16, 0), (100, [float(v) for v in x[100]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    got = {}
    for r in ann.search(df, 50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:20]
        rows_q = sorted(got[q])
        assert [r[0] for r in rows_q] == list(range(1, 21)) and all(abs(r[2] - s[r[1]]) < 1e-9 for r in rows_q)
        found += len({r[1] for r in rows_q} & set(order))
        total += 20
    assert found / total >= 0.9 and set(got) == set(range(0, 1500, 50))
    assert [r[1] for r in sorted(got[100])] == list(range(101, 121))  # ties go to smaller ids
    assert ann.search(df.where("false"), 20).count() == 0


@pytest.mark.parametrize("case", ["few", "huge", "far"])
def test_ann_leaves_no_query_short(spark, case):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12 if case == "few" else 300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "huge":
        x[7] *= 1e5
    if case == "far":
        x[1:] = -x[0] + 0.01 * x[1:]  # one query has all candidates on the other side
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, 1 if case == "few" else 15).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q in range(0, len(x), 1 if case == "few" else 15):
        s = x @ x[q]
        true = [i for i in np.argsort(-s) if i != q][:20]
        rows = sorted(got.get(q, []))
        assert [r[0] for r in rows] == list(range(1, len(true) + 1)) and len({r[1] for r in rows}) == len(rows) and all(abs(r[2] - s[r[1]]) < 1e-6 for r in rows)
        found, total = found + len({r[1] for r in rows} & set(true)), total + len(true)
    assert found / total >= (1 if case == "few" else 0.9)


def test_toxicity_whole_score_against_plain_python(spark):
    rng = np.random.default_rng(4)
    plain = "the river runs calm past old mills and green fields while people walk home in the evening".split()
    bad = ["moron", "m0r0n", "idiot", "id1ot", "mo.ron", "i d i o t"]
    rows = []
    for i in range(400):
        w = [plain[j] for j in rng.integers(0, len(plain), 12)]
        if i % 5 == 0:
            w[3] = bad[i // 5 % len(bad)]
        rows.append((i, " ".join(w) + (" été" if i % 3 else "")))
    rows += [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chars = toxicity.char_model(df)
    model = toxicity.train(df, labels, chars)
    got = {r.doc_id: r for r in toxicity.score(df, model, chars).collect()}

    kind = lambda b: 27 if b >= 128 else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0
    counts = np.zeros(toxicity.KINDS**3, np.int64)
    for _, t in rows:
        c = [kind(b) for b in b"  " + (t or "").encode() + b" "] if t else []
        for x, y, z in zip(c, c[1:], c[2:]):
            counts[(x * toxicity.KINDS + y) * toxicity.KINDS + z] += 1
    assert toxicity.CharModel(counts).logs == chars.logs

    def marks(t):
        words_ = re.findall(rb"[A-Za-z\x80-\xff]+", toxicity.restore((t or "").encode(), chars))
        return {w for w in words_} | {(k, w[:k]) for w in words_ for k in toxicity.PREFIXES if len(w) >= k}

    learnt = [(marks(t), int(i % 5 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n1, n0 = sum(y for _, y in learnt), sum(1 - y for _, y in learnt)
    seen = {y: Counter(m for s, z in learnt if z == y for m in s) for y in (0, 1)}
    picked = []
    for m, b in seen[1].items():
        g = seen[0][m]
        z = (b / n1 - g / n0) / math.sqrt((b + g + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
        if b >= toxicity.LEAST_DOCS and (b + 0.5) / (n1 + 1) / ((g + 0.5) / (n0 + 1)) > toxicity.LEAST_RATIO and z > toxicity.LEAST_Z:
            picked.append(m)
    assert 0 < len(picked) == len(model.hashes)
    place = {m: j for j, m in enumerate(picked)}
    again = toxicity.fit([np.array(sorted(place[m] for m in s if m in place), int) for s, _ in learnt], np.array([y for _, y in learnt]), np.arange(len(picked), dtype=np.uint64))
    for i, t in rows:
        want = 1 / (1 + math.exp(-(again.intercept + sum(again.weights[place[m]] for m in marks(t) if m in place))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400))


def test_toxicity(spark, docs, empty):
    clean = ["the old man walks by the river and sings to his dog", "we read many books on winter nights", "bread and butter with a little salt"]
    rows = [(i, clean[i % 3] + (" you idiot" if i % 7 == 0 else "") + f" n{i}") for i in range(700)]
    more = [(1000, "you 1d10t there"), (1001, "what an i d i o t"), (1002, "idiiiiot"), (1003, None), (1004, ""), (1005, clean[0])]
    df = spark.createDataFrame([(*r, "en") for r in rows + more], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chars = toxicity.char_model(df)
    assert [chars.restore(t) for t in ("1d10t", "i d i o t", "plain")] == ["idiot", "idiot", "plain"]
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, labels, chars), chars).collect()}
    assert all(got[i].predicted == int(i % 7 == 0) for i, _ in rows)
    assert [got[i].predicted for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    none = toxicity.train(df, labels.where("false"), chars)
    assert toxicity.score(docs, none, chars).count() == len(TEXTS) + 2 and toxicity.score(empty, none, chars).count() == 0


def test_every_token_with_signs_is_decoded():
    text = b"we hate it and they hate him . oh shit what a moron . such a idiot is an ass . well known room and the old room . " * 40
    chars = toxicity.CharModel(toxicity.char_counts([text]))
    told = {
        "hat3": "hate", "sh!7": "shit", "a$$": "ass", "id-iot": "idiot", "mo.ron": "moron", "a.s.s": "ass", "such a m o r o n": "such a moron", "an a s s": "an ass",
        "m.o.r.o.n!!": "moron", "the!!": "the", "well-known room101": "well-known room101", "1d10t": "idiot", "plain": "plain",
    }
    assert {t: toxicity.restore(t.encode(), chars).decode() for t in told} == told


def test_quality(spark, docs, empty):
    text = {0: "zz zz zz !! zz", 1: "plain words zz and others", 2: "a calm and even sentence about rivers"}
    rows = [(i, f"{text[i % 3]} v{i % 11}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i, _ in rows] + [(None, 1), (2, None), (2, 5)], "doc_id long, quality int").where("quality is null or quality < 5")
    m = quality.train(df, ratings, sample_rows=300)
    assert (np.diff(m.cuts) > 0).all() and m.grades.tolist() == [0, 1, 2]
    got = quality.score(df, m).collect()
    assert np.mean([round(r.expected_grade) == r.doc_id % 3 for r in got]) > 0.95 and np.mean([r.keep == (r.doc_id % 3 == 2) for r in got]) > 0.95
    out = quality.score(docs, m)
    assert out.count() == len(TEXTS) + 2 and quality.score(empty, m).count() == 0 and out.columns.count("keep") == 1
    flat = quality.train(df, ratings.where("false"))
    assert quality.score(df, flat).where("keep").count() == 600


def test_components(spark):
    from feedloom.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and 0 not in got
