"""Every operator and stage on clashing columns, nulls, blanks, very long texts, ties, repeated rows and empty tables; the pipeline against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, bpe, chat, decontam, lm, neardup, quality, sharding, substring, toxicity

from test_operators import brute_links, words

#: Names that the operators use inside, and some that they return.
NAMES = """b cuts s p id key kept keep pd pt th w rep n regs bands set_key component component_id expected_grade tail_prob shard slot fp iw span block rank pos part base hub fame at h g z r whole first
runs spans n_words y idx val signs score held_out predicted n_tokens ids decoded n_hit items contaminated n_shingles law size turns row flags __w __id __key __kept __grade __tail __stays __shard""".split()
PASSAGE = " ".join(f"passage{i}" for i in range(70))
LONG = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(330_000))  # some 3 MB


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12))), (2, None), (2, ""), (None, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark):
    good, bad = "the river runs calm past the old mill and the fields", "zz zz !! zz zz ## zz zz"
    texts = [(i, (good if i % 2 else bad) + f" number {i} " + " ".join(f"t{i}_{j}" for j in range(6))) for i in range(1, 13)]
    texts += [(20, None), (21, ""), (22, " \t\n"), (23, LONG), (24, good + " " + PASSAGE), (25, good + " again " + PASSAGE), (26, good + " " + " ".join(f"q{i}" for i in range(12))), (27, good), (27, good), (None, good), (28, good + " same"), (28, bad)]
    df = spark.createDataFrame([(*x, "en") for x in texts], "doc_id long, text string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit(0))).alias(n) for n in NAMES])


STAGES = {"quality": quality.stage, "neardup": neardup.stage, "substring": substring.stage, "decontam": decontam.stage}


@pytest.mark.parametrize("name", [*STAGES, "shard", "quality.score"])
def test_columns_of_any_name_pass_through(spark, docs, sf_dir, name):
    if name == "shard":
        out, keep = sharding.shard(docs, 3), {"shard": "__shard", "slot": "__slot"}
        keep["shard"] = "___shard"  # the input has a column __shard of its own
    elif name == "quality.score":
        out, keep = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), {n: f"__{n}" for n in ("expected_grade", "tail_prob", "keep")}
    else:
        out, keep = STAGES[name](spark, docs, sf_dir), {}
        assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[keep.get(n, n)] == f"{n}:{r['doc_id'] or 0}" for r in rows for n in NAMES)
    if name in ("shard", "quality.score"):
        assert len(rows) == docs.count()


@pytest.mark.parametrize("name", [*STAGES, "bpe"])
def test_stages_on_empty_tables(spark, docs, sf_dir, name):
    assert (bpe.stage if name == "bpe" else STAGES[name])(spark, docs.where("false"), sf_dir).count() == 0


def test_stages_keep_what_they_should(spark, docs, sf_dir):
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = ids(neardup.stage(spark, docs, sf_dir))
    assert kept[27] == 2 and kept[23] == 1 and kept[None] == 1 and kept[20] == kept[21] == kept[22] == 1
    left = {r.doc_id: r.text for r in substring.stage(spark, docs, sf_dir).where("doc_id in (23, 24, 25)").collect()}
    assert left[23] == LONG and left[24].endswith("passage69") and "passage" not in left[25]
    assert set(ids(docs)) - set(ids(decontam.stage(spark, docs, sf_dir))) == {26}


def test_other_operators_take_the_same_rows(spark, docs, sf_dir):
    n = docs.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chars = toxicity.char_model(docs)
    assert toxicity.score(docs, toxicity.train(docs, labels, chars), chars).count() == n
    g = lm.grams(docs)
    scored = lm.score(g, lm.train(g)).collect()
    assert len(scored) == n and all(math.isfinite(r.score) for r in scored)
    d = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert d[23].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    h = {r.doc_id: r.n_hit for r in decontam.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert h[26] == 12
    talk = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *NAMES)
    assert {r.conv_id for r in chat.render(chat.collapse(talk)).collect()} >= {23, 24, 25}


def test_equal_turn_numbers_are_ordered_by_role_and_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "bot", "z"), (1, 0, None, "n"), (2, 0, None, "n"), (2, 0, "bot", "z"), (3, None, "user", "first"), (3, 0, "user", "b")]
    got = {r.conv_id: (r.chat, r.n_snapshots) for r in chat.render(chat.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert set(got) == {1, 3} and got[1][1] == 2 and [x for x in re.findall(r"\n(\w)<", got[1][0])] == ["n", "z", "a", "b"] and got[3][0].index("first") < got[3][0].index("b<")


def test_sharding_query(spark, tmp_path):
    texts = ["", None, "é€", "a", "a", "x" * 5000] + [f"t{i}" for i in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    by = {s: sorted((r.slot, r.doc_id) for r in got if r.shard == s) for s in range(24)}
    assert all([x[0] for x in v] == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # uniform: shards' mean ids, and how often neighbours of the input stay neighbours, are those of a random permutation
    n = len(texts)
    for v in by.values():
        assert abs(np.mean([i for _, i in v]) - n / 2) < 5 * n / math.sqrt(12 * len(v))
    together = sum(abs(a[1] - b[1]) == 1 for v in by.values() for a, b in zip(v, v[1:]))
    assert together < 2 + 5 * math.sqrt(2)


def test_viterbi_is_the_best_of_all_paths():
    text = b"we hate it and they hate him . oh shit what a moron . such a idiot is an ass . well known room and the old room . " * 40
    chars = toxicity.CharModel(toxicity.char_counts([text]))
    kind = lambda c: 27 if ord(c) > 127 else int(toxicity.CLASS[ord(c)])

    def every(token):
        """All readings of a token with their best log-probability, path by path."""
        tail = len(token.rstrip("".join(toxicity.LEET) + ".-_*"))
        run = [len(list(g)) for _, grp in itertools.groupby(token) for g in [list(grp)] for _ in g]
        choices = []
        for i, o in enumerate(token):
            if o.isalpha():
                c = [(o, toxicity.ASIS)]
            elif o in toxicity.LEET:
                c = [(x, toxicity.SWAP) for x in toxicity.LEET[o]] + [(o, toxicity.SIGNED)]
                if i >= tail and (run[i] > 2 or not token[tail:].strip("!.-_*")):
                    c.append((None, toxicity.GAP))
            elif o in " .-_*":
                c = [(None, toxicity.GAP), (o, toxicity.GAP)]
            else:
                c = [(o, toxicity.SIGNED)]
            if run[i] > 2:
                c = [(x, p, drop) for x, p in c for drop in ((False, True) if x is not None else (False,))]
            else:
                c = [(x, p, False) for x, p in c]
            choices.append(c)
        best = {}
        for path in itertools.product(*choices):
            p, out, a, b = 0.0, "", 0, 0
            for i, (c, cost, drop) in enumerate(path):
                if c is None:
                    p += cost
                    continue
                again = bool(out) and c == out[-1] and run[i] > 2
                if drop and not again:
                    p = -math.inf
                    break
                if drop:
                    p += toxicity.DROP
                    continue
                k = kind(c)
                p += (toxicity.GAP if c.isdigit() and out[-1:].isdigit() else cost) + chars.logs[a][b][k] + (toxicity.REPEAT if again else 0)
                a, b, out = b, k, out + c
            p += chars.logs[a][b][0]
            best[out] = max(best.get(out, -math.inf), p)
        return best

    for token in ("h4te", "sh!7", "a$$", "1d10t", "mo.ron", "iddiot", "a.s.s", "sooo", "m0r0n!", "room101", "h-t"):
        best = every(token)
        assert best[chars._decode(token)] == pytest.approx(max(best.values()))


def test_quality_agrees_with_an_independent_fit():
    """With two grades the cumulative link is logistic regression: an IRLS fit on dense features gives the same decisions, and tails follow the definition."""
    rng = np.random.default_rng(2)
    vocab = [["calm", "river", "and", "field", "with"], ["zz!!", "##", "click", "buy", "now"]]
    make = lambda y: " ".join(rng.choice(vocab[y if rng.random() < 0.75 else 1 - y]) for _ in range(12)).encode()
    y = np.array([i % 2 for i in range(400)])
    texts = [make(1 - v) for v in y]
    rows = quality.features(texts)
    m = quality.fit(rows[:300], y[:300])
    x = np.zeros((400, quality.REPEATS + 1))
    for i, (idx, val) in enumerate(rows):
        x[i, idx] = val
    used = np.flatnonzero(x.any(0))
    a = np.concatenate([x[:, used], np.ones((400, 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a[:300] @ w))
        h = (a[:300] * (p * (1 - p))[:, None]).T @ a[:300] / 300 + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, a[:300].T @ (p - y[:300]) / 300 + 1e-3 * w)
    mine = m.tails(m.raw(texts))[:, 0]
    theirs = 1 / (1 + np.exp(-a @ w))
    assert np.mean((mine >= 0.5) == (theirs >= 0.5)) >= 0.98 and np.mean((mine[300:] >= 0.5) == (y[300:] == 1)) >= 0.93
    s = m.raw(texts[:5])
    assert np.allclose(s, [float(m.weights[r[0]] @ r[1].astype(float)) for r in rows[:5]], rtol=1e-4) and np.allclose(m.tails(s)[:, 0], 1 / (1 + np.exp(m.cuts[0] - s)))


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))

    def grade(t):
        b = (t or "").encode()
        cells = Counter((((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761) & 0xFFFFFFFF) >> (32 - quality.BITS) for i in range(len(b) - 2))
        w = [x.lower() for x in b.split()]
        twice = sum(x == z for x, z in zip(w, w[1:])) / len(w) if len(w) > 1 else 0.0
        s = sum(float(model.weights[c]) * n for c, n in cells.items()) * 30.0 / max(1, len(b) - 2) + float(model.weights[quality.REPEATS]) * 3 * twice
        return 1 / (1 + math.exp(model.cuts[-1] - s))

    rows = {r.doc_id: r.text for r in docs.collect()}
    close = {i for i, t in rows.items() if abs(grade(t) - 0.5) < 1e-6}
    assert not close
    rows = {i: t for i, t in rows.items() if grade(t) >= 0.5}
    groups = brute_links(sorted(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    start = {}
    for i, t in rows.items():
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            start[k] = min(i, start.get(k, i))
    after = {}
    for i, t in rows.items():
        w = words(t)
        out = {x for j in range(len(w) - 49) if start[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        if not out:
            after[i] = t
        elif len(out) < len(w):
            after[i] = b" ".join(x for j, x in enumerate(w) if j not in out).decode()
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = low(r.text)
        n = min(10, len(w))
        bench |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in bench}

    def clean(t):
        w = low(t)
        return not any(tuple(w[j : j + n]) in bench for n in sizes for j in range(len(w) - n + 1))

    after = {i: t for i, t in after.items() if clean(t)}
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(after) and 0 < len(after) < 200
    for i, t in after.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, np.uint32).tolist() == ids and got[i].decoded == (t or "") and got[i].n_tokens == len(ids)


def test_ann_takes_extra_columns_and_long_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(n) for n in NAMES])
    got = ann.search(df, 20).collect()
    assert len(got) == 3 * 20 and {r.query_id for r in got} == {0, 20, 40}
