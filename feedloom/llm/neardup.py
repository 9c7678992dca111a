"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles.  Register i keeps the smallest of independent exponential values of the
set's elements, truncated to a power of BASE: an exponentially spaced minimum.  Registers of a union are the maxima of
the registers (mergeable), and two sets agree in a register with a probability near their Jaccard similarity
(locality-sensitive).  BANDS bands of WIDTH registers give candidates; a pair's similarity is estimated jointly from
the counts of larger, smaller and equal registers by likelihood, and pairs that cannot reach the threshold
are let go; all others are confirmed on the full sets.  At similarity 0.8 a pair shares no band with probability
(1 - 0.8**4)**40 < 1e-9, where registers agree independently, and the estimate's margin (MARGIN) errs with about the same probability.

Skew: documents with equal sets form a class first, so that copies count once.  In a bucket, members are held against one hub, the
member whose buckets are the largest, not against each other; components follow; only pairs of a bucket whose members
are still in different components are then confirmed, in further rounds of hubs and a last full pass.  No pair
inside a component is ever made, and no link between components is lost.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing; fewer words
than a shingle make one shingle; rows without doc_id are linked with nothing (component_id null, kept true); equal rows
with one id all remain and name that id; ids are whole numbers; texts of any length take part whole; extra columns are ignored, and ``stage`` passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize, own, session, table, tidy
from .words import LOWER, PLAIN, U, hashed, mix, rolled, texts_of

WORDS, SIMILARITY = 5, 0.8
WIDTH, BANDS = 4, 40
REGISTERS = WIDTH * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65_534
MARGIN = 20.0
HUB_ROUNDS, CROWD, BLOCK = 1, 128, 384
_rng = np.random.Generator(np.random.PCG64(5))
FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
CHUNK = 1 << 14


def shingle_sets(texts: list[bytes | None], k: int, fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, (w,), off in hashed(texts, fold):
        all_of = rolled(w, k)
        for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
            n = z - a
            if n >= k:
                out.append(np.unique(all_of[a : z - k + 1]))
            elif n:
                out.append(rolled(w[a:z], n) ^ U(n))  # the whole sequence
            else:
                out.append(np.empty(0, U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of REGISTERS truncated exponential minima, as powers of BASE (larger: smaller value)."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    joined = np.concatenate([sets[i] for i in full])
    begins = np.cumsum([0] + [len(sets[i]) for i in full])
    low = np.full((REGISTERS, len(full)), np.iinfo(U).max, U)
    for c in range(0, len(joined), CHUNK):
        x = joined[c : c + CHUNK]
        first = int(np.searchsorted(begins, c, "right")) - 1
        last = int(np.searchsorted(begins, c + len(x), "left"))
        cuts = np.maximum(begins[first:last], c) - c
        y = np.empty_like(x)
        for r in range(REGISTERS):
            np.multiply(x, FACTORS[r], out=y)
            y += SHIFTS[r]
            np.minimum(low[r, first:last], np.minimum.reduceat(y, cuts), out=low[r, first:last])
    u = (low.astype(float) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype(np.uint16).T
    return out


def _pb(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_ratio(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """How much likelier (log) the best similarity is than ``similarity`` for pairs of register rows; 0 where the best is at least that."""
    more, less = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def likely(j: np.ndarray) -> np.ndarray:
        p, q = _pb(np.maximum(u - v * j, 1e-12)), _pb(np.maximum(v - u * j, 1e-12))
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), top.copy()
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likely(a) < likely(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    best = (low + high) / 2
    at = np.minimum(similarity, top)
    return np.where(best >= at, 0.0, likely(best) - likely(at))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Hashes of each row's bands of WIDTH registers, one column a band."""
    h = np.zeros((len(regs), BANDS), U)
    cols = regs.reshape(len(regs), BANDS, WIDTH).astype(U)
    for i in range(WIDTH):
        h = mix(h ^ (cols[:, :, i] + U(i + 1)))
    return mix(h + np.arange(BANDS, dtype=U)[None, :])


def sketches(docs: DataFrame, k: int, fold: np.ndarray = LOWER) -> DataFrame:
    """doc_id, n (set size), set_key (digest of the set; null if empty), regs, bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(texts_of(b.column(1)), k, fold)
            regs = registers(sets)
            h = band_keys(regs).view(np.int64)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS), pa.int32()), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), bands], ["doc_id", "n", "set_key", "regs", "bands"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, set_key binary, regs binary, bands array<long>")


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, fold: np.ndarray) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ka, kb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            na, nb = (b.column(i).to_numpy().astype(float) for i in (4, 5))
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (log_ratio(ka, kb, na, nb, percent / 100) <= MARGIN)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            us, vs, tu, tv = b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), texts_of(b.column(3))
            keep = []
            for u, v, x, y in zip(us, vs, tu, tv):
                if u not in held:
                    held = {u: shingle_sets([x], k, fold)[0]}  # pairs of one u often follow each other
                s, t = held[u], shingle_sets([y], k, fold)[0]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["u"].dataType.simpleString()
    r = reps.select("rep", "regs", "n")
    near = pairs.join(r.toDF("u", "ru", "nu"), "u").join(r.toDF("v", "rv", "nv"), "v").where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    near = materialize(near.select("u", "v", "ru", "rv", "nu", "nv").mapInArrow(likely, f"u {kind}, v {kind}"))
    # only the texts that take part are shuffled
    part = near.select(F.col("u").alias("rep")).unionByName(near.select(F.col("v").alias("rep"))).distinct()
    some = materialize(texts.join(part, "rep", "left_semi"), "zstd")
    full = near.join(some.toDF("u", "tu"), "u").join(some.toDF("v", "tv"), "v")
    return materialize(full.select("u", "v", "tu", "tv").mapInArrow(exact, f"u {kind}, v {kind}"))


def _uncrowded(open_: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, fold: np.ndarray) -> DataFrame:
    """Links (u, v) between components in buckets of at most CROWD members, without a row for each pair.

    A pair is judged in the first bucket that it shares.  The first pass reads registers and names the members of a bucket that
    have a pair to confirm there; in the second their texts come along, full sets decide, and only links leave the task.
    """
    kind = open_.schema["rep"].dataType.simpleString()

    def likely(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) of t by bucket: pairs of two components that may reach the threshold and share no earlier bucket."""
        key, comp, n = (t.column(i).to_numpy() for i in (0, 2, 4))
        regs = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        own = band_keys(regs).view(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, z in zip(cut[:-1], cut[1:]):
            i, j = np.triu_indices(z - a, 1)
            i, j = i + a, j + a
            ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            ok = own[i, (own[i] == own[j]).argmax(1)] == key[a]
            i, j = i[ok], j[ok]
            if len(i):
                ok = log_ratio(regs[i], regs[j], n[i].astype(float), n[j].astype(float), percent / 100) <= MARGIN
                yield i[ok], j[ok]

    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = None  # the bucket that the batch before ended in
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = t.column(0).to_numpy()
            turns = np.flatnonzero(key[1:] != key[:-1])
            edge = int(turns[-1]) + 1 if len(turns) else 0
            if edge:
                yield t.slice(0, edge)
            held = t.slice(edge)
        if held is not None and held.num_rows:
            yield held

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            at = [x for pair in likely(t) for x in pair]
            if at:
                yield from t.take(np.unique(np.concatenate(at))).to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            rep, us, vs = t.column(1).to_numpy(), [], []
            sets = shingle_sets(texts_of(t.column(5).combine_chunks()), k, fold)
            for i, j in likely(t):
                for a, b in zip(i.tolist(), j.tolist()):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        us.append(min(rep[a], rep[b]))
                        vs.append(max(rep[a], rep[b]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.schema.field(1).type) for x in (us, vs)], ["u", "v"])

    by_bucket = lambda df: df.repartition("key").sortWithinPartitions("key")
    rows = open_.join(reps.select("rep", "regs", "n"), "rep").select("key", "rep", "component", "regs", "n")
    some = materialize(by_bucket(rows).mapInArrow(members, f"key long, rep {kind}, component {kind}, regs binary, n long"))
    part = materialize(texts.join(some.select("rep").distinct(), "rep", "left_semi"), "zstd")
    return by_bucket(some.join(part, "rep").select("key", "rep", "component", "regs", "n", "text")).mapInArrow(links, f"u {kind}, v {kind}").distinct()


def _crowded(open_: DataFrame, texts: DataFrame, k: int, percent: int, fold: np.ndarray) -> DataFrame:
    """Links (u, v) between components in buckets of many members, without a row for each pair.

    Members outside the bucket's largest component are held against all members, block by block: an inverted index of a
    block's shingles gives exact intersections, and only links leave the task.
    """
    kind = open_.schema["rep"].dataType.simpleString()
    by = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = by.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside"))
    cuts = main.select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("ma"), F.ceil(F.col("outside") / BLOCK).cast("int").alias("mo"))
    rows = open_.join(cuts, "key").join(texts, "rep")
    left = rows.select("key", F.pmod(F.xxhash64("rep"), F.col("ma")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mo") - 1)).alias("j"), "rep", "component", "text")
    right = rows.where("component <> main").select(
        F.col("key").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("ma") - 1)).alias("i2"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("mo")).cast("int").alias("j2"),
        F.col("rep").alias("rep2"), F.col("component").alias("component2"), F.col("text").alias("text2"),
    )

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        us, vs = [], []
        if some.num_rows and others.num_rows:
            ids, comp = some.column("rep").to_numpy(), some.column("component").to_numpy()
            sets = shingle_sets(texts_of(some.column("text").combine_chunks()), k, fold)
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for own, c, s in zip(others.column("rep2").to_pylist(), others.column("component2").to_pylist(), shingle_sets(texts_of(others.column("text2").combine_chunks()), k, fold)):
                a, z = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = z - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero((100 * both >= percent * (size + len(s) - both)) & (comp != c)):
                    us.append(min(own, int(ids[i])))
                    vs.append(max(own, int(ids[i])))
        return pa.table([pa.array(us, some.schema.field("rep").type), pa.array(vs, some.schema.field("rep").type)], names=["u", "v"])

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("k2", "i2", "j2")).applyInArrow(meet, f"u {kind}, v {kind}").distinct()


def cluster(docs: DataFrame, words: int = WORDS, percent: int = 80, fold: np.ndarray = LOWER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    session(docs.sparkSession)
    all_rows = materialize(sketches(docs, words, fold))
    with_set = all_rows.where("set_key is not null and doc_id is not null")
    classes = with_set.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("regs").alias("regs"), F.count("*").alias("copies"))
    classes = materialize(classes)
    # the bands again from the registers of the classes alone: copies bring none
    own = all_rows.select("doc_id", "set_key", "bands").join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    band = own.dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    sizes = band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(band.join(sizes, "key"))
    fame = shared.groupBy("rep").agg(F.sum("size").alias("fame"))
    shared = materialize(shared.join(fame, "rep").select("key", "rep", "fame"))
    tidy(docs.sparkSession)
    order = F.struct("fame", (-F.col("rep")).alias("back"), "rep")
    hub = shared.groupBy("key").agg(F.max(order).getField("rep").alias("hub"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    texts = texts.join(classes.select("rep"), "rep", "left_semi")
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    tried = materialize(shared.join(hub, "key").where("rep <> hub").select(*pair("rep", "hub")).distinct())
    links = _confirm(tried, classes, texts, words, percent, fold)
    comp = materialize(components(links))
    tidy(docs.sparkSession)

    def open_buckets(comp: DataFrame) -> DataFrame:
        """Buckets of more than two members whose members are in different components."""
        at = shared.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        split = at.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a <> b and size > 2").select("key")
        return materialize(at.join(split, "key").select("key", "rep", "fame", "component"))

    for _ in range(HUB_ROUNDS):  # the most shared member of each bucket's second component against the others
        open_ = open_buckets(comp)
        lead = open_.groupBy("key").agg(F.max(order).getField("rep").alias("first"))
        led = open_.join(lead.join(comp.toDF("first", "fc"), "first", "left").select("key", F.coalesce("fc", "first").alias("fc")), "key")
        hub = led.where("component <> fc").groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("back"), "rep", "component")).alias("h"))
        hub = hub.select("key", F.col("h.rep").alias("hub"), F.col("h.component").alias("hc"))
        new = open_.join(hub, "key").where("component <> hc").select(*pair("rep", "hub"))
        new = materialize(new.distinct().join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(new)
        links = links.unionByName(_confirm(new, classes, texts, words, percent, fold))
        comp = materialize(components(links))
        tidy(docs.sparkSession)
    open_ = open_buckets(comp)
    crowds = open_.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CROWD).select("key")
    last = _uncrowded(open_.join(crowds, "key", "left_anti"), classes, texts, words, percent, fold)
    last = last.unionByName(_crowded(open_.join(crowds, "key", "left_semi"), texts, words, percent, fold))
    comp = materialize(components(links.unionByName(materialize(last))))
    tidy(docs.sparkSession)
    named = classes.select("set_key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    keyed = all_rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = keyed.join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    kept = cluster(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*own(docs)).unionByName(docs.where("doc_id is null"))
