"""Approximate nearest neighbours: multiprobe hashing with p-stable projections.

A table cuts Gaussian projections into slots of equal width; a vector's bucket is its slots.  A query visits the buckets
around its own in the order of estimated success (the sum of squared distances from its projections to the slots'
bounds), in every table, as far as a fitted bound of that sum.  Largest inner products become smallest distances by one
more coordinate that gives all rows the same norm.  The candidates of the tables are merged and ranked by their inner
products in double precision.

Functions and tables follow the number of rows (``shape``: a bucket holds a few hundred rows, whatever their number);
width and bound are fitted on a bounded sample (SAMPLE queries, SAMPLE_ROWS rows): of the widths that find TARGET of the
sample's true neighbours among all rows, the one that scores the fewest rows.

All rows are indexed.  Buckets are cut into cells of about CELL rows, cells are dealt into parts of about PART rows, and
queries into groups of about GROUP; a part meets a group in one task, which returns the best k of each query.  So a bucket that
holds a third of all rows is many cells in many parts, and no pair of vectors becomes a row but the best of a part.  Queries whose
buckets give fewer than k of the candidates there are meet all rows; so do all queries if no width finds TARGET.

Defined results: vectors that are null, zero, hold nulls or non-finite numbers, or have another length than most, take no part;
rows without vec_id neither; a vec_id that comes twice counts once, with its smallest vector; fewer candidates than k give all of them; ties
go to the smaller vec_id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, session, table

K, CELL, PART, GROUP, SAMPLE, SAMPLE_ROWS, TARGET, SEED = 20, 512, 8192, 4096, 64, 4096, 0.94, 3
WIDTHS, PROBES = (1.0, 1.4, 2.0, 2.8), 4096
VISIT = 48  # what a visit to a bucket costs, in rows scored


def shape(rows: int) -> tuple[int, int]:
    """(functions, tables) for a number of rows."""
    functions = min(16, max(2, round(math.log2(max(rows, 2)) / 2 - 1.5)))
    return functions, max(2, functions // 3)


@cache
def steps(functions: int, most: int = PROBES) -> np.ndarray:
    """Perturbations as rows of ranks of bounds, likeliest first: bit j says that the slot's j-th nearest bound is crossed.

    A query has 2 x functions bounds; sets of them are drawn best first by the bounds' expected squared distances.  The j-th nearest bound and the
    j-th farthest belong to one function, so that a set never holds both.
    """
    m = 2 * functions
    z = np.array([j * (j + 1) / (4 * (functions + 1) * (functions + 2)) if j <= functions else 1 - (m + 1 - j) / (functions + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (functions + 1) * (functions + 2)) for j in range(1, m + 1)])
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < most:
        cost, s = heapq.heappop(heap)
        if not any(m - 1 - j in s for j in s):
            out.append(s)
        if s[-1] + 1 < m:
            heapq.heappush(heap, (cost - z[s[-1]] + z[s[-1] + 1], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (cost + z[s[-1] + 1], (*s, s[-1] + 1)))
    rows = np.zeros((len(out), m), np.int8)
    for i, s in enumerate(out):
        rows[i, list(s)] = 1
    return rows


class Hashes:
    """tables x functions projections of vectors scaled to norm 1 in dim + 1 coordinates, in slots of ``width``."""

    def __init__(self, dim: int, top: float, functions: int, tables: int, width: float, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.functions, self.tables, self.width, self.top = functions, tables, width, top
        self.a = rng.standard_normal((tables * functions, dim + 1))
        self.b = rng.random(tables * functions) * width
        self.bound = math.inf

    def places(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections in slots: (rows, tables, functions)."""
        n = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            y = np.concatenate([x / np.maximum(n, 1e-300), np.zeros((len(x), 1))], 1)
        else:
            y = np.concatenate([x, np.sqrt(np.maximum(self.top**2 - n**2, 0))], 1) / self.top
        return ((np.einsum("nd,kd->nk", y, self.a) + self.b) / self.width).reshape(len(x), self.tables, self.functions)

    @staticmethod
    def keys(slots: np.ndarray) -> np.ndarray:
        """Slots (..., functions) as one number."""
        out = np.zeros(slots.shape[:-1], np.uint64)
        for i in range(slots.shape[-1]):
            out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers (rows, tables)."""
        return self.keys(np.floor(self.places(x)))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers and costs (rows, tables, probes), likeliest first."""
        p = self.places(x, True)
        slot = np.floor(p)
        part = p - slot
        gaps = np.concatenate([part, 1 - part], -1)  # to the slot below, above
        order = np.argsort(gaps, -1, kind="stable")
        sets = steps(self.functions).astype(float)
        cost = np.take_along_axis(gaps, order, -1) ** 2 @ sets.T
        moves = np.zeros((*p.shape, len(sets)))
        for j in range(2 * self.functions):  # the bound that is j-th nearest moves its own function
            bound = order[..., j]
            where = np.arange(self.functions) == (bound % self.functions)[..., None]
            sign = np.where(bound < self.functions, -1.0, 1.0)[..., None]
            moves += (where * sign)[..., None] * sets[:, j]
        keys = self.keys(np.moveaxis(slot[..., None] + moves, -2, -1))
        by = np.argsort(cost, -1, kind="stable")
        return np.take_along_axis(keys, by, -1), np.take_along_axis(cost, by, -1)


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float]:
    """(vec_id, v (binary, original precision)) of the rows that take part, their length and largest norm."""
    e = F.col("embedding")
    fine = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    fine = fine.where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))
    fine = fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    by = fine.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("top"))
    most = by.orderBy(F.desc("n"), "d").limit(1).collect()
    if not most:
        return fine, 0, 0.0
    return fine.where(F.size("embedding") == most[0]["d"]), most[0]["d"], most[0]["top"]


def nearest(q_ids, q, cells_of, ids, x, cells, k: int, tables: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): the best k of the rows in each query's cells (None: all rows).  Rows are ordered by cell.

    Blocks of products choose; the chosen are scored again one by one, so that equal vectors have equal scores wherever they stand.
    """
    begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    own = cells[begins]
    ends = np.append(begins[1:], len(cells))
    by_id = np.argsort(ids, kind="stable")
    for c in range(0, len(q_ids), 256):
        some = q[c : c + 256]
        s = np.full((len(some), len(ids)), -np.inf)
        if cells_of is None:
            s[:] = some @ x.T
        else:
            visits = np.zeros((len(some), len(own)), bool)
            for i, mine in enumerate(cells_of[c : c + 256]):
                visits[i, np.searchsorted(own, mine)] = True
            for j in np.flatnonzero(visits.any(0)):
                who = np.flatnonzero(visits[:, j])
                s[who, begins[j] : ends[j]] = some[who] @ x[begins[j] : ends[j]].T
        for i, qi in enumerate(q_ids[c : c + 256]):
            row = s[i]
            row[by_id[np.searchsorted(ids[by_id], qi) : np.searchsorted(ids[by_id], qi, side="right")]] = -np.inf
            many = k * tables  # a row may come once for each table
            least = np.partition(row, len(row) - many)[len(row) - many] if len(row) > many else -np.inf
            keep = np.flatnonzero((row >= least - 1e-9) & (row > -np.inf))
            found, first = np.unique(ids[keep], return_index=True)
            exact = np.einsum("nd,d->n", x[keep[first]], some[i])
            best = np.lexsort((found, -exact))[:k]
            if len(best):
                yield int(qi), found[best], exact[best]


def search(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose vec_id is divisible by ``every``."""
    spark = session(vectors.sparkSession)
    rows, dim, top = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    np_kind = np.float32 if kind == "float" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np_kind).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, dim), np_kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    packed = materialize(rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "vec_id long, v binary"))
    queries = packed.where(F.col("vec_id") % every == 0)
    n = packed.count()
    hashes = fit(packed, queries, n, dim, top, np_kind, k)["hashes"]
    parts = lambda many: max(1, -(-many // PART))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            ids, cells = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            order = np.lexsort((ids, cells))
            x = _matrix(left.column("v"), np_kind)[order]
            asked = None
            if "cells" in right.column_names:
                asked = [np.array(c, np.int64) for c in right.column("cells").to_pylist()]
            for qi, found, scores in nearest(right.column("query_id").to_numpy(), _matrix(right.column("q"), np_kind), asked, ids[order], x, cells[order], k, hashes.tables if asked else 1):
                out_q.append(np.full(len(found), qi))
                out_i.append(found)
                out_s.append(scores)
        join = lambda a, t: pa.array(np.concatenate(a) if a else [], t)
        return pa.table([join(out_q, pa.int64()), join(out_i, pa.int64()), join(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    def merge(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The best k of every query: each part's best are distinct rows, so the last step is a plain top-k by query."""
        part = rows.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(meet, "query_id long, vec_id long, score double")
        once = part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    def scan(queries: DataFrame, many: int) -> DataFrame:
        """The queries against all rows: each part of rows meets each group of queries once."""
        groups = max(1, -(-many // GROUP))
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        rows = packed.withColumn("part", deal("vec_id", parts(n))).withColumn("cell", F.col("part").cast("long")).withColumn("group", each(groups))
        asked = queries.withColumn("group", deal("vec_id", groups)).withColumn("part", each(parts(n)))
        return merge(rows, asked.withColumnsRenamed({"vec_id": "query_id", "v": "q"}))

    if hashes is None:
        return scan(queries, queries.count()).select("query_id", "rank", "vec_id", "score")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = hashes.index(_matrix(b.column(1), np_kind))
                t = np.tile(np.arange(hashes.tables, dtype=np.int32), b.num_rows)
                pick = pa.array(np.repeat(np.arange(b.num_rows), hashes.tables))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(keys.ravel()), b.column(0).take(pick), b.column(1).take(pick)], ["t", "bucket", "vec_id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                ids, v = b.column(0)[i : i + 16], b.column(1)[i : i + 16]
                keys, cost = hashes.probes(_matrix(v, np_kind))
                at, t, p = np.nonzero(cost <= hashes.bound)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(keys[at, t, p]), ids.take(pa.array(at))], ["t", "bucket", "query_id"])

    indexed = materialize(packed.mapInArrow(index, "t int, bucket long, vec_id long, v binary"))
    sizes = indexed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    many, n_queries = parts(n * hashes.tables), queries.count()
    groups = max(1, -(-n_queries // GROUP))
    cell = F.xxhash64("t", "bucket", "block")  # two cells of one number are visited together, no more
    cut = indexed.join(sizes, ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    cut = cut.select(cell.alias("cell"), "vec_id", "v").withColumn("part", deal("cell", many))
    visits = queries.mapInArrow(visit, "t int, bucket long, query_id long").join(sizes, ["t", "bucket"])
    visits = visits.select("query_id", "t", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("query_id", cell.alias("cell"))
    visits = visits.withColumn("group", deal("query_id", groups))
    if groups > 1:
        visits = materialize(visits)
        cut = cut.join(visits.select("cell", (F.col("group") + 0).alias("group")).distinct(), "cell")  # a cell goes to the groups that visit it, and to no other
    else:
        cut = cut.withColumn("group", F.lit(0))
    asked = visits.groupBy("query_id", "group", deal("cell", many).alias("part")).agg(F.collect_set("cell").alias("cells"))
    asked = asked.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    merged = materialize(merge(cut, asked))
    full = merged.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = materialize(queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if lacking := short.count() if n > 1 else 0:
        merged = merged.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(scan(short, lacking))
    return merged.select("query_id", "rank", "vec_id", "score")


def exact(packed: DataFrame, q_ids: np.ndarray, q: np.ndarray, np_kind, k: int) -> dict[int, list[tuple[float, int, bytes]]]:
    """True neighbours of a few queries among all rows: each task returns its best k for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in q_ids]
        for b in batches:
            if not b.num_rows:
                continue
            ids, raw = b.column(0).to_numpy(), b.column(1)
            x = _matrix(raw, np_kind)
            for i, (_, found, scores) in enumerate(nearest(q_ids, q, None, ids, x, np.zeros(len(ids), np.int64), k, 1)):
                at = {int(v): j for j, v in enumerate(ids)}
                best[i] = sorted([*best[i], *((-s, int(v), raw[at[int(v)]].as_py()) for v, s in zip(found, scores))])[:k]
        flat = [(i, *x) for i, rows in enumerate(best) for x in rows]
        cols = list(zip(*flat)) if flat else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["i", "s", "vec_id", "v"])

    found = packed.mapInArrow(run, "i int, s double, vec_id long, v binary")
    top = Window.partitionBy("i").orderBy("s", "vec_id")
    rows = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).collect()  # SAMPLE x k rows
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["place"])):
        out.setdefault(int(q_ids[r["i"]]), []).append((r["s"], r["vec_id"], bytes(r["v"])))
    return out


def fit(packed: DataFrame, queries: DataFrame, n: int, dim: int, top: float, np_kind, k: int, sample: int = SAMPLE, target: float = TARGET) -> dict:
    """hashes (None: no width finds ``target`` of the sample's neighbours; scan), and on the sample recall, share of all rows scored and buckets visited."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some or n < 2:
        return {"hashes": None, "recall": 1.0, "share": 1.0, "buckets": 0}
    of = lambda rows: np.stack([np.frombuffer(r, np_kind).astype(float) for r in rows])
    q_ids, q = np.array([r["vec_id"] for r in some]), of([r["v"] for r in some])
    truth = exact(packed, q_ids, q, np_kind, k)
    others = of([r["v"] for r in packed.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).collect()])
    tried = []
    for width in WIDTHS:
        h = Hashes(dim, top, *shape(n), width)
        keys, cost = h.probes(q)
        seen = h.index(others)

        def costs(at: np.ndarray, i: int, keys=keys, cost=cost) -> np.ndarray:
            """Of rows in buckets ``at`` (rows, tables): the least cost at which query i meets each, and each table's."""
            out = np.full(at.shape, np.inf)
            for t in range(at.shape[1]):
                order = np.argsort(keys[i, t], kind="stable")
                place = np.searchsorted(keys[i, t], at[:, t], sorter=order).clip(0, len(order) - 1)
                hit = keys[i, t][order[place]] == at[:, t]
                out[hit, t] = cost[i, t][order[place]][hit]
            return out

        near = [costs(h.index(of([x[2] for x in truth[int(qi)]])), i).min(1) for i, qi in enumerate(q_ids) if int(qi) in truth]
        near = np.concatenate(near) if near else np.zeros(1)
        bound = float(np.quantile(near, target, method="higher"))
        if bound == math.inf:
            continue
        h.bound = bound * (1 + 1e-12) + 1e-12
        share = float(np.mean([(costs(seen, i) <= h.bound).mean(0).sum() for i in range(len(q))]))  # a row in two tables is scored twice
        occupied = [set(np.unique(seen[:, t]).tolist()) for t in range(h.tables)]
        buckets = float(np.mean([sum(sum(x in occupied[t] for x in keys[i, t][cost[i, t] <= h.bound].tolist()) for t in range(h.tables)) for i in range(len(q))]))
        tried.append((share * n + VISIT * buckets, {"hashes": h, "recall": float((near <= h.bound).mean()), "share": share, "buckets": buckets}))
    if not tried:
        return {"hashes": None, "recall": 1.0, "share": 1.0, "buckets": 0}
    return min(tried, key=lambda x: x[0])[1]


def op8_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=20)
