"""Uniform sharding by an exactly drawn communication matrix.

Rows lie in blocks (input partitions, folded to at most ``blocks``).  The driver draws how many rows of each block go to
each shard: a matrix with the blocks' sizes as row sums and the shards' sizes as column sums, from the multivariate
hypergeometric law that a uniform permutation of all rows would give.  Each block is then permuted locally and cut by
its row of the matrix, rows are exchanged, and each shard is permuted again.  Every assignment of rows to places is
equally likely, and the shards' sizes are exact, at most one row apart.

Defined results: nulls, equal rows and repeated ids are rows like any other (places never depend on content, so no key
can be hot); texts of any length are rows like any other; an empty table gives an empty table; columns that clash with helpers keep
their names and values, and an input column named ``shard`` or ``slot`` comes out under its name with underscores before it.
Only DataFrame functions touch rows.  The driver sees blocks x shards counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, literal_table, materialize, session, set_aside, table

SHARDS, BLOCKS, PARTS, WINDOW, SEED = 24, (1024, 16_384), 256, 1 << 19, 20_240_917
SMALL = 200_000  # rows of three numbers that are broadcast


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` of good + bad balls are good, by inversion on the support around the mode; any size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    p = good / total
    reach = 30 + int(12 * math.sqrt(drawn * p * (1 - p) * (total - drawn) / max(1, total - 1) + 1))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=float)
    step = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.exp(logs - logs.max())
    return low + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right").clip(0, high - low))


def communication_matrix(sizes: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Counts[block, shard] with the given row and column sums."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(capacities)
    out = np.zeros((len(sizes), len(left)), np.int64)
    for b, n in enumerate(sizes):
        rest = sum(left)
        for s in range(len(left)):
            rest -= left[s]
            x = hypergeometric(rng, left[s], rest, n)
            out[b, s] = x
            left[s] -= x
            n -= x
    return out


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, blocks: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (place in the shard, from 0, without gaps).

    ``blocks`` and ``parts`` follow the number of rows: WINDOW rows or so are sorted at once, in BLOCKS[0] to BLOCKS[1] blocks and PARTS parts of a shard or more.
    """
    spark = session(df.sparkSession)
    df = set_aside(df, "shard", "slot")
    pos, block, rank, part, base, b_, cuts_, s_, p_ = (free_name(df, x) for x in ("pos", "block", "rank", "part", "base", "b", "cuts", "s", "p"))
    placed = materialize(df.withColumn(pos, F.monotonically_increasing_id()))  # places are drawn once: a recomputed task finds the same ones
    whole = placed.count()
    blocks = blocks or min(BLOCKS[1], max(BLOCKS[0], whole // WINDOW))
    parts = parts or max(PARTS, whole // shards // WINDOW)
    placed = placed.withColumn(block, F.pmod(F.shiftrightunsigned(pos, 33), F.lit(blocks)).cast("int"))  # the input partition, folded
    counts = sorted((r[0], r[1]) for r in placed.groupBy(block).agg(F.count("*")).collect())  # at most ``blocks`` rows
    total = sum(n for _, n in counts)
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = communication_matrix([n for _, n in counts], capacities, seed).cumsum(1)
    cuts = literal_table(spark, [{"b": b, "cuts": drawn[i].tolist()} for i, (b, _) in enumerate(counts)], "b int, cuts array<long>").toDF(b_, cuts_)
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.col(pos), F.lit(seed)), pos)
    dealt = (
        placed.withColumn(rank, F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), F.col(block) == F.col(b_))  # blocks x shards numbers at most
        .withColumn("shard", F.expr(f"cast(size(filter(`{cuts_}`, c -> c <= `{rank}`)) as int)"))
        .withColumn(part, F.pmod(F.xxhash64(F.col(pos), F.lit(seed + 1)), F.lit(parts)).cast("int"))
        .drop(b_, cuts_, block, rank)
    )
    dealt = materialize(dealt)
    before = dealt.groupBy(F.col("shard").alias(s_), F.col(part).alias(p_)).agg(F.count("*").alias(base))
    before = before.withColumn(base, F.sum(base).over(Window.partitionBy(s_).orderBy(p_)) - F.col(base))
    inside = Window.partitionBy("shard", part).orderBy(F.xxhash64(F.col(pos), F.lit(seed + 2)), pos)
    return (
        dealt.withColumn("slot", F.row_number().over(inside) - 1)
        .join(before if shards * parts > SMALL else F.broadcast(before), (F.col("shard") == F.col(s_)) & (F.col(part) == F.col(p_)))  # SMALL rows at most, or a shuffle
        .withColumn("slot", (F.col("slot") + F.col(base)).cast("long"))
        .drop(s_, p_, base, part, pos)
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
