"""Importance resampling towards a target: documents drawn as if from the distribution of another table's n-grams.

Features are the runs of one and two words, hashed into buckets.  A bucket's gain is the log ratio of its smoothed share in the
target to its share in the documents; a document's weight is the mean gain of its features, so length does not count.  Adding Gumbel
noise to the weights and keeping the highest draws without replacement in proportion to exp(weight).

Identical texts are grouped by their full text first: features are taken once for each distinct text, counts are multiplied by how many
rows have it, and weights join back by the text's digest before each row gets noise of its own.  Counts are summed to ``buckets`` numbers in
each task before the shuffle.  Texts that more than a thousandth of all rows share are at most a thousand and are joined by broadcast, so no
group of copies meets in one task.  Ranks need no sort in one place: scores are whole numbers in a range that the noise's 32 bits and the logarithms bound
(some 100,000 values), so a histogram of them gives each score's first rank, and rows of one score are numbered by doc_id among themselves.

Defined results: null and blank texts have no features and weight 0; without ``least_words`` words a row is never drawn; an empty table gives an empty one and
an empty target smooths to equal counts; rows without doc_id are scored with an empty id and, among equal scores, come first; rows
that share an id share their noise and each count; texts of any length are read whole, in pieces cut between words; extra columns are ignored by
``draw`` and kept by ``drawn``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, materialize, own, session, table
from .words import BLOCK, LOWER, _cuts, spans, texts_of

BUCKETS, SEED, LEAST_WORDS, SHARE, HOT = 10_000, 7, 20, (25, 100), 1000
LONG_WORD = 48
#: Bytes outside words, once A-Z are lower-cased.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
TABLE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
TABLE ^= TABLE[0]


def advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after each has read the bytes from its start to its end: one byte of all spans at a time, longest spans first."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG_WORD).astype(np.int16), kind="stable")
    held, at, sizes = state[order], starts[order], size[order]
    active = len(order) - np.searchsorted(np.minimum(sizes, LONG_WORD)[::-1], np.arange(LONG_WORD), "right")
    for j in range(LONG_WORD):
        m = int(active[j])
        if not m:
            break
        held[:m] = TABLE[(held[:m] ^ buf[at[:m] + j]) & 255] ^ (held[:m] >> np.uint32(8))
    for i in np.flatnonzero(sizes > LONG_WORD):
        rest = buf[at[i] + LONG_WORD : at[i] + sizes[i]].tobytes()
        held[i] = zlib.crc32(rest, int(held[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = held
    return out


def _block(some: list[bytes], carried: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of every feature of the texts, the text each belongs to, words of each text).  ``carried``: the first word is the last of the piece before and counts in a pair only."""
    buf = LOWER[np.frombuffer(b"\n".join(some), np.uint8)]
    s, e = spans(buf, GAP)
    begins = np.cumsum([0] + [len(t) + 1 for t in some])
    text = np.searchsorted(begins, s, "right") - 1
    one = advance(np.full(len(s), 0xFFFFFFFF, np.uint32), buf, s, e)
    pair = text[1:] == text[:-1]
    left = one[:-1][pair]
    left = TABLE[(left ^ np.uint32(32)) & 255] ^ (left >> np.uint32(8))
    two = advance(left, buf, s[1:][pair], e[1:][pair])
    skip = 1 if carried else 0
    crc = np.concatenate([one[skip:], two]) ^ np.uint32(0xFFFFFFFF)
    n = np.bincount(text, minlength=len(some))
    n[:1] -= skip
    return crc, np.concatenate([text[skip:], text[:-1][pair]]), n


def features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, index of its text, words by text), in blocks of bounded size; a long text comes in several."""
    i = 0
    while i < len(texts):
        if len(texts[i] or b"") > BLOCK:
            last = b""
            for piece in _cuts(texts[i], GAP):
                crc, text, n = _block([last + b" " + piece], bool(last))
                words = np.zeros(len(texts), np.int64)
                words[i] = n[0]
                yield (crc % buckets).astype(np.int64), text + i, words
                s, e = spans(np.frombuffer(piece, np.uint8), GAP)
                if len(s):
                    last = piece[s[-1] : e[-1]]
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j] or b"") <= BLOCK:
            size += len(texts[j] or b"") + 1
            j += 1
        j = max(j, i + 1)
        crc, text, n = _block([t or b"" for t in texts[i:j]])
        words = np.zeros(len(texts), np.int64)
        words[i:j] = n
        yield (crc % buckets).astype(np.int64), text + i, words
        i = j


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def collapse(docs: DataFrame) -> DataFrame:
    """text, n (rows that have it), key (its digest): one row for each distinct text, null counted as empty."""
    return docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n")).withColumn("key", key_of(F.col("text")))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``texts`` (text, n) by bucket, each text counted n times.

    A task sends its sums as a square, a row for each ``side`` buckets in a row, so that the shuffle holds as many rows a task as the square root of ``buckets``, and the driver gets one square.
    """
    side = math.isqrt(buckets - 1) + 1
    names = [f"c{j}" for j in range(side)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for b in batches:
            copies = b.column(1).to_numpy().astype(np.float64)
            for ids, text, _ in features(texts_of(b.column(0)), buckets):
                total += np.bincount(ids, copies[text], len(total)).astype(np.int64)
        square = total.reshape(side, side)
        at = np.flatnonzero(square.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(square[at, j])) for j in range(side)]], ["line", *names])

    lines = texts.select("text", "n").mapInArrow(run, "line long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((side, side), np.int64)
    for r in lines.groupBy("line").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r.line] = r[1:]
    return out.reshape(-1)[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """A whole number of thousandths for each bucket: floor(1000 ln of the smoothed target share over the smoothed source share)."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n))
    return [math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())]


def weights(texts: DataFrame, gain: list[int]) -> DataFrame:
    """key, n, n_words, n_features, weight for each row of ``texts``."""
    by = np.array(gain, np.float64)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for ids, text, more in features(texts_of(b.column(0)), buckets):
                words += more
                n += np.bincount(text, minlength=b.num_rows)
                total += np.bincount(text, by[ids], b.num_rows).astype(np.int64)
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *map(pa.array, (words, n, mean))], ["key", "n", "n_words", "n_features", "weight"])

    return texts.select("text", "key", "n").mapInArrow(run, "key binary, n long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """doc_id (and ``carry``) with n_words, n_features, weight for every row of ``docs``."""
    session(docs.sparkSession)
    texts = materialize(collapse(docs), "zstd")
    gain = gains(bucket_counts(texts, buckets), bucket_counts(collapse(target), buckets))
    known = materialize(weights(texts, gain))
    slim = docs.select(*(carry or ["doc_id"]), key_of(F.col("text")).alias("key"))
    total = known.agg(F.sum("n")).collect()[0][0] or 0
    many = F.broadcast(known.where(F.col("n") > total / HOT))  # at most HOT texts
    slim = materialize(slim)
    out = ["n_words", "n_features", "weight"]
    hot = slim.join(many.select("key", *out), "key")
    cold = slim.join(many.select("key"), "key", "left_anti").join(known.where(F.col("n") <= total / HOT).select("key", *out), "key")
    return hot.unionByName(cold).drop("key")


def ranked(scored: DataFrame, share: tuple[int, int] = SHARE, ties: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... for the highest ``share`` of the rows whose ``may`` is true, null for the others; ``may`` goes."""
    may = scored.where("may")
    counts = may.groupBy("score").agg(F.count("*").alias("n"))  # as many rows as scores differ: bounded
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = counts.withColumns({"before": F.sum("n").over(down) - F.col("n"), "drawn": F.expr(f"sum(n) over () * {share[0]} div {share[1]}")}).where("before < drawn")
    base = materialize(base.select("score", "before", "drawn"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first(ties)))
    over = may.join(F.broadcast(base), "score").withColumn("rank", F.col("before") + place)
    over = over.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).select(*scored.columns, "rank")
    lost = may.join(F.broadcast(base.select("score")), "score", "left_anti").unionByName(scored.where("not may"))
    return over.unionByName(lost.withColumn("rank", F.lit(None).cast("long"))).drop("may")


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``: rank is null where the row is not drawn."""
    scored = weigh(docs, target, buckets).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "may": F.col("n_words") >= least_words})
    return ranked(materialize(scored.select("doc_id", "n_features", "weight", "score", "may")), share)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``draw`` chooses, with all their columns, in no order.  Rows are told apart by a number of their own, so ids may repeat."""
    buckets, share, least, seed = (options.pop(k, v) for k, v in (("buckets", BUCKETS), ("share", SHARE), ("least_words", LEAST_WORDS), ("seed", SEED)))
    if options:
        raise TypeError(f"unknown options: {sorted(options)}")
    row = free_name(docs, "row")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    scored = weigh(kept, target, buckets, ["doc_id", row]).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "may": F.col("n_words") >= least})
    won = ranked(materialize(scored), share).where("rank is not null").select(row)
    return kept.join(won, row, "left_semi").select(*own(docs))


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
