"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(s(text) - t_k)): one weight vector shared by all grades over hashed text features, and
ordered thresholds t_0 < t_1 < ...  The expected grade and the tail probability P(grade >= cut) follow.  Features of a
text are the shares, among its byte trigrams, of each hashed trigram, and the share of words equal to the word before.

The fit uses at most ``sample_rows`` labelled rows, those with the smallest hash of their id, as far as they hold ``sample_cells`` features
(documented bounds, SAMPLE_ROWS and SAMPLE_CELLS by default); scoring is one pass over whole texts with the fixed-size weights.

Defined results: a null or empty text has no features, so its score is the intercept alone; rows without an id or rating are not
learnt from; an id rated twice is learnt at its lowest grade, an id on several rows is one example; texts of any length count whole; ratings of one grade only, or none, give that grade (or 0) to all with tail 1 (keep) for
want of evidence; extra columns pass through ``score`` untouched.  Ratings, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, materialize, own, session, set_aside, table
from .words import BLOCK, LOWER, U, hashed, texts_of

BITS, SAMPLE_ROWS, SAMPLE_CELLS, ROUNDS, RIDGE, SEED = 15, 4000, 8_000_000, 160, 1e-4, 11
KEEP_TAIL = 0.5
REPEATS = 1 << BITS  # the feature that follows the hashed trigrams
SCALE = np.float32(30.0)


def _trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    k = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (k * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _repeats(texts: list[bytes | None]) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    out = np.zeros(len(texts), np.float32)
    for first, (w,), off in hashed(texts, LOWER):
        same = np.zeros(len(w) + 1, np.int64)
        same[2:] = np.cumsum(w[1:] == w[:-1])
        for i in range(len(off) - 1):
            a, z = off[i], off[i + 1]
            if z - a > 1:
                out[first + i] = (same[z] - same[a + 1]) / (z - a)
    return out


def features(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows: indices and square roots of shares."""
    rows, rep = [], _repeats(texts)
    for t, r in zip(texts, rep):
        t = t or b""
        counts = np.zeros(1 << BITS, np.int64)
        for at in range(0, max(0, len(t) - 2), BLOCK):
            counts += np.bincount(_trigrams(t[at : at + BLOCK + 2]), minlength=1 << BITS)
        idx = np.flatnonzero(counts)
        val = counts[idx].astype(np.float32) / max(1, len(t) - 2)
        rows.append((np.append(idx, REPEATS).astype(np.int32), np.append(val * SCALE, r * 3).astype(np.float32)))
    return rows


@dataclass
class Ordinal:
    """weights: shared over grades; cuts: ordered thresholds; grades: the ratings in order."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k >= 1, a column each."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts[None, :], -60, 60)))

    def expected(self, s: np.ndarray) -> np.ndarray:
        steps = np.diff(self.grades)
        return self.grades[0] + self.tails(s) @ steps if len(steps) else np.full(len(s), float(self.grades[0]) if len(self.grades) else 0.0)

    def raw(self, texts: list[bytes | None]) -> np.ndarray:
        w, rep = self.weights, _repeats(texts)
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            total = 0.0
            if t and len(t) > 2:
                for at in range(0, len(t) - 2, BLOCK):
                    total += float(w[_trigrams(t[at : at + BLOCK + 2])].sum(dtype=np.float64))
                total *= float(SCALE) / (len(t) - 2)
            out[i] = total + float(w[REPEATS]) * 3 * rep[i]
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> Ordinal:
    """Maximum likelihood with a ridge penalty by Adam on all rows; balanced so that rare grades count."""
    grades, y = np.unique(np.asarray(ratings, float), return_inverse=True)
    w = np.zeros(REPEATS + 1)
    k = len(grades)
    if k < 2:
        return Ordinal(w, np.zeros(0), grades)
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows]).astype(float)
    begins = np.cumsum([0] + [len(r[0]) for r in rows])[:-1]
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.bincount(y, minlength=k) / len(y)
    per = (1 / share[y]) ** 0.5
    per /= per.sum()
    # thresholds: the first one free, then positive gaps exp(g)
    par = np.concatenate([w, [0.0], np.zeros(k - 2)])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, rounds + 1):
        w = par[: REPEATS + 1]
        cuts = np.cumsum(np.concatenate([[par[REPEATS + 1]], np.exp(par[REPEATS + 2 :])]))
        s = np.add.reduceat(w[idx] * val, begins)
        cum = np.concatenate([np.zeros((len(s), 1)), 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -40, 40))), np.ones((len(s), 1))], 1)
        p = np.maximum(cum[np.arange(len(s)), y + 1] - cum[np.arange(len(s)), y], 1e-12)
        d = cum * (1 - cum)
        hi, lo = d[np.arange(len(s)), y + 1], d[np.arange(len(s)), y]
        gs = per * (hi - lo) / p  # of the loss by s
        gcut = np.zeros(k - 1)
        np.add.at(gcut, np.minimum(y, k - 2), np.where(y < k - 1, -per * hi / p, 0))
        np.add.at(gcut, np.maximum(y - 1, 0), np.where(y > 0, per * lo / p, 0))
        back = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([np.bincount(idx, gs[row] * val, REPEATS + 1) + ridge * w, [back[0]], back[1:] * np.exp(par[REPEATS + 2 :])])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        par = par - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Ordinal(par[: REPEATS + 1], np.cumsum(np.concatenate([[par[REPEATS + 1]], np.exp(par[REPEATS + 2 :])])), grades)


def train(docs: DataFrame, ratings: DataFrame, rating: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_cells: int = SAMPLE_CELLS) -> Ordinal:
    """Fit on the texts of at most ``sample_rows`` rated ids, as far as they hold ``sample_cells`` features together."""
    session(docs.sparkSession)
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col(rating).isNotNull()).groupBy("doc_id").agg(F.min(F.col(rating).cast("double")).alias("y"))
    some = rated.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")  # sample_rows rows at most

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = features(texts_of(b.column(1)))
            cols = [pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["doc_id", "y", "n", "idx", "val"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = joined.mapInArrow(sparse, f"doc_id {kind}, y double, n long, idx binary, val binary")
    rows = materialize(rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct("n", "idx", "val")).alias("x")).select("doc_id", "y", "x.*"))  # an id on several rows is one example
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))  # sample_rows pairs of numbers
    within = rows.select("doc_id", "n").withColumn("upto", upto).where(F.col("upto") - F.col("n") <= sample_cells).select("doc_id")
    got = rows.join(within, "doc_id", "left_semi").collect()  # sample_cells numbers and one row more
    got.sort(key=lambda r: (r["y"], bytes(r["idx"]), bytes(r["val"])))
    return fit([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got], np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Ordinal, cut: float | None = None, text: str = "text", names: tuple[str, str, str] = ("expected_grade", "tail_prob", "keep")) -> DataFrame:
    """``docs`` with expected_grade, tail_prob = P(grade >= cut) (cut: the highest grade) and keep = tail_prob >= KEEP_TAIL.

    Input columns of these ``names`` come out under their name with underscores before it.
    """
    session(docs.sparkSession)
    k = len(model.cuts)
    at = (k - 1) if cut is None else int(np.searchsorted(model.grades[1:], cut))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = held.value
            s = m.raw(texts_of(b.column(b.schema.get_field_index(text))))
            tail = m.tails(s)[:, at] if 0 <= at < k else np.ones(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.expected(s)), pa.array(tail), pa.array(tail >= KEEP_TAIL)], [*b.schema.names, *names])

    docs = set_aside(docs, *names)
    kinds = [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds]))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_prob, keep for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "expected_grade", "tail_prob", "keep")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with the columns they came with."""
    names = tuple(free_name(docs, x) for x in ("grade", "tail", "stays"))
    return score(docs, train(docs, table(spark, sf_dir, "labels")), names=names).where(F.col(names[2])).select(*own(docs))
