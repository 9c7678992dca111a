"""Toxicity with noisy-channel deobfuscation.

Tokens that may be disguised (any with letters and a sign or separator, a letter three times in a row, single letters strung
out by spaces) become character lattices: each sign may stand for itself, for the letters it resembles, or for
nothing where it repeats or ends a token, each separator for itself or nothing.  Viterbi decoding under a character trigram model, counted over all documents,
picks the likeliest plain spelling, and the restored text is scored: a logistic model over whole words and word
beginnings that the labels single out.  Each pass works on whole texts.

The label model uses at most ``sample_rows`` labelled rows (a documented bound, default SAMPLE_ROWS, smallest id hashes
first); rows whose crc32(doc_id as text) mod 4 is 2 are held out.  labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts score as texts without any known sign (the intercept); rows without id are scored and count as not
held out, but are not learnt from; an id labelled twice is toxic if one label says so; an id on several rows is one example; texts of any
length are decoded and scored whole, in pieces cut at white space; extra columns are ignored; without labels, or with one
class only, the score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, materialize, session, table
from .words import BLOCK, LETTER, LOWER, SPACE, U, _cuts, mix, powers, prefix_sums, spans, texts_of

SAMPLE_ROWS, SEED, CUT = 8000, 7, 0.3
#: A sign counts as toxic from so many labelled documents, so many times the share in clean ones, and so many standard errors on.
LEAST_DOCS, LEAST_RATIO, LEAST_Z = 4, 6, 4.5
KINDS = 29
CLASS = np.zeros(256, np.int32)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27
#: Which letters a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in LEET]] = True
APART = np.zeros(256, bool)
APART[[ord(c) for c in ".-_*"]] = True
PREFIXES = (3, 4, 5, 6)
#: Log-probabilities of the channel: a letter as it is, a sign for a letter, a sign as it is, a dropped repeat, a dropped or kept separator or closing sign, a kept repeat.
ASIS, SWAP, SIGNED, DROP, GAP, REPEAT = -0.05, -1.0, -9.0, -0.2, -0.1, -3.0


def char_counts(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros(KINDS**3, np.int64)
    for t in texts:
        for at in range(0, len(t or b""), BLOCK):
            piece = t[max(0, at - 2) : at + BLOCK]
            c = CLASS[np.frombuffer((b"  " if at == 0 else b"") + piece + (b" " if at + BLOCK >= len(t) else b""), np.uint8)]
            out += np.bincount((c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:], minlength=KINDS**3)
    return out


class CharModel:
    """Trigram log-probabilities over letters, other letters and the boundary, backed off by interpolation."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        one = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * KINDS)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
        self.logs = np.log((c + 5 * two[None]) / (c.sum(2)[:, :, None] + 5)).tolist()
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        if (got := self.known.get(token)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[token] = self._decode(token)
        return got

    def _decode(self, token: str) -> str:
        """The likeliest plain spelling.  States: the last two classes; a state keeps its best path."""
        beam: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        tail = len(token.rstrip("".join(LEET) + ".-_*"))  # signs from here on end the token
        run = [0] * len(token)  # length of the run that each place stands in
        for i, o in enumerate(token):
            run[i] = run[i - 1] + 1 if i and token[i - 1] == o else 1
        for i in range(len(token) - 2, -1, -1):
            run[i] = max(run[i], run[i + 1]) if token[i] == token[i + 1] else run[i]
        for i, o in enumerate(token):
            arcs: list[tuple[str | None, float]] = []
            if o.isalpha():
                arcs.append((o, ASIS))
            elif o in LEET:
                arcs += [(x, SWAP) for x in LEET[o]] + [(o, SIGNED)]
                if i >= tail and (run[i] > 2 or not token[tail:].strip("!.-_*")):
                    arcs.append((None, GAP))
            elif o in " .-_*":
                arcs += [(None, GAP), (o, GAP)]
            else:
                arcs.append((o, SIGNED))
            then: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            for (a, b, last), (p, path) in beam.items():
                for c, cost in arcs:
                    if c is None:
                        options = [((a, b, last), p + cost, path)]
                    else:
                        k = 27 if ord(c) > 127 else int(CLASS[ord(c)])
                        again = c == last and run[i] > 2
                        price = GAP if c.isdigit() and last.isdigit() else cost  # a number is kept as one
                        options = [((b, k, c), p + price + self.logs[a][b][k] + (REPEAT if again else 0), (path, c))]
                        if again:
                            options.append(((a, b, last), p + DROP, path))
                    for state, q, way in options:
                        if state not in then or q > then[state][0]:
                            then[state] = (q, way)
            beam = then
        way = max(((p + self.logs[a][b][0], path) for (a, b, _), (p, path) in beam.items()), key=lambda x: x[0])[1]
        out = []
        while way:
            way, c = way
            out.append(c)
        return "".join(reversed(out))


def _shorten(token: str) -> str:
    """Runs of one sign cut to three: longer runs say no more."""
    out: list[str] = []
    for c in token:
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == c):
            out.append(c)
    return "".join(out)


def disguised(buf: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the buffer (lower case) to decode."""
    n = len(buf)
    if n < 3:
        return []
    letter, sign, apart = LETTER[buf], SIGN[buf], APART[buf]
    mark = np.zeros(n, bool)
    mark |= sign | apart
    mark[2:] |= (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & letter[2:] & (buf[2:] < 128)
    s, e = spans(buf)
    found: list[tuple[int, int]] = []
    if mark.any():
        before = np.concatenate([[0], np.cumsum(mark)])
        before_letter = np.concatenate([[0], np.cumsum(letter)])
        hit = (before[e] > before[s]) & (before_letter[e] - before_letter[s] >= 1)
        found += list(zip(s[hit].tolist(), e[hit].tolist()))
    single = (e - s == 1) & (letter[s] | sign[s])
    if single.any():
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if z - a >= 3 and letter[s[a:z]].any():
                found.append((int(s[a]), int(e[z - 1])))
    return sorted(found)


def restore(text: bytes | None, model: CharModel) -> bytes:
    """The text in lower case with disguised tokens spelt out."""
    whole = (text or b"").lower()
    out: list[bytes] = []
    for t in [whole] if len(whole) <= BLOCK else _cuts(whole, SPACE):
        at = 0
        for s, e in disguised(np.frombuffer(t, np.uint8)):
            if s < at:
                continue
            token = t[s:e].decode("utf-8", "replace")
            core = token.strip(".,;:?\"'()-*_ ")
            out += [t[at:s], token.replace(core, model.restore(_shorten(core)), 1).encode() if core else t[s:e]]
            at = e
        out.append(t[at:])
    return b"".join(out)


def signs(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's words and word beginnings."""
    out = []
    gap = ~LETTER
    for t in [text] if len(text) <= BLOCK else _cuts(text, gap):
        buf = np.frombuffer(t, np.uint8)
        s, e = spans(buf, gap)
        if not len(s):
            continue
        h = prefix_sums(buf, LOWER, 0)
        down = powers(len(h), 0)[1]
        out.append(mix((h[e] - h[s]) * down[s]) ^ U(0x5851F42D4C957F2D))
        for k in PREFIXES:
            a = s[e - s >= k]
            out.append(mix((h[a + k] - h[a]) * down[a]) + U(k))
    return np.unique(np.concatenate(out)) if out else np.empty(0, U)


@dataclass
class Toxic:
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, U))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = 0.0
    gate: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))

    def known(self, text: bytes) -> np.ndarray:
        """Indices of the model's signs in a restored text; a bit table turns most hashes away."""
        found = []
        gap = ~LETTER
        for t in [text] if len(text) <= BLOCK else _cuts(text, gap):
            buf = np.frombuffer(t, np.uint8)
            s, e = spans(buf, gap)
            if not len(s) or not len(self.hashes):
                continue
            h = prefix_sums(buf, LOWER, 0)
            down = powers(len(h), 0)[1]
            for x in [mix((h[e] - h[s]) * down[s]) ^ U(0x5851F42D4C957F2D)] + [mix((h[a + k] - h[a]) * down[a]) + U(k) for k in PREFIXES for a in (s[e - s >= k],)]:
                x = x[self.gate[x >> U(48)]]
                at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
                found.append(at[self.hashes[at] == x])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def score(self, text: bytes) -> float:
        z = self.intercept + float(self.weights[self.known(text)].sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, hashes: np.ndarray, rounds: int = 300) -> Toxic:
    """Weigh the picked signs (``rows``: each text's places in ``hashes``) by penalised logistic regression."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    base = math.log((n1 + 0.5) / (n0 + 0.5)) if len(rows) else -20.0
    if not n1 or not n0:
        return Toxic(intercept=base)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, y = np.zeros(len(hashes)), base, toxic.astype(float)
    m, v = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    for t in range(1, rounds + 1):
        s = b + np.bincount(row, w[col], len(rows))
        d = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
        g = np.append(np.bincount(col, d[row], len(hashes)) + 0.02 * w, d.sum()) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    gate = np.zeros(1 << 16, bool)
    gate[hashes >> U(48)] = True
    return Toxic(hashes, w, float(b), gate)


def char_model(docs: DataFrame) -> CharModel:
    """Trigram counts over all texts: each task sums its own, a shuffle adds the KINDS**3 cells."""
    session(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, np.int64)
        for b in batches:
            total += char_counts(texts_of(b.column(0)))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # KINDS**3 rows at most
    out = np.zeros(KINDS**3, np.int64)
    for r in cells:
        out[r["cell"]] = r["n"]
    return CharModel(out)


def train(docs: DataFrame, labels: DataFrame, chars: CharModel, sample_rows: int = SAMPLE_ROWS, least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO, least_z: float = LEAST_Z) -> Toxic:
    """Fit on at most ``sample_rows`` labelled ids.  Signs are counted by class in Spark; all that pass the test of ``least_docs``, ``least_ratio`` and ``least_z`` are used, and the driver sees these and their places."""
    session(docs.sparkSession)
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = marked.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_rows)
    held = docs.sparkSession.sparkContext.broadcast(chars)  # KINDS**3 numbers

    def signs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signs(restore(t, held.value)).view(np.int64) for t in texts_of(b.column(1))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], ["doc_id", "y", "signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")  # sample_rows rows at most
    seen = joined.mapInArrow(signs_of, f"doc_id {kind}, y int, signs array<long>")
    seen = materialize(seen.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("signs").alias("signs")))  # an id on several rows is one example
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return fit([np.empty(0, int)] * (n1 + n0), np.repeat([1, 0], [n1, n0]), np.empty(0, U))
    by = seen.select("y", F.explode("signs").alias("sign")).groupBy("sign").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).where(F.col("bad") >= least_docs)
    share = (F.col("bad") + 0.5) / (n1 + 1) / ((F.col("good") + 0.5) / (n0 + 1))
    z = (F.col("bad") / n1 - F.col("good") / n0) / F.sqrt((F.col("bad") + F.col("good") + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    top = by.withColumn("z", z).where((share > least_ratio) & (F.col("z") > least_z)).select("sign").collect()
    hashes = np.sort(np.array([r["sign"] for r in top], np.int64).view(U))
    picked = docs.sparkSession.sparkContext.broadcast(hashes)

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(1).to_pylist():
                x = np.array(x, np.int64).view(U)
                at = np.minimum(np.searchsorted(picked.value, x), max(0, len(picked.value) - 1))
                found.append(at[picked.value[at] == x].tolist() if len(picked.value) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "at"])

    rows = seen.select("y", "signs").mapInArrow(places_of, "y int, at array<int>").collect()  # sample_rows rows of a few places
    rows.sort(key=lambda r: (r["y"], r["at"]))
    return fit([np.array(r["at"], int) for r in rows], np.array([r["y"] for r in rows], int), hashes)


def score(docs: DataFrame, model: Toxic, chars: CharModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    session(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model, chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, c = held.value
            p = np.array([m.score(restore(t, c)) for t in texts_of(b.column(1))], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars = char_model(docs)
    return score(docs, train(docs, table(spark, sf_dir, "labels"), chars), chars)
