"""Repeated windows of words, found with a count-min prefilter and removed.

A window is ``window`` consecutive words of one text.  Each word that lies in a window whose words also start in a
document with a smaller id is removed; windows are judged on the input.

First pass: a count-min sketch of the windows, as a table of (row, column, count).  A window's address in a row is the hash
of the smallest hash among its word 8-grams: a function of its words alone, so equal windows share addresses and a
count can only be too large, and neighbouring windows mostly share one, so that a document adds one to few columns.
Partition sketches are summed before and after the shuffle; the width follows the number of entries.
Second pass: only windows whose estimate (the least of the rows) says that another document has them are hashed exactly
(96 bits of two independent word hashes) and grouped.  No repeated window is lost, whatever the sketch collides.

Skew: texts with equal words form a class first, and only the one with the smallest id takes part; the others are
removed whole.  Counting is summed map-side; the joins that follow are plain equi-joins that adaptive execution can split.

Defined results: null and blank texts have no words (the digest of the empty string); texts shorter than a window lose nothing;
rows without doc_id lose nothing and remove nothing; rows that share an id never remove each other's words; ids are
whole numbers; texts of any length are judged whole, cut only at white space while they are hashed; extra
columns are ignored, and ``stage`` passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize, own, session, table
from .words import U, hashed, mix, rolled, texts_of, window_sums

WINDOW, GRAM, ROWS, ROOM, RANGE, HOT = 50, 8, 2, 8, 250_000, 1000
EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each k consecutive values, by doubling."""
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if k > span else x


def addresses(w: np.ndarray, window: int, gram: int = GRAM) -> np.ndarray:
    """For each window its smallest gram hash."""
    return sliding_min(rolled(w, gram), window - gram + 1) if len(w) >= window else np.empty(0, U)


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, whole (digest of the words), runs of windows with one address, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            n = np.zeros(len(texts), np.int64)
            sizes, cells, lows, highs = np.zeros(len(texts), np.int64), [], [], []
            for first, (w,), off in hashed(texts):
                n[first : first + len(off) - 1] = np.diff(off)
                at = addresses(w, window)
                for i in range(len(off) - 1):
                    a, z = int(off[i]), int(off[i + 1]) - window + 1
                    if z <= a:
                        continue
                    m = at[a:z]
                    cut = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
                    cells.append(m[cut[:-1]].view(np.int64))
                    lows.append(cut[:-1])
                    highs.append(cut[1:] - 1)
                    sizes[first + i] = len(cut) - 1
            join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
            runs = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(join(cells, np.int64)), pa.array(join(lows, np.int32)), pa.array(join(highs, np.int32))], ["cell", "lo", "hi"]),
            )
            whole = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in texts]
            w = [int.from_bytes(bytes.fromhex(x[:16]), "big", signed=True) for x in whole]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(whole, pa.string()), pa.array(w, pa.int64()), runs], ["doc_id", "n_words", "whole", "w", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, whole string, w long, runs array<struct<cell: long, lo: int, hi: int>>")


def estimated_repeated(firsts: DataFrame) -> DataFrame:
    """Runs of windows (doc_id, w, lo, hi) that the count-min sketch says another row of ``firsts`` may have."""
    entries = firsts.select("doc_id", "w", F.explode("runs").alias("r")).select("doc_id", "w", "r.cell", "r.lo", "r.hi")
    total = firsts.agg(F.sum(F.size("runs"))).collect()[0][0] or 0
    width = 1 << max(10, (ROOM * total).bit_length())
    column = lambda j, c="cell": F.pmod(F.xxhash64(F.lit(j), c), F.lit(width))
    once = firsts.select(F.explode(F.array_distinct(F.transform("runs", lambda r: r["cell"]))).alias("cell"))
    # row and column as one number
    cells = once.select(F.explode(F.array(*[column(j) * ROWS + j for j in range(ROWS)])).alias("col"))
    busy = materialize(cells.groupBy("col").count().where("count > 1").select("col"))
    for j in range(ROWS):
        entries = entries.withColumn("col", column(j) * ROWS + j).join(busy.where(F.col("col") % ROWS == j), "col", "left_semi").drop("col")
    return entries


def _row_key(words: bytes) -> int:
    """64 bits of the digest of a text's words, to tell rows of one id apart."""
    return int.from_bytes(hashlib.sha256(words).digest()[:8], "big", signed=True)


def _unpacked(group: pa.Table) -> tuple[list[tuple[int, int, bytes]], list[np.ndarray]]:
    """(rows that were settled before, [hashes, second hashes, row ids, row keys, places] of the other windows)."""
    found: list[tuple[int, int, bytes]] = []
    cols = {n: group.column(n).to_pylist() for n in ("settled", "ids", "keys", "h", "g", "at", "d")}
    out: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (U, np.uint32, np.int64, np.int64, np.int32)]
    for i, done in enumerate(cols["settled"]):
        own, key = np.frombuffer(cols["ids"][i], np.int64), np.frombuffer(cols["keys"][i], np.int64)
        if done:
            found.append((int(own[0]), int(key[0]), cols["at"][i]))
            continue
        d = np.frombuffer(cols["d"][i], np.uint16)
        for to, x in zip(out, (np.frombuffer(cols["h"][i], U), np.frombuffer(cols["g"][i], np.uint32), own[d], key[d], np.frombuffer(cols["at"][i], np.int32))):
            to.append(x)
    return found, [np.concatenate(x) for x in out]


def _least(h: np.ndarray, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order, and the smallest id of each."""
    order = np.lexsort((own, g, h))
    h, g, own = h[order], g[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], g[new], own[new]


def _place(h: np.ndarray, g: np.ndarray, of_h: np.ndarray, of_g: np.ndarray) -> np.ndarray:
    """Where each window (h, g) stands among distinct ones in order, of which it is one."""
    both, which = np.unique(np.concatenate([of_h, h]), return_inverse=True)
    key, known = which.astype(U) << U(32), len(of_h)
    return np.searchsorted(key[:known] | of_g.astype(U), key[known:] | g.astype(U))


def _hits(found: list[tuple[int, int, bytes]], own: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.Table:
    """Packed places by row."""
    order = np.lexsort((at, key, own))
    at, own, key = at[order], own[order], key[order]
    cut = np.concatenate([[0], np.flatnonzero((np.diff(own) != 0) | (np.diff(key) != 0)) + 1, [len(own)]]) if len(own) else [0]
    found = found + [(int(own[a]), int(key[a]), at[a:e].tobytes()) for a, e in zip(cut[:-1], cut[1:])]
    one, two, three = zip(*found) if found else ((), (), ())
    return pa.table([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(three, pa.binary())], names=["doc_id", "w", "at"])


def _settled(dealt: DataFrame) -> DataFrame:
    """doc_id, w, at (packed places): windows that a smaller id has too.

    The windows of one range meet in one task.  A range of more than four times its due, as a passage in many documents makes, is cut into parts first: each part's smallest ids, then the smallest of
    these, a row a part, and that answer goes back to the parts.  Only distinct windows meet, and a hash deals these evenly.
    """
    hits, kind = "doc_id long, w long, at binary", {"h": pa.binary(), "g": pa.binary(), "least": pa.binary()}

    def settle(group: pa.Table) -> pa.Table:
        found, (h, g, own, key, at) = _unpacked(group)
        dh, dg, least = _least(h, g, own)
        hit = own > least[_place(h, g, dh, dg)] if len(h) else np.zeros(0, bool)
        return _hits(found, own[hit], key[hit], at[hit])

    def answer(r: int, h: np.ndarray, g: np.ndarray, own: np.ndarray) -> pa.Table:
        return pa.table([pa.array([r], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in _least(h, g, own)]], names=["r", *kind])

    def first(group: pa.Table) -> pa.Table:
        _, (h, g, own, _, _) = _unpacked(group)
        return answer(group.column("r")[0].as_py(), h, g, own)

    def joined(rows: pa.Table) -> list[np.ndarray]:
        return [np.concatenate([np.frombuffer(x, t) for x in rows.column(n).to_pylist()]) for n, t in (("h", U), ("g", np.uint32), ("least", np.int64))]

    def merge(group: pa.Table) -> pa.Table:
        return answer(group.column("r")[0].as_py(), *joined(group))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found, (h, g, own, key, at) = _unpacked(left)
        dh, dg, least = joined(right)
        hit = own > least[_place(h, g, dh, dg)] if len(h) else np.zeros(0, bool)
        return _hits(found, own[hit], key[hit], at[hit])

    sizes = dealt.groupBy("r").agg(F.sum(F.octet_length("h") / 8).alias("n"))
    heavy = materialize(sizes.where(F.col("n") > 4 * RANGE).select("r", F.ceil(F.col("n") / RANGE).cast("int").alias("parts")))
    known = F.broadcast(heavy)  # a row for each 4 * RANGE windows at most
    out = dealt.join(known, "r", "left_anti").groupBy("r").applyInArrow(settle, hits)
    if heavy.isEmpty():
        return out
    hot = dealt.join(known, "r").withColumn("part", F.pmod(F.xxhash64("ids", "at"), F.col("parts")).cast("int")).drop("parts")
    firsts = hot.groupBy("r", "part").applyInArrow(first, "r int, h binary, g binary, least binary")
    best = firsts.groupBy("r").applyInArrow(merge, "r int, h binary, g binary, least binary")
    told = best.join(known, "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return out.unionByName(hot.groupBy("r", "part").cogroup(told.groupBy("r", "part")).applyInArrow(compare, hits))


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(scan of docs, the rows that lose words: doc_id, w, n_removed, kept (text of the kept words))."""
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_rows = materialize(scan(docs, window))
    long_ = all_rows.where(f"doc_id is not null and n_words >= {window}")
    slim = long_.select("doc_id", "w", "whole", "n_words")
    first = materialize(slim.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    firsts = long_.join(first.select("whole", F.col("first").alias("doc_id")), ["doc_id", "whole"], "left_semi")  # no key is shared by many rows
    firsts = materialize(firsts.select("doc_id", "w", "runs").dropDuplicates(["doc_id", "w"]))
    # texts of which a thousandth of all rows are copies are at most a thousand, and their rows stay where they are; the rest are dealt by text
    total = first.agg(F.sum("n")).collect()[0][0] or 0
    many = first.where(F.col("n") > total / HOT)
    hot = slim.join(F.broadcast(many), "whole")
    cold = slim.join(F.broadcast(many.select("whole")), "whole", "left_anti").join(first.where(F.col("n").between(2, total / HOT)), "whole")
    copies = hot.unionByName(cold.select(hot.columns)).where("doc_id > first").select("doc_id", "w", F.col("n_words").alias("n_removed"), F.lit("").alias("kept")).distinct()
    spans = estimated_repeated(firsts).groupBy("doc_id", "w").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            words = [b" ".join((t or b"").split()) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_row_key(x) for x in words], pa.int64()), pa.array([z.compress(x) for x in words], pa.binary())], ["doc_id", "w", "z"])

    packed = docs.select("doc_id", "text").mapInArrow(squeeze, f"doc_id {kind}, w long, z binary")
    some = materialize(packed.join(spans, ["doc_id", "w"]))
    windows = some.agg(F.sum(F.expr("aggregate(spans, 0L, (s, r) -> s + r.hi - r.lo + 1)"))).collect()[0][0] or 0
    ranges = max(1, -(-windows // RANGE))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact hashes of the windows in question, packed by range of hash.  A window that this batch has in a smaller id too is settled here."""
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            if not b.num_rows:
                continue
            spans_of = b.column(3)
            edge = spans_of.offsets.to_numpy()
            lo, hi = (spans_of.values.field(i).to_numpy() for i in (0, 1))
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            hs, gs, ats, ds, rs = [], [], [], [], []
            for i, zipped in enumerate(b.column(2).to_pylist()):
                w = [np.concatenate(x) for x in zip(*(y for _, y, _ in hashed([unzip.decompress(zipped)], bases=(0, 1))))]
                mark = np.zeros(len(w[0]) + 1, np.int64)
                np.add.at(mark, lo[edge[i] : edge[i + 1]], 1)
                np.add.at(mark, hi[edge[i] : edge[i + 1]] + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[: max(0, len(w[0]) - window + 1)] > 0)
                hs.append(window_sums(w[0], window, 0)[at])
                gs.append((window_sums(w[1], window, 1)[at] >> U(32)).astype(np.uint32))
                ats.append(at.astype(np.int32))
                ds.append(np.full(len(at), i, np.int32))
                # the range follows the address, so that neighbouring windows mostly share one however many ranges there are
                rs.append(((mix(addresses(w[0], window)[at]) >> U(32)) * U(ranges) >> U(32)).astype(np.int64))
            h, g, at, d, r = (np.concatenate(x) for x in (hs, gs, ats, ds, rs))
            order = np.lexsort((ids[d], g, h, r))
            h, g, at, d, r = h[order], g[order], at[order], d[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            least = ids[d[new]][np.cumsum(new) - 1] if len(h) else ids[:0]
            later = ids[d] > least
            out = []
            for i in np.unique(d[later]):
                out.append((int(i) % ranges, True, ids[i : i + 1].tobytes(), keys[i : i + 1].tobytes(), b"", b"", np.sort(at[later & (d == i)]).tobytes(), b""))
            h, g, at, d, r = h[~later], g[~later], at[~later], d[~later], r[~later]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]]) if len(r) else np.zeros(1, np.int64)
            for a, e in zip(cut[:-1], cut[1:]):
                own, local = np.unique(d[a:e], return_inverse=True)
                out.append((int(r[a]), False, ids[own].tobytes(), keys[own].tobytes(), h[a:e].tobytes(), g[a:e].tobytes(), at[a:e].tobytes(), local.astype(np.uint16).tobytes()))
            if out:
                kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["r", "settled", "ids", "keys", "h", "g", "at", "d"])

    ours = some.select(F.col("doc_id").cast("long").alias("doc_id"), "w", "z", "spans")
    dealt = materialize(ours.mapInArrow(exact, "r int, settled boolean, ids binary, keys binary, h binary, g binary, at binary, d binary"))
    hits = _settled(dealt).groupBy("doc_id", "w").agg(F.collect_list("at").alias("hits"))
    cut = ours.select("doc_id", "w", "z").join(hits, ["doc_id", "w"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            n, kept = [], []
            for zipped, packs in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = unzip.decompress(zipped).split(b" ")
                a = np.frombuffer(b"".join(packs), np.int32)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, np.minimum(a + window, len(words)), -1)
                stay = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                n.append(len(words) - len(stay))
                kept.append(b" ".join([words[j] for j in stay]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "w", "n_removed", "kept"])

    lost = cut.mapInArrow(remove, "doc_id long, w long, n_removed long, kept string").dropDuplicates(["doc_id", "w"])
    return all_rows, lost.unionByName(copies)


def op4_substring(spark, sf_dir: str) -> DataFrame:
    rows, lost = repeats(table(spark, sf_dir, "documents"))
    lost = lost.select("doc_id", "w", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    out = rows.drop("runs").join(lost, ["doc_id", "w"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; those that lose all their words go, untouched texts stay as they are.

    Columns of any name pass through; ``n_chars``, where there is one, follows the text.
    """
    _, lost = repeats(docs)
    mine, id_, key, kept = (free_name(docs, x) for x in ("w", "id", "key", "kept"))
    lost = lost.select(F.col("doc_id").alias(id_), F.col("w").alias(key), F.col("kept").alias(kept))
    words = F.array_join(F.array_remove(F.split("text", r"[ \t-\r]+"), ""), " ")
    hashed_ = F.conv(F.substring(F.sha2(words, 256), 1, 16), 16, -10).cast("long")  # as _row_key
    joined = docs.withColumn(mine, hashed_).join(lost, (F.col("doc_id") == F.col(id_)) & (F.col(mine) == F.col(key)), "left")
    out = joined.where(F.col(kept).isNull() | (F.col(kept) != "")).withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*own(docs))
