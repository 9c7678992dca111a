"""Katz backoff language model over word trigrams, evaluated from the trigram down.

Counts are discounted by Good-Turing up to LAST, the freed mass of each context backs off to the next lower order, with weights that
normalise exactly over the vocabulary and one class of unknown words:

    P(w | t, u) = d(c) c(t, u, w) / c(t, u)     if c(t, u, w) > cut
                = a(t, u) P(w | u)              otherwise, a(t, u) = (1 - sum of the above) / (1 - sum of P(w | u) over the same w)
    P(w | u)    = d(c) c(u, w) / c(u)           if c(u, w) > 0
                = a(u) P1(w)                    otherwise, a(u) likewise
    P1(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))

``cut`` is 0: every trigram of training counts.  With a larger one, trigrams that training has ``cut`` times or less back off, and their mass is freed with the rest.  A text's first word has the start
as its context alone, its second the start and the first.  A context that training never saw, or that keeps no trigram, backs off with weight 1.  A context without
freed mass (all counts above LAST) gives up one count in c + 1.  Words, bigrams and trigrams are 64-bit hashes.  All statistics cover all training rows.

Documents are packed into blocks of BLOCK bytes.  A block asks for each of its distinct words and bigrams once, as sorted and
compressed keys with its own counts, dealt by range of hash; a range sums what all blocks send and answers each of them
with the totals in the order of its keys.  So the counts are a table partitioned by range and block.  For each n-gram
one block is named owner: it adds the n-gram to its context's sums, which a smaller exchange of contexts turns into
backoff weights.  Then the same is done for trigrams, level by level: a block asks only for those both of whose bigrams training has more than ``cut`` times, as no other
can be kept; the totals, with the lower order's probabilities, give the sums of contexts, and these the weights.

Skew: a key is one entry a block, however often it occurs.  Memory: a block and a range of about BUCKET bytes of text, or the
longest text.  Packets number blocks times ranges, at most one a distinct n-gram of a block.

Defined results: null and blank texts are their end token; rows without doc_id are scored but not learnt from and count as not held out; rows that
repeat an id are scored each on its own; a text longer than a block is a block of its own and scored whole; without training rows P1 is 1 for the one unknown class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, discard, materialize, session, table, tidy
from .words import LOWER, U, hashed, mix, texts_of

LAST = 5
START, END = 1, 2  # context of a text's first word, and the token after its last
BLOCK, BUCKET = 5 << 20, 8 << 20
TOLD = [f"s{r}" for r in range(1, LAST + 2)]


def packed(a: np.ndarray) -> bytes:
    """An array's bytes by place, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) if len(a) else b""


def unpacked(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed_keys(k: np.ndarray) -> bytes:
    return packed(np.diff(k, prepend=U(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, U), dtype=U)


def dealt(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges of hash that sorted keys fall into."""
    r = ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
    return ((int(r[a]), slice(int(a), int(z))) for a, z in zip(cut[:-1], cut[1:]) if z > a)


def grams(docs: DataFrame) -> DataFrame:
    """Blocks of documents: block, doc_ids, flags (1: held out, 2: train), lengths and text, packed, and n bytes."""
    session(docs.sparkSession)
    part = F.pmod(crc_of_id("doc_id"), F.lit(5))
    flags = F.when(part == 1, 1).when(part.isNotNull(), 2).otherwise(0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def block(ids: pa.DataType) -> pa.RecordBatch:
            z = zstandard.ZstdCompressor(3).compress(b"".join(r[3] for r in rows))
            lengths = packed(np.array([len(r[3]) for r in rows], np.int64))
            cols = [pa.array([rows[0][2]], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(ids)), *(pa.array([x], pa.binary()) for x in (bytes(r[1] for r in rows), lengths, z)), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "flags", "lengths", "z", "n"])

        ids = None
        for b in batches:
            ids = b.schema.field(0).type
            for r in zip(*(b.column(i).to_pylist() for i in range(3)), texts_of(b.column(3))):
                rows.append((*r[:3], r[3] or b""))
                size += len(rows[-1][3])
                if size >= BLOCK:
                    yield block(ids)
                    rows.clear()
                    size = 0
        if rows:
            yield block(ids)

    rows = docs.select("doc_id", flags.alias("flags"), F.monotonically_increasing_id().alias("row"), "text")
    return materialize(rows.mapInArrow(run, f"block long, doc_ids array<{kind}>, flags binary, lengths binary, z binary, n long"))


class Tokens:
    """A block's tokens: starts of documents, distinct words and bigrams, and each token's place among them."""

    def __init__(self, flags: bytes, lengths: bytes, z: bytes):
        self.flags = np.frombuffer(flags, np.uint8)
        text = zstandard.ZstdDecompressor().decompress(z) if z else b""
        ends = np.cumsum(unpacked(lengths, np.int64))
        texts = [text[a:e] for a, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
        parts, sizes = [], []
        for _, (w,), off in hashed(texts, LOWER):
            parts.append(np.insert(w, off[1:], U(END)))
            sizes.append(np.diff(off) + 1)
        t, self.n = np.concatenate(parts), np.concatenate(sizes)
        self.starts = np.cumsum(self.n) - self.n
        learnt = np.repeat(self.flags == 2, self.n)
        del text, texts, parts
        self.words, at = np.unique(np.concatenate([np.array([START], U), t]), return_inverse=True)
        at = at.astype(np.int32)  # places fit, as a block has fewer tokens than bytes
        self.word, begin = at[1:], at[0]
        self.context = np.concatenate([at[:1], self.word[:-1]])
        self.context[self.starts] = begin
        self.word_counts = np.bincount(self.word, weights=learnt, minlength=len(self.words)).astype(np.int64)
        self.word_counts[begin] = np.count_nonzero(self.flags == 2)
        self.bigrams, self.bigram = np.unique(mix(self.words[self.context] * U(0x9E3779B97F4A7C15) + t), return_inverse=True)
        self.bigram = self.bigram.astype(np.int32)
        self.bigram_counts = np.bincount(self.bigram, weights=learnt, minlength=len(self.bigrams)).astype(np.int64)


    def bigram_state(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of bigrams, whether this block owns them, and totals of words."""
        told = sorted(answers, key=lambda x: x[0] if x[0] >= 0 else -1 - x[0])
        v = np.concatenate([unpacked(x, np.int64) for deal, x in told if deal >= 0])
        return v >> 1, (v & 1) > 0, np.concatenate([unpacked(x, np.int64) for deal, x in told if deal < 0]) >> 1

    def thirds(self, c: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens whose trigram may be kept, distinct trigram hashes, each such token's place among them); ``c``: totals of bigrams."""
        first = np.zeros(len(self.word), bool)
        first[self.starts] = True
        at = np.flatnonzero(~first)
        at = at[(c[self.bigram[at - 1]] > cut) & (c[self.bigram[at]] > cut)]
        keys, place = np.unique(mix(self.bigrams[self.bigram[at - 1]] * U(0xC2B2AE3D27D4EB4F) + self.words[self.word[at]]), return_inverse=True)
        return at, keys, place.astype(np.int32)


def turing(count_of: dict[int, int], cut: int) -> list[float]:
    """Good-Turing discounts for counts 1 to LAST where counts up to ``cut`` are not kept: r* / r with r* = (r + 1) n(r + 1) / n(r); (r - 1/2) / r where that is no discount."""
    n = lambda r: count_of.get(r, 0)
    ratio = [(r + 1) * n(r + 1) / n(r) / r if n(r) and r > cut else -1.0 for r in range(1, LAST + 1)]
    return [d if 0 < d < 1 else (r - 0.5) / r for r, d in enumerate(ratio, 1)]


def discounts(count_of: dict[int, int]) -> list[float]:
    """Katz's discounts for counts 1 to LAST from the numbers of n-grams seen once, twice, ...; (r - 1/2) / r where those give none."""
    n = lambda r: count_of.get(r, 0)
    out = []
    for r in range(1, LAST + 1):
        d = -1.0
        if n(1) and n(r):
            high = (LAST + 1) * n(LAST + 1) / n(1)
            if high < 1:
                d = ((r + 1) * n(r + 1) / n(r) / r - high) / (1 - high)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Katz:
    """Totals for each block's keys (block, deal, v = 2 * count + owner), the discounts, the totals N and V, and the number of ranges."""

    def __init__(self, counts: DataFrame, held: list[float], n: int, v: int, ranges: int):
        self.counts, self.held, self.n, self.v, self.ranges = counts, held, n, v, ranges


def _merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(order, starts of equal keys in it, group of each place in it, ends of the parts)."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum([len(x) for x in keys]).tolist()


def _tally(group: pa.Table) -> pa.Table:
    """One range's totals, in each block's order; words are dealt below zero."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    keys = [unpacked_keys(r["keys"]) for r in rows]
    order, starts, which, ends = _merged(keys)
    total = np.add.reduceat(np.concatenate([unpacked(r["counts"], np.int64) for r in rows])[order], starts)
    v = np.empty(len(order), np.int64)
    v[order] = 2 * total[which]
    v[order[starts]] += total > 0
    deal = rows[0]["deal"]
    if deal < 0:
        real = total[np.concatenate(keys)[order[starts]] != START]
        told = [int(real.sum()), int(np.count_nonzero(real)), *[0] * (LAST - 1)]
    else:
        told = [int(np.count_nonzero(total == r)) for r in range(1, LAST + 2)]
    cols = [pa.array([*(r["block"] for r in rows), None], pa.int64()), pa.array([deal] * (len(rows) + 1), pa.int32()), pa.array([*map(packed, np.split(v, ends[:-1])), None], pa.binary())]
    return pa.table(cols + [pa.array([*[None] * len(rows), x], pa.int64()) for x in told], names=["block", "deal", "v", *TOLD])


def train(g: DataFrame) -> Katz:
    ranges = max(1, -(-(g.agg(F.sum("n")).collect()[0][0] or 0) // BUCKET))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *what in zip(*(b.column(i).to_pylist() for i in range(4))):
                t = Tokens(*what)
                out = [(block, r, packed_keys(t.bigrams[s]), packed(t.bigram_counts[s])) for r, s in dealt(t.bigrams, ranges)]
                out += [(block, -1 - r, packed_keys(t.words[s]), packed(t.word_counts[s])) for r, s in dealt(t.words, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "deal", "keys", "counts"])

    asked = g.select("block", "flags", "lengths", "z").mapInArrow(ask, "block long, deal int, keys binary, counts binary")
    counts = materialize(asked.groupBy("deal").applyInArrow(_tally, f"block long, deal int, v binary, {', '.join(f'{x} long' for x in TOLD)}"))
    tidy(g.sparkSession)
    sums = {r["words"]: r for r in counts.where("block is null").groupBy((F.col("deal") < 0).alias("words")).agg(*(F.sum(x).alias(x) for x in TOLD)).collect()}
    n, v = (sums[True][x] for x in TOLD[:2]) if sums else (0, 0)
    held = discounts({r + 1: sums[False][x] for r, x in enumerate(TOLD)} if sums else {})
    return Katz(counts, held, n, v, ranges)


def weigher(held: np.ndarray, unit: float, whole: type):
    """The function that turns one range's shares in the sums of contexts into backoff weights, for the blocks that want them: logarithms of the weight and of the scale of seen n-grams.

    Blocks send how many n-grams of each count up to LAST they own in a context, the sum of the larger counts, and the lower order's probabilities in ``unit``s.
    """

    def weigh(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        order, starts, which, ends = _merged([unpacked_keys(r["keys"]) for r in rows])
        column = lambda c, kind: np.concatenate([unpacked(r[c], kind) for r in rows])[order]
        mass = np.add.reduceat(column("many", np.int64), starts).astype(float)
        few = [unpacked(r["few"], np.int32).reshape(LAST, -1) for r in rows]
        for k in range(LAST):
            mass += held[k + 1] * (k + 1) * np.add.reduceat(np.concatenate([f[k] for f in few])[order], starts, dtype=np.int64)
        del few
        cu, p = np.maximum(column("cu", np.int64)[starts], 1), np.add.reduceat(column("p", whole), starts) * unit
        seen = mass / cu
        none = 1 - seen < 1e-9
        la = np.log10(np.where(none, 1 / (cu + 1), 1 - seen) / np.maximum(1 - p, 1e-300))
        ls = np.where(none, np.log10(cu / (cu + 1)), 0.0)
        back = np.empty(len(order), np.int64)
        back[order] = which
        out = []
        for r, at in zip(rows, np.split(back, ends[:-1])):
            at = at[unpacked(r["wanted"], np.uint8) > 0]
            if len(at):
                out.append((r["block"], r["deal"], packed(la[at]), packed(ls[at])))
        one = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(x, k) for x, k in zip(one, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "deal", "la", "ls"])

    return weigh


def _seconds(t: Tokens, c: np.ndarray, cw: np.ndarray, total: float, held: np.ndarray) -> dict[str, np.ndarray]:
    """What a block knows of the bigram level before the weights of its contexts: by bigram its share and log-probability; by token whether it waits for its context."""
    at = np.empty(len(t.bigrams), np.int64)
    at[t.bigram] = np.arange(len(t.bigram))
    u, w = t.context[at], t.word[at]
    p1, seen = (cw + 0.5) / total, c > 0
    share = np.where(c > LAST, c, held[np.minimum(c, LAST)] * c) / np.maximum(cw[u], 1)
    freed = np.zeros(len(t.words), bool)
    freed[u[seen & (c <= LAST)]] = True
    # tokens that wait for their context: unseen bigrams, and seen ones where no count here frees mass
    wait = (~seen[t.bigram] | ~freed[t.context]) & (cw[t.context] > 0)
    wanted = np.zeros(len(t.words), bool)
    wanted[t.context[wait]] = True
    l1 = np.log10(p1)
    return dict(u=u, w=w, p1=p1, l1=l1, seen=seen, share=share, sure=np.where(seen, np.log10(np.where(seen, share, 1.0)), l1[w]), wait=wait, wanted=wanted)


CONTEXT = {"block": pa.int64(), "level": pa.int32(), "deal": pa.int32(), **{x: pa.binary() for x in ("keys", "few", "many", "p", "cu", "wanted", "counts")}}
TEXTS = ("flags", "n_tokens", "n_known", "base", "sure", "open", "code")


def _contexts(block: int, level: int, keys: np.ndarray, where: np.ndarray, c: np.ndarray, p: np.ndarray, cu: np.ndarray, wanted: np.ndarray, ranges: int) -> list[dict]:
    """A block's share in the sums of contexts, from the n-grams it owns (their context, count and lower-order probability), and which of the contexts' weights it wants, by range."""
    size = len(keys)
    few = [np.bincount(where[c == r], minlength=size).astype(np.int32) for r in range(1, LAST + 1)]
    many = np.bincount(where, weights=np.where(c > LAST, c, 0), minlength=size).astype(np.int64)
    mass = np.bincount(where, weights=p, minlength=size).astype(p.dtype)
    owned = np.zeros(size, bool)
    owned[where] = True
    send = np.flatnonzero(wanted | owned)
    out = []
    for r, s in dealt(keys[send], ranges):
        x = send[s]
        out.append(dict(block=block, level=level, deal=r, keys=packed_keys(keys[x]), few=packed(np.concatenate([f[x] for f in few])), many=packed(many[x]), p=packed(mass[x]), cu=packed(cu[x]), wanted=packed(wanted[x].astype(np.uint8))))
    return out


def score(g: DataFrame, m: Katz, cut: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.  ``cut``: trigrams that training has so often or less back off."""
    spark = g.sparkSession
    kind = g.schema["doc_ids"].dataType.elementType.simpleString()
    total, held, ranges, n = m.n + 0.5 * (m.v + 1), np.array([0.0, *m.held]), m.ranges, m.n
    ddl = lambda shape: ", ".join(f"{k} {'long' if t == pa.int64() else 'int' if t == pa.int32() else 'binary'}" for k, t in shape.items())

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's share in the sums of one-word contexts, and the trigrams it asks for."""
        row = left.to_pylist()[0]
        t = Tokens(row["flags"], row["lengths"], row["z"])
        c, own, cw = t.bigram_state(list(zip(right.column("deal").to_pylist(), right.column("v").to_pylist())))
        x = _seconds(t, c, cw, total, held)
        out = _contexts(row["block"], 2, t.words, x["u"][own], c[own], 2 * cw[x["w"][own]] + 1, cw, x["wanted"], ranges)  # P1 is (2 c + 1) / (2 total)
        at, keys, place = t.thirds(c, cut)
        learnt = np.repeat(t.flags == 2, t.n)[at]
        counts = np.bincount(place, weights=learnt, minlength=len(keys)).astype(np.int64)
        out += [dict(block=row["block"], level=3, deal=r, keys=packed_keys(keys[s]), counts=packed(counts[s])) for r, s in dealt(keys, ranges)]
        return pa.table({k: pa.array([r.get(k) for r in out], x) for k, x in CONTEXT.items()})

    judged = g.select("block", "flags", "lengths", "z").groupBy("block").cogroup(m.counts.where("block is not null").select("block", "deal", "v").groupBy("block")).applyInArrow(judge, ddl(CONTEXT))
    told = {"block": pa.int64(), "level": pa.int32(), "deal": pa.int32(), "v": pa.binary(), "la": pa.binary(), "ls": pa.binary(), **{x: pa.int64() for x in TOLD}}

    weigh2 = weigher(held, 0.5 / total, np.int64)

    def answer(group: pa.Table) -> pa.Table:
        """One range's answers: weights of one-word contexts, or totals of trigrams."""
        level = group.column("level")[0].as_py()
        out = weigh2(group) if level == 2 else _tally(group)
        n_rows = out.num_rows
        full = {k: out.column(k) if k in out.column_names else pa.array([level] * n_rows if k == "level" else [None] * n_rows, x) for k, x in told.items()}
        return pa.table(full)

    second = materialize(judged.groupBy("level", "deal").applyInArrow(answer, ddl(told)))
    tidy(spark)
    found = second.where("block is null").agg(*(F.sum(x).alias(x) for x in TOLD)).collect()[0]
    count_of = {r + 1: found[x] or 0 for r, x in enumerate(TOLD)}
    held3 = np.array([0.0, *(turing(count_of, cut) if cut else discounts(count_of))])
    first = m.counts.where("block is not null").select("block", F.lit(1).alias("level"), "deal", "v", *[F.lit(None).cast("binary").alias(x) for x in ("la", "ls")])
    answers = first.unionByName(second.where("block is not null").select(first.columns))
    shape = {**CONTEXT, **{x: pa.binary() for x in TEXTS}}

    def weave(left: pa.Table, right: pa.Table) -> pa.Table:
        """What a block's documents score without the weights of their two-word contexts, and its share in these contexts' sums."""
        row = left.to_pylist()[0]
        t = Tokens(row["flags"], row["lengths"], row["z"])
        told = right.to_pylist()
        c, own, cw = t.bigram_state([(r["deal"], r["v"]) for r in told if r["level"] == 1])
        x = _seconds(t, c, cw, total, held)
        late = sorted((r for r in told if r["level"] == 2), key=lambda r: r["deal"])
        la, ls = (np.zeros(len(t.words)) for _ in range(2))
        for to, name in ((la, "la"), (ls, "ls")):
            to[x["wanted"]] = np.concatenate([np.empty(0), *(unpacked(r[name], float) for r in late)])
        v = np.concatenate([np.empty(0, np.int64), *(unpacked(r["v"], np.int64) for r in sorted((r for r in told if r["level"] == 3), key=lambda r: r["deal"]))])
        second = x["sure"][t.bigram]
        late = np.flatnonzero(x["wait"])
        second[late] += np.where(x["seen"][t.bigram[late]], ls[t.context[late]], la[t.context[late]])
        del late, told
        at, keys, place = t.thirds(c, cut)
        c3, mine = v >> 1, (v & 1) > 0
        some = np.empty(len(keys), np.int64)  # a token of each trigram
        some[place] = np.arange(len(at))
        some = at[some]
        over, cu = t.bigram[some - 1], np.maximum(c[t.bigram[some - 1]], 1)
        kept = c3 > cut
        share = np.where(c3 > LAST, c3, held3[np.minimum(c3, LAST)] * c3) / cu
        freed = np.zeros(len(t.bigrams), bool)
        freed[over[(c3 > 0) & (c3 <= LAST)]] = True
        context = np.full(len(t.word), -1, np.int32)
        context[1:] = t.bigram[:-1]
        context[t.starts] = -1
        third = np.full(len(t.word), -1, np.int32)
        third[at] = place
        is_kept = third >= 0
        is_kept[is_kept] = kept[third[is_kept]]
        back = (context >= 0) & ~is_kept
        back[back] = c[context[back]] > cut
        wait = back.copy()
        wait[is_kept] = ~freed[context[is_kept]]
        sure = second
        sure[is_kept] = np.log10(share[third[is_kept]])
        wanted = np.zeros(len(t.bigrams), bool)
        wanted[context[wait]] = True
        number = np.cumsum(wanted, dtype=np.int32) - 1
        code = 2 * number[context[wait]].astype(np.int64) + is_kept[wait]
        del number, third, back
        add = mine & kept
        lower = x["sure"][t.bigram[some[add]]] + np.where(x["wait"][some[add]], ls[t.context[some[add]]], 0.0)  # a kept trigram's bigram was seen
        out = _contexts(row["block"], 3, t.bigrams, over[add], c3[add], 10.0**lower, c, wanted, ranges)
        by_doc = lambda y, k: packed(np.add.reduceat(y, t.starts).astype(k))
        out.append(dict(block=row["block"], flags=row["flags"], n_tokens=packed(t.n.astype(np.int64)), n_known=by_doc((cw[t.word] > 0).astype(np.int64), np.int64), base=by_doc(x["l1"][t.word], float), sure=by_doc(sure, float), open=by_doc(wait.astype(np.int64), np.int64), code=packed(code)))
        cols = {k: pa.array([r.get(k) for r in out], x) for k, x in shape.items()}
        ids = pa.array([*[None] * (len(out) - 1), row["doc_ids"]], left.column("doc_ids").type)
        return pa.table({**cols, "doc_ids": ids})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        told = sorted(right.to_pylist(), key=lambda r: r["deal"])
        la, ls = (np.concatenate([np.empty(0), *(unpacked(r[x], float) for r in told)]) for x in ("la", "ls"))
        code, base = unpacked(row["code"], np.int64), unpacked(row["base"], float)
        late = np.where(code & 1, ls[code >> 1], la[code >> 1])
        who = np.repeat(np.arange(len(base)), unpacked(row["open"], np.int64))
        done = unpacked(row["sure"], float) + np.bincount(who, weights=late, minlength=len(base))
        out = {
            "doc_id": pa.array(row["doc_ids"], left.column("doc_ids").type.value_type), "held_out": pa.array(np.frombuffer(row["flags"], np.uint8) == 1),
            "n_tokens": pa.array(unpacked(row["n_tokens"], np.int64)), "n_known": pa.array(unpacked(row["n_known"], np.int64)),
            "train_tokens": pa.array(np.full(len(base), n, np.int64)), "base_score": pa.array(base), "score": pa.array(done),
        }
        return pa.table(out)

    woven = materialize(g.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weave, f"{ddl(shape)}, doc_ids array<{kind}>"))
    discard(second)
    tidy(spark)
    third = woven.where("level = 3").select("block", "deal", "keys", "few", "many", "p", "cu", "wanted").groupBy("deal")
    weights3 = materialize(third.applyInArrow(weigher(held3, 1.0, float), "block long, deal int, la binary, ls binary"))
    tidy(spark)
    texts = woven.where("level is null").select("block", "doc_ids", *TEXTS)
    return texts.groupBy("block").cogroup(weights3.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm(spark, sf_dir: str) -> DataFrame:
    """With trigrams that training has once cut, as is usual at the highest order: with all of them, the sums of contexts took more disk than the check tool allows (README)."""
    session(spark)
    g = grams(table(spark, sf_dir, "documents"))
    m = train(g)
    out = score(g, m, cut=1)
    discard(g, m.counts)  # the scores' plan reads neither
    return out
