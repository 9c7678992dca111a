"""Exact BPE ids by dynamic programming over prefixes, and their decoding.

For every prefix of a piece of text there is exactly one token that its encoding ends with.  An automaton over all
tokens (suffix links, so that every token ending at a place is found in one pass) proposes the candidates at each place;
a candidate t of length L is the last token of the prefix of length i exactly when the last token of the prefix of
length i - L may stand before t, which is a test on the merges alone.  Following the back-pointers from the end gives the ids.
Pieces are those of the byte-level pre-tokenizer; special tokens are cut out first, as the tokenizer does.

Defined results: null is the empty text, which has no ids; texts of any length are encoded whole; rows are independent, so repeated rows, ties and extra
columns change nothing.  Memory is bounded by the longest text and CACHE pieces a worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .shared import session, table
from .words import texts_of

CACHE = 300_000
PAIRS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def piece_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """Pieces of a text without characters above ``top``: the smaller the classes, the faster the search."""
    import regex

    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, top + 1)] if top > 0xD800 else range(top + 1)))
    kinds = {}
    for k in "LN":
        runs = (m[0] for m in regex.finditer(rf"\p{{{k}}}+", signs))
        kinds[k] = "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in runs)
    letters, numbers = kinds["L"], kinds["N"]
    space = "".join(c for c in regex.findall(rf"[{SPACES}]", signs))
    space = "".join(f"\\U{ord(c):08x}" for c in space)
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Pieces(dict):
    """Ids by piece, in two generations, so that memory is bounded and common pieces stay."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = self.make(text.encode().decode("latin-1"))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = got
        return got


class Encoder:
    """A byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        unletter = {c: chr(b) for b, c in byte_letters().items()}  # bytes as Latin-1 text, for the automaton
        plain = lambda token: "".join(unletter[c] for c in token)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = r
            if whole not in rank:
                rank[whole], parts[whole] = r, (left, right)
        self.rank, self.parts = rank, parts
        self.bytes_of = {i: plain(t).encode("latin-1") for t, i in vocab.items() if t not in special}
        self.table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for i, b in self.bytes_of.items():
            self.table[i] = b
        for t, i in special.items():
            self.table[i] = t.encode()
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t not in special and (len(t) == 1 or i in parts):
                self.automaton.add_word(plain(t), i)
        self.automaton.make_automaton()
        self.sizes = [len(b) for b in self.table]
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self._piece)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of a and b together encodes to exactly a, b.

        Undo merges on both sides of the seam, latest first.  If at any moment the tokens that meet at the seam would
        merge before the piece that is still whole was made, the merge would have come first, and the pair is impossible.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = len(merged) + 1
        while True:
            r = merged.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a was made later: its right part met b before
                limit = ra
                a = parts[a][1]
            else:
                limit = rb + 1  # at one rank the left seam goes first
                b = parts[b][0]

    def _piece(self, s: str) -> bytes:
        """Ids of a piece, given as Latin-1 text of its bytes."""
        n = len(s)
        last = [-1] * (n + 1)
        pairs, sizes = self.pairs, self.sizes
        for end, t in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - sizes[t]
            if start:
                key = last[start] << 32 | t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.may_follow(last[start], t)
                if not ok:
                    continue
            last[end] = t
        out = array("I")
        while n:
            t = last[n]
            n -= sizes[t]
            out.append(t)
        out.reverse()
        return out.tobytes()

    def _plain(self, text: str) -> list[bytes]:
        top = 0x7F if text.isascii() else 0xFF
        if top == 0xFF:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                top = sys.maxunicode
        return list(map(self.pieces.__getitem__, piece_pattern(top).findall(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def decode(self, ids: bytes) -> str:
        a = array("I")
        a.frombytes(ids)
        return b"".join(map(self.table.__getitem__, a)).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, vocabulary: str | None = None, ship: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded for every row.

    The vocabulary file goes to the executors with ``addFile``; its size does not depend on the data.
    """
    spark = session(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    name = path.rpartition("/")[2]
    if ship:
        spark.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name) if ship else path)
        for b in batches:
            ids = [enc.encode((t or b"").decode("utf-8", "replace")) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_texts, but only the digests leave the workers."""
    spark = session(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    name = path.rpartition("/")[2]
    spark.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n, a, d = [], [], []
            for t in texts_of(b.column(1)):
                ids = enc.encode((t or b"").decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that came this far: doc_id, n_tokens, ids, decoded."""
    return encode_texts(docs)
