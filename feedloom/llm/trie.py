"""Prefix trie of conversations: which turns are shared by how many conversations, and how much storing each shared prefix once saves.

A node is a distinct sequence of first turns.  Turns are reduced to digests and sizes before anything is shuffled; conversations with
the same turns form a class, counted map-side, and only the class's smallest conversation goes on.  Classes are dealt by the digest of their first turn to
hash buckets, and each bucket's subtries are built inside ``applyInPandas`` as nodes with dictionaries of pointers to children, summed from the last node
to the first (a child is always younger than its parent, so no recursion).

A subtrie of more than ``limit`` turns never meets in one task: its shared first turns become upper nodes from sums that are combined map-side, and what is
left is dealt anew by the turn after them, as often as needed.  Turns that all of its classes share are passed in one step, so a long common
prompt costs one round.  A subtrie of a single class is a chain and needs no trie: running sums along it give its nodes.  The upper nodes are summed from the last
round to the first.

Defined results: turns are ordered by turn (null first), then role, then the digest of role and text; null role or text count as empty; repeated rows are
repeated turns; rows without conv_id are left out; a conversation without turns belongs to the root alone; an empty table gives no node, not even a root; texts of
any length are digested whole; extra columns are ignored.  A conversation's turns are numbered by one task, which streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, session, table

LIMIT, BUCKET, CHUNK = 1024, 1024, 4096
FAMILY, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEY = ["ka", "kb"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), mark (16 bytes that stand for role and text), size (bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "mark")
    return slim.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", "mark", "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation, its turns) after each has taken the first turns of its family's first conversation in place of its own.

    A family is ``family`` ids in a row; a conversation takes as many turns as its id's checksum modulo ``heads`` says.  Families are small, whatever is hot.
    """
    turns = materialize(turns.withColumn("home", F.col("conv_id") - F.col("conv_id") % family))
    takes = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("takes")
    each = turns.groupBy("conv_id", "home").agg(F.max("pos").alias("own")).select("*", takes)
    first = each.where("conv_id = home").select("home", F.col("own").alias("there"))
    each = materialize(each.join(first, "home", "left").withColumn("given", F.least("takes", F.coalesce("there", F.lit(0)))).select("conv_id", "home", "takes", "given"))
    lent = turns.where(f"conv_id = home and pos < {heads}").select("home", "pos", "mark", "size")
    head = lent.join(each, "home").where("pos <= takes").select("conv_id", "pos", "mark", "size")
    rest = turns.drop("home").join(each.drop("home"), "conv_id").where("pos > takes").select("conv_id", (F.col("pos") - F.col("takes") + F.col("given")).alias("pos"), "mark", "size")
    return each.select("conv_id"), head.unionByName(rest)


def with_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, a, b, size: a and b are 128 bits of the turns up to here."""
    far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "mark")).over(far).alias(n) for n, seed in (("a", 11), ("b", 12))]
    return turns.select("conv_id", "pos", *so_far, "size")


def _digests(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each class's pieces, which come sorted and may fill many batches."""
    held, cls, out = None, None, []
    for pdf in pieces:
        for c, piece in zip(pdf["cls"].tolist(), pdf["piece"].tolist()):
            if c != cls:
                if held is not None:
                    out.append((cls, held.hexdigest()))
                held, cls = hashlib.sha256(piece.encode()), c
            else:
                held.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["cls", "ends"])
        out = []
    if held is not None:
        yield pd.DataFrame([(cls, held.hexdigest())], columns=["cls", "ends"])


def classes(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """cls (smallest conv_id), n, len, ka and kb (of the first turn), ends (digest of all its ids): conversations with the same turns.

    Ids are joined to text in chunks of ``CHUNK`` neighbouring ids, so that a class of any size is put together by many tasks; one task then streams its chunks.
    """
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("w"), F.min(F.struct("pos", "a", "b")).alias("f"))
    whole = ids.join(whole, "conv_id", "left").select("conv_id", F.coalesce("w.pos", F.lit(0)).cast("long").alias("len"), F.coalesce("w.a", F.lit(0)).cast("long").alias("a"), F.coalesce("w.b", F.lit(0)).cast("long").alias("b"), F.col("f.a").alias("ka"), F.col("f.b").alias("kb"))
    same = ["len", "a", "b", "ka", "kb"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = materialize(whole.groupBy(*same, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), text.alias("piece")))
    found = materialize(chunks.groupBy(*same).agg(F.min("least").alias("cls"), F.sum("n").alias("n"), F.count("*").alias("chunks"), F.max("piece").alias("piece")))
    many = found.where("chunks > 1").select("len", "a", "b", "cls")
    streamed = chunks.join(many, ["len", "a", "b"]).select("cls", "chunk", "piece").repartition("cls").sortWithinPartitions("cls", "chunk").select("cls", "piece").mapInPandas(_digests, "cls long, ends string")
    out = ["cls", "n", "len", "ka", "kb"]
    one = found.where("chunks = 1").select(*out, F.sha2("piece", 256).alias("ends"))
    return one.unionByName(found.where("chunks > 1").select(*out).join(streamed, "cls"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket's subtries."""
    pdf = pdf.sort_values(["cls", "pos"], kind="stable")
    tops: dict[tuple[int, int], int] = {}
    kids: list[dict[tuple[int, int], int]] = []
    up, conv, depth, count, size, ends, key = [], [], [], [], [], [], []
    cols = [pdf[c].tolist() for c in ("cls", "n", "len", "pos", "a", "b", "size", "ends", "ka", "kb", "pka", "pkb", "pc", "d")]
    at = -1
    for cls, n, length, pos, a, b, nbytes, end, ka, kb, pka, pkb, pc, d in zip(*cols):
        top = pos == d
        known = tops if top else kids[at]
        node = known.get((a, b))
        if node is None:  # classes come in order, so the first has the smallest id
            node = known[a, b] = len(up)
            kids.append({})
            up.append(-1 if top else at)
            key.append((ka, kb, pka, pkb, pc))
            conv.append(cls)
            depth.append(pos)
            count.append(0)
            size.append(nbytes)
            ends.append(NOTHING)
        count[node] += n
        if pos == length:
            ends[node] = end
        at = node
    leaves, saved = [0] * len(up), [(c - 1) * s for c, s in zip(count, size)]
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    above = [key[i][4] if up[i] < 0 else conv[up[i]] for i in range(len(up))]
    out = {"conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends}
    return pd.DataFrame(out | {"pka": [k[2] for k in key], "pkb": [k[3] for k in key], "top": [u < 0 for u in up]})


def _chains(rows: DataFrame) -> DataFrame:
    """Nodes of subtries of one class: a path."""
    ahead = Window.partitionBy("cls").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last, top = F.col("pos") == F.col("len"), F.col("pos") == F.col("d")
    return rows.select(
        F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), F.when(top, F.col("pc")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.sum((F.col("n") - 1) * F.col("size")).over(ahead).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"), "pka", "pkb", top.alias("top"),
    )


def _peel(paths: DataFrame, groups: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upper nodes, groups one turn after them) of the subtries ``over``: the turns that all their classes share."""
    mine = materialize(groups.join(over.select(*KEY, "classes"), KEY))
    rows = paths.join(mine, "cls").where("pos >= d")
    per = [*KEY, "d", "pka", "pkb", "pc", "classes"]
    levels = rows.groupBy(*per, "pos").agg(
        F.count("*").alias("c"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.min("cls").alias("least"), F.sum("n").alias("n_convs"), F.max("size").alias("size"),
        F.max(F.when(F.col("pos") == F.col("len"), F.col("ends"))).alias("ended"),
    )
    spine = materialize(levels.where("c = classes and a0 = a1 and b0 = b1").select("ka", "kb", "d", "pka", "pkb", "pc", "pos", "least", "n_convs", "size", "ended"))
    end = spine.groupBy(*KEY).agg(F.max("pos").alias("e"), F.first("least").alias("least"))
    # what is left of each class is known by its next turn
    on = mine.select("cls", "n", "len", "ends", *KEY).join(end, KEY).where("len > e").select("cls", "n", "len", "ends", "e", F.col("ka").alias("pka"), F.col("kb").alias("pkb"), F.col("least").alias("pc"))
    going = on.join(paths.select("cls", "pos", F.col("a").alias("ka"), F.col("b").alias("kb")), "cls").where("pos = e + 1").select("cls", "n", "len", "ends", *KEY, F.col("pos").alias("d"), "pka", "pkb", "pc")
    return spine, materialize(going)


def _upper(spine: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of shared turns, from the sums of the subtries under them."""
    far = Window.partitionBy(*KEY).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("pos") == F.max("pos").over(Window.partitionBy(*KEY))
    top = F.col("pos") == F.col("d")
    rows = spine.join(below.withColumnsRenamed({"pka": "ka", "pkb": "kb"}), KEY)
    return rows.select(
        F.col("least").alias("conv_id"), F.col("pos").alias("depth"), F.when(top, F.col("pc")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("tops")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.sum((F.col("n_convs") - 1) * F.col("size")).over(far) + F.col("saved")).alias("saved_tokens"), F.coalesce("ended", F.lit(NOTHING)).alias("ends_sha256"), "pka", "pkb", top.alias("top"),
    )


def _sums(nodes: DataFrame) -> DataFrame:
    return nodes.where("top").groupBy("pka", "pkb").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("tops"))


def prefix_trie(ids: DataFrame, turns: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """One row for each node.  ids: conv_id of every conversation; turns: conv_id, pos, mark, size.  ``limit``: turns in a subtrie that one task may build; ``bucket``: turns that subtries are dealt into buckets by."""
    spark = session(ids.sparkSession)
    rows = materialize(with_prefixes(turns))
    found = materialize(classes(ids, rows))
    paths = materialize(rows.withColumnRenamed("conv_id", "cls").join(found.where("len > 0").select("cls"), "cls", "left_semi"))
    all_ = found.agg(F.min("cls").alias("least"), F.sum("n").alias("n"), F.sum("len").alias("turns")).collect()[0]
    if all_.least is None:
        return spark.createDataFrame([], NODE)
    nil = F.lit(None).cast("long")
    groups = found.where("len > 0").select("cls", "n", "len", "ends", *KEY, F.lit(1).cast("long").alias("d"), nil.alias("pka"), nil.alias("pkb"), F.lit(all_.least).alias("pc"))
    spines, final = [], None
    while True:
        sizes = materialize(groups.groupBy(*KEY).agg(F.sum(F.col("len") - F.col("d") + 1).alias("turns"), F.count("*").alias("classes")))
        is_over = (F.col("turns") > limit) & (F.col("classes") > 1)
        settled = groups.join(sizes.where(~is_over), KEY)
        final = settled if final is None else final.unionByName(settled)
        over = sizes.where(is_over)
        if over.isEmpty():
            break
        spine, groups = _peel(paths, groups, over)
        spines.append(spine)
    final = materialize(final)
    rows = paths.join(final, "cls").where("pos >= d")
    buckets = max(1, -(-all_.turns // bucket))
    dealt = rows.where("classes > 1").select("cls", "n", "len", "pos", "a", "b", "size", "ends", *KEY, F.coalesce("pka", F.lit(0)).alias("pka"), F.coalesce("pkb", F.lit(0)).alias("pkb"), "pc", "d", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"))
    tries = dealt.groupBy("bucket").applyInPandas(_build, f"{NODE}, pka long, pkb long, top boolean")
    plain = lambda df: df.withColumns({"pka": F.coalesce("pka", F.lit(0)).cast("long"), "pkb": F.coalesce("pkb", F.lit(0)).cast("long")})
    nodes = materialize(tries.unionByName(plain(_chains(rows.where("classes = 1")))))
    out, below = nodes, nodes
    for spine in reversed(spines):
        nodes = materialize(plain(_upper(spine, _sums(below))))
        out, below = out.unionByName(nodes), below.unionByName(nodes)
    return out.drop("pka", "pkb", "top").unionByName(_root(found, out, all_.least, all_.n))


def _root(found: DataFrame, nodes: DataFrame, least: int, n: int) -> DataFrame:
    no = F.lit(None).cast("long")
    under = nodes.where("depth = 1").select("n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    parts = under.unionByName(found.where("len = 0").select(no.alias("n_leaves"), no.alias("saved_tokens"), "ends"))
    whole = parts.agg(F.count("n_leaves").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NOTHING)).alias("ends_sha256"))
    as_long: dict[str, Column] = {"conv_id": F.lit(least), "depth": F.lit(0), "parent_conv_id": F.lit(None), "n_convs": F.lit(n)}
    return whole.select(*[c.cast("long").alias(k) for k, c in as_long.items()], *[F.col(c).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")], "ends_sha256")


def op12_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))
