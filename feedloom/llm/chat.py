"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

Logged conversations are often snapshots of one another: a log of the first n turns, then of n + 2, and so on.  Each conversation's
turns, in order, give rolling hashes of its prefixes (128 bits from two seeds, over place, role and text), by a running aggregate over sorted
rows, so that only a conversation that stays is ever held whole.  A conversation goes
when its whole hash is a proper prefix of a longer conversation's, or when it equals another with a smaller
conv_id; anti-joins leave the maximal ones, which are then rendered.  Hashes of prefixes, not turns, are joined: a first
turn that a third of all conversations share is one row for each, summed map-side.

Defined results: turns are ordered by turn, then role, then text; nulls sort first and render as nothing; rows without conv_id are left out;
equal rows of one conversation count once; texts of any length are hashed and rendered whole; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, session, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (ordered structs), n_turns, n_snapshots: the maximal conversations and how many logs each stands for.

    n_snapshots counts the conversation itself, its equals and the conversations that are prefixes of it.
    """
    session(conversations.sparkSession)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    this = F.struct("turn", "role", "text")
    rows = turns.withColumn("last", F.lag(this).over(order)).where(~F.col("last").eqNullSafe(this))
    rows = rows.withColumn("pos", F.row_number().over(order))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    nulls = F.when(F.col("role").isNull(), 1).otherwise(0) + F.when(F.col("text").isNull(), 2).otherwise(0)
    # a prefix's hash is the exclusive or of its turns' hashes, each of which holds its place
    far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "pos", *[F.bit_xor(F.xxhash64(F.lit(seed), "pos", nulls, *x)).over(far).alias(n) for n, seed, x in (("a", 1, (role, text)), ("b", 2, (text, role)))])
    chains = materialize(rows)
    whole = chains.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct("a", "b"), "pos").alias("h"))
    whole = whole.select("conv_id", "n_turns", "h.a", "h.b")
    unique = materialize(whole.groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    # proper prefixes of one conversation for each distinct whole
    prefixes = chains.join(unique.select("conv_id", "n_turns"), "conv_id").where(F.col("pos") < F.col("n_turns")).select("conv_id", "a", "b")
    proper = prefixes.select("a", "b").distinct()
    maximal = materialize(unique.join(proper, ["a", "b"], "left_anti").select("conv_id", "n_turns", "copies"))
    shorter = prefixes.join(maximal.select("conv_id"), "conv_id", "left_semi")
    # of the hashes, few are whole conversations: that side is the smaller one
    within = shorter.join(unique.select("a", "b", "copies"), ["a", "b"]).groupBy("conv_id").agg(F.sum("copies").alias("inner"))
    out = maximal.join(within, "conv_id", "left").select("conv_id", "n_turns", (F.col("copies") + F.coalesce("inner", F.lit(0))).alias("n_snapshots"))
    kept = turns.join(maximal.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_set(this), _order).alias("turns"))
    return kept.join(out, "conv_id")


def _order(x, y):
    def by(c, rest):
        return F.when(x[c].eqNullSafe(y[c]), rest).when(x[c].isNull(), -1).when(y[c].isNull(), 1).when(x[c] < y[c], -1).otherwise(1)

    return by("turn", by("role", by("text", F.lit(0))))


def render(collapsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_snapshots, chat: each turn as role and text between markers."""
    turn = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))
    return collapsed.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_snapshots").cast("long").alias("n_snapshots"), F.array_join(F.transform("turns", turn), "").alias("chat"))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return render(collapse(table(spark, sf_dir, "conversations")))
