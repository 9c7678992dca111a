"""Snapshots: what changed, what is kept, what a week brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_of


def last_of(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id: of a repeated one the last by ``ord``, or by content where rows have no order; so a table with repeats counts each thing once."""
    x = F.struct(*rows.columns)
    plain = F.to_json(x)
    place = F.struct("ord", plain) if "ord" in rows.columns else plain
    return rows.groupBy(F.col(key).alias("__id")).agg(F.max_by(x, place).alias("x")).select("x.*")


def by_id(key: str = "id") -> list[Column]:
    """Order of ids: whole numbers by value, before all others by code point."""
    number = F.when(F.col(key).cast("string").rlike(r"^\d+$"), F.col(key).cast("decimal(38,0)"))
    return [number.asc_nulls_last(), F.col(key).cast("string")]


def diff(before: DataFrame, after: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One row for each id of either side: kind (added, removed, changed, unchanged) and the fields that changed.  Blank equals null; of an id that a side repeats, the last row counts (``last_of``)."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    one = lambda rows: last_of(rows.select(*dict.fromkeys([key, *fields, *(["ord"] if "ord" in rows.columns else [])])), key)
    b = one(before).select(F.col(key), F.lit(True).alias("was"), *[F.col(f).alias(f"b_{f}") for f in fields])
    a = one(after).select(F.col(key), F.lit(True).alias("now"), *[F.col(f).alias(f"a_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~blank(F.col(f"b_{f}")).eqNullSafe(blank(F.col(f"a_{f}"))), F.lit(f)) for f in fields]))
    joined = b.join(a, key, "full_outer").withColumn("fields", F.when(F.col("was") & F.col("now"), changed).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size("fields") > 0, "changed").otherwise("unchanged")
    return joined.select(key, kind.alias("kind"), "fields")


def status(was: Column, cancelled: Column, superseded: Column, hash_before: Column, hash_after: Column, n_changes: Column) -> Column:
    return F.when(~was, "new").when(cancelled, "cancelled").when(superseded, "superseded").when((hash_before != hash_after) | (n_changes > 0), "updated").otherwise("unchanged")


def item_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Typed change rows (id, kind, field, before, after) for the watched fields of items."""
    b, a = before.alias("b"), after.alias("a")
    old, new = (lambda f: F.col(f"b.{f}")), (lambda f: F.col(f"a.{f}"))

    def change(cond: Column, kind: str, field: str) -> Column:
        text = lambda c: c.cast("string")
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text(old(field)).alias("before"), text(new(field)).alias("after")))

    differ = lambda f: ~old(f).eqNullSafe(new(f))
    on = lambda f: F.coalesce(new(f), F.lit(False)) & ~F.coalesce(old(f), F.lit(False))
    off = lambda f: F.coalesce(old(f), F.lit(False)) & ~F.coalesce(new(f), F.lit(False))
    said = lambda cond, kind, field, was, now: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), was.alias("before"), now.alias("after")))
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    to = F.coalesce(new("published_in") if "published_in" in after.columns else F.lit(None), new("published_doi"))
    rules = [
        change(differ("title"), "title", "title"), said(on("is_cancelled"), "cancelled", "status", F.lit("scheduled"), F.lit("cancelled")), said(off("is_cancelled"), "uncancelled", "status", F.lit("cancelled"), F.lit("back on")),
        change(differ("location"), "location", "location"), change(differ("starts_at"), "time", "starts_at"), said(on("has_registration"), "registration-opened", "registration", F.lit("not open"), F.lit("open")),
        said(new("preprint_version") > old("preprint_version"), "preprint-revised", "preprint_version", v(old("preprint_version")), v(new("preprint_version"))),
        said(old("published_doi").isNull() & new("published_doi").isNotNull(), "preprint-published", "publication", F.lit("preprint"), to),
    ]
    found = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"a.{key}").alias("item_id"), F.explode(F.array_compact(F.array(*rules))).alias("c"))
    return found.select("item_id", "c.*")


def carry_forward(sources: DataFrame, previous: DataFrame) -> DataFrame:
    """Provenance rows take the first_seen that the snapshot before had for (source, external_id); where it names a pair more than once, the latest ``ord`` or else the earliest time."""
    seen = F.max_by("first_seen", "ord") if "ord" in previous.columns else F.min("first_seen")
    old = previous.groupBy("source", "external_id").agg(seen.alias("seen"))
    return sources.join(old, ["source", "external_id"], "left").withColumn("first_seen", F.coalesce("seen", "first_seen")).drop("seen")


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with status and the first_seen it had.  Both: id, title, content_hash, first_seen, is_superseded and the fields that ``item_changes`` watches."""
    n = item_changes(before, after).groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("__n"))
    old = before.select("id", F.lit(True).alias("__was"), F.col("content_hash").alias("__hash"), F.col("first_seen").alias("__seen"))
    rows = after.join(old, "id", "left").join(n, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    told = status(no("__was"), no("is_cancelled"), no("is_superseded"), F.col("__hash"), F.col("content_hash"), F.coalesce("__n", F.lit(0)))
    return rows.withColumns({"status": told, "first_seen": F.coalesce("__seen", "first_seen")}).drop("__was", "__hash", "__seen", "__n")


def summary(kinds: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: added, removed, changes, cancelled, published, is_empty and a line of text, from ``diff`` and ``item_changes``."""
    a = kinds.agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))
    c = changes.agg(F.count("*").alias("changes"), F.count_if(F.col("kind") == "cancelled").alias("cancelled"), F.count_if(F.col("kind") == "preprint-published").alias("published"))
    said = [F.concat(F.col(n).cast("string"), F.lit(t)) for n, t in (("added", " added"), ("removed", " removed"), ("changes", " change(s)"))]
    said += [F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(t))) for n, t in (("cancelled", " cancelled"), ("published", " preprint(s) published"))]
    return a.crossJoin(c).withColumns({"is_empty": (F.col("added") + F.col("removed") + F.col("changes")) == 0, "text": F.concat_ws(", ", *said)})  # one row each


def digest_history(digests: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Digests without those of runs that read nothing (scanned is 0) or that ``broken`` names by vertical and week_of."""
    out = digests.where(F.coalesce("scanned", F.lit(0)) > 0)
    return out.join(broken, ["vertical", "week_of"], "left_anti") if broken is not None else out


def retain(previous: DataFrame, current: DataFrame, impaired: DataFrame, key: str = "id") -> DataFrame:
    """Items absent now, all of whose sources are impaired, stay with status unchanged.  items: key, sources array<string>."""
    gone = previous.join(current.select(key), key, "left_anti").where(F.size("sources") > 0)
    bad = gone.select(key, F.explode("sources").alias("source")).join(impaired.select("source", F.lit(1).alias("bad")).distinct(), "source", "left")
    keep = bad.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("b")).where("n = b").select(key)
    kept = gone.join(keep, key, "left_semi").withColumn("status", F.lit("unchanged"))
    return current.unionByName(kept, allowMissingColumns=True)


def weekly_digest(items: DataFrame, week: Column, top: int = 6) -> DataFrame:
    """Items first seen in a week, not cancelled, the most relevant few by week and vertical."""
    from .score import by_relevance

    when = F.coalesce("starts_at", "occurred_at") if "starts_at" in items.columns else F.col("occurred_at") if "occurred_at" in items.columns else F.lit(None).cast("timestamp")
    w = Window.partitionBy("week_of", "vertical").orderBy(*by_relevance(F.col("vertical"), F.col("relevance"), when, F.col("id")))
    rows = items.where(~F.coalesce(F.col("is_cancelled"), F.lit(False))).withColumn("week_of", week_of(week))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


ENTRY = ["place", "id", "headline", "minutes"]


def build_digests(items: DataFrame, week: Column, changes: DataFrame, top: int = 6) -> DataFrame:
    """One row for each week and vertical: scanned, candidates, entries array<struct<place, id, headline, minutes>>, minutes, changes array<struct<item_id, kind>>.

    items: id, vertical, relevance, is_cancelled, reasons, summary, text (what there is to read), is_candidate (whether it cleared the floor); changes: week_of, vertical, item_id, kind.  Scanned and
    candidates count all items of the week; entries are the few that ``weekly_digest`` chooses among the candidates, with minutes to read for research and none for events.
    """
    from . import score

    rows = items.withColumn("week_of", week_of(week))
    counts = rows.groupBy("week_of", "vertical").agg(F.count("*").alias("scanned"), F.count_if("is_candidate").alias("candidates"))
    best = weekly_digest(items.where("is_candidate"), week, top)
    minutes = F.when(F.col("vertical") == "research", score.reading_minutes(F.col("text"))).otherwise(0)
    told = best.select("week_of", "vertical", F.struct(F.col("place").cast("int").alias("place"), F.col("id").cast("string").alias("id"), score.headline(F.col("reasons"), F.col("summary")).alias("headline"), minutes.alias("minutes")).alias("e"))
    entries = told.groupBy("week_of", "vertical").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    happened = changes.groupBy("week_of", "vertical").agg(F.array_sort(F.collect_list(F.struct("item_id", "kind"))).alias("changes"))
    out = counts.join(entries, ["week_of", "vertical"], "left").join(happened, ["week_of", "vertical"], "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = out.withColumns({"entries": none("entries", "array<struct<place:int,id:string,headline:string,minutes:int>>"), "changes": none("changes", "array<struct<item_id:string,kind:string>>")})
    return out.withColumn("minutes", _minutes(F.col("entries")))


def _minutes(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0), lambda s, e: s + F.coalesce(e["minutes"], F.lit(0)))


def without_items(digests: DataFrame, gone: DataFrame) -> DataFrame:
    """``digests`` with the entries and changes of ``gone`` (id) taken out: the others keep their order and headlines, and the minutes are what is left."""
    lost = gone.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("lost")).distinct()
    keys = ["week_of", "vertical"]
    named = digests.select(*keys, F.explode(F.array_distinct(F.concat(F.transform("entries", lambda e: e["id"]), F.transform("changes", lambda c: c["item_id"])))).alias("id"))
    hit = named.join(lost, "id").groupBy(*keys).agg(F.collect_list("id").alias("__lost"))  # at most a digest's own entries and changes
    rows = digests.join(hit, keys, "left").withColumn("__lost", F.coalesce("__lost", F.array().cast("array<string>")))
    stays = lambda i: ~F.array_contains(F.col("__lost"), i)
    rows = rows.withColumns({"entries": F.filter("entries", lambda e: stays(e["id"])), "changes": F.filter("changes", lambda c: stays(c["item_id"]))})
    return rows.withColumn("minutes", _minutes(F.col("entries"))).drop("__lost")


def merge_digests(old: DataFrame, new: DataFrame, keep: int = 104) -> DataFrame:
    """Upsert by (vertical, week_of): the new one wins; the latest ``keep`` stay, of all verticals together."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    last = both.withColumn("rn", F.row_number().over(Window.partitionBy("vertical", "week_of").orderBy(F.desc("version")))).where("rn = 1").drop("rn", "version")
    return last.orderBy(F.desc("week_of"), "vertical").limit(keep)
