"""The read side: search, tabs, facets, personal ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import millis
from ..functions.text import by_locale


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def matches_search(text: Column, query: str) -> Column:
    """Every word of the query occurs."""
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.contains(text, F.lit(term))
    return out


def tabs(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def facet_counts(df: DataFrame, column: str, leave_out: list[str] | None = None) -> DataFrame:
    rows = df.select(F.explode(column).alias("value"))
    if leave_out:
        rows = rows.where(~F.col("value").isin(leave_out))
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def apply_view(df: DataFrame, tab: str | None, query: str, dismissed: DataFrame | None = None) -> DataFrame:
    out = df.where(matches_search(F.col("search"), query))
    if tab:
        out = out.where(F.array_contains("tabs", tab))
    return out.join(dismissed, "id", "left_anti") if dismissed is not None else out


def filter_known(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all bounds, one row with how many were hidden because a bounded value is unknown)."""
    known, unknown = F.lit(True), F.lit(False)
    for c, (low, high) in bounds.items():
        x = F.col(c)
        unknown = unknown | x.isNull()
        ok = F.lit(True)
        if low is not None:
            ok = ok & (x >= low)
        if high is not None:
            ok = ok & (x <= high)
        known = known & F.coalesce(ok, F.lit(True))
    return df.where(known & ~unknown), df.agg(F.count_if(known & unknown).alias("hidden_unknown"))


def since_visit(df: DataFrame, visit: Column) -> DataFrame:
    return df.where(visit.isNull() | (F.col("first_seen") > visit) | (F.col("status") == "updated"))


def digest_items(digests: DataFrame, items: DataFrame) -> DataFrame:
    """Recommended entries with their live items; missing ones are counted by digest."""
    rows = digests.select("week_of", "vertical", F.posexplode("recommended").alias("pos", "entry")).select("week_of", "vertical", "pos", "entry.id", "entry.headline")
    return rows.join(items.select("id", F.lit(True).alias("live")), "id", "left").groupBy("week_of", "vertical").agg(F.count("*").alias("entries"), F.count_if(F.col("live").isNull()).alias("missing"))


def source_health(reports: DataFrame) -> DataFrame:
    """reports (source, error, warnings, fetch_source, item_count, failed_requests) with status, worst first: failed, degraded, unavailable (nothing was asked), ok."""
    asked = F.col("fetch_source").isNotNull() if "fetch_source" in reports.columns else F.lit(True)
    status = F.when(F.col("error").isNotNull(), "failed").when(F.size("warnings") > 0, "degraded").when(~asked, "unavailable").otherwise("ok")
    order = F.when(status == "failed", 0).when(status == "degraded", 1).when(status == "unavailable", 2).otherwise(3)
    return reports.withColumn("status", status).orderBy(order, "source")


def health_totals(reports: DataFrame) -> DataFrame:
    """One row: sources by status, items and failed requests."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "degraded", "failed", "unavailable")]
    return source_health(reports).agg(*counts, F.sum("item_count").alias("items"), F.sum("failed_requests").alias("failed_requests"))


def rss(live: DataFrame, added: DataFrame, changed: DataFrame, newest: int = 30, top: int = 50) -> DataFrame:
    """The newest live rows, those added and those changed, once each, latest first.  live: id, at."""
    fresh = live.orderBy(F.desc("at"), "id").limit(newest)
    more = live.join(added.select("id").unionByName(changed.select("id")).distinct(), "id", "left_semi")
    return fresh.unionByName(more).distinct().orderBy(F.desc("at"), "id").limit(top)


def redact(df: DataFrame, columns: list[str], guard: str) -> DataFrame:
    """Contact columns become null; any row whose ``guard`` column still holds an address fails the job."""
    from ..functions.text import EMAIL

    out = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
    return out.withColumn(guard, F.when(F.col(guard).rlike(EMAIL), F.raise_error(F.lit("an email address would be published"))).otherwise(F.col(guard)))


def calendar_link(title: Column, starts: Column, ends: Column, base: str) -> Column:
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(F.lit(base + "?action=TEMPLATE&text="), F.url_encode(title), F.lit("&dates="), stamp(starts), F.lit("/"), stamp(F.coalesce(ends, starts + F.expr("interval 1 hour"))))


RESEARCH_TABS = {"for-you": "Top", "new": "New", "preprints": "Preprints", "methods": "Methods", "mtb": "Mtb", "host": "Host / Diabetes", "tracked": "Tracked"}
CAMPUS_TABS = {
    "all": "All", "for-you": "For you", "today": "Today", "this-week": "Next 7 days", "intramurals": "Intramurals", "campus": "Campus", "companies": "Companies", "sports": "Sports", "clubs": "Clubs",
    "research-events": "Research Events", "free": "Food provided", "online": "Online", "deadlines": "Deadlines", "bcs": "B/CS", "interested": "Interested", "going": "Going",
}
STUDIES_TABS = {"all": "All", "ranked": "Ranked", "online": "Online", "inperson": "In person", "saved": "Saved"}
BAND_LABELS = {"core": "highly relevant", "adjacent": "adjacent", "methods": "methods / tools"}
CATEGORY_LABELS = {"companies": "Companies", "sports": "Sports", "clubs": "Clubs", "research": "Research Events", "academic": "Campus", "deadline": "Deadlines", "community": "B/CS"}
FOOD_LABELS = {"confirmed": "Free food confirmed", "provided": "Food provided", "mentioned": "Food mentioned", "none": ""}
CATEGORY_TABS = {"academic": "campus", "companies": "companies", "sports": "sports", "clubs": "clubs", "research": "research-events", "deadline": "deadlines", "community": "bcs"}


def label(value: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


def research_tabs(in_for_you: Column, kind: Column, band: Column, reasons: Column) -> Column:
    """Names of the tabs a paper is in.  ``in_for_you``: among the ranked few, decided by the caller."""
    has = lambda s: F.exists(reasons, lambda r: r["signal"] == s)
    return tabs({"for-you": in_for_you, "new": F.lit(True), "preprints": kind == "preprint", "methods": band == "methods", "mtb": has("organism"), "host": has("host")})


def campus_tabs(in_for_you: Column, category: Column, sources: Column, directory: str, starts: Column, now: Column, intramural: Column, tier: Column, deadline: Column, online: Column) -> Column:
    """Names of the tabs an event is in.  ``directory``: the source whose listings are all clubs' own."""
    from ..functions.dates import calendar_days_until

    days = calendar_days_until(starts, now)
    rules = {
        "for-you": in_for_you, "clubs": F.array_contains(sources, directory) & (category != "clubs"), "today": days == 0, "this-week": days.between(0, 7), "intramurals": intramural,
        "free": tier.isin("confirmed", "provided"), "deadlines": deadline.isNotNull() & (category != "deadline"), "online": online,
    }
    named = tabs(rules)
    first = F.when(F.array_contains(named, "for-you"), F.array(F.lit("for-you"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.array(label(category, CATEGORY_TABS)), F.array_remove(named, "for-you")))


def by_campus_date(starts: Column, occurred: Column, relevance: Column, id_: Column) -> list[Column]:
    """Soonest first, undated last, then by relevance and id."""
    return [F.coalesce(starts, occurred).asc_nulls_last(), relevance.desc(), id_.asc()]


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in one order over all rows, from 1: rows are dealt by range and sorted in parallel, and each range begins where the ranges before it end."""
    from ..storage import materialize

    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each range
    out = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1).drop("__at", "__part", "__before")


def recently_added(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return df.where(millis("first_seen") >= millis(now) - days * 86_400_000)


def signals_of(reasons: Column) -> Column:
    """Distinct signals with points above zero, in order."""
    return F.array_join(F.array_distinct(F.transform(F.filter(reasons, lambda r: r["points"] > 0), lambda r: r["signal"])), ",")


def find_item(items: DataFrame, id_: str, order: list[str] = ("research", "campus")) -> DataFrame:
    """The row of that id; of several verticals' the first in ``order``."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("vertical"))
    return items.where(F.col("id") == id_).orderBy(F.when(place > 0, place).asc_nulls_last()).limit(1)


def latest_digest(digests: DataFrame) -> DataFrame:
    return digests.groupBy("vertical").agg(F.max("week_of").alias("week_of"))


def of_band(df: DataFrame, band: str) -> DataFrame:
    return df.where(F.col("band") == band)


def of_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("category") == category)


def view_counts(df: DataFrame, query: str, names: list[str], dismissed: DataFrame | None = None) -> DataFrame:
    """How many rows that match the query each tab holds: tab, n, also tabs that hold none."""
    rows = apply_view(df, None, query, dismissed).select(F.explode("tabs").alias("tab")).groupBy("tab").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("tab"))
    return every.join(rows, "tab", "left").select("tab", F.coalesce("n", F.lit(0)).alias("n"))


def personal_tabs(df: DataFrame, saved: DataFrame, attending: DataFrame, tracked: DataFrame) -> DataFrame:
    """``df`` with the tabs that follow from a user's own marks (each a table of id) added to ``tabs``."""
    out = df
    for marks, name in ((saved, "interested"), (attending, "going"), (tracked, "tracked")):
        out = out.join(marks.select("id", F.lit(name).alias("__tab")).distinct(), "id", "left")
        out = out.withColumn("tabs", F.when(F.col("__tab").isNotNull(), F.array_append("tabs", F.col("__tab"))).otherwise(F.col("tabs"))).drop("__tab")
    return out


def matches_profile(category: Column, interests: Column, organizer: Column, search: Column, wanted: dict[str, list[str]]) -> Column:
    """Whether an event meets a profile: a preferred category, an interest, or a followed organiser that is named.  wanted: categories, interests, organizers (lower case)."""
    out = category.isin(wanted["categories"]) if wanted["categories"] else F.lit(False)
    if wanted["interests"]:
        out = out | F.arrays_overlap(interests, F.array(*[F.lit(x) for x in wanted["interests"]]))
    for name in wanted["organizers"]:
        out = out | F.contains(F.lower(organizer), F.lit(name)) | F.contains(search, F.lit(name))
    return F.coalesce(out, F.lit(False))


def in_tab(tab: str, tabs_: Column, profile: Column, saved: Column, attending: Column) -> Column:
    """Whether a row shows in a tab: all, the user's marks, or its own tabs; For you also takes what meets the profile."""
    named = F.array_contains(tabs_, tab)
    return {"all": F.lit(True), "interested": saved, "going": attending, "for-you": named | profile}.get(tab, named)


def studies_api(rows: DataFrame, fetched_at: Column, contact: list[str], guard: str) -> tuple[DataFrame, DataFrame]:
    """(one row of counts: total, live, ranked, fetched_at; the records without contact fields, by id).  An address left in ``guard`` fails the job."""
    meta = rows.agg(F.count("*").alias("total"), F.count_if(~F.col("is_expired")).alias("live"), F.count_if(F.col("rate").isNotNull()).alias("ranked")).withColumn("fetched_at", fetched_at)
    return meta, redact(rows, contact, guard).orderBy(F.col("id").try_cast("double").asc_nulls_last(), "id")


def profile_list(items: DataFrame, marks: DataFrame) -> DataFrame:
    """A user's marked items in the order they were marked (marks: id, pos)."""
    return items.join(marks.select("id", "pos"), "id").orderBy("pos")


def topic_counts(items: DataFrame, rules: list[dict]) -> DataFrame:
    """Items by profile term: id, label, hits; terms without hits too."""
    hits = items.select(F.explode("reasons").alias("r")).where("r.points > 0").groupBy(F.col("r.label").alias("label")).agg(F.count("*").alias("hits"))
    terms = items.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["label"]).alias("label")) for r in rules])))
    return terms.join(hits, "label", "left").select("id", "label", F.coalesce("hits", F.lit(0)).alias("hits"))


def organizer_suggestions(events: DataFrame, pinned: list[str] = (), prefix: str = "organization: ", top: int = 60) -> DataFrame:
    """Names a profile can follow: place, name, n (events that name it): the pinned ones first, then organisers, channels (array<string>, where rows have them) and organisations named in tags, most events first, then by name in the order of the locale."""
    none = F.array().cast("array<string>")
    named = F.transform(F.filter(F.coalesce("tags", none), lambda t: F.startswith(F.lower(t), F.lit(prefix))), lambda t: F.substring(t, len(prefix) + 1, F.length(t)))
    channels = F.coalesce("channels", none) if "channels" in events.columns else none
    own = F.array_compact(F.array(F.nullif(F.trim("organizer"), F.lit(""))))
    counts = events.select(F.explode(F.array_distinct(F.concat(own, channels, named))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    best = counts.where(~F.col("name").isin(list(pinned)) if pinned else F.lit(True)).orderBy(F.desc("n"), by_locale(F.col("name"))).limit(top)
    head = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(p).alias("name")) for i, p in enumerate(dict.fromkeys(pinned))]) if pinned else F.array().cast("array<struct<o:int,name:string>>")
    first = events.sparkSession.range(1).select(F.inline(head)).join(counts, "name", "left").select("o", "name", F.coalesce("n", F.lit(0)).alias("n"))
    place = F.row_number().over(Window.orderBy("o", F.desc("n"), by_locale(F.col("name"))))  # of the pinned and ``top`` more
    return first.unionByName(best.withColumn("o", F.lit(len(pinned)))).withColumn("place", place).where(F.col("place") <= top).select("place", "name", "n")


def agenda(events: DataFrame, now: Column) -> DataFrame:
    """id, day, label, place: events by civil day, in the order of ``by_campus_date`` within each, the undated in a last group of their own.  events: id, starts_at, relevance."""
    from ..functions.dates import agenda_label, day_key

    order = by_campus_date(F.col("starts_at"), F.lit(None).cast("timestamp"), F.col("relevance"), F.col("id"))
    rows = ranked(events.select("id", "starts_at", "relevance", day_key(F.col("starts_at")).alias("day")), order, "__rank")
    first = rows.groupBy("day").agg(F.min("__rank").alias("__first"))  # days follow one another, so each begins where its first event stands
    return rows.join(F.broadcast(first), "day").select("id", "day", agenda_label(F.col("starts_at"), now).alias("label"), (F.col("__rank") - F.col("__first") + 1).alias("place"))


def landing_counters(items: DataFrame, now: Column) -> DataFrame:
    """One row of the numbers a landing page shows: items and items new this week by vertical, papers by band, events today and events with free food for certain (``food``, where rows have it)."""
    from ..functions.dates import calendar_days_until

    mine = lambda v: F.col("vertical") == v
    fresh = millis("first_seen") >= millis(now) - 7 * 86_400_000
    return items.agg(
        F.count_if(mine("research")).alias("research"), F.count_if(mine("campus")).alias("campus"), F.count_if(mine("research") & fresh).alias("research_new"), F.count_if(mine("campus") & fresh).alias("campus_new"),
        F.count_if(F.col("band") == "core").alias("core"), F.count_if(F.col("band") == "methods").alias("methods"), F.count_if(mine("campus") & (calendar_days_until(F.col("starts_at"), now) == 0)).alias("today"),
        F.count_if(mine("campus") & (F.col("food.tier") == "confirmed") if "food" in items.columns else F.lit(False)).alias("free_food"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes by kind, most first."""
    return changes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def run_summary(items: DataFrame) -> DataFrame:
    """Counts by vertical and band or category, and the five most relevant of each vertical, as lines of one report: section, name, n or relevance."""
    kind = F.coalesce("band", "category")
    counts = items.groupBy(F.col("vertical").alias("section"), kind.alias("name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("vertical").orderBy(F.desc("relevance"), "id")
    top = items.withColumn("place", F.row_number().over(w)).where("place <= 5").select(F.concat("vertical", F.lit(" top")).alias("section"), F.col("title").alias("name"), F.col("relevance").cast("long").alias("n"))
    return counts.unionByName(top)


def excludes_participant_studies(items: DataFrame, registry: str, pattern: str) -> DataFrame:
    """Items that are no recruitment for a study: not from the registry, and title and summary do not speak like one."""
    told = F.lower(F.concat_ws(" ", "title", "summary")).rlike(pattern)
    return items.where(~F.coalesce(F.array_contains("sources", registry), F.lit(False)) & ~F.coalesce(told, F.lit(False)))


def sanitize_snapshot(items: DataFrame, changes: DataFrame, registry: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """An older snapshot and its changes without such items."""
    kept = excludes_participant_studies(items, registry, pattern)
    gone = items.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("item_id"))
    return kept, changes.join(gone, "item_id", "left_anti")


def rss_xml(feed: DataFrame, title: str, link: str) -> DataFrame:
    """One row with the feed as XML.  feed: guid, title, url, summary, at; the caller has cut it to its size (``rss``)."""
    from ..functions.dates import rfc822
    from ..functions.text import xml_escape

    e = lambda c: xml_escape(F.coalesce(F.col(c), F.lit("")))
    item = F.concat(F.lit("<item><guid isPermaLink=\"false\">"), e("guid"), F.lit("</guid><title>"), e("title"), F.lit("</title><link>"), e("url"), F.lit("</link><pubDate>"), rfc822(F.col("at")), F.lit("</pubDate><description>"), e("summary"), F.lit("</description></item>"))
    rows = feed.select(F.struct((-millis("at")).alias("o"), F.col("guid").alias("g"), item.alias("x")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    return rows.agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


def json_export(items: DataFrame, path: str) -> None:
    """One JSON file, rows by id, for readers that want the snapshot as a document; the size of a snapshot, not of a corpus."""
    items.orderBy("id").coalesce(1).write.mode("overwrite").json(path)
