"""From source rows to a ranked list, by vertical: normalise, resolve duplicates, score, cut, enrich.

Rows of all connectors of a vertical come in one table.  Ids follow from identity, never from content, so that an edit changes the content hash and not the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import millis
from ..functions.text import canonical_title, clamp, strip_emails
from ..storage import materialize
from . import classify, collapse, score, studies

# How far each source is trusted alone.
TRUST = {"europepmc": 0.95, "pubmed": 0.95, "crossref": 0.93, "openalex": 0.90, "biorxiv": 0.90, "medrxiv": 0.90, "arxiv": 0.90, "calendar": 0.90, "leagues": 0.90, "listing": 0.85}
KEEP_FINISHED_HOURS = 18


def trust(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TRUST.items() for x in p]), source), F.lit(0.8))


def normalize(raw: DataFrame, vertical: str, now: Column) -> DataFrame:
    """Items from raw rows (source, identity, title, summary or abstract, ...) that have a title and an identity; addresses of people leave the text.

    Adds id, member (tells rows apart; wholly equal rows count once), ord, vertical, summary, content_hash, first_seen, sources, source_refs (where rows bring an external_id), title_words, confidence.
    ``ord``: a connector's own input order if rows bring one, otherwise the order of ``member``.
    """
    body = F.col("abstract") if "abstract" in raw.columns else F.col("summary")
    rows = raw.where("coalesce(title, '') <> '' and size(identity) > 0")
    key = F.array_min("identity")
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    member = F.concat_ws("|", "source", key, F.sha2(F.to_json(F.struct(*plain)), 256))
    rows = rows.withColumn("member", member).dropDuplicates(["member"])
    if "external_id" in raw.columns:
        rows = rows.withColumn("source_refs", F.array(F.struct("source", "external_id")))
    return rows.withColumns({
        "id": F.concat(F.lit(vertical + "-"), F.substring(F.sha2(key, 256), 1, 12)), "ord": F.col("ord").cast("long") if "ord" in raw.columns else F.lit(0).cast("long"), "vertical": F.lit(vertical), "title": strip_emails(F.col("title")),
        "summary": clamp(strip_emails(F.coalesce(body, F.lit(""))), 400), "first_seen": now, "sources": F.array("source"), "title_words": canonical_title(F.col("title")), "confidence": trust(F.col("source")),
    }).withColumn("content_hash", content_hash(raw.columns))


def content_hash(columns: list[str]) -> Column:
    """Of the fields whose change is news, as far as rows have them."""
    watched = [c for c in ("title", "starts_at", "ends_at", "location", "is_cancelled", "has_registration", "preprint_version", "published_doi") if c in columns]
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in watched], "summary")), 256)


#: How the fields of members that turn out to be one thing are merged; a field that rows don't bring is left out.
SHARED = {"sources": "union", "source_refs": "union", "identity": "sorted_union", "tags": "folded_union", "summary": "longest", "first_seen": "least", "last_seen": "most", "last_modified": "most", "occurred_at": "first", "ends_at": "first"}
PAPERS = {
    "doi": "first", "pmid": "first", "pmcid": "first", "arxiv_id": "first", "openalex_id": "first", "journal": "first", "authors": "longest", "abstract": "longest", "published_date": "first", "cited_by": "peak", "is_open_access": "any",
    "open_access_url": "first", "topics": "longest", "preprint_version": "positive", "published_doi": "first", "published_in": "first", "is_superseded": "any", "references": "longest",
}
EVENTS = {
    "starts_at": "first", "location": "first", "coordinates": "first", "organizer": "first", "online_url": "first", "is_cancelled": "any", "is_online": "any", "has_registration": "any", "audience": "longest", "event_types": "union",
    "companies": "union", "food": lambda f: classify.food_rank(f["tier"]), "cost": "first", "compensation": "first", "compensation_usd": "first", "deadline_at": "first",
}


def resolve(items: DataFrame, rank: Column, policies: dict) -> DataFrame:
    """One row for each cluster of the same thing, merged from all members; fields without a policy are the winner's.

    Members go by ``rank``, the highest first, then by input order.  Rows of one id are tied like any others that share an identity key, so each keeps its part in the merge.
    """
    rows = items.withColumn("__rank", rank).withColumnsRenamed({"id": "item_id", "member": "id"})
    clusters = collapse.dedupe(rows)
    own = ["cluster", "id", "members", "__rank"]
    every = {c: policies.get(c, "winner") for c in clusters.columns if c not in own}
    merged = collapse.merge_members(clusters, F.struct((-F.col("__rank")).alias("r"), F.col("ord").alias("n"), F.col("id").alias("m")), every)
    out = merged.drop(*own).withColumnRenamed("item_id", "id")
    return out.withColumn("source_confidence", collapse.merged_confidence(F.array_max(F.transform("sources", trust)), F.size("sources")))


def research(raw: DataFrame, metadata: DataFrame | None, now: Column, **context) -> DataFrame:
    """Papers that match the profile and clear its floor, with metadata by DOI, the most relevant first.  ``context``: as in ``score.score_research``."""
    from ..sources.feeds import enrich

    items = normalize(raw, "research", now).withColumn("occurred_at", F.col("published_date"))
    rank = collapse.canonical_rank(F.col("confidence"), F.coalesce("abstract", F.lit("")), F.size(F.coalesce("authors", F.array().cast(items.schema["authors"].dataType))), F.lit(None), F.lit(None))
    one = resolve(items.withColumn("organizer", F.lit(None).cast("string")), rank, SHARED | PAPERS)
    linked = collapse.link_preprints(one)
    scored = score.score_research(linked, now, **context)
    kept = scored.where(score.passes_floor(F.col("relevance"), F.col("band"), F.col("reasons")))
    return (enrich(kept, metadata) if metadata is not None else kept).orderBy(*score.by_relevance(F.col("vertical"), F.col("relevance"), F.col("occurred_at"), F.col("id")))


def facets(events: DataFrame, hay: str) -> DataFrame:
    """``events`` with companies, food, category (unless a source settles it) and the deadline that a listing of deadlines is.  Written down: each of them is read many times by what follows."""
    h = F.col(hay)
    from ..functions.text import padded

    named = events.withColumns({"companies": classify.companies(h), "food": classify.freebies(h, F.col("cost"))})
    told = classify.category(h, F.col("organizer"), F.col("companies"), padded(F.array_join("event_types", " ")))
    named = named.withColumn("category", F.coalesce("category", told) if "category" in events.columns else told)
    return materialize(named.withColumn("deadline_at", F.coalesce("deadline_at", F.when(F.col("category") == "deadline", F.col("starts_at")))))


def campus(raw: DataFrame, now: Column, registry: str, directory: str, complete: str, festival: dict | None = None, **context) -> DataFrame:
    """Events still ahead that clear the floor, or are cancelled, or come from a schedule that is shown whole, the most relevant first.

    ``registry``: the source of study listings, which are another vertical's; ``directory``: the clubs' own source; ``complete``: the source shown whole; ``festival``: arguments of
    ``collapse.collapse_co_marketed``.  raw: source, identity, title, summary, organizer, starts_at, ends_at, deadline_at, location, cost, tags, event_types, is_cancelled, is_online, has_registration.
    """
    from ..functions.text import padded

    mine = raw.where(~classify.seeks_participants(F.col("title"), F.col("summary"), F.col("tags"), F.lit(None).cast("string"), F.col("source"), registry))
    hay = padded(F.col("title"), F.col("summary"))
    named = facets(mine.withColumn("__hay", hay), "__hay").drop("__hay")
    items = normalize(named, "campus", now).withColumn("occurred_at", F.col("starts_at"))
    rank = collapse.canonical_rank(F.col("confidence"), F.lit(""), F.lit(0), F.col("location"), F.col("starts_at"))
    one = resolve(items, rank, SHARED | EVENTS)
    if festival:
        one = collapse.collapse_co_marketed(one, **festival, policies=SHARED | EVENTS)
        many = F.col("members") > 1
        one = one.withColumns({"category": F.when(many, "clubs").otherwise(F.col("category")), "content_hash": F.when(many, content_hash(raw.columns)).otherwise(F.col("content_hash"))}).drop("members")
    keys = ["title_words", "organizer", "location"]
    dated = one.where("starts_at is not null and size(title_words) > 0")
    series = collapse.collapse_series(dated, keys, "starts_at", "ends_at").select("id", F.col("ends_at").alias("__ends"), "series_count")
    off = F.bool_or(F.coalesce("is_cancelled", F.lit(False))).over(Window.partitionBy(*keys))
    folded = dated.withColumn("__off", off).join(series, "id").withColumn("is_cancelled", F.when(F.col("series_count") > 1, F.col("__off")).otherwise(F.col("is_cancelled"))).drop("__off")
    folded = folded.withColumn("ends_at", F.when(F.col("series_count") > 1, F.col("__ends")).otherwise(F.col("ends_at"))).drop("__ends")
    rest = one.where("starts_at is null or size(title_words) = 0").withColumn("series_count", F.lit(1).cast("long"))
    scored = score.score_campus(folded.unionByName(rest), now, **context)
    kept = scored.where(still_ahead(F.col("starts_at"), F.col("ends_at"), now) & above_floor(F.col("relevance"), F.col("is_cancelled"), F.col("sources"), complete))
    return kept.orderBy(*score.by_relevance(F.col("vertical"), F.col("relevance"), F.coalesce("starts_at", "occurred_at"), F.col("id")))


def still_ahead(starts: Column, ends: Column, now: Column, hours: int = KEEP_FINISHED_HOURS) -> Column:
    """False where an event ended more than ``hours`` ago; undated ones stay."""
    end = F.coalesce(ends, starts)
    return F.coalesce(millis(end) >= millis(now) - hours * 3_600_000, F.lit(True))


def above_floor(relevance: Column, cancelled: Column, sources: Column, complete: str) -> Column:
    """Relevant enough, or cancelled (someone may have planned to go), or of a source that is shown whole."""
    return (relevance >= score.FLOOR) | F.coalesce(cancelled, F.lit(False)) | F.array_contains(sources, complete)


def study_list(raw: DataFrame, now: Column, terms: Column | None = None) -> DataFrame:
    """Study listings, normalised, with duplicates named: ``duplicate_of`` is null for those to show."""
    return studies.dedupe_studies(studies.normalize(raw, now, terms).withColumn("title", F.col("plain_title")))


def study_run(raw: DataFrame, now: Column, terms: Column | None = None, **readers) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listings as ``study_list`` gives them, quarantine, warnings: one line for each reason with its number of listings)."""
    rows, bad = studies.normalize_all(raw, now, terms, **readers)
    lines = bad.groupBy("error").agg(F.count("*").alias("n")).select(F.concat(F.col("n").cast("string"), F.lit(" listing(s) could not be read: "), "error").alias("warning"))
    lines = lines.unionByName(rows.where("degraded is not null").groupBy("degraded").agg(F.count("*").alias("n")).select(F.concat(F.col("n").cast("string"), F.lit(" listing(s) kept with criteria by age alone: "), "degraded").alias("warning")))
    return studies.dedupe_studies(rows.withColumn("title", F.col("plain_title"))), bad, lines
