"""Additive, explainable scores: every point belongs to a named reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_days_until, millis
from ..functions.text import by_locale, first_words, has_any, js_round, let, searchable
from ..rules import interests

FOR_YOU, FLOOR, ADJACENT_FLOOR = 55, 12, 30
CONTENT = ["organism", "method", "topic", "host", "domain"]


def reason(signal: str, label: Column | str, points: Column | int) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    return F.struct(F.lit(signal).alias("signal"), as_col(label).alias("label"), js_round(as_col(points)).cast("int").alias("points"))


def reasons(*rules: tuple[Column, Column]) -> Column:
    """(condition, reason) pairs as an array of those that hold."""
    return F.array_compact(F.array(*[F.when(c, r) for c, r in rules]))


def finalize(points: Column) -> Column:
    """Reasons' points summed, rounded, held between 0 and 100."""
    total = F.aggregate(points, F.lit(0.0), lambda s, r: s + r["points"])
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(total))).cast("int")


def tidy(df: DataFrame, key: str, column: str = "reasons") -> DataFrame:
    """Sum points by signal and label, drop zeros, order by size then label."""
    rows = df.select(key, F.explode(column).alias("r")).groupBy(key, "r.signal", "r.label").agg(F.sum("r.points").cast("int").alias("points")).where("points <> 0")
    back = F.array_sort(F.collect_list(F.struct((-F.abs("points")).alias("o"), by_locale(F.col("label")).alias("k"), "label", "signal", "points")))
    return rows.groupBy(key).agg(F.transform(back, lambda r: F.struct(r["signal"].alias("signal"), r["label"].alias("label"), r["points"].alias("points"))).alias(column))


def recency_points(published: Column, now: Column) -> Column:
    """By civil days since publication; a date still to come counts as new."""
    d = -calendar_days_until(published, now)
    return F.when(d <= 3, 10).when(d <= 14, 7).when(d <= 45, 4).when(d <= 180, 1).when(d <= 730, F.lit(None)).when(d.isNotNull(), -6)


def _told(points: Column, signal: str, names: dict[int, str]) -> Column:
    """A reason named by its points."""
    label = F.lit(None).cast("string")
    for n, name in names.items():
        label = F.when(points == n, name).otherwise(label)
    return reason(signal, label, points)


def recency(published: Column, now: Column) -> Column:
    d = -calendar_days_until(published, now)
    label = F.when(d < 0, "just posted").when(d <= 3, "very recent").when(d <= 14, "recent").when(d <= 45, "this month").when(d <= 180, "this year").otherwise("older work")
    return reason("recency", label, recency_points(published, now))


def imminence(starts: Column, now: Column) -> Column:
    return _told(imminence_points(starts, now), "timing", {-60: "already happened", 6: "happening now", 14: "today", 12: "tomorrow", 9: "this week", 5: "in the next 3 weeks", 2: "later this term", -2: "far out"})


def cancellation_points(cancelled: Column) -> Column:
    return F.when(cancelled, -45)


def imminence_points(starts: Column, now: Column) -> Column:
    d = calendar_days_until(starts, now)
    return F.when(d < -1, -60).when(d < 0, 6).when(d == 0, 14).when(d == 1, 12).when(d <= 7, 9).when(d <= 21, 5).when(d <= 60, 2).when(d.isNotNull(), -2)


def deadline_points(deadline: Column, now: Column) -> Column:
    d = calendar_days_until(deadline, now)
    return F.when(d < 0, -60).when(d <= 7, 10).when(d <= 30, 4)


def corroboration_points(distinct_sources: Column) -> Column:
    return F.when(distinct_sources > 1, F.least(F.lit(6), 3 * (distinct_sources - 1)))


def food_points(confidence: Column) -> Column:
    return F.when(confidence == "confirmed", 8).when(confidence == "provided", 5)


def band(points: Column) -> Column:
    """core, methods or adjacent from an array of (signal, band, weight) matches."""
    total = lambda b: F.aggregate(F.filter(points, lambda m: m["band"] == b), F.lit(0), lambda s, m: s + m["weight"])
    core, methods = total("core"), total("methods")
    organism = F.exists(points, lambda m: m["signal"] == "organism")
    return F.when((organism & (core >= 24)) | (core >= 45), "core").when(methods >= 18, "methods").otherwise("adjacent")


def matches(hay: Column, rules: list[dict]) -> Column:
    """Rules (label, band, signal, weight, patterns) that a padded text meets, at most once each, in rule order."""
    if not rules:
        return F.array().cast("array<struct<signal:string,label:string,band:string,weight:int>>")
    return let(hay, lambda h: let(first_words(h, [p for r in rules for p in r["patterns"]]), lambda seen: _matches(h, seen, rules)))


def _matches(hay: Column, seen: Column, rules: list[dict]) -> Column:
    hit = lambda r: F.when(has_any(hay, r["patterns"], seen), F.struct(F.lit(r["signal"]).alias("signal"), F.lit(r["label"]).alias("label"), F.lit(r["band"]).alias("band"), F.lit(r["weight"]).alias("weight")))
    return F.array_compact(F.array(*[hit(r) for r in rules]))


def reasons_of(*found: Column) -> Column:
    """Reasons whose points are null did not fire."""
    return F.filter(F.array(*found), lambda r: r["points"].isNotNull())


def _profile_reasons(matched: Column) -> Column:
    return F.transform(matched, lambda m: F.struct(m["signal"].alias("signal"), m["label"].alias("label"), m["weight"].cast("int").alias("points")))


def tidied(all_reasons: Column) -> Column:
    """Points summed by signal and label, without zeros, the largest first, then by label in the order of the locale; one pass over sorted reasons, no shuffle."""
    none = F.array().cast("array<struct<signal:string,label:string,points:int>>")
    one = lambda r, points: F.struct(r["signal"].alias("signal"), r["label"].alias("label"), points.alias("points"))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce((last["signal"] == r["signal"]) & (last["label"] == r["label"]), F.lit(False))
        return F.when(same, F.array_append(F.slice(acc, 1, F.size(acc) - 1), one(r, last["points"] + r["points"]))).otherwise(F.array_append(acc, one(r, r["points"])))

    summed = F.aggregate(F.array_sort(F.transform(all_reasons, lambda r: one(r, r["points"]))), none, step)
    back = F.array_sort(F.transform(F.filter(summed, lambda r: r["points"] != 0), lambda r: F.struct((-F.abs(r["points"])).alias("o"), by_locale(r["label"]).alias("k"), r["label"].alias("label"), r["signal"].alias("signal"), r["points"].alias("points"))))
    return F.transform(back, lambda r: one(r, r["points"]))


def _with_score(df: DataFrame, hay: Column, rules: list[dict], more, banded: bool) -> DataFrame:
    """Adds reasons, relevance and, where asked for, band; ``more``: further reasons from the matches."""

    def body(m: Column) -> Column:
        found = tidied(F.concat(_profile_reasons(m), more(m)))
        return F.struct(found.alias("reasons"), *([band(m).alias("band")] if banded else []))

    # a generator: filters on the score stay above it, so texts are matched once however often the score is read
    rows = df.select("*", F.inline(F.array(let(matches(hay, rules), body))))
    return rows.withColumn("relevance", finalize(F.col("reasons")))


def score_research(items: DataFrame, now: Column, rules: list[dict] | None = None, muted: list[str] = (), tracked: list[str] = (), authors: list[str] = (), labs: list[str] = (), folded: bool = False) -> DataFrame:
    """``items`` with reasons, relevance and band.

    items: title, abstract, published_date, occurred_at, references array<string>, authors array<struct<name, affiliation>>, is_open_access, open_access_url,
    published_doi, preprint_version, kind, sources array<string>.  ``tracked``: ids of works, ``authors`` and ``labs``: names, all of one user.
    """
    rules = [r for r in rules or interests.RESEARCH if r["id"] not in muted]
    c, n = F.col, F.lit(None).cast("int")
    has = lambda m, s: F.exists(m, lambda x: x["signal"] == s)
    cites = F.size(F.array_intersect(F.coalesce(c("references"), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in tracked]).cast("array<string>")))
    first = lambda field, names: F.try_element_at(F.filter(c("authors"), lambda a: F.coalesce(F.lower(a[field]).isin([x.lower() for x in names]) if names else F.lit(False), F.lit(False))), F.lit(1))[field]
    who, lab = first("name", authors), first("affiliation", labs)
    version = F.coalesce(c("preprint_version"), F.lit(1))
    sources = F.size(F.array_distinct("sources"))
    more = lambda m: reasons_of(
        reason("combination", "selection methods applied to Mtb", F.when(has(m, "organism") & has(m, "method"), 12).otherwise(n)),
        reason("combination", "TB + host metabolic angle", F.when(has(m, "organism") & has(m, "host"), 10).otherwise(n)),
        recency(F.coalesce("published_date", "occurred_at"), now),
        reason("citation", F.concat(F.lit("cites "), cites.cast("string"), F.when(cites == 1, " paper").otherwise(" papers"), F.lit(" you saved")), F.when(cites > 0, F.least(F.lit(16), cites * 6))),
        reason("author", F.concat(F.lit("watched author: "), who), F.when(who.isNotNull(), 14)),
        reason("lab", F.concat(F.lit("watched lab: "), lab), F.when(lab.isNotNull(), 10)),
        reason("access", "open access", F.when(c("is_open_access") & c("open_access_url").isNotNull(), 4)),
        reason("lifecycle", F.when(c("published_doi").isNotNull(), "preprint now published").otherwise(F.concat(F.lit("revised preprint (v"), version.cast("string"), F.lit(")"))), F.when(c("published_doi").isNotNull(), -8).when((c("kind") == "preprint") & (version > 1), 5)),
        reason("sources", F.concat(sources.cast("string"), F.lit(" sources confirm")), corroboration_points(sources)),
        reason("evidence", "title only - no abstract available", F.when(F.length(F.coalesce("abstract", F.lit(""))) < 80, -6)),
    )
    return _with_score(items, searchable(c("title"), c("abstract"), folded=folded), rules, more, True)


def score_campus(items: DataFrame, now: Column, rules: list[dict] | None = None, muted: list[str] = (), watched: list[str] = (), folded: bool = False) -> DataFrame:
    """``items`` with reasons and relevance.

    items: title, summary, organizer, event_types array<string>, companies array<string>, food struct<tier, items>, starts_at, deadline_at, is_online,
    is_cancelled, sources array<string>.  ``watched``: employers that the user follows.
    """
    rules = [r for r in rules or interests.CAMPUS if r["id"] not in muted]
    c = F.col
    followed = F.filter(c("companies"), lambda x: F.lower(x).isin([w.lower() for w in watched]) if watched else F.lit(False))
    dated = c("starts_at").isNotNull()
    closing = F.when(~dated, deadline_points(c("deadline_at"), now))
    sources = F.size(F.array_distinct("sources"))
    tier = c("food")["tier"]
    more = lambda _: reasons_of(
        reason("company", F.when(F.size(followed) > 0, F.concat(F.lit("tracking "), F.array_join(followed, ", "))).otherwise(F.concat(F.lit("employer: "), F.array_join(F.slice("companies", 1, 2), ", "))), F.when(F.size(followed) > 0, 18).when(F.size("companies") > 0, 10)),
        reason("food", F.when(tier == "confirmed", F.concat(F.lit("free food: "), F.array_join(F.slice(c("food")["items"], 1, 2), ", "))).otherwise("food provided"), food_points(tier)),
        imminence(c("starts_at"), now),
        _told(closing, "timing", {-60: "closed", 10: "closes within a week", 4: "closes this month"}),
        reason("format", "online", F.when(c("is_online"), 2)),
        reason("status", "cancelled", cancellation_points(c("is_cancelled"))),
        reason("sources", F.concat(sources.cast("string"), F.lit(" sources confirm")), corroboration_points(sources)),
    )
    hay = searchable(c("title"), c("summary"), c("organizer"), F.array_join("event_types", " "), folded=folded)
    return _with_score(items, hay, rules, more, False)


def match_phrases(df: DataFrame, key: str, words: str, lexicon: DataFrame, longest: int = 4) -> DataFrame:
    """Lexicon hits by equi-join on word n-grams instead of a nested loop: (key, id, weight), each id once.

    Runs of ``longest`` words are first held against the beginnings of the lexicon's phrases (two words, or one where a phrase has no more), and only those that begin like a phrase are cut into all their lengths.
    """
    w, parts = F.col(words), lambda c, n: F.substring_index(c, " ", n)
    shortest = lexicon.agg(F.min(F.size(F.split("phrase", " ")))).first()[0]
    n = min(2, shortest or 1, longest)
    runs = F.transform(F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(""))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, longest)]))
    places = df.where(w.isNotNull()).select(key, F.explode(F.array_distinct(runs)).alias("run")).withColumn("head", parts(F.col("run"), n))
    likely = places.join(lexicon.select(parts(F.col("phrase"), n).alias("head")).distinct(), "head", "left_semi")
    grams = likely.select(key, F.explode(F.array_distinct(F.array(*[parts(F.col("run"), k) for k in range(1, longest + 1)]))).alias("phrase"))
    return grams.join(lexicon, "phrase").groupBy(key, "id").agg(F.max("weight").alias("weight"))


def passes_floor(relevance: Column, band_: Column, why: Column) -> Column:
    content = F.exists(why, lambda r: (r["points"] > 0) & r["signal"].isin(CONTENT))
    return content & (relevance >= F.when(band_ == "adjacent", ADJACENT_FLOOR).otherwise(FLOOR))


def adjusted(relevance: Column, signals: Column, bias: Column) -> Column:
    """Relevance plus the user's bias for each signal, held between 0 and 100."""
    extra = F.aggregate(signals, F.lit(0), lambda s, x: s + F.coalesce(F.try_element_at(bias, x), F.lit(0)).cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(100), relevance + extra))


def by_relevance(vertical: Column, relevance: Column, when: Column, id_: Column) -> list[Column]:
    ms = millis(when)
    return [relevance.desc(), F.when(vertical == "campus", ms).otherwise(-ms).asc_nulls_last(), id_.asc()]


def for_you(df: DataFrame, least: int = FOR_YOU, top: int = 15) -> DataFrame:
    """The ``top`` rows that reach ``least``, in the order of ``by_relevance``.  df: id, vertical, relevance, occurred_at and, for events, starts_at."""
    when = F.coalesce("starts_at", "occurred_at") if "starts_at" in df.columns else F.col("occurred_at")
    return df.where(F.col("relevance") >= least).orderBy(*by_relevance(F.col("vertical"), F.col("relevance"), when, F.col("id"))).limit(top)


def headline(why: Column, summary: Column) -> Column:
    best = F.slice(F.filter(why, lambda r: r["points"] > 0), 1, 3)
    joined = F.array_join(F.transform(best, lambda r: r["label"]), " · ")
    return F.when(F.size(best) > 0, joined).otherwise(F.substring(summary, 1, 120))


def reading_minutes(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(words == 0, 8).otherwise(F.least(F.lit(45), 10 + js_round(words / 40))).cast("int")
