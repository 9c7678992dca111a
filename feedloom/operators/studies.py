"""Paid studies: honest hourly rates in which unknown is never zero, tags, duplicates, and the whole of a listing.

``pay``, ``timing`` and ``eligible`` read the free text; here their results become rates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_piece, let
from . import eligible, pay, timing
from .eligible import check_eligibility, eligibility, parse_eligibility  # noqa: F401
from .pay import compensation, parse_compensation  # noqa: F401
from .timing import duration, duration_with_pay, parse_duration  # noqa: F401


def usable(x: Column) -> Column:
    """Finite and not below zero, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def exact_hours(h: Column) -> Column:
    """Snapped to a whole number of minutes that is within a hundredth of one."""
    whole = F.floor(h * 60 + 0.5)
    return F.when((whole > 0) & (F.abs(h * 60 - whole) <= 0.01), whole / 60).otherwise(h)


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


# How a text says that its hours are those of all visits, and that they are those of one.
WHOLE = r"(?i)\b(?:totals?|totall?ing|altogether|combined|overall|in all|across|cumulative|all (?:visits|sessions|appointments)|entire)\b"
PER_SESSION = (
    r"(?i)\b(?:visits?|sessions?|appointments?|meetings?|scans?|interviews?)\s+(?:\w+\s+){0,2}?(?:last|lasts|take|takes|run|runs|require|requires)\b|"
    r"\b(?:each|every|per)\s+(?:visit|session|appointment|meeting|scan|interview|study day)\b"
)


def hours_per_session(text: Column, session_count: Column) -> Column:
    """Whether a duration without a count of sessions tells the hours of one."""
    return session_count.isNull() & F.coalesce(~text.rlike(WHOLE) & text.rlike(PER_SESSION), F.lit(False))


def reconcile_rate(df: DataFrame) -> DataFrame:
    """``df`` with rate, basis, visits, total and disputed, from hourly_min/max, raffle_only, guaranteed_min/max, per_visit, visit_count, hours_min/max, session_count and
    hours_per_session.  Pay for one visit and hours of all (or the reverse) are brought together by the number of visits; where two counts
    differ, the one that pays less an hour is taken.  No rate is ever invented: null stays null."""
    c, none = F.col, F.lit(None).cast("double")
    positive = lambda x: F.when(usable(x) > 0, x)
    # bound as columns by a generator, since a plain projection would be repeated in every branch that reads it
    bound = lambda rows, **named: rows.select("*", F.inline(F.array(F.struct(*[x.alias(f"__{k}") for k, x in named.items()]))))
    rows = bound(
        df, hourly=F.coalesce(positive(c("hourly_max")), positive(c("hourly_min"))), pay=F.coalesce(usable(c("guaranteed_max")), usable(c("guaranteed_min"))),
        hours=exact_hours(F.coalesce(positive(c("hours_max")), positive(c("hours_min")))), a=F.when(c("visit_count").between(1, 60), c("visit_count")), b=F.when(c("session_count").between(1, 60), c("session_count")),
        by_visit=F.coalesce((usable(c("per_visit")) > 0) & usable(c("guaranteed_max")).isNull() & (c("guaranteed_min") >= c("per_visit")) & (c("guaranteed_min") < 2 * c("per_visit")), F.lit(False)), by_session=F.coalesce(c("hours_per_session"), F.lit(False)),
    )
    hourly, pay_, hours, a, b, by_visit, by_session = (c(f"__{k}") for k in ("hourly", "pay", "hours", "a", "b", "by_visit", "by_session"))
    rows = bound(rows, n=F.when(by_session & ~by_visit, F.greatest(a, b)).when(by_visit, F.least(a, b)), extra=F.greatest(F.lit(0.0), _cents(pay_ - c("per_visit"))), ready=hourly.isNull() & ~F.coalesce(c("raffle_only"), F.lit(False)) & pay_.isNotNull())
    n, ready = c("__n"), c("__ready")
    scaled, timed = _cents(c("per_visit") * n + c("__extra")), ready & hours.isNotNull()
    both, one = by_visit & by_session, by_visit != by_session
    raw = F.when(hourly.isNotNull(), hourly).when(~timed, none).when(one & n.isNull(), none).when(both & n.isNull(), c("per_visit") / hours).when(both, scaled / (hours * n))
    raw = raw.when(by_visit, scaled / hours).when(by_session, pay_ / (hours * n)).otherwise(pay_ / hours)
    basis = F.when(hourly.isNotNull(), "stated-hourly").when(~timed, "unknown").when(one & n.isNull(), "unreconciled").when(both, "single-visit")
    basis = basis.when(by_visit, "per-visit-pay-scaled").when(by_session, "per-session-hours-scaled").otherwise("whole-study")
    total = F.when(~ready | (timed & by_visit & n.isNull()), none).when(timed & by_visit, scaled).otherwise(pay_)
    rows = rows.withColumns({"rate": _cents(raw), "basis": basis, "visits": F.when(timed, n).cast("int"), "total": total, "disputed": F.coalesce(timed & n.isNotNull() & (a != b), F.lit(False))})
    return rows.drop(*[x for x in rows.columns if x.startswith("__") and x not in df.columns])


def rate_bucket(rate: Column) -> Column:
    known = usable(rate)
    return F.when(known.isNull(), "unknown").when(known < 10, "low").when(known < 20, "ok").when(known < 40, "good").otherwise("great")


def by_rate(rate: Column, ord_: Column, descending: bool = True) -> list[Column]:
    """Unknown rates last in both directions, input order on ties."""
    return [rate.desc_nulls_last() if descending else rate.asc_nulls_last(), ord_.asc()]


def usd(x: Column) -> Column:
    """$1,234 or $1,234.50."""
    return F.concat(F.lit("$"), F.regexp_replace(F.format_number(_cents(x), 2), r"\.00$", ""))


def pay_label(rate: Column, low: Column, high: Column, raffle_only: Column, raffle_max: Column) -> Column:
    """One line of a listing's pay: a rate with the total, unpaid, a draw, a total without a rate, or unclear."""
    paid = high > 0
    none = (rate == 0) | ((high == 0) & ~F.coalesce(raffle_only, F.lit(False)) & raffle_max.isNull())
    return (
        F.when(rate > 0, F.concat(usd(rate), F.lit("/hr"), F.when(paid, F.concat(F.lit(" - "), usd(high), F.lit(" total"))).otherwise("")))
        .when(F.coalesce(none, F.lit(False)), "Unpaid").when(F.coalesce(raffle_only, F.lit(False)), "Drawing entry only")
        .when(paid, F.concat(F.when(low.isNull(), "up to ").otherwise(""), usd(high), F.lit(" total, rate unknown"))).otherwise("Pay unclear")
    )


def hours_label(low: Column, high: Column) -> Column:
    """1-3 hours, 1.5 hours, 1 hour; null for unknown."""
    n = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.format_string("%.1f", x))
    one = F.coalesce(high, low)
    return F.when(low != high, F.concat(n(low), F.lit("-"), n(high), F.lit(" hours"))).when(one.isNotNull(), F.concat(n(one), F.when(one == 1, " hour").otherwise(" hours")))


def ages_label(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "not stated").when(high.isNull(), F.concat(low.cast("string"), F.lit(" and up"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def card(rows: DataFrame) -> DataFrame:
    """What a listing is filtered by: id, rate, total (only a guaranteed maximum), hours (the larger known), online, in_person, tags, expired, posted, search (without addresses)."""
    from ..functions.text import EMAIL, collapse

    c = F.col
    words = F.concat_ws(" ", "title", "summary", "pi_name", "contact_name", "irb_number", F.array_join("tags", " "), F.array_join("eligibility.flags", " "))
    return rows.select(
        "id", "rate", c("guaranteed_max").alias("total"), F.coalesce("hours_max", "hours_min").alias("hours"), F.array_contains("tags", "online").alias("online"), F.array_contains("tags", "in-person").alias("in_person"), "tags",
        c("is_expired").alias("expired"), "posted", collapse(F.lower(F.regexp_replace(words, EMAIL, ""))).alias("search"),
    )


def filter_cards(cards: DataFrame, query: str = "", tab: str = "all", tags: list[str] = (), min_rate: float = 0, min_total: float = 0, max_hours: float | None = None, saved: DataFrame | None = None, dismissed: DataFrame | None = None, ineligible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards that pass every filter, one row with how many live cards a numeric bound hides only because their figure is unknown)."""
    from .serve import filter_known, matches_search

    rows = cards.where(matches_search(F.col("search"), query))
    rows = {"ranked": rows.where("rate is not null"), "online": rows.where("online"), "inperson": rows.where("in_person")}.get(tab, rows)
    if tab == "saved" and saved is not None:
        rows = rows.join(saved.select("id"), "id", "left_semi")
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    for gone in (dismissed, ineligible):
        rows = rows.join(gone.select("id"), "id", "left_anti") if gone is not None else rows
    bounds = {c: b for c, b, on in (("rate", (min_rate, None), min_rate > 0), ("total", (min_total, None), min_total > 0), ("hours", (None, max_hours), max_hours is not None)) if on}
    return filter_known(rows, bounds)[0], filter_known(rows.where("not expired"), bounds)[1]


def sort_cards(mode: str, ord_: Column) -> list[Column]:
    """Order of cards by rate, total or newest (largest first) or time (smallest first); unknown last in each."""
    by = {"rate": F.col("rate").desc_nulls_last(), "total": F.col("total").desc_nulls_last(), "time": F.col("hours").asc_nulls_last(), "new": F.col("posted").desc_nulls_last()}
    return [by.get(mode, by["rate"]), ord_.asc()]


def by_total(low: Column, high: Column, posted: Column, ord_: Column) -> list[Column]:
    """Order of studies without a rate: the larger guaranteed total first, unknown last, then the newest."""
    return [F.coalesce(usable(high), usable(low)).desc_nulls_last(), posted.desc_nulls_last(), ord_.asc()]


# Tags in display order and the words that give them, and the taxonomy terms that give them.
TAGS = {
    "online": r"(?i)\bonline\b|\bremote(ly)?\b|\bzoom\b|\bweb-?based\b|\bvirtual (?:session|meeting|visit)\b|\bteleconference\b|\bqualtrics\b",
    "in-person": r"(?i)\bin-?person\b|\bon-?campus\b|\bin (?:our|the) lab(?:oratory)?\b|\blab visit\b|\bvisit (?:our|the) (?:lab|clinic|center|centre)\b|\bcome to\b",
    "mri": r"(?i)\bf?MRI\b|\bmagnetic resonance\b|\bneuroimag", "eeg": r"(?i)\bEEG\b|\belectroencephalo",
    "vr-ar": r"(?i:\bvirtual reality\b|\baugmented reality\b|\bmixed reality\b|\bhead-?mounted\b|\bheadset\b)|\b(?:VR|AR|XR)\b", "focus-group": r"(?i)\bfocus group\b", "survey": r"(?i)\bsurvey(s|ed)?\b|\bquestionnaire",
    "interview": r"(?i)\binterview(s|ed|ing)?\b",
    "clinical": r"(?i)\bclinical trial\b|\bplacebo\b|\brandomi[sz]ed controlled\b|\bdouble-?blind\b|\bdrug\b|\bmedication\b|\bsupplement\b|\bpatients? with\b|\bdiagnos(ed|is)\b",
    "hci": r"(?i)\bhuman-?computer\b|\bhuman-?robot\b|\buser interface\b|\busability\b|\buser experience\b|\bHCI\b|\bwearable\b",
}
TERMS = {
    "online": r"(?i)online survey|online interview|^online only$|^remote$", "in-person": r"(?i)single visit|multiple visits|on-campus|off-campus", "survey": r"(?i)online survey", "interview": r"(?i)online interview",
    "clinical": r"(?i)clinical trials?|medicine", "hci": r"(?i)^technology$",
}


#: Pieces one of which stands in whatever a tag's pattern matches, those in lower case in any case: texts without them are not held against it.
PIECES = {
    "online": ["online", "remote", "zoom", "based", "virtual", "teleconference", "qualtrics"], "in-person": ["person", "campus", " lab", "visit", "come to"], "mri": ["mri", "magnetic", "neuroimag"],
    "eeg": ["eeg", "electroenceph"], "vr-ar": ["reality", "mounted", "headset", "VR", "AR", "XR"], "focus-group": ["focus group"], "survey": ["survey", "questionnaire"], "interview": ["interview"],
    "clinical": ["clinical", "placebo", "controlled", "blind", "drug", "medication", "supplement", "patient", "diagnos"], "hci": ["human", "user", "usability", "hci", "wearable"],
}


def tags(text: Column, terms: Column | None = None) -> Column:
    """Tags of a listing by its text and its taxonomy terms; a study that is online only is never in person."""
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda x: _tags(x["text"], x["low"], terms))


def _tags(text: Column, low: Column, terms: Column | None) -> Column:
    named = F.coalesce(terms, F.array().cast("array<string>")) if terms is not None else F.array().cast("array<string>")
    by_term = lambda p: F.exists(named, lambda t: t.rlike(p))
    near = lambda k: has_piece(low, [x for x in PIECES[k] if x == x.lower()]) | (has_piece(text, caps) if (caps := [x for x in PIECES[k] if x != x.lower()]) else F.lit(False))
    holds = {k: (near(k) & text.rlike(p)) | (by_term(TERMS[k]) if k in TERMS else F.lit(False)) for k, p in TAGS.items()}
    holds["in-person"] = holds["in-person"] & ~by_term(r"(?i)^online only$")
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]))


def term_names(ids: Column, terms: Column) -> Column:
    """Names of term ids in a map, without unknown ids."""
    return F.array_compact(F.transform(ids, lambda i: F.try_element_at(terms, i)))


def read_listing(field: str | None, time: str | None, body: str | None) -> tuple[dict, dict]:
    """Pay and time of one listing: a silent pay field falls back to the body, and the two confirm each other's number of visits."""
    alone = duration(time)
    found = pay.with_fallbacks(compensation(field), time, any(alone[k] is not None for k in timing.FIELDS if k != "confidence"), body)
    return found, duration_with_pay(time, found)


READ = T.StructType([T.StructField("pay", pay.SCHEMA), T.StructField("time", timing.SCHEMA), T.StructField("error", T.StringType())])
CRITERIA = T.StructType([T.StructField("criteria", eligible.SCHEMA), T.StructField("error", T.StringType())])


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def reader(read=read_listing):
    """A column function of (compensation, duration, body) that gives pay and time, or else ``error``: a listing that ``read`` stumbles over spoils no other."""

    @F.pandas_udf(READ)
    def run(field: pd.Series, time: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows, errors = [], []
        for r in zip(field, time, body):
            try:
                rows.append(read(*r))
                errors.append(None)
            except Exception as e:  # whatever it is, it belongs to this row
                rows.append(({}, {}))
                errors.append(_said(e))
        plain = lambda df: df.astype(object).where(lambda x: x.notna(), None).to_dict("records")
        return pd.DataFrame({"pay": plain(pay.frame([p for p, _ in rows])), "time": plain(timing.frame([t for _, t in rows])), "error": pd.Series(errors, dtype=object)})

    return run


def criteria_reader(read=eligibility):
    """A column function of (title, excerpt, body, minimum and maximum age) that gives a listing's criteria, or else ``error``."""

    @F.pandas_udf(CRITERIA)
    def run(title: pd.Series, excerpt: pd.Series, body: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        rows, errors = [], []
        for r in zip(title, excerpt, body, low, high):
            try:
                rows.append(read(*r))
                errors.append(None)
            except Exception as e:
                rows.append(None)
                errors.append(_said(e))
        return pd.DataFrame({"criteria": rows, "error": pd.Series(errors, dtype=object)})

    return run


# Fixed value: the maximum age from which on a field means that there is none.
NO_MAX_AGE = 100


def criteria_by_age(low: Column, high: Column) -> Column:
    """Criteria where a text can't be read: the age fields alone."""
    whole = lambda x: F.nullif(F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"-?\d+", 0), F.lit("")).try_cast("int")
    values = {"min_age": F.coalesce(whole(low), F.lit(0)), "max_age": F.when(whole(high) < NO_MAX_AGE, whole(high)), "flags": F.array().cast("array<string>")}
    parts = [values.get(f.name, F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in eligible.SCHEMA]
    return F.struct(*parts)


def age_by_edit(modified: Column, posted: Column, now: Column) -> Column:
    """Staleness by the last edit alone, where the approval date says nothing: fresh within 90 days, aging within 270."""
    days = (F.unix_seconds(now) - F.unix_seconds(F.coalesce(modified, posted))) / 86_400
    return F.when(days <= 90, "fresh").when(days <= 270, "aging").otherwise("stale")


def irb_key(number: Column) -> Column:
    """An approval number's letters and digits; null for none."""
    return F.nullif(F.regexp_replace(F.upper(number), "[^A-Z0-9]", ""), F.lit(""))


def titles_alike(a: Column, b: Column) -> Column:
    """Whether one title's words contain the other's."""
    key = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    x, y = key(a), key(b)
    return (x == y) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))


def dedupe_studies(rows: DataFrame) -> DataFrame:
    """``rows`` (id, title, irb_number, modified) with duplicate_of (null for those that stay), duplicate_ids and titles_diverge: of one approval number the last modified, then the largest id, stays."""
    from pyspark.sql import Window

    number = F.col("id").try_cast("double")
    last = [F.desc_nulls_last("modified"), F.desc_nulls_last(number), F.desc("id")]
    x = rows.withColumn("__key", irb_key(F.col("irb_number")))
    w = Window.partitionBy("__key").orderBy(*last)
    keyed = x.where("__key is not null").withColumns({"__first": F.first("id").over(w), "__title": F.first("title").over(w), "__place": F.row_number().over(w)})
    lost = keyed.where("__place > 1").groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct(number.alias("n"), "id"))).alias("__lost"), F.bool_or(~titles_alike(F.col("title"), F.col("__title"))).alias("__diverge")
    )
    joined = keyed.join(lost, "__key", "left")
    mine = F.col("__place") == 1
    joined = joined.withColumns({
        "duplicate_of": F.when(~mine, F.col("__first")), "duplicate_ids": F.when(mine, F.coalesce(F.transform("__lost", lambda r: r["id"]), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        "titles_diverge": F.coalesce(mine & F.col("__diverge"), F.lit(False)),
    })
    alone = x.where("__key is null").withColumns({"duplicate_of": F.lit(None).cast("string"), "duplicate_ids": F.array().cast("array<string>"), "titles_diverge": F.lit(False)})
    names = [*rows.columns, "duplicate_of", "duplicate_ids", "titles_diverge"]
    return joined.select(*names).unionByName(alone.select(*names))


def _normalized(raw: DataFrame, now: Column, terms: Column | None, read, criteria) -> DataFrame:
    from ..functions.dates import staleness, study_instant
    from ..functions.text import study_text, truncate

    c = F.col
    rows = raw.withColumns({"plain_title": study_text(c("title")), "plain_excerpt": study_text(c("excerpt")), "text": study_text(c("body"))})
    low, high = c("min_age").cast("string"), c("max_age").cast("string")
    rows = rows.withColumns({"__read": reader(read)("compensation", "duration", "body"), "__criteria": criteria_reader(criteria)("title", "excerpt", "body", low, high)})
    rows = rows.withColumns({"pay": c("__read.pay"), "time": c("__read.time"), "error": c("__read.error"), "eligibility": F.when(c("__criteria.error").isNull(), c("__criteria.criteria")).otherwise(criteria_by_age(low, high)), "degraded": c("__criteria.error")}).drop("__read", "__criteria")
    flat = rows.withColumns({
        "summary": truncate(F.when(F.length("plain_excerpt") >= 40, c("plain_excerpt")).otherwise(F.coalesce(F.nullif(c("text"), F.lit("")), c("plain_excerpt"))), 260),
        **{k: c(f"pay.{k}") for k in ("guaranteed_min", "guaranteed_max", "hourly_min", "hourly_max", "raffle_only", "per_visit", "visit_count")},
        "hours_min": c("time.total_hours_min"), "hours_max": c("time.total_hours_max"), "session_count": c("time.session_count"), "hours_per_session": hours_per_session(c("duration"), c("time.session_count")),
    })
    named = term_names(c("term_ids"), terms) if terms is not None else None
    age = F.coalesce(staleness(study_instant(c("expires")), study_instant(c("approved")), now), age_by_edit(c("modified"), c("posted"), now))
    return reconcile_rate(flat).withColumns({"bucket": rate_bucket(c("rate")), "tags": tags(F.concat_ws(" ", "plain_title", "plain_excerpt", "text"), named), "staleness": age, "is_expired": age == "expired"})


def normalize_all(raw: DataFrame, now: Column, terms: Column | None = None, read=read_listing, criteria=eligibility) -> tuple[DataFrame, DataFrame]:
    """(study rows, quarantine): rows as ``normalize`` gives them, and (id, error, raw: the listing as JSON) for those that couldn't be read.  Every row of ``raw`` is in one of them.

    One listing that can't be read never fails the others.  Where only its criteria can't be, it stays, with those of its age fields, and ``degraded`` says why.  Written down, so that
    texts are read once for both.
    """
    from ..storage import materialize

    done = materialize(_normalized(raw.withColumn("__raw", F.to_json(F.struct(*raw.columns))), now, terms, read, criteria))
    bad = done.where("error is not null").select(F.col("id"), "error", F.col("__raw").alias("raw"))
    return done.where("error is null").drop("error", "__raw"), bad


def normalize(raw: DataFrame, now: Column, terms: Column | None = None) -> DataFrame:
    """Study rows from raw listings (id, title, excerpt, body, compensation, duration, expires, approved, posted, modified, irb_number, min_age, max_age, term_ids array<long>) with text, summary,
    pay, time, eligibility, rate and its basis, bucket, tags and staleness.  ``terms``: a map of taxonomy ids to names.  Listings that can't be read are left out: ``normalize_all`` names them."""
    return _normalized(raw, now, terms, read_listing, eligibility).where("error is null").drop("error")
