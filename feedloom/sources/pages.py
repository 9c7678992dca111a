"""Landed pages, some of which may be broken: rows of the good ones, and a report for each source instead of an exception.

A page is a file (or a row with the text of one).  Parsing never fails a job: a page that can't be read, lacks its records or carries its server's error gets a ``fault`` in words and gives no rows;
one with fields of the wrong type gives the rest of its rows and a ``note``.  Reports say what each source delivered, in the columns that
``serve.source_health`` grades and ``snapshots.retain`` reads, so that an outage of one page never looks like the end of what was on it.  Files are read
by Spark, so any store that Spark reads will do, and the same functions work on a stream of pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "source string, fetch_source string, pages long, item_count long, failed_requests long, warnings array<string>, error string"


@dataclass(frozen=True)
class Kind:
    """How a source's pages are written.

    ``form``: json (an object), array (of records), xml or html; ``schema``: an object's fields, or a record's where pages are arrays; ``records``: the field that holds the records; for html, a
    pattern that each record matches, and for xml, the element that each record is (its text is then read record by record, so that an odd one spoils no other).  ``broken``: from the parsed page, what is wrong with it, null for nothing.
    """

    form: str
    schema: str
    records: str = "records"
    broken: Callable[[Callable[[str], Column]], Column] | None = None


def landed(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """page (its place), body: the files at ``path``; none where nothing has landed."""
    if streaming:
        return spark.readStream.schema("value string").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("body"))
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("body"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "page string, body string")


def parsed(pages: DataFrame, kind: Kind) -> DataFrame:
    """``pages`` (page, body) with data (a struct), n (records in it), fault and note."""
    body = F.col("body")
    if kind.form == "array":
        rows = pages.withColumn("data", F.struct(F.from_json(body, f"array<struct<{kind.schema}>>").alias("records"))).withColumn("__bad", F.lit(None).cast("string"))
    elif kind.form == "xml":
        each = F.regexp_extract_all(body, F.lit(rf"(?s)<{kind.records}[\s>].*?</{kind.records}\s*>"), F.lit(0))
        rows = pages.withColumns({"data": F.struct(each.alias("records")), "__bad": F.lit(None).cast("string")})
    elif kind.form == "html":
        rows = pages.withColumns({"data": F.struct(F.regexp_extract_all(body, F.lit(kind.records), F.lit(0)).alias("records"), body.alias("html")), "__bad": F.lit(None).cast("string")})
    else:
        whole = F.from_json(body, f"struct<{kind.schema}, __bad string>", {"columnNameOfCorruptRecord": "__bad"})
        rows = pages.withColumn("data", whole).withColumn("__bad", F.col("data.__bad"))
    field = lambda name: F.col(f"data.{name}")
    held = field(kind.records if kind.form == "json" else "records")
    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    fault = F.when(blank, "the page is empty")
    if kind.form == "xml":
        opened = F.size(F.regexp_extract_all(body, F.lit(rf"<{kind.records}[\s>]"), F.lit(0)))
        fault = fault.when(~body.rlike(r"^\s*<"), "the page is not XML").when(opened > F.size(held), "the page is cut short")
    if kind.broken is not None:
        told = kind.broken(field)
        fault = fault.when(told.isNotNull(), told)
    fault = fault.when(held.isNull() & F.col("__bad").isNotNull(), f"the page is not {kind.form.upper()}").when(held.isNull(), "the page lacks its records")
    rows = rows.withColumn("fault", fault).withColumn("note", F.when(F.col("fault").isNull() & F.col("__bad").isNotNull(), "some fields could not be read"))
    return rows.withColumn("n", F.when(F.col("fault").isNull(), F.size(held)).otherwise(0).cast("long")).drop("__bad")


def good(pages: DataFrame, kind: Kind) -> DataFrame:
    """The data of the pages without a fault, as columns."""
    return parsed(pages, kind).where("fault is null").select("data.*")


def records(pages: DataFrame, kind: Kind) -> DataFrame:
    """The records of an xml source's good pages, as columns of its schema; one that can't be read is left out."""
    each = good(pages, kind).select(F.explode("records").alias("x"))
    return each.select(F.from_xml("x", f"{kind.schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")).where("r.__bad is null").select("r.*").drop("__bad")


def faults(pages: DataFrame, kind: Kind, source: str) -> DataFrame:
    """source, page, fault of every broken page."""
    return parsed(pages, kind).where("fault is not null").select(F.lit(source).alias("source"), "page", "fault")


def report(pages: DataFrame, kind: Kind, source: str, asked: int | None = None) -> DataFrame:
    """One row (``REPORT``): pages, records and failed pages of a source.

    ``asked``: how many pages were asked for, where the caller knows; those that never landed count as failed.  Warnings name each reason once, with its number of pages, so that they stay few
    whatever fails.  ``error`` is set where no page could be read.
    """
    rows = parsed(pages, kind).select("n", F.explode(F.array("fault", "note")).alias("why"), F.col("fault").isNotNull().alias("bad"))
    # two rows a page, one for its fault and one for its note: halves of what is summed
    by = rows.groupBy("why").agg(F.sum("n").alias("n"), F.count("*").alias("halves"), F.count_if("bad").alias("bad"))
    said = F.when(F.col("why").isNotNull(), F.concat(F.col("halves").cast("string"), F.lit(" page(s): "), "why"))
    all_ = by.agg(F.coalesce(F.sum("n") / 2, F.lit(0)).cast("long").alias("item_count"), F.coalesce(F.sum("halves") / 2, F.lit(0)).cast("long").alias("pages"), F.coalesce(F.sum("bad") / 2, F.lit(0)).cast("long").alias("failed"), F.array_sort(F.collect_list(said)).alias("warnings"))
    missing = F.greatest(F.lit(asked) - F.col("pages"), F.lit(0)) if asked is not None else F.when(F.col("pages") == 0, 1).otherwise(0)
    lost = F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" page(s) never landed")))
    dead = F.when(F.col("pages") == 0, "nothing landed").when(F.col("failed") == F.col("pages"), F.element_at("warnings", 1))
    return all_.select(
        F.lit(source).alias("source"), F.when(F.col("pages") > 0, "live").alias("fetch_source"), "pages", "item_count", (F.col("failed") + missing).cast("long").alias("failed_requests"),
        F.concat("warnings", F.array_compact(F.array(lost))).alias("warnings"), dead.alias("error"),
    )


def impaired(reports: DataFrame) -> DataFrame:
    """Sources that did not deliver all they have: for ``snapshots.retain``."""
    return reports.where("failed_requests > 0").select("source")
