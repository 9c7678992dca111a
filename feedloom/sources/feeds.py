"""Landed extracts (JSON, XML, HTML) as typed tables.  Transport is not Spark's business: files are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import civil_instant, from_parts, millis, month_of, to_instant
from ..functions.text import collapse, html_to_text, normalize_arxiv, normalize_doi, normalize_openalex, strip_emails, version_of
from .pages import Kind, good, landed, records

PREPRINT = "collection array<struct<title:string,authors:string,doi:string,date:string,version:string,type:string,category:string,abstract:string,published:string,server:string>>"
CALENDAR = "id bigint, gid bigint, group_title string, title string, url string, date_utc string, date_ts bigint, date2_iso string, is_canceled string, is_all_day string, is_online string, online_url string, has_registration string, date_iso string, event_types_audience array<string>, location_title string, description string, cost string, location string, location_latitude string, location_longitude string, event_types array<string>, tags array<string>, last_modified bigint"
WORKS = (
    "results array<struct<id:string,doi:string,ids:struct<doi:string,pmid:string,pmcid:string>,title:string,display_name:string,publication_date:string,publication_year:int,type:string,cited_by_count:int,is_paratext:boolean,"
    "referenced_works:array<string>,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string>>,"
    "raw_affiliation_strings:array<string>>>,topics:array<struct<display_name:string>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>,"
    "best_oa_location:struct<pdf_url:string>>>"
)
# The types of works that are literature.
INCLUDED_TYPES = ["article", "preprint", "review", "book-chapter", "book", "dissertation"]


def newest(rows: DataFrame, most: int | None, when: Column, id_: str, by: str | None = None) -> DataFrame:
    """At most ``most`` rows, or of each value of ``by``, the newest first: a source's own cap on what it delivers.  None: all rows, in no order, as no task then needs to see them all."""
    from pyspark.sql import Window

    if most is None:
        return rows
    order = [when.desc_nulls_last(), F.col(id_)]
    if by is None:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__place") <= most).drop("__place")


def one_of(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the first by ``order`` or, where the rows have no such column, by content."""
    x = F.struct(*rows.columns)
    place = F.struct(order, F.to_json(x)) if order and order in rows.columns else F.to_json(x)
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(x, place).alias("x")).select("x.*")


def first_of(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs])


def _answered(field) -> Column:
    """What a server said instead of records."""
    said = F.lower(F.get(field("messages"), F.lit(0))["status"])
    return F.when(said.isNotNull() & ~said.isin("ok") & (F.coalesce(F.size(field("collection")), F.lit(0)) <= 0) & ~F.contains(said, F.lit("no posts")), F.concat(F.lit("the feed answered: "), said))


PREPRINT_PAGES = Kind("json", "messages array<struct<status:string>>, " + PREPRINT, "collection", _answered)


def preprints(spark: SparkSession, path: str, most: int | None = 600) -> DataFrame:
    """bioRxiv-like interval feeds: a row for each record with a valid DOI; 'NA' is no publication.  A page whose status is not ok gives none (``PREPRINT_PAGES``); at most ``most`` records of a server, newest first."""
    r = good(landed(spark, path), PREPRINT_PAGES).select(F.explode("collection").alias("r"))
    doi = normalize_doi(F.col("r.doi"))
    published = normalize_doi(F.nullif(F.col("r.published"), F.lit("NA")))
    authors = F.filter(F.transform(F.split("r.authors", ";"), lambda a: F.trim(a)), lambda a: a != "")
    out = r.select(
        F.concat(F.lit("doi:"), doi).alias("identity"), doi.alias("doi"), F.trim("r.title").alias("title"), authors.alias("authors"), F.to_date("r.date").alias("published_date"), F.col("r.version").try_cast("int").alias("preprint_version"),
        F.col("r.category").alias("category"), F.trim("r.abstract").alias("abstract"), published.alias("published_doi"), published.isNotNull().alias("is_superseded"), F.lower("r.server").alias("source"),
    ).where("doi is not null")
    return newest(out.withColumn("__tie", F.concat_ws("|", "doi", F.lpad((999 - F.coalesce("preprint_version", F.lit(0))).cast("string"), 4, "0"))), most, F.col("published_date"), "__tie", "source").drop("__tie")


def _positions(batches):
    for pdf in batches:
        for i in range(0, len(pdf), 256):  # indexes of few texts at a time are held
            part, found = pdf.iloc[i : i + 256], []
            for words in part.pop("words"):
                index = {}
                for p, w in enumerate(() if words is None else words):
                    index.setdefault(w, []).append(p)
                found.append(None if words is None else [{"w": w, "ps": ps} for w, ps in index.items()])
            yield part.assign(entries=found)


def invert(rows: DataFrame, words: str, name: str) -> DataFrame:
    """``rows`` with, in place of their ``words`` array, a map ``name`` of each word to its positions.  A row's index is made where the row is; no word travels."""
    rest = [c for c in rows.columns if c != words]
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    out = rows.select(*rest, F.col(words).alias("words")).mapInPandas(_positions, f"{kept}, entries array<struct<w:string,ps:array<int>>>")
    return out.select(*rest, F.map_from_entries("entries").alias(name))


def rebuild_abstract(index: Column, most: int = 4000) -> Column:
    """Text from word positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda x: x["p"] <= most)), lambda x: x["w"]), " ")


WORKS_PAGES = Kind("json", WORKS, "results")


def works(spark: SparkSession, path: str, since: Column | None = None, most: int | None = 150, channel: str = "", longest: int = 4000) -> DataFrame:
    """Literature works of the included types, with title and id, not front matter; from ``since`` on, at most ``most`` of one search, newest first.  ``channel``: the search.  ``longest``: the last position of an abstract's word that is taken."""
    r = good(landed(spark, path), WORKS_PAGES).select(F.explode("results").alias("r")).where("not coalesce(r.is_paratext, false)")
    r = r.where(F.col("r.type").isNull() | F.col("r.type").isin(INCLUDED_TYPES))
    when = F.coalesce(F.to_date("r.publication_date"), F.make_date("r.publication_year", F.lit(1), F.lit(1)))
    kind = F.when(F.col("r.type").isin("preprint", "review", "dataset"), F.col("r.type")).when(F.col("r.type") == "article", "journal-article").otherwise("other")
    first = lambda xs: F.get(xs, F.lit(0))
    people = F.transform("r.authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"), a["author"]["orcid"].alias("orcid"), F.coalesce(first(a["institutions"])["display_name"], first(a["raw_affiliation_strings"])).alias("affiliation")))
    named = F.filter(F.coalesce(people, F.array().cast("array<struct<name:string,orcid:string,affiliation:string>>")), lambda a: F.coalesce(a["name"], F.lit("")) != "")
    topics = F.slice(F.array_compact(F.transform(F.coalesce("r.topics", F.array().cast("array<struct<display_name:string>>")), lambda t: t["display_name"])), 1, 8)
    doi, work = normalize_doi(F.coalesce("r.doi", "r.ids.doi")), normalize_openalex(F.col("r.id"))
    pmid = F.nullif(F.regexp_extract(F.coalesce("r.ids.pmid", F.lit("")), r"(\d+)\s*$", 1), F.lit(""))
    cited = F.array_compact(F.transform(F.coalesce("r.referenced_works", F.array().cast("array<string>")), normalize_openalex))
    out = r.select(
        F.col("r.id").alias("id"), doi.alias("doi"), html_to_text(F.coalesce("r.title", "r.display_name")).alias("title"), when.alias("published_date"), kind.alias("kind"), work.alias("openalex_id"), F.col("r.cited_by_count").alias("cited_by"),
        F.slice(cited, 1, 200).alias("references"), rebuild_abstract(F.col("r.abstract_inverted_index"), longest).alias("abstract"), pmid.alias("pmid"), F.col("r.ids.pmcid").alias("pmcid"), named.alias("authors"), topics.alias("topics"), topics.alias("tags"),
        F.col("r.primary_location.source.display_name").alias("journal"), F.coalesce("r.open_access.is_oa", F.lit(False)).alias("is_open_access"), F.coalesce("r.best_oa_location.pdf_url", "r.open_access.oa_url").alias("open_access_url"),
        F.coalesce("r.primary_location.landing_page_url", F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)), F.col("r.id")).alias("url"), F.lit(channel).alias("channel"), F.lit("openalex").alias("source"),
        F.array_compact(F.array(F.concat(F.lit("openalex:"), F.lower(work)), F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), pmid))).alias("identity"),
    ).where("title <> '' and openalex_id is not null")
    return newest(out if since is None else out.where(F.col("published_date") >= since), most, F.col("published_date"), "id")


ATOM = "id string, title string, updated string, published string, summary string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_rel:string,_title:string>>"


ATOM_PAGES = Kind("xml", ATOM, "entry")


def atom(spark: SparkSession, path: str) -> DataFrame:
    r = records(landed(spark, path), ATOM_PAGES)
    link = lambda test: F.try_element_at(F.filter("link", test), F.lit(1))["_href"]
    arxiv = normalize_arxiv(F.col("id"))
    return r.select(
        arxiv.alias("arxiv_id"), version_of(F.col("id")).alias("preprint_version"), F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), F.regexp_replace(F.trim("summary"), r"\s+", " ").alias("abstract"),
        F.try_to_timestamp("published").alias("published_at"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("topics"),
        link(lambda x: x["_rel"] == "alternate").alias("url"), link(lambda x: x["_title"] == "pdf").alias("pdf"),
    )


_TEXTS = "array<struct<_Label:string,_VALUE:string>>"
ARTICLE = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,"
    f"Abstract:struct<AbstractText:{_TEXTS}>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string,Identifier:array<struct<_Source:string,_VALUE:string>>>>>,"
    "PublicationTypeList:struct<PublicationType:array<string>>>,KeywordList:struct<Keyword:array<string>>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


ARTICLE_PAGES = Kind("xml", ARTICLE, "PubmedArticle")


def medline_date(d: Column) -> Column:
    """Year, Month (name or number) and Day, or the year a MedlineDate begins with."""
    month = F.coalesce(month_of(d["Month"]), d["Month"].try_cast("int"))
    day = F.when(month.isNotNull(), d["Day"].try_cast("int"))
    year = F.coalesce(d["Year"].try_cast("int"), F.regexp_extract(d["MedlineDate"], r"^(\d{4})", 1).try_cast("int"))
    return from_parts(F.array(year, F.when(d["Year"].isNotNull(), month), F.when(d["Year"].isNotNull(), day)))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def pubmed(spark: SparkSession, path: str, channel: str = "", ids: DataFrame | None = None) -> DataFrame:
    """Article records with PMID and title.  ``ids``: a search's answer (pmid); only its articles are read."""
    r = records(landed(spark, path), ARTICLE_PAGES).select("MedlineCitation.*", F.col("PubmedData.ArticleIdList.ArticleId").alias("ids"))
    section = lambda s: F.concat_ws(": ", F.nullif(s["_Label"], F.lit("")), collapse(s["_VALUE"]))
    spoken = F.filter(F.col("Article.Abstract.AbstractText"), lambda x: F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != "")
    named = lambda x: F.when(x["LastName"].isNotNull(), F.concat_ws(" ", F.coalesce(x["ForeName"], x["Initials"]), x["LastName"])).otherwise(x["CollectiveName"])
    orcid = lambda x: F.try_element_at(F.filter(x["Identifier"], lambda i: i["_Source"] == "ORCID"), F.lit(1))["_VALUE"]
    people = F.transform(F.col("Article.AuthorList.Author"), lambda x: F.struct(named(x).alias("name"), orcid(x).alias("orcid"), F.lit(None).cast("string").alias("affiliation")))
    of = lambda kind: F.try_element_at(F.filter("ids", lambda i: i["_IdType"] == kind), F.lit(1))["_VALUE"]
    types = F.transform(_strings(F.col("Article.PublicationTypeList.PublicationType")), lambda t: F.lower(t))
    kind = F.when(F.arrays_overlap(types, F.array(F.lit("review"), F.lit("systematic review"))), "review").when(F.array_contains(types, "preprint"), "preprint").when(F.array_contains(types, "dataset"), "dataset")
    mesh = F.transform(F.coalesce("MeshHeadingList.MeshHeading", F.array().cast("array<struct<DescriptorName:string>>")), lambda m: m["DescriptorName"])
    out = r.select(
        F.col("PMID").alias("pmid"), normalize_doi(of("doi")).alias("doi"), F.lower(of("pmc")).alias("pmcid"), collapse(F.col("Article.ArticleTitle")).alias("title"),
        F.array_join(F.transform(spoken, section), " ").alias("abstract"), medline_date(F.col("Article.Journal.JournalIssue.PubDate")).alias("published_date"),
        F.coalesce("Article.Journal.Title", "Article.Journal.ISOAbbreviation").alias("journal"), F.filter(people, lambda x: F.coalesce(x["name"], F.lit("")) != "").alias("authors"), F.coalesce(kind, F.lit("journal-article")).alias("kind"),
        F.slice(F.concat(F.slice(_strings(F.col("KeywordList.Keyword")), 1, 8), F.slice(mesh, 1, 10)), 1, 12).alias("tags"), F.slice(mesh, 1, 8).alias("topics"), F.lit(channel).alias("channel"),
    ).where("coalesce(pmid, '') <> '' and coalesce(title, '') <> ''")
    return out.join(ids, "pmid", "left_semi") if ids is not None else out


LITERATURE = (
    "nextCursorMark string, resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,authorList:struct<author:array<struct<fullName:string,"
    "firstName:string,lastName:string>>>,journalInfo:struct<journal:struct<title:string>>,pubYear:string,firstPublicationDate:string,electronicPublicationDate:string,abstractText:string,isOpenAccess:string,"
    "citedByCount:int,pubTypeList:struct<pubType:array<string>>,keywordList:struct<keyword:array<string>>,meshHeadingList:struct<meshHeading:array<struct<descriptorName:string>>>,"
    "fullTextUrlList:struct<fullTextUrl:array<struct<url:string,availabilityCode:string,documentStyle:string>>>>>>"
)


LITERATURE_PAGES = Kind("json", LITERATURE, "resultList.result")


def literature(spark: SparkSession, path: str, channel: str, site: str, since: Column | None = None, most: int = 150) -> DataFrame:
    """Pages of a literature search, one row for each record that has a title and an address; at most ``most`` of one search, newest first.

    ``site``: the address that records of the search are shown under; ``since``: the day from which records are wanted.
    """
    from pyspark.sql import Window

    r = good(landed(spark, path), LITERATURE_PAGES).select(F.explode("resultList.result").alias("r")).select("r.*")
    doi = normalize_doi(F.col("doi"))
    listed = F.transform("authorList.author", lambda a: F.coalesce(a["fullName"], F.concat_ws(" ", a["firstName"], a["lastName"])))
    told = F.transform(F.split(F.coalesce("authorString", F.lit("")), ","), lambda a: F.trim(F.regexp_replace(a, r"\.$", "")))
    names = F.filter(F.when(F.size("authorList.author") > 0, listed).otherwise(told), lambda a: F.coalesce(a, F.lit("")) != "")
    urls = F.filter("fullTextUrlList.fullTextUrl", lambda u: u["availabilityCode"] == "OA")
    first = lambda xs: F.try_element_at(xs, F.lit(1))["url"]
    full = F.coalesce(first(F.filter(urls, lambda u: u["documentStyle"] == "pdf")), first(urls))
    page = F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit(site.rstrip("/") + "/"), F.url_encode(F.coalesce("source", F.lit("MED"))), F.lit("/"), F.url_encode("id"))).otherwise(F.concat(F.lit("https://doi.org/"), doi))
    mesh = F.transform(F.coalesce("meshHeadingList.meshHeading", F.array().cast("array<struct<descriptorName:string>>")), lambda m: m["descriptorName"])
    types = F.transform(_strings(F.col("pubTypeList.pubType")), lambda t: F.lower(t))
    preprint = F.col("source") == "PPR"
    when = F.coalesce(*[to_instant(F.col(c)) for c in ("firstPublicationDate", "electronicPublicationDate", "pubYear")])
    out = r.select(
        F.col("id").alias("external_id"), doi.alias("doi"), F.nullif("pmid", F.lit("")).alias("pmid"), F.lower(F.nullif("pmcid", F.lit(""))).alias("pmcid"), html_to_text(F.col("title")).alias("title"),
        html_to_text(F.col("abstractText")).alias("abstract"), when.alias("published_date"), F.col("journalInfo.journal.title").alias("journal"),
        F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("affiliation"))).alias("authors"),
        F.when(preprint, "preprint").when(F.array_contains(types, "review"), "review").otherwise("journal-article").alias("kind"), F.slice(F.concat(_strings(F.col("keywordList.keyword")), mesh), 1, 12).alias("tags"),
        F.slice(mesh, 1, 8).alias("topics"), F.col("citedByCount").alias("cited_by"), F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False)).alias("is_open_access"), full.alias("open_access_url"), page.alias("url"),
        F.when(preprint, 1).alias("preprint_version"), F.lit(channel).alias("channel"),
    ).where("title <> '' and url is not null")
    if since is not None:
        out = out.where(F.col("published_date") >= since)
    newest = Window.partitionBy("channel").orderBy(F.desc_nulls_last("published_date"), "external_id")
    return out.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= most).drop("__place")


def identity(df: DataFrame) -> DataFrame:
    """``df`` with identity: the namespaced keys of the ids it has."""
    kinds = {"doi": "doi", "pmid": "pmid", "pmcid": "pmcid", "arxiv_id": "arxiv", "openalex_id": "openalex"}
    keys = [F.concat(F.lit(f"{name}:"), F.col(c)) for c, name in kinds.items() if c in df.columns]
    return df.withColumn("identity", F.array_compact(F.array(*keys)))


def plausible(day: Column, now: Column, ahead: int = 400) -> Column:
    """Dates more than ``ahead`` days after now are slips."""
    return F.when(millis(day) <= millis(now) + ahead * 86_400_000, day)


CROSSREF = (
    "message struct<items:array<struct<DOI:string,type:string,title:array<string>,`container-title`:array<string>,abstract:string,`is-referenced-by-count`:int,license:array<struct<URL:string>>,"
    "link:array<struct<URL:string,`content-type`:string>>,issued:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>>>>"
)


CROSSREF_PAGES = Kind("json", CROSSREF, "message.items")


def crossref(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Metadata by DOI.  Open access counts only with an open licence; a link to the full text only then."""
    r = good(landed(spark, path), CROSSREF_PAGES).select(F.explode("message.items").alias("r"))
    is_open = F.coalesce(F.exists("r.license", lambda x: x["URL"].rlike("(?i)creativecommons|/open")), F.lit(False))
    day = F.coalesce(*[from_parts(F.get(F.col(f"r.{c}.date-parts"), F.lit(0))) for c in ("issued", "published")])
    pdf = F.try_element_at(F.filter("r.link", lambda x: F.coalesce(x["content-type"] == "application/pdf", F.lit(False))), F.lit(1))["URL"]
    return r.select(
        normalize_doi(F.col("r.DOI")).alias("doi"), F.get("r.title", F.lit(0)).alias("title"), html_to_text(F.col("r.abstract")).alias("abstract"), F.col("r.is-referenced-by-count").alias("cited_by"), is_open.alias("is_open_access"),
        F.get(F.col("r.container-title"), F.lit(0)).alias("journal"), (plausible(day, now) if now is not None else day).alias("published_date"), F.when(is_open, pdf).alias("open_access_url"),
    ).where("doi is not null")


def enrich(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join by DOI: the metadata's journal and citation count win, its date, link and open access fill gaps, the longer abstract stays.  Fields that either side lacks are left alone."""
    fields = [c for c in ("journal", "cited_by", "published_date", "open_access_url", "is_open_access", "abstract") if c in metadata.columns and c in items.columns]
    m = one_of(metadata, ["doi"], "ord").select("doi", *[F.col(c).alias(f"__{c}") for c in fields])
    j, known = items.join(m, "doi", "left"), {}
    for c in fields:
        own, new = F.col(c), F.col(f"__{c}")
        if c in ("journal", "cited_by"):
            known[c] = F.coalesce(new, own)
        elif c == "is_open_access":
            known[c] = F.coalesce(own, F.lit(False)) | F.coalesce(new, F.lit(False))
        elif c == "abstract":
            known[c] = F.when(F.coalesce(F.length(new), F.lit(0)) > F.coalesce(F.length(own), F.lit(0)), new).otherwise(own)
        else:
            known[c] = F.coalesce(own, new)
    return j.withColumns(known).drop(*[f"__{c}" for c in fields]) if known else j


CALENDAR_PAGES = Kind("array", re.sub(r"(\w+) ", r"\1:", CALENDAR))


def calendar(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """Calendar feed: fields that hold 1 or null are booleans; (0, 0) is no place; addresses never leave the text."""
    r = good(landed(spark, path), CALENDAR_PAGES).select(F.inline("records"))
    on = lambda c: F.coalesce(F.col(c).try_cast("int") > 0, F.lit(False))
    lat, lon = F.col("location_latitude").try_cast("double"), F.col("location_longitude").try_cast("double")
    where = F.when(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)), F.struct(lat.alias("lat"), lon.alias("lon")))
    out = r.select(
        F.concat(F.lit("event:calendar-"), "id").alias("identity"), F.lit(channel).alias("channel"), F.trim("title").alias("title"), strip_emails(html_to_text(F.col("description"))).alias("summary"), F.col("group_title").alias("organizer"),
        F.coalesce(to_instant(F.col("date_iso")), to_instant(F.col("date_utc")), F.timestamp_seconds("date_ts")).alias("starts_at"), to_instant(F.col("date2_iso")).alias("ends_at"), on("is_all_day").alias("is_all_day"), on("is_canceled").alias("is_cancelled"), on("is_online").alias("is_online"), on("has_registration").alias("has_registration"),
        first_of(F.col("location_title"), F.col("location")).alias("location"), first_of(F.col("cost")).alias("cost"), F.when(on("is_online"), F.col("online_url")).alias("online_url"), F.col("url").alias("url"),
        F.slice(F.concat(_strings(F.col("tags")), _strings(F.col("event_types"))), 1, 10).alias("tags"), _strings(F.col("event_types_audience")).alias("audience"), where.alias("coordinates"), F.coalesce("event_types", F.array().cast("array<string>")).alias("event_types"), F.timestamp_seconds("last_modified").alias("last_modified"),
    )
    return one_of(out, ["identity"])


# Bare names of places, as titles of listings that only tell opening hours.
PLACES = [
    "50 meter", "50 meter pool", "indoor climbing tower", "lap pool", "outdoor pool", "peap", "polo road", "rc", "southside rec center", "student rec center", "student recreation center",
]


def useful_listing(title: Column, description: Column, owner: Column, location: Column, department: str = "rec sports") -> Column:
    """False for a department's routine opening hours; an explicit closure of the main centre stays."""
    words = lambda *xs: F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *xs)), "[^a-z0-9]+", " "))
    t, all_ = words(title), words(title, description, location)
    hours = t.rlike(r"\b(hours?|operating hours?|adjusted facility hours?)\b") | t.rlike(r"\b(open|closed|closure)$") | t.isin(PLACES)
    hours = hours | (t.rlike(r"\bfacilit(y|ies) (update|notice)\b") & all_.rlike(r"\b(hours?|open|closed|closure)\b"))
    closes = all_.rlike(r"\bstudent rec(reation)? center\b") & all_.rlike(r"\b(closed|closure)\b")
    ours = F.contains(F.lower(F.coalesce(owner, F.lit(""))), F.lit(department))
    return ~ours | ~hours | closes


def calendars(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(events of all channels, one row for each by identity; a report for each channel: rows, and warnings where a feed is full or empty).  paths: channel to file, the main one first."""
    feeds = [calendar(spark, p, c) for c, p in paths.items()]
    every = feeds[0]
    for f in feeds[1:]:
        every = every.unionByName(f)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(paths) for x in (c, i)])
    first = every.groupBy("identity").agg(F.min_by(F.struct(*[c for c in every.columns if c != "identity"]), order[F.col("channel")]).alias("x")).select("identity", "x.*")
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in paths])).alias("place", "channel"))
    counts = names.join(every.groupBy("channel").agg(F.count("*").alias("rows")), "channel", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    warn = F.when(F.col("rows") >= 1000, "hit the feed's cap of 1000 rows").when((F.col("rows") == 0) & (F.col("place") > 0), "no events")
    return first, counts.select("channel", "rows", F.array_compact(F.array(warn)).alias("warnings"))


CARDS = "external_id string, title string, organizer string, date_label string, location string"
_CARD = re.compile(r'<a\b[^>]*href="(/org/[^"/]+/events/[^"]+)"[^>]*>(.*?)</a>(.*?)(?=<a\b[^>]*href="/org/[^"/]+/events/|\Z)', re.S)
_PARA = re.compile(r'<p\b[^>]*text-sm2[^>]*>(.*?)</p>', re.S)


def event_cards(pages: DataFrame) -> DataFrame:
    """Cards of HTML listing pages (column html): anchors bound the records, three paragraphs give the rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strip = lambda x: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", x)).strip()
        for f in frames:
            rows = []
            for page in f["html"]:
                for m in _CARD.finditer(page or ""):
                    p = [strip(x) for x in _PARA.findall(m[2] + m[3])][:3] + [None] * 3
                    rows.append((m[1].rsplit("/", 1)[-1], strip(_PARA.sub("", m[2])), p[0], p[1], p[2]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CARDS.split(", ")])

    return one_of(pages.select("html").mapInPandas(run, CARDS), ["external_id"])


_DAY = r"(?:[A-Za-z]{3},\s*)?([A-Za-z]{3})\s+(\d{1,2})(?:,\s*(\d{4}))?(?:\s+(\d{1,2}(?::\d{2})?\s*[apAP][mM]))?"


def _clock(x: Column) -> Column:
    """Minutes after midnight of "1:00 pm" or "1pm"; null for none."""
    hour, minute = F.regexp_extract(x, r"^(\d{1,2})(?::(\d{2}))?\s*[apAP][mM]$", 1).try_cast("int"), F.regexp_extract(x, r"^(\d{1,2})(?::(\d{2}))?\s*[apAP][mM]$", 2)
    late = F.when(F.lower(x).rlike(r"pm$"), 12).otherwise(0)
    low = F.coalesce(F.nullif(minute, F.lit("")).try_cast("int"), F.lit(0))
    return F.when(hour.between(1, 12) & (low <= 59), (hour % 12 + late) * 60 + low)


def card_span(label: Column, now: Column) -> Column:
    """struct(starts_at, ends_at, is_all_day) of "Sun, Sep 6, 2026 1:00 pm", "Sep 6 - Sep 8, 2026" or "Sep 6, 2026 1:00 pm - 3:00 pm": local days and times; a missing year is the end's or the current one."""
    this_year = F.year(F.from_utc_timestamp(now, "America/Chicago"))
    text = collapse(label)
    left, right = F.get(F.split(text, r"\s+-\s+"), F.lit(0)), F.get(F.split(text, r"\s+-\s+"), F.lit(1))
    part = lambda x, i: F.nullif(F.regexp_extract(x, f"^{_DAY}$", i), F.lit(""))
    year_of = lambda x, other: F.coalesce(part(x, 3).try_cast("int"), other)

    def at(x: Column, year: Column, minutes: Column) -> Column:
        day = F.try_make_timestamp(year, month_of(part(x, 1)), part(x, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
        return F.when(year.between(2000, 2100) & x.rlike(f"^{_DAY}$"), civil_instant(F.timestamp_seconds(F.unix_seconds(day) + minutes * 60)))

    def minutes(x: Column) -> Column:
        return F.when(part(x, 4).isNull(), 0).otherwise(_clock(part(x, 4)))

    dated = F.coalesce(right.rlike(f"^{_DAY}$"), F.lit(False))
    year = year_of(left, F.when(dated, year_of(right, this_year)).otherwise(this_year))
    ends = F.when(dated, at(right, year_of(right, this_year), minutes(right))).otherwise(at(left, year, _clock(right)))
    return F.struct(at(left, year, minutes(left)).alias("starts_at"), ends.alias("ends_at"), part(left, 4).isNull().alias("is_all_day"))


def card_instant(label: Column, now: Column | None = None) -> Column:
    """When an event of a card begins."""
    return card_span(label, now if now is not None else F.current_timestamp())["starts_at"]


LISTING_PAGES = Kind("html", "", r'<a\b[^>]*href="/org/[^"/]+/events/[^"]+"', lambda field: F.when(F.size(field("records")) == 0, "the page holds no event card"))


def event_listing(pages: DataFrame, now: Column, days: int = 45) -> DataFrame:
    """Events of listing pages (page, html) with title, organiser and date, within the horizon.  A first page without any card is a fault (``LISTING_PAGES``): its markup has changed."""
    cards = event_cards(pages).withColumn("span", card_span(F.col("date_label"), now))
    known = cards.where("coalesce(title, '') <> '' and coalesce(organizer, '') <> '' and span.starts_at is not null")
    end = F.coalesce("span.ends_at", "span.starts_at")
    near = known.where((millis("span.starts_at") <= millis(now) + days * 86_400_000) & (millis(end) >= millis(now) - 86_400_000))
    return near.select("external_id", "title", "organizer", "location", "span.*", F.array(F.concat(F.lit("event:listing-"), "external_id")).alias("identity"), F.array(F.lit("Student organization"), F.col("organizer")).alias("tags"))


LEAGUES = "id string, name string, schedules array<struct<divisions:array<string>,registration:string,join:string,season:string,payment:string>>"


def _local(text: Column, year: int, end_of_day: bool = False) -> Column:
    """"Aug 30", "Aug 30 5:00PM" or "Aug 30 midnight" in local time."""
    month, day, clock = (F.regexp_extract(F.trim(text), r"^([A-Z][a-z]{2})\s+(\d{1,2})(?:\s+(.+))?$", i) for i in (1, 2, 3))
    minutes = F.when(clock == "", (24 * 60 - 1) if end_of_day else 0).when(F.lower(clock) == "midnight", 0).otherwise(_clock(clock))
    at = F.try_make_timestamp(F.lit(year), month_of(month), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return civil_instant(F.timestamp_seconds(F.unix_seconds(at) + minutes * 60 + (59 if end_of_day else 0)))


def leagues(sports: DataFrame, now: Column, year: int, source: str, membership: str = "Membership") -> DataFrame:
    """Events from a published league schedule (``LEAGUES``): one for each sport, from the first season's start to the last one's end, its deadline the next end of registration or else the last.

    ``membership``: the payment that is a membership for each player.
    """
    half = lambda x, i: F.get(F.split(x, " - "), F.lit(i))
    starts, ends = F.transform("schedules", lambda s: _local(half(s["season"], 0), year)), F.transform("schedules", lambda s: _local(half(s["season"], 1), year, True))
    closing = F.array_sort(F.transform("schedules", lambda s: _local(half(s["registration"], 1), year)))
    cost_of = lambda p: F.when(p == membership, "Membership required per player").when(p == "$50.00 Team", "$50 per team").otherwise(p)
    paid = F.array_distinct(F.filter(F.transform("schedules", lambda s: s["payment"]), lambda p: p.isNotNull()))
    divisions = F.flatten(F.transform("schedules", lambda s: s["divisions"]))
    said = lambda s: F.concat(F.lit("Divisions: "), F.array_join(s["divisions"], ", "), F.lit(". Registration: "), s["registration"], F.lit(". Join teams: "), s["join"], F.lit(". Season: "), s["season"], F.lit("."), F.coalesce(F.concat(F.lit(" "), cost_of(s["payment"]), F.lit(".")), F.lit("")))
    return sports.select(
        F.array(F.concat(F.lit(f"event:{source}-"), "id")).alias("identity"), F.col("name").alias("title"), F.array_join(F.transform("schedules", said), " ").alias("summary"), F.array_min(starts).alias("starts_at"), F.array_max(ends).alias("ends_at"),
        F.coalesce(F.try_element_at(F.filter(closing, lambda d: d >= now), F.lit(1)), F.array_max(closing)).alias("deadline_at"),
        F.when(F.size(paid) == 1, cost_of(F.get(paid, F.lit(0)))).when(F.size(paid) > 1, "Varies by division").alias("cost"), F.concat(F.array(F.lit("IM"), F.lit("Intramural")), divisions).alias("tags"),
        F.size(divisions).alias("n_divisions"), F.lit("sports").alias("category"), F.lit(source).alias("source"),
    )


def taxonomies(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(taxonomy, id, name, slug) from term lists that are arrays or objects keyed by id; malformed terms are left out."""
    out = None
    for name, path in paths.items():
        raw = spark.read.text(path, wholetext=True)
        term = "struct<id:bigint,name:string,slug:string>"
        listed, keyed = F.from_json("value", f"array<{term}>"), F.map_values(F.from_json("value", f"map<string,{term}>"))
        rows = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(keyed)).alias("t")).where("t.id is not null and t.name is not null")
        rows = rows.select(F.lit(name).alias("taxonomy"), "t.id", html_to_text(F.col("t.name")).alias("name"), "t.slug")
        out = rows if out is None else out.unionByName(rows)
    return one_of(out, ["taxonomy", "id"])


def term_map(terms: DataFrame) -> DataFrame:
    """One row with a map of ids to names; a dimension of hundreds of rows."""
    return terms.agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("terms"))


_R = "struct<rendered:string>"
STUDIES = (
    f"id bigint, date_gmt string, modified_gmt string, slug string, link string, status string, title {_R}, content {_R}, excerpt {_R}, aux_study_category array<bigint>, aux_study_location array<bigint>, "
    "aux_study_session_type array<bigint>, aux_study_topic array<bigint>, meta struct<compensation:string,duration:string,contact_name:string,contact_email:string,pi_name:string,irb_number:string,"
    "irb_approval_date:string,expiration_date:string,lifecycle:string,minimum_age:string,maximum_age:string>"
)


STUDY_PAGES = Kind("array", STUDIES)


def studies(spark: SparkSession, path: str) -> DataFrame:
    """Raw study listings, one row for each id; rows without an id or meta are malformed and left out."""
    r = good(landed(spark, path), STUDY_PAGES).select(F.inline("records")).where("id is not null and meta is not null")
    terms = F.flatten(F.array_compact(F.array("aux_study_session_type", "aux_study_location", "aux_study_category", "aux_study_topic")))
    out = r.select(
        F.col("id").cast("string").alias("id"), "slug", F.col("link").alias("url"), F.col("title.rendered").alias("title"), F.col("excerpt.rendered").alias("excerpt"), F.col("content.rendered").alias("body"), "meta.compensation", "meta.duration",
        first_of(F.col("meta.irb_number")).alias("irb_number"), first_of(F.col("meta.pi_name")).alias("pi_name"), first_of(F.col("meta.contact_name")).alias("contact_name"), first_of(F.col("meta.contact_email")).alias("contact_email"),
        F.col("meta.irb_approval_date").alias("approved"), F.col("meta.expiration_date").alias("expires"), F.regexp_extract("meta.lifecycle", r"-?\d+", 0).try_cast("int").alias("lifecycle_months"),
        F.col("meta.minimum_age").alias("min_age"), F.col("meta.maximum_age").alias("max_age"), to_instant(F.col("date_gmt")).alias("posted"),
        F.coalesce(to_instant(F.col("modified_gmt")), to_instant(F.col("date_gmt"))).alias("modified"), terms.alias("term_ids"),
    )
    return one_of(out, ["id"])


def check_pages(rows: DataFrame, stated: int) -> list[str]:
    """Warnings where the rows read are not as many as the source's header states."""
    n = rows.count()
    return [] if n == stated else [f"the header states {stated} rows, {n} were read"]


def unexpected_lifecycles(rows: DataFrame, known: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    return rows.where(~F.col("lifecycle_months").isin(*known)).select("lifecycle_months").distinct().orderBy("lifecycle_months")
