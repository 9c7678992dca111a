"""Connectors on small extracts of our own, and the vertical drivers from source rows to ranked lists."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ingest, serve, snapshots, state, studies
from feedloom.sources import feeds, pages


def ts(x):
    return F.lit(x).cast("timestamp")


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text, indent=1))  # over many lines, as servers send it
    return str(path)


def test_literature(spark, tmp_path):
    rows = [
        {"id": "1", "source": "MED", "pmid": "1", "doi": "10.1000/A", "title": "<i>M. tuberculosis</i> : x", "authorString": "Doe J., Roe R.", "firstPublicationDate": "2026-01-05", "isOpenAccess": "Y", "citedByCount": 3,
         "fullTextUrlList": {"fullTextUrl": [{"url": "h", "availabilityCode": "OA", "documentStyle": "html"}, {"url": "p", "availabilityCode": "OA", "documentStyle": "pdf"}]}, "pubTypeList": {"pubType": ["Review"]}, "keywordList": {"keyword": ["k"]}},
        {"id": "2", "source": "PPR", "title": "Second", "authorList": {"author": [{"fullName": "A B"}, {"firstName": "C", "lastName": "D"}, {}]}, "pubYear": "2025"}, {"id": "3", "title": ""}, {"title": "no address"}, {"title": "by doi", "doi": "10.1000/z", "pubYear": "2024"},
    ]
    p = put(tmp_path / "l.json", {"nextCursorMark": "x", "resultList": {"result": rows}})
    got = {r.title: r for r in feeds.identity(feeds.literature(spark, p, "q", "https://example.org/article")).collect()}
    assert set(got) == {"M. tuberculosis : x", "Second", "by doi"}
    a, b, c = got["M. tuberculosis : x"], got["Second"], got["by doi"]
    assert (a.kind, a.open_access_url, a.url, a.identity, [x.name for x in a.authors]) == ("review", "p", "https://example.org/article/MED/1", ["doi:10.1000/a", "pmid:1"], ["Doe J", "Roe R"])
    assert (b.kind, b.preprint_version, [x.name for x in b.authors], b.published_date.year) == ("preprint", 1, ["A B", "C D"], 2025) and c.url == "https://doi.org/10.1000/z"
    assert feeds.literature(spark, p, "q", "s", since=ts("2025-06-01")).count() == 1 and feeds.literature(spark, p, "q", "s", most=2).count() == 2


def test_pubmed(spark, tmp_path):
    xml = """<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2025</Year><Month>Mar</Month><Day>4</Day></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T  one</ArticleTitle>
    <Abstract><AbstractText Label="BACKGROUND">b</AbstractText><AbstractText>c</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName><Identifier Source="ORCID">0-1</Identifier></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
    <PublicationTypeList><PublicationType>Systematic Review</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1000/Q</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
    <PubmedArticle><MedlineCitation><PMID>8</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2024 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>U</ArticleTitle><Abstract><AbstractText>x</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
    <PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal></Journal></Article></MedlineCitation></PubmedArticle></Set>"""
    p = put(tmp_path / "a.xml", xml)
    got = {r.pmid: r for r in feeds.pubmed(spark, p).collect()}
    assert set(got) == {"7", "8"}
    a = got["7"]
    assert (a.doi, a.pmcid, a.title, a.abstract, a.journal, a.kind, str(a.published_date)) == ("10.1000/q", "pmc9", "T one", "BACKGROUND: b c", "J", "review", "2025-03-04 00:00:00")
    assert [(x.name, x.orcid) for x in a.authors] == [("Jo Doe", "0-1"), ("Group", None)] and str(got["8"].published_date) == "2024-01-01 00:00:00"
    assert [r.pmid for r in feeds.pubmed(spark, p, ids=spark.createDataFrame([("8",)], "pmid string")).collect()] == ["8"]


def test_metadata_and_enrichment(spark, tmp_path):
    items = [{"DOI": "10.1000/A", "title": ["T"], "container-title": ["J"], "is-referenced-by-count": 9, "license": [{"URL": "https://creativecommons.org/x"}], "link": [{"URL": "f", "content-type": "application/pdf"}], "issued": {"date-parts": [[2025, 3]]}},
             {"DOI": "10.1000/b", "issued": {"date-parts": [[2999]]}, "link": [{"URL": "g", "content-type": "application/pdf"}]}]
    m = feeds.crossref(spark, put(tmp_path / "c.json", {"message": {"items": items}}), ts("2026-01-01"))
    got = {r.doi: r for r in m.collect()}
    assert (got["10.1000/a"].journal, str(got["10.1000/a"].published_date), got["10.1000/a"].open_access_url) == ("J", "2025-03-01 00:00:00", "f")
    assert got["10.1000/b"].published_date is None and got["10.1000/b"].open_access_url is None
    own = spark.createDataFrame([("10.1000/a", "old", 1, False, "long abstract"), ("x", "own", 2, True, "y")], "doi string, journal string, cited_by int, is_open_access boolean, abstract string")
    e = {r.doi: (r.journal, r.cited_by, r.is_open_access, r.abstract) for r in feeds.enrich(own, m).collect()}
    assert e == {"10.1000/a": ("J", 9, True, "long abstract"), "x": ("own", 2, True, "y")}


def test_calendars_and_listings(spark, tmp_path):
    ev = lambda i, t, **k: {"id": i, "title": t, "date_ts": 1_700_000_000, "group_title": "Rec Sports", **k}
    a = put(tmp_path / "a.json", [ev(1, "Holiday hours"), ev(2, "Student Rec Center closed"), ev(3, "Yoga", tags=["x"])])
    b = put(tmp_path / "b.json", [ev(3, "Yoga again")])
    c = put(tmp_path / "c.json", [])
    rows, reports = feeds.calendars(spark, {"main": a, "sub": b, "none": c})
    got = {r.title: r.channel for r in rows.collect()}
    assert got == {"Holiday hours": "main", "Student Rec Center closed": "main", "Yoga": "main"} and {r.channel: list(r.warnings) for r in reports.collect()} == {"main": [], "sub": [], "none": ["no events"]}
    useful = rows.where(feeds.useful_listing(F.col("title"), F.lit(""), F.col("organizer"), F.lit(None).cast("string")))
    assert {r.title for r in useful.collect()} == {"Student Rec Center closed", "Yoga"}
    card = lambda n, day: f'<a href="/org/x/events/{n}">Event {n}</a><p class="text-sm2">Club</p><p class="text-sm2">{day}</p><p class="text-sm2">Hall</p>'
    html = card(1, "Sun, Sep 6, 2026 1:00 pm - 3:00 pm") + card(2, "Sep 6 - Sep 8, 2026") + card(3, "Sep 9 1pm") + card(4, "soon") + card(5, "Dec 25, 2026 1pm")
    got = {r.external_id: r for r in feeds.event_listing(spark.createDataFrame([(1, html)], "page int, html string"), ts("2026-09-01")).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (str(got["1"].starts_at), str(got["1"].ends_at), got["1"].is_all_day) == ("2026-09-06 18:00:00", "2026-09-06 20:00:00", False)
    assert (str(got["2"].starts_at), str(got["2"].ends_at), got["2"].is_all_day) == ("2026-09-06 05:00:00", "2026-09-08 05:00:00", True) and str(got["3"].starts_at) == "2026-09-09 18:00:00"
    assert feeds.event_listing(spark.createDataFrame([(1, "<p>nothing</p>")], "page int, html string"), ts("2026-09-01")).count() == 0


def test_preprint_pages(spark, tmp_path):
    one = lambda i: {"title": f"T{i}", "doi": f"10.1101/{i}", "date": f"2026-01-0{i}", "version": "1", "published": "NA", "server": "bioRxiv", "authors": "A"}
    good = put(tmp_path / "g.json", {"messages": [{"status": "ok"}], "collection": [one(1), one(2), one(3), {"title": "x", "doi": "NA"}]})
    assert [r.doi for r in feeds.preprints(spark, good, most=2).orderBy("doi").collect()] == ["10.1101/2", "10.1101/3"]
    none = put(tmp_path / "n.json", {"messages": [{"status": "no posts found"}], "collection": []})
    assert feeds.preprints(spark, none).count() == 0
    bad = put(tmp_path / "b.json", {"messages": [{"status": "error 500"}], "collection": []})
    assert feeds.preprints(spark, bad).count() == 0
    r = pages.report(pages.landed(spark, bad), feeds.PREPRINT_PAGES, "biorxiv").first()
    assert (r.failed_requests, r.error, r.warnings) == (1, "1 page(s): the feed answered: error 500", ["1 page(s): the feed answered: error 500"])


def test_works(spark, tmp_path):
    w = lambda i, **k: {"id": f"https://x.org/W{i}000", "title": f"t{i}", "publication_date": f"2026-01-0{i}", "type": "article", "abstract_inverted_index": {"b": [1], "a": [0]}, **k}
    p = put(tmp_path / "w.json", {"results": [w(1), w(2, type="preprint"), w(3, type="paratext"), w(4, is_paratext=True), w(5, type=None), w(6, type="book"), w(7, type="dataset")]})
    got = {r.title: (r.kind, r.openalex_id, r.abstract) for r in feeds.works(spark, p).collect()}
    assert got == {"t1": ("journal-article", "W1000", "a b"), "t2": ("preprint", "W2000", "a b"), "t5": ("other", "W5000", "a b"), "t6": ("other", "W6000", "a b")}
    assert feeds.works(spark, p, most=1).first().title == "t6" and feeds.works(spark, p, since=F.lit("2026-01-02").cast("date")).count() == 3
    more = w(1, doi="https://doi.org/10.1/A", ids={"pmid": "https://x.org/77", "pmcid": "PMC1"}, cited_by_count=3, referenced_works=["https://openalex.org/W2000", "odd"], topics=[{"display_name": "T"}], primary_location={"landing_page_url": "u", "source": {"display_name": "J"}},
             open_access={"is_oa": True, "oa_url": "oa"}, best_oa_location={"pdf_url": None}, authorships=[{"author": {"display_name": "Doe", "orcid": "0-1"}, "institutions": [{"display_name": "Lab"}]}, {"author": {"display_name": "Roe"}, "institutions": [], "raw_affiliation_strings": ["Raw"]}, {"author": {}}])
    r = feeds.works(spark, put(tmp_path / "m.json", {"results": [more]}), channel="q").first()
    assert (r.journal, r.is_open_access, r.open_access_url, r.pmid, r.url, r.channel, r.topics, r.references) == ("J", True, "oa", "77", "u", "q", ["T"], ["W2000"])
    assert [tuple(a) for a in r.authors] == [("Doe", "0-1", "Lab"), ("Roe", None, "Raw")] and r.identity[0] == "openalex:w1000" and r.identity[-1] == "pmid:77"



def test_leagues(spark):
    s = [("Aug 30 - Oct 11", "Aug 1 12:00AM - Aug 20 5:00PM", ["A", "B"], "$50.00 Team"), ("Oct 12 - Nov 1", "Sep 1 12:00AM - Oct 1 midnight", ["C"], "Membership")]
    row = [("7", "Soccer", [{"divisions": d, "registration": r, "join": "j", "season": x, "payment": p} for x, r, d, p in s])]
    r = feeds.leagues(spark.createDataFrame(row, feeds.LEAGUES), ts("2026-09-01"), 2026, "leagues").first()
    assert (str(r.starts_at), str(r.ends_at), str(r.deadline_at), r.cost, r.n_divisions) == ("2026-08-30 05:00:00", "2026-11-02 05:59:59", "2026-10-01 05:00:00", "Varies by division", 3)
    assert "Divisions: A, B. Registration: Aug 1 12:00AM - Aug 20 5:00PM. Join teams: j. Season: Aug 30 - Oct 11. $50 per team." in r.summary


def test_study_listings(spark, tmp_path):
    meta = lambda **k: {"irb_number": "IRB2025-1", "minimum_age": "18", "maximum_age": "99", "irb_approval_date": "01/15/2026", **k}
    row = lambda i, m, **k: {"id": i, "title": {"rendered": f"A &amp; B {i}"}, "excerpt": {"rendered": ""}, "content": {"rendered": "<p>We meet on Zoom. Participants will receive $40.</p>"}, "modified_gmt": f"2026-01-0{i}T00:00:00", "date_gmt": "2025-12-01T00:00:00", "meta": m, **k}
    rows = [row(1, meta(compensation="", duration="2 hours", lifecycle=6), aux_study_topic=[5]), row(2, meta(compensation="$30", duration="Two visits, each 1 hour", lifecycle="7")), row(3, meta(irb_number="", compensation="$25/hr", duration="")), {"id": None}, row(2, meta())]
    raw = feeds.studies(spark, put(tmp_path / "s.json", rows))
    assert raw.count() == 3 and feeds.check_pages(raw, 4) and not feeds.check_pages(raw, 3) and [r[0] for r in feeds.unexpected_lifecycles(raw).collect()] == [7]
    terms = feeds.taxonomies(spark, {"topic": put(tmp_path / "t.json", [{"id": 5, "name": "Online only"}, {"id": None}]), "place": put(tmp_path / "u.json", {"6": {"id": 6, "name": "Remote", "slug": "r"}})})
    assert {(r.taxonomy, r.id, r.name) for r in terms.collect()} == {("topic", 5, "Online only"), ("place", 6, "Remote")}
    names = feeds.term_map(terms).first().terms
    got = {r.id: r for r in ingest.study_list(raw, ts("2026-02-01"), F.create_map(*[F.lit(x) for p in names.items() for x in p])).collect()}
    assert (got["1"].rate, got["1"].pay.notes[0], "online" in got["1"].tags, got["1"].plain_title) == (20.0, "from the body", True, "A & B 1")
    assert (got["2"].rate, got["2"].bucket, got["2"].duplicate_ids, got["1"].duplicate_of) == (15.0, "ok", ["1"], "2") and (got["3"].rate, got["3"].basis, got["3"].duplicate_of) == (25.0, "stated-hourly", None)
    assert {r.staleness for r in got.values()} == {"fresh"} and got["1"].eligibility.min_age == 18 and got["1"].eligibility.max_age is None


def test_research_driver(spark):
    rows = [
        ("pubmed", ["doi:10.1/a", "pmid:1"], "Positive selection in Mycobacterium tuberculosis", "codon model " * 20, "10.1/a", "journal-article", None, "2026-01-20"),
        ("biorxiv", ["doi:10.1/a"], "Positive selection in M. tuberculosis", "short", "10.1/a", "preprint", None, None), ("biorxiv", ["doi:10.1/p"], "Diabetes and tuberculosis: a study", "x " * 60, "10.1/p", "preprint", "10.1/a", "2026-01-25"),
        ("arxiv", ["arxiv:1"], "Nothing of interest", "y " * 60, None, "preprint", None, "2026-01-25"), ("arxiv", [], "No identity", "", None, "preprint", None, None),
    ]
    none = lambda t: F.lit(None).cast(t)
    raw = spark.createDataFrame(rows, "source string, identity array<string>, title string, abstract string, doi string, kind string, published_doi string, day string").withColumns({
        "published_date": F.col("day").cast("timestamp"), "journal": F.when(F.col("kind") == "journal-article", "Journal"), "authors": F.array(F.struct(F.lit("Doe").alias("name"), none("string").alias("affiliation"))), "tags": F.array(F.lit("t")),
        "references": F.array().cast("array<string>"), "is_open_access": F.lit(False), "open_access_url": none("string"), "preprint_version": none("int"), "cited_by": F.lit(1), "published_in": none("string"), "url": F.lit("u"), "pmid": none("string"), "pmcid": none("string"),
        "arxiv_id": none("string"), "openalex_id": none("string"), "topics": F.array().cast("array<string>"), "is_superseded": F.lit(False),
    }).drop("day")
    meta = spark.createDataFrame([("10.1/a", 50)], "doi string, cited_by int")
    got = {r.doi: r for r in ingest.research(raw, meta, ts("2026-02-01")).collect()}
    assert set(got) == {"10.1/a", "10.1/p"}
    a, p = got["10.1/a"], got["10.1/p"]
    assert (a.band, a.cited_by, sorted(a.sources), a.is_superseded, round(a.source_confidence, 2)) == ("core", 50, ["biorxiv", "pubmed"], False, 0.99) and (p.published_in, p.is_superseded) == ("Journal", True)
    assert a.relevance == 95 and "codon-model analysis" in [r.label for r in a.reasons] and a.id.startswith("research-") and len(a.id) == 21


def test_campus_driver(spark):
    rows = [
        ("calendar", "event:c-1", "Google info session", "free pizza provided", "CS", "2026-02-02 18:00:00", False), ("listing", "event:l-9", "Google info session", "", "CS", "2026-02-02 18:30:00", False),
        ("calendar", "event:c-2", "Old hackathon", "coding", "CS", "2026-01-01 18:00:00", False), ("calendar", "event:c-3", "Hackathon", "coding", "CS", "2026-02-03 10:00:00", False), ("calendar", "event:c-4", "Hackathon", "coding", "CS", "2026-02-04 10:00:00", True),
        ("calendar", "event:c-5", "Participants needed", "a paid study", "Lab", "2026-02-05 10:00:00", False), ("leagues", "event:g-1", "Cornhole", "", "Rec Sports", "2026-09-01 10:00:00", False), ("calendar", "event:c-6", "Quiet hour", "", "X", "2026-09-01 10:00:00", False),
    ]
    raw = spark.createDataFrame(rows, "source string, k string, title string, summary string, organizer string, s string, is_cancelled boolean").select(
        "source", F.array("k").alias("identity"), "title", "summary", "organizer", F.col("s").cast("timestamp").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), F.lit(None).cast("timestamp").alias("deadline_at"),
        F.lit("Hall").alias("location"), F.lit(None).cast("string").alias("cost"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("event_types"), "is_cancelled", F.lit(False).alias("is_online"), F.lit(False).alias("has_registration"),
    )
    festival = dict(pattern=r"(?i)^club crawl\s+((?:fall|spring)\s+\d{4})(?:\s*[-:]\s*(.*))?$", name="Club Crawl {}", umbrella="Club Crawl")
    got = {r.title: r for r in ingest.campus(raw, ts("2026-02-01 12:00:00"), "registry", "listing", "leagues", festival).collect()}
    assert set(got) == {"Google info session", "Hackathon", "Cornhole"}
    g, h = got["Google info session"], got["Hackathon"]
    assert (sorted(g.sources), g.category, g.companies, g.food.tier, g.series_count) == (["calendar", "listing"], "companies", ["google"], "confirmed", 1)
    assert (h.series_count, h.is_cancelled) == (2, True) and g.relevance >= 12


def test_feed_export(spark, tmp_path):
    df = spark.createDataFrame([("g1", "A & B", "u", "s<", "2026-01-02 03:04:05"), ("g2", "C", "u", None, "2026-01-03 00:00:00")], "guid string, title string, url string, summary string, t string").withColumn("at", F.col("t").cast("timestamp"))
    xml = serve.rss_xml(df, "Feed", "https://example.org").first().xml
    assert xml.index("g2") < xml.index("g1") and "A &amp; B" in xml and "s&lt;" in xml and "Fri, 02 Jan 2026 03:04:05 GMT" in xml
    serve.json_export(spark.createDataFrame([("b",), ("a",)], "id string"), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == ["a", "b"]


def test_old_snapshots_are_sanitised(spark):
    items = spark.createDataFrame([("a", "Talk", "x", ["calendar"]), ("b", "Participants needed", "", ["calendar"]), ("c", "Study", "", ["registry"])], "id string, title string, summary string, sources array<string>")
    changes = spark.createDataFrame([("a", "k"), ("b", "k")], "item_id string, kind string")
    kept, left = serve.sanitize_snapshot(items, changes, "registry", r"participants? needed")
    assert [r.id for r in kept.collect()] == ["a"] and [r.item_id for r in left.collect()] == ["a"]
    assert [r.id for r in serve.find_item(items.withColumn("vertical", F.lit("campus")), "a").collect()] == ["a"]


def test_marks_and_profiles(spark):
    e = spark.createDataFrame([("u", "i", "save", 1), ("u", "i", "attend", 2), ("u", "i", "less", 3), ("u", "i", "track", 4)], "u string, i string, k string, at int")
    assert state.marks(e, "u", "i", "k", ["at"]).first().asDict() == {"u": "u", "i": "i", "saved": False, "attending": False, "dismissed": True, "tracked": True, "feedback": "less"}
    p = spark.range(1).select(state.parse_profile(F.lit('{"v":2,"profile":{"age":30.5,"sex":"x"}}')).alias("p"), state.parse_profile(F.lit("nonsense")).alias("q")).first()
    assert p.p.age is None and p.p.sex is None and p.q.age is None
    one = spark.createDataFrame([("a", 0), ("b", 1)], "vertical string, scanned int").withColumn("week_of", F.lit("2026-01-05").cast("date"))
    assert [r.vertical for r in snapshots.digest_history(one).collect()] == ["b"]


def test_study_text(spark):
    from feedloom.functions import text as T
    from feedloom.operators import pay

    cases = {"<p>a&frac12;<br>b</p><!-- x --><script>y</script>": "a½ b", "c&alpha;&#39;\u200bd<hr>e": "c&alpha;' d e", None: "", "x&#0;&szlig;": "x&#0;ß"}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").select("x", "want", T.study_text(F.col("x")).alias("got")).collect()
    assert all(r.got == r.want == pay.plain_text(r.x) for r in got)
    assert [r[0] for r in spark.createDataFrame([("alpha beta gamma",), ("short",), ("abcdefghijklmnop",)], "x string").select(T.truncate(F.col("x"), 12)).collect()] == ["alpha beta…", "short", "abcdefghijk…"]


def test_broken_pages_are_reported_and_good_ones_read(spark, tmp_path):
    one = lambda i: {"title": f"T{i}", "doi": f"10.1101/{i}", "date": "2026-01-01", "version": "1", "published": "NA", "server": "bioRxiv", "authors": "A"}
    where = tmp_path / "bio"
    where.mkdir()
    for n, page in enumerate([{"messages": [{"status": "ok"}], "collection": [one(1), one(2)]}, {"messages": [{"status": "ok"}], "collection": [one(3), {**one(4), "title": {"odd": 1}}]}, {"other": 1}]):
        put(where / f"{n}.json", page)
    (where / "3.json").write_text('{"messages": [{"status": "ok"}], "collection": [{"title"')
    (where / "4.json").write_text(" ")
    assert {r.doi for r in feeds.preprints(spark, str(where)).collect()} >= {"10.1101/1", "10.1101/2", "10.1101/3"}
    r = pages.report(pages.landed(spark, str(where)), feeds.PREPRINT_PAGES, "biorxiv", asked=6).first()
    assert (r.pages, r.failed_requests, r.error, r.fetch_source) == (5, 4, None, "live") and r.item_count == 4
    assert {"1 page(s): the page lacks its records", "1 page(s): the page is not JSON", "1 page(s): the page is empty", "1 page(s) never landed"} <= set(r.warnings)
    assert {(f.page.rsplit("/")[-1], f.fault) for f in pages.faults(pages.landed(spark, str(where)), feeds.PREPRINT_PAGES, "b").collect()} == {("2.json", "the page lacks its records"), ("3.json", "the page is not JSON"), ("4.json", "the page is empty")}
    none = pages.report(pages.landed(spark, str(tmp_path / "nowhere")), feeds.WORKS_PAGES, "openalex")
    both = pages.report(pages.landed(spark, str(where)), feeds.PREPRINT_PAGES, "biorxiv").unionByName(none)
    assert {r.source: (r.status, r.failed_requests) for r in serve.source_health(both).collect()} == {"openalex": ("failed", 1), "biorxiv": ("degraded", 3)}
    assert both.select(*[c.split()[0] for c in pages.REPORT.split(", ")]).columns == both.columns
    # what the outage hid stays, what a healthy source no longer has goes
    items = lambda *rows: spark.createDataFrame(rows, "id string, sources array<string>, status string")
    before = items(("gone", ["biorxiv"], "new"), ("left", ["pubmed"], "new"), ("half", ["biorxiv", "pubmed"], "new"))
    kept = snapshots.retain(before, items(("now", ["pubmed"], "new")), pages.impaired(both))
    assert {(r.id, r.status) for r in kept.collect()} == {("now", "new"), ("gone", "unchanged")}


def test_broken_xml_and_html_pages(spark):
    rows = [("a", "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>8"), ("b", "oops"), ("c", "<Set/>"), ("d", "<Set><PubmedArticle><MedlineCitation><PMID>9</PMID></MedlineCitation></PubmedArticle></Set>")]
    xml = spark.createDataFrame(rows, "page string, body string")
    assert [r.MedlineCitation.PMID for r in pages.records(xml, feeds.ARTICLE_PAGES).collect()] == ["9"]
    r = pages.report(xml, feeds.ARTICLE_PAGES, "pubmed").first()
    assert (r.pages, r.item_count, r.failed_requests, r.warnings) == (4, 1, 2, ["1 page(s): the page is cut short", "1 page(s): the page is not XML"])
    html = spark.createDataFrame([("1", "<p>nothing</p>")], "page string, body string")
    assert pages.report(html, feeds.LISTING_PAGES, "listing").first().error == "1 page(s): the page holds no event card"


def test_pages_as_a_stream(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    put(where / "a.json", {"results": [{"id": "W1", "title": "t"}]})
    (where / "b.json").write_text("not json")
    q = pages.parsed(pages.landed(spark, str(where), streaming=True), feeds.WORKS_PAGES).select("page", "fault", "n").writeStream.format("memory").queryName("landed_pages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert {(r.fault, r.n) for r in spark.table("landed_pages").collect()} == {(None, 1), ("the page is not JSON", 0)}


def _listing(i, text="", **k):
    meta = {"irb_number": f"IRB2025-{i}", "minimum_age": "18", "maximum_age": "120", "irb_approval_date": "01/15/2026", "compensation": "$30", "duration": "Two visits, each 1 hour", "lifecycle": "6", **k}
    return {"id": i, "title": {"rendered": f"Study {i}"}, "excerpt": {"rendered": ""}, "content": {"rendered": f"<p>We meet on Zoom. {text}</p>"}, "modified_gmt": "2026-01-02T00:00:00", "date_gmt": "2025-12-01T00:00:00", "meta": meta}


def test_a_poisoned_listing_is_quarantined(spark, tmp_path):
    raw = feeds.studies(spark, put(tmp_path / "s.json", [_listing(1), _listing(2, "POISON"), _listing(3, "ODD"), _listing(4, irb_approval_date="")]))
    whole = {r.id: r for r in ingest.study_list(raw, ts("2026-02-01")).collect()}

    def read(field, time, body):
        if "POISON" in (body or ""):
            raise ZeroDivisionError("no such pay")
        return studies.read_listing(field, time, body)

    def criteria(title, excerpt, body, low, high):
        if "ODD" in (body or ""):
            raise KeyError("criteria")
        return studies.eligibility(title, excerpt, body, low, high)

    rows, bad, lines = ingest.study_run(raw, ts("2026-02-01"), read=read, criteria=criteria)
    got = {r.id: r for r in rows.collect()}
    assert set(whole) == {"1", "2", "3", "4"} and set(got) == {"1", "3", "4"}
    q = bad.collect()
    assert [(r.id, r.error) for r in q] == [("2", "ZeroDivisionError: no such pay")] and json.loads(q[0].raw)["compensation"] == "$30"
    assert {r.warning for r in lines.collect()} == {"1 listing(s) could not be read: ZeroDivisionError: no such pay", "1 listing(s) kept with criteria by age alone: KeyError: 'criteria'"}
    same = lambda r: {k: v for k, v in r.asDict().items() if k not in ("degraded", "eligibility")}
    assert all(same(got[i]) == same(whole[i]) for i in got) and got["1"].eligibility == whole["1"].eligibility
    assert (got["3"].eligibility.min_age, got["3"].eligibility.max_age, got["3"].eligibility.flags, got["3"].degraded) == (18, None, [], "KeyError: 'criteria'")
    assert whole["4"].staleness in ("fresh", "stale", "aging") and whole["1"].degraded is None
    assert all(df.count() == 0 for df in ingest.study_run(raw.where("false"), ts("2026-02-01")))
