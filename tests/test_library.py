"""Known answers for the library's operators."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from feedloom.functions import dates as D
from feedloom.functions import text as T
from feedloom.operators import collapse, score, serve, snapshots, state, studies


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def ts(x):
    return F.lit(x).cast("timestamp")


def test_text(spark):
    r = one(
        spark, a=T.collapse(F.lit(" a  b\n")), b=T.normalize_doi(F.lit("https://doi.org/10.1101/ABC.1")), c=T.normalize_doi(F.lit("nope")), d=T.tokens(F.lit("The Host-Pathogen été is x 7")),
        e=T.decode_email(T.encode_email(F.lit("a@bé–.org"), b"k3y!"), b"k3y!"), f=T.fnv1a(F.lit("a")), g=T.strip_emails(F.lit("to x@y.org now")), h=T.html_to_text(F.lit("<p>a&amp;b</p><script>x</script> c .")), i=T.clamp(F.lit("one twoo three four"), 13),
        j=T.js_round(F.lit(-2.5)), k=T.jaccard(F.array(), F.array()),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("a b", "10.1101/abc.1", None, ["host", "pathogen", "ete", "7"], "a@bé–.org", "e40c292c")
    assert (r.g, r.h, r.i, r.j, r.k) == ("to [email removed] now", "a&b c .", "one twoo…", -2, 0.0)  # html_to_text leaves punctuation alone; tidy_punctuation is a step of its own


def test_scores(spark):
    pts = lambda *p: F.array(*[score.reason("s", "l", x) for x in p])
    r = one(spark, a=score.finalize(pts(60, 60)), b=score.finalize(pts(-60)), c=score.imminence_points(ts("2026-08-10 14:00:00"), ts("2026-08-10 00:00:00")), d=score.imminence_points(ts("2026-08-10 01:30:00"), ts("2026-08-10 00:00:00")))
    assert (r.a, r.b, r.c, r.d) == (100, 0, 12, 14)  # tomorrow, today: civil days in Chicago
    df = spark.range(1).select("id", F.array(score.reason("a", "A", 5), score.reason("a", "A", 3), score.reason("b", "B", 0)).alias("reasons"))
    assert score.tidy(df, "id").first().reasons == [Row(signal="a", label="A", points=8)]


def test_dates(spark):
    r = one(spark, a=D.months_between(F.lit("2024-01-31"), F.lit("2024-02-29")), b=D.to_instant(F.lit("2024")), c=D.staleness(ts("2020-01-01"), ts("2024-01-01"), ts("2024-06-01")), d=D.staleness(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), ts("2024-06-01")))
    assert r.a == 1.0 and r.b.year == 2024 and (r.c, r.d) == ("expired", "stale")


@pytest.mark.parametrize(
    "text, low, high",
    [("None", 0.0, 0.0), ("", None, None), ("First Phase: $10 Second Phase: $20", 30.0, 30.0), ("Session 1: you get $5.00. Session 2: you get $10.00.", 15.0, 15.0), ("Entered into a raffle for $50", 0.0, 0.0)],
)
def test_pay(text, low, high):
    c = studies.compensation(text)
    assert (c["guaranteed_min"], c["guaranteed_max"]) == (low, high)


def test_time():
    assert studies.duration("45-60 minutes")["total_hours_max"] == 1.0
    assert studies.duration("Approximately 6 weeks") | {"confidence": 0} == {"total_hours_min": None, "total_hours_max": None, "session_count": None, "span_weeks": 6.0, "confidence": 0}
    d = studies.duration("Two visits, each about 2 hours, completed within two weeks.")
    assert (d["total_hours_max"], d["session_count"], d["span_weeks"]) == (4.0, 2, 2.0)


def test_rates(spark):
    schema = "hourly_min double, hourly_max double, raffle_only boolean, guaranteed_min double, guaranteed_max double, per_visit double, visit_count int, hours_min double, hours_max double, session_count int, hours_per_session boolean"
    rows = [(None, None, False, 70.0, None, 50.0, 2, None, 2.0, None, False), (None, None, False, 20.0, 20.0, None, None, None, 0.3333, None, False), (None, None, False, None, None, None, None, None, 1.0, None, False)]
    got = studies.reconcile_rate(spark.createDataFrame(rows, schema)).select("rate", "basis").collect()
    assert [tuple(r) for r in got] == [(60.0, "per-visit-pay-scaled"), (60.0, "whole-study"), (None, "unknown")]
    assert [r[0] for r in spark.createDataFrame([(9.99,), (10.0,), (20.0,), (40.0,), (None,)], "r double").select(studies.rate_bucket(F.col("r"))).collect()] == ["low", "ok", "good", "great", "unknown"]


def test_unanswered_is_never_ineligible(spark):
    e = studies.parse_eligibility(F.lit("A study"), F.lit(""), F.lit("Right-handed adults, must be MRI safe. Exclusion: pregnancy."), F.lit("18"), F.lit("30"))
    nothing = F.struct(F.lit(None).cast("int").alias("age"), *[F.lit(None).cast("boolean").alias(x) for x in ("right_handed", "mri_safe", "fasting", "cardiovascular", "pregnant", "seizure", "student")], F.lit(None).cast("string").alias("sex"))
    assert one(spark, v=studies.check_eligibility(e, nothing)).v.status == "unknown"


def test_entities(spark):
    cases = {
        "&amp;lt; &AMP; &nbsp;x": "&lt; &  x", "&#38;lt;": "&lt;", "&#x2013;&#8211;&#X41;": "––A", "&ampx &amp": "&ampx &amp", "&#0; &#x110000; &#xD800; &unknown;": "&#0; &#x110000; &#xD800; &unknown;", "a & b": "a & b", "": "", "&alpha;&le;": "α≤",
        "&#128512;": "😀",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "x string, want string").select("want", T.decode_entities(F.col("x")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_titles_and_cuts(spark):
    r = one(spark, a=T.clamp(F.lit("alpha beta gamma"), 10), b=T.canonical_title(F.lit("2026 R&D version 2 v3 – Été")), c=T.tidy_punctuation(F.lit("( a ) , b !")), d=T.clamp(F.lit("abcdefghijklmnop"), 10))
    assert (r.a, r.b, r.c, r.d) == ("alpha beta…", ["version", "2", "ete"], "(a), b!", "abcdefghij…")


def test_global_ids_forbid_a_merge_unless_shared(spark):
    rows = [(1, ["doi:1"]), (2, ["pmid:2"]), (3, []), (4, ["doi:1", "pmid:9"])]
    df = spark.createDataFrame(rows, "id long, identity array<string>").select("id", "identity", F.lit("research").alias("vertical"), F.array(F.lit("same"), F.lit("title"), F.lit("here")).alias("title_words"), F.lit(None).cast("timestamp").alias("occurred_at"), F.lit("o").alias("organizer"))
    assert {r.id: r.cluster for r in collapse.dedupe(df.where("id in (1, 2)")).collect()} == {1: 1, 2: 2}
    assert {r.id: r.cluster for r in collapse.dedupe(df.where("id in (1, 2, 4)")).collect()} == {1: 1, 2: 2, 4: 1}
    assert {r.id: r.cluster for r in collapse.dedupe(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}  # the one without ids ties the others


def test_companies_and_categories(spark):
    from feedloom.operators import classify

    def of(title, owner=None, types=""):
        hay = T.padded(F.lit(title))
        return one(spark, c=classify.category(hay, F.lit(owner), classify.companies(hay), T.padded(F.lit(types)))).c

    assert one(spark, c=classify.companies(T.padded(F.lit("Honeywell and ExxonMobil info session")))).c == ["exxonmobil", "honeywell"]
    assert [of("Scholarship applications due"), of("x", types="Athletics"), of("talk", "MSC Town Hall"), of("talk", None), of("Career night", "Aggie Athletics")] == ["deadline", "sports", "clubs", "community", "sports"]


def test_recency_counts_civil_days(spark):
    p = lambda a, b: one(spark, x=score.recency_points(ts(a), ts(b))).x
    assert p("2026-08-06 23:00:00", "2026-08-10 20:00:00") == 7  # four civil days, under four elapsed ones
    assert p("2026-08-20 00:00:00", "2026-08-10 00:00:00") == 10


def test_co_marketed_passes_others_through(spark):
    rows = [(1, "Club Crawl Fall 2026 - Chess", "chess", 0), (2, "Club Crawl Fall 2026", "Club Crawl", 0), (3, "Other", "o", 0), (4, "Club Crawl Fall 2026 - Go", "go", None), (5, "Club Crawl Spring 2027: Go", "go", 0)]
    df = spark.createDataFrame(rows, "id long, title string, organizer string, day int").select("id", F.col("id").alias("ord"), "title", F.lit("s").alias("summary"), "organizer", F.array("organizer").alias("tags"), F.array(F.lit("c")).alias("sources"), F.when(F.col("day") == 0, ts("2026-09-01")).alias("starts_at"))
    pattern = r"(?i)^club crawl\s+((?:fall|spring)\s+\d{4})(?:\s*[-:]\s*(.*))?$"
    got = {r.id: (r.title, r.members) for r in collapse.collapse_co_marketed(df, pattern, "Club Crawl {}: all", "Club Crawl").collect()}
    assert got == {2: ("Club Crawl Fall 2026: all", 2), 3: ("Other", 1), 4: ("Club Crawl Fall 2026 - Go", 1), 5: ("Club Crawl Spring 2027: Go", 1)}


def test_pay_in_the_body(spark):
    from feedloom.operators import pay

    assert pay.from_body("<p>Overview Participants will receive $40 for taking part.</p><p>Funded by a $4000 grant.</p>")["guaranteed_max"] == 40.0
    assert pay.from_body("You will be paid $10. You will be paid $20.") is None  # they disagree
    assert pay.misplaced("lunch and a t-shirt", False) == "perk" and pay.misplaced("$5 gift card", False) == "cash" and pay.misplaced("2 hours and lunch", True) is None


def test_pay_and_time_confirm_each_other():
    assert studies.duration_with_pay("3 visits with the team. 2 hours", {"visit_count": 3})["total_hours_max"] == 6.0
    assert studies.duration_with_pay("Two visits, each about 2 hours", {"visit_count": 2})["confidence"] == "high"
    assert studies.duration_with_pay("Two visits, each about 2 hours", {"visit_count": 5})["confidence"] == "low"


def test_series(spark):
    days = [f"2026-09-0{i} 10:00:00" for i in range(1, 6)]
    rows = [(i, "x", "a", d) for i, d in enumerate(days)] + [(10, "y", "a", "2026-01-01 10:00:00"), (11, "y", "a", "2026-03-06 10:00:00")]
    df = spark.createDataFrame(rows, "id int, title string, org string, s string").selectExpr("id", "title", "org", "cast(s as timestamp) starts_at", "cast(null as timestamp) ends_at")
    got = {r.id: r.series_count for r in collapse.collapse_series(df, ["title", "org"], "starts_at", "ends_at").collect()}
    assert got == {0: 5, 10: 1, 11: 1}


def test_dedupe(spark):
    rows = [(1, "campus", ["big", "sale", "day"], ["event:a-1"], "2026-01-01 10:00:00", "o"), (2, "campus", ["big", "sale", "day"], ["event:b-9"], "2026-01-01 10:00:00", "o"), (3, "campus", ["big", "sale", "day"], ["event:c-1"], "2026-01-08 10:00:00", "o"), (4, "research", ["q"], ["doi:1"], None, None), (5, "research", ["z"], ["doi:1"], None, None)]
    df = spark.createDataFrame(rows, "id long, vertical string, title_words array<string>, identity array<string>, o string, organizer string").withColumn("occurred_at", F.col("o").cast("timestamp"))
    assert {r.id: r.cluster for r in collapse.dedupe(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r.id: r.cluster for r in collapse.dedupe(df.repartition(7)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (3, "z")], "id int, t string")
    assert not snapshots.diff(a, a, ["t"]).where("kind <> 'unchanged'").count()
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "n")], "id int, t string")
    assert {r.id: r.kind for r in snapshots.diff(a, b, ["t"]).collect()} == {1: "changed", 2: "unchanged", 3: "removed", 4: "added"}
    prev = spark.createDataFrame([(1, ["s"]), (2, ["s", "h"]), (3, ["h"])], "id int, sources array<string>")
    kept = snapshots.retain(prev, prev.where("id = 3"), spark.createDataFrame([("s",)], "source string"))
    assert {r.id for r in kept.collect()} == {1, 3}


def test_state(spark):
    e = spark.createDataFrame([("u", "a", 15, 1), ("u", "a", 15, 2), ("u", "a", -3, 3)], "u string, s string, d int, at int")
    assert state.bias_fold(e, "u", "s", "d", ["at"]).first().bias == 17
    k = spark.createDataFrame([("u", "i", "save", 1), ("u", "i", "dismiss", 2)], "u string, i string, k string, at int")
    assert tuple(state.toggles(k, "u", "i", "k", ["at"]).first())[2:] == (False, True)
    assert one(spark, s=state.parse_state(F.lit("garbage"))).s.saved == []


def test_sources(spark, tmp_path):
    from feedloom.sources import feeds

    (tmp_path / "p.json").write_text('{"collection":[{"title":"T","authors":"A; B;","doi":"10.1101/X","date":"2026-01-02","version":"2","abstract":"x","published":"NA","server":"bioRxiv"}]}')
    r = feeds.preprints(spark, str(tmp_path / "p.json")).first()
    assert (r.doi, r.authors, r.preprint_version, r.published_doi) == ("10.1101/x", ["A", "B"], 2, None)
    (tmp_path / "c.json").write_text('[{"id":1,"title":"t","date_ts":1700000000,"location_latitude":30.61,"location_longitude":"-96.34","is_online":1,"description":"mail me a@b.org"},{"id":2,"title":"u","location_latitude":0,"location_longitude":"0"}]')
    a, b = feeds.calendar(spark, str(tmp_path / "c.json"), "main").orderBy("identity").collect()
    assert (tuple(a.coordinates), b.coordinates, a.is_online, "@" in a.summary) == ((30.61, -96.34), None, True, False)
    (tmp_path / "a.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2601.00001v3</id><title>A  b</title><link href="u" rel="alternate"/><link href="p" title="pdf"/><author><name>N</name></author></entry></feed>')
    x = feeds.atom(spark, str(tmp_path / "a.xml")).first()
    assert (x.arxiv_id, x.preprint_version, x.title, x.url, x.pdf) == ("2601.00001", 3, "A b", "u", "p")
    page = '<a href="/org/x/events/1/2">Big day</a><p class="text-sm2">Club</p><p class="text-sm2">Sun, Sep 6, 2026 1:00 pm</p><p class="text-sm2">Hall</p>'
    c = feeds.event_cards(spark.createDataFrame([(page,)], "html string")).select("*", feeds.card_instant(F.col("date_label")).alias("at")).first()
    assert (c.title, c.organizer, c.location, str(c["at"])) == ("Big day", "Club", "Hall", "2026-09-06 18:00:00")


def test_redaction_fails_loudly(spark):
    df = spark.createDataFrame([("n", "write to a@b.org")], "pi string, text string")
    with pytest.raises(Exception, match="would be published"):
        serve.redact(df, ["pi"], "text").collect()


def test_streaming(spark, tmp_path):
    from feedloom.streaming import feeds

    src = tmp_path / "in"
    spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "a", "y")], "k string, at int, c string, v string").write.parquet(str(src))
    stream = spark.readStream.schema("k string, at int, c string, v string").parquet(str(src))
    q = feeds.last_writer(stream, "k", "at", "c", "v").writeStream.outputMode("complete").format("memory").queryName("lww").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lww").first().v == "y"


def test_upserts_keep_the_latest_record(spark, tmp_path):
    from feedloom import store

    path = str(tmp_path / "vault")
    rec = lambda rows: spark.createDataFrame(rows, "k string, at int, c string, v string")
    assert store.table(spark, path) is None
    store.upsert(rec([("a", 1, "x", "one"), ("b", 5, "x", "b")]), path, "k", "at", "c", buckets=4)
    store.upsert(rec([("a", 2, "x", "two"), ("b", 4, "z", "old"), ("c", 1, "x", "c")]), path, "k", "at", "c", buckets=4)
    store.upsert(rec([("a", 2, "x", "two"), ("b", 4, "z", "old"), ("c", 1, "x", "c")]), path, "k", "at", "c", buckets=4)  # again
    assert {r.k: r.v for r in store.table(spark, path).collect()} == {"a": "two", "b": "b", "c": "c"}


def test_entry_survives_without_extras():
    import __spark_entry__ as e

    assert {"dedupe_components", "for_you_topk", "snapshot_diff"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def _sql(spark, name, sql, path):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "part"):
        if (path / f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    from feedloom.plans import queries as q

    return sorted(tuple(r) for r in q.QUERIES[name](spark, str(path)).collect()), sorted(con.execute(sql).fetchall())


def test_similarity_reads_whole_texts(spark, tmp_path):
    from feedloom.plans import queries as q

    head = " ".join(f"head{i}" for i in range(12))
    tail = [f"tail{i}" for i in range(60)]
    texts = [head + " " + " ".join(f"a{i}x" for i in range(60)), head + " " + " ".join(f"b{i}x" for i in range(60)), head + " " + " ".join(tail), head + " " + " ".join([*tail[:30], "other", *tail[31:]]), head, head, "too short", None]
    texts += ["head0 head1 " + " ".join(f"{v}{i}" for i in range(3)) + " " + " ".join(tail) + " end" for v in "pq"]  # heads differ, the rest is alike
    spark.createDataFrame([(i, x, "de", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _sql(spark, "title_similarity_pairs", q.ORACLES["title_similarity_pairs"], tmp_path)
    assert [r[:2] for r in got] == [r[:2] for r in want] == [(2, 3), (4, 5), (8, 9)] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
    clusters = {r.doc_id: r.cluster for r in q.QUERIES["dedupe_components"](spark, str(tmp_path)).collect()}
    assert clusters == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}


def test_words_travel_only_within_shared_blocks(spark, tmp_path, monkeypatch):
    """Of a corpus whose texts all start differently, no table holds a text but the first."""
    from feedloom.operators import collapse as c

    seen = []
    monkeypatch.setattr(c, "materialize", lambda df, *a, put=c.materialize: seen.append(put(df, *a)) or seen[-1])
    monkeypatch.setattr(c, "discard", lambda *a: None)
    rows = spark.range(40).select("id", F.split(F.concat(F.lit("u"), "id", F.lit(" v "), F.repeat(F.lit("same words here "), 20), F.lit("end")), " ").alias("words")).withColumn("block", F.concat_ws(" ", F.slice("words", 1, 2)))
    rows = rows.unionByName(spark.createDataFrame([(90 + i, f"one head {x}".split(), "one head") for i, x in enumerate(("a b c d e f g h", "a b c d e f g h i"))], "id long, words array<string>, block string"))
    _, links = c.similar_classes(rows, 0.82)
    assert links.where("ca <> cb").count() == 1 and links.count() == 43
    held = [x for x in seen if any(k in x.columns for k in ("said", "w", "words", "k"))]
    assert [x.count() for x in held] == [42, 2, 0] and not any(t.typeName() == "array" and n in ("w", "g") for x in seen for n, t in ((f.name, f.dataType) for f in x.schema))


def test_works_keep_long_abstracts(spark, tmp_path):
    from feedloom.plans import queries as q

    text = " ".join("".join(chr(97 + int(c)) for c in str(i)) for i in range(4500))
    spark.createDataFrame([(1, text, "de", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _sql(spark, "works_pages", q.ORACLES["works_pages"], tmp_path)
    assert got == want and len(got[0][-1].split()) == 4500


def test_markup_parts_as_in_sql(spark, tmp_path):
    import duckdb

    from feedloom.plans import queries as q

    pages = ["<title>a  &quot;b&quot; &amp;amp; <i>c</i>\n</title><a href='x?a&amp;b&lt;'>", "<title></title><title>second</title>", "<p>none</p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(q.ORACLES["markup_parts"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in q.QUERIES["markup_parts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and [r[2] for r in sorted(got)] == ['a  "b" &amp; c\n'.replace('"', "&quot;"), "", "", None]


def test_index_of_every_text(spark, tmp_path):
    from feedloom.plans import queries as q

    rows = [(1, "a b a\tc  b"), (2, ""), (3, None), (4, " \n ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in q.QUERIES["inverted_index_rebuild"](spark, str(tmp_path)).collect()}
    assert got == {1: "a b a c b", 2: "", 3: None, 4: ""}


def test_no_cap_needs_no_order(spark):
    from feedloom.sources import feeds

    rows = spark.range(5).withColumns({"source": F.lit("s"), "at": F.lit("2024-01-01").cast("date")})
    assert feeds.newest(rows, None, F.col("at"), "id", "source") is rows
    assert [r.id for r in feeds.newest(rows, 2, F.col("at"), "id", "source").orderBy("id").collect()] == [0, 1]


@pytest.mark.parametrize("name", ["band_facets", "run_summary"])
def test_texts_are_scored_once(spark, name, tmp_path):
    from feedloom.plans import queries as q

    spark.createDataFrame([(i, "words of a text", "en", "s", 15) for i in range(1, 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert not any("documents.parquet" in f for f in q.QUERIES[name](spark, str(tmp_path)).inputFiles())


def test_ranks_of_all_parts(spark, tmp_path):
    from feedloom.plans import queries as q

    spark.range(1, 301).selectExpr("id AS p_partkey", "900 + (id * 37) % 101 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got, want = _sql(spark, "nulls_last_both_ways", q.ORACLES["nulls_last_both_ways"], tmp_path)
    assert got == want and len(got) == 300
    unknown = [r for r in got if r[0] % 5 == 0]
    assert len(unknown) == 60 and all(r[1] > 240 and r[2] > 240 for r in unknown)


def test_snapshots_hold_every_row(spark, tmp_path):
    from feedloom.plans import queries as q

    spark.range(1, 155).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus", "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = {r.id: r.kind for r in q.QUERIES["snapshot_diff"](spark, str(tmp_path)).collect()}
    assert set(kinds) == set(range(1, 155)) and (kinds[77], kinds[7], kinds[11], kinds[5], kinds[6]) == ("added", "added", "removed", "changed", "unchanged")
    # user = event_id; user 9 is seen only by an event divisible by 3 and not by 5
    rows = [(i, i, "click" if i != 4 else "view") for i in (1, 3, 4, 5, 9, 15)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", (F.lit(1700000000) + F.col("event_id")).cast("timestamp"))
    e.unionByName(e.withColumns({"ts": F.col("ts") + F.expr("interval 1 day"), "event_id": F.col("event_id") - 300})).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.id for r in q.QUERIES["retain_unfetched"](spark, str(tmp_path)).collect()} == {1, 3, 5, 9, 15}
    seen = {(r.user_id, r.event_type): r.first_seen.timestamp() for r in q.QUERIES["carry_forward_first_seen"](spark, str(tmp_path)).collect()}
    # rows of the version before keep its date, the others have that of the new pull
    assert seen == {(i, k): 1700000000.0 + i + (86400 if i % 3 == 0 else 0) for i, _, k in rows}


def test_digests_of_two_years_stay(spark, tmp_path):
    from feedloom.plans import queries as q

    e = spark.range(110 * 2).selectExpr("id AS event_id", "'click' AS event_type", "timestamp'2024-01-01 12:00:00' + make_interval(0, 0, cast(id div 2 as int)) AS ts")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r.week_of for r in q.QUERIES["merge_digests_lww"](spark, str(tmp_path)).collect())
    weeks = sorted({r.w for r in e.selectExpr("cast(date_trunc('week', ts) as date) AS w").collect()})
    assert len(weeks) == 110 and got == weeks[-104:]


def test_locale_order(spark):
    from feedloom.functions.text import by_locale
    from feedloom.operators import score

    names = ["Zebra", "éclair", "apple", "Éclair", "Apple", "zebra", "eclair", "ähnlich", "b-c", "b c", "Öl"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(by_locale(F.col("n"))).collect()]
    assert got == ["ähnlich", "apple", "Apple", "b c", "b-c", "eclair", "éclair", "Éclair", "Öl", "zebra", "Zebra"]
    labels = [("topic", "Zebra", 5), ("topic", "éclair", 5), ("topic", "apple", -5), ("topic", "Apple", 5), ("topic", "eclair", 9)]
    df = spark.createDataFrame([(labels,)], "r array<struct<signal:string,label:string,points:int>>")
    assert [r.label for r in df.select(score.tidied(F.col("r")).alias("t")).first().t] == ["eclair", "apple", "Apple", "éclair", "Zebra"]
    rec = spark.createDataFrame([("k", 1, "B-client", "late"), ("k", 1, "a-client", "early"), ("k", 0, "z", "old")], "k string, at int, c string, v string")
    assert state.last_writer(rec, "k", "at", "c", "v").first().v == "late"


def test_suggestions_and_agenda(spark):
    rows = [(1, "Zed", ["Organization: Éa", "x"], ["Chan"]), (2, "zed", ["organization: Ea"], None), (3, None, None, ["Chan"]), (4, "Pin", [], [])]
    df = spark.createDataFrame(rows, "id int, organizer string, tags array<string>, channels array<string>")
    assert [tuple(r) for r in serve.organizer_suggestions(df, ["Pin", "New"], top=6).orderBy("place").collect()] == [(1, "Pin", 1), (2, "New", 0), (3, "Chan", 2), (4, "Ea", 1), (5, "Éa", 1), (6, "zed", 1)]
    days = [(1, "2026-09-01 20:00:00", 5), (2, "2026-09-02 03:00:00", 9), (3, "2026-09-02 15:00:00", 1), (4, None, 3), (5, "2026-09-02 03:00:00", 9)]
    x = spark.createDataFrame(days, "id int, s string, relevance int").withColumn("starts_at", F.col("s").cast("timestamp"))
    got = {r.id: (r.day, r.label, r.place) for r in serve.agenda(x, F.lit("2026-09-01 12:00:00").cast("timestamp")).collect()}
    assert got == {1: ("2026-09-01", "Today", 1), 2: ("2026-09-01", "Today", 2), 5: ("2026-09-01", "Today", 3), 3: ("2026-09-02", "Tomorrow", 1), 4: ("undated", "Open listing", 1)}
    kinds = serve.change_counts(spark.createDataFrame([("time",), ("title",), ("time",)], "kind string"))
    assert [tuple(r) for r in kinds.collect()] == [("time", 2), ("title", 1)]
    assert serve.of_category(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, category string"), "y").first().id == "b"


def test_records_of_several_clients(spark):
    rec = spark.createDataFrame([("k", 2, "a", '{"schema_version":1,"saved":["x"]}', "2026-01-01"), ("k", 1, "b", "{}", "2026-03-01"), ("j", 1, "a", "{}", None)], "k string, at long, c string, state string, visit string")
    got = {r.k: (r["at"], r.state, r.visit) for r in state.reconcile_records(rec, "k", "at", "c", "visit").collect()}
    assert got == {"k": (2, '{"schema_version":1,"saved":["x"]}', "2026-03-01"), "j": (1, "{}", None)}
    one = rec.where("c = 'a'")
    cleared = state.clear_all(one, one.where("k = 'k'").select("k"), "k", "at", F.lit(1))
    back = {r.k: (r["at"], r.state) for r in state.reconcile_records(cleared.unionByName(rec.where("k = 'k'")), "k", "at", "c", "visit").collect()}
    assert back == {"k": (3, "{}"), "j": (1, "{}")}  # the tombstone wins over every copy
    text = state.export(one.where("k = 'k'").withColumn("s", state.parse_state(F.col("state"))), "s").select(state.parse_state(F.col("s")).alias("again"))
    assert text.first().again.saved == ["x"]
    v = spark.range(1).select(*[state.valid_write(F.lit(a).cast("long"), F.lit(b), F.lit(s)).alias(f"v{i}") for i, (a, b, s) in enumerate([(None, 1, 5), (5, 5, 5), (5, 6, 5), (5, 6, 1 << 21)])]).first()
    assert tuple(v) == (True, False, True, False)
    p = spark.range(1).select(state.profile_answers({"age": F.lit(3), "sex": F.lit(None).cast("string"), "student": F.lit(False)}).alias("n")).first()
    assert p.n == 2


def test_small_text_and_date_functions(spark):
    from feedloom.functions import dates as D
    from feedloom.functions import text as T
    from feedloom.operators import message, score

    w = lambda x: F.array(*[F.lit(y) for y in x.split()])
    r = one(spark, same=T.title_similarity(w("a b c"), w("a b c")), part=T.title_similarity(w("a b c d"), w("a b x d")), sentences=T.sentences(F.lit("One is here. Two  came!\nthree\n\n Four? $5 now")), days=D.days_between(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-02 12:00:00").cast("timestamp")))
    assert r.same == 1.0 and r.part == pytest.approx(0.6 * 3 / 5 + 0.4 * 1 / 5) and r.sentences == ["One is here.", "Two came!", "three", "Four?", "$5 now"] and r.days == 1
    why = spark.createDataFrame([([("t", "A", 5), ("t", "B", -2), ("t", "C", 1), ("t", "D", 1), ("t", "E", 1)],), ([("t", "B", -2)],)], "r array<struct<signal:string,label:string,points:int>>")
    assert [x.h for x in why.select(score.headline(F.col("r"), F.lit("s" * 200)).alias("h")).collect()] == ["A · C · D", "s" * 120]
    assert [x.m for x in spark.createDataFrame([("",), (None,), ("word " * 400,), ("word " * 9000,)], "t string").select(score.reading_minutes(F.col("t")).alias("m")).collect()] == [8, 8, 20, 45]
    assert "@" not in one(spark, s=message.scrub(F.lit("mail a@b.org now"))).s
