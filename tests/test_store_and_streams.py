"""Published tables, runs as streams, keyed streaming state, folds of hot keys, digests, the merge of all members and quarantined listings."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom import store
from feedloom.operators import collapse, ingest, serve, snapshots, state
from feedloom.streaming import feeds as streams
from feedloom.streaming import keyed

VAULT = "k string, at int, c string, v string"


def test_upsert_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "vault")
    rec = lambda rows: spark.createDataFrame(rows, VAULT)
    first = rec([(f"k{i}", 1, "x", "old") for i in range(400)])
    assert store.upsert(first, path, "k", "at", "c", 0, buckets=16) == 16
    before = store.read(spark, path)[1]["parts"]
    assert store.upsert(rec([("k7", 2, "x", "new"), ("k7", 2, "a", "lesser"), ("k8", 0, "x", "late")]), path, "k", "at", "c", 1, buckets=16) <= 2
    after = store.read(spark, path)[1]["parts"]
    assert len([b for b in before if before[b] != after[b]]) <= 2 and len(before) == len(after) == 16
    got = {r.k: r.v for r in store.table(spark, path).collect()}
    assert len(got) == 400 and got["k7"] == "new" and got["k8"] == "old"
    assert store.upsert(rec([("k7", 9, "x", "again")]), path, "k", "at", "c", 1, buckets=16) == 0  # a batch that was published
    with pytest.raises(ValueError, match="16 buckets"):
        store.upsert(rec([("k7", 9, "x", "again")]), path, "k", "at", "c", 2, buckets=8)
    assert store.expire(spark, path, keep=1) == 0 and len(store.versions(spark, path)) == 1  # the first write still holds the other buckets
    assert store.table(spark, path).count() == 400


def test_a_write_that_died_is_not_in_the_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vault")
    rec = lambda rows: spark.createDataFrame(rows, VAULT)
    store.upsert(rec([("a", 1, "x", "one")]), path, "k", "at", "c", 0, buckets=4)
    real = store.publish

    def dies(*a, **b):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "publish", dies)
    with pytest.raises(RuntimeError):
        store.upsert(rec([("a", 2, "x", "two")]), path, "k", "at", "c", 1, buckets=4)
    monkeypatch.setattr(store, "publish", real)
    assert store.table(spark, path).first().v == "one"
    assert store.upsert(rec([("a", 2, "x", "two")]), path, "k", "at", "c", 1, buckets=4) == 1
    assert store.table(spark, path).first().v == "two" and store.expire(spark, path, keep=1) == 2
    with pytest.raises(store.Conflict):
        store.publish(spark, path, 1, {})


def test_a_run_of_one_vertical_leaves_the_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "radar")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert store.read_snapshot(spark, path, "campus") is None
    store.write_snapshot(spark, path, "campus", {"items": rows("c1"), "changes": rows("x")}, "monday", {"scanned": 5})
    store.write_snapshot(spark, path, "research", {"items": rows("r1", "r2"), "changes": rows()}, "monday")
    store.write_snapshot(spark, path, "research", {"items": rows("r3"), "changes": rows("y")}, "tuesday")
    ids = lambda v, n="items": [r.id for r in store.read_snapshot(spark, path, v, n).collect()]
    assert (ids("campus"), ids("campus", "changes"), ids("research"), store.note(spark, path, "campus"), store.note(spark, path, "research"), store.note(spark, path, "campus", "scanned")) == (["c1"], ["x"], ["r3"], "monday", "tuesday", 5)
    # a run that dies between its tables and the manifest shows nothing of itself
    real = store.publish
    monkeypatch.setattr(store, "publish", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.write_snapshot(spark, path, "campus", {"items": rows("half")}, "wednesday")
    monkeypatch.setattr(store, "publish", real)
    assert ids("campus") == ["c1"] and ids("campus", "changes") == ["x"]
    assert store.expire(spark, path, keep=1) == 3 and ids("research") == ["r3"]


ITEM = "id string, title string, content_hash string, sources array<string>, run int, first_seen timestamp, is_superseded boolean, is_cancelled boolean, location string, starts_at timestamp, has_registration boolean, preprint_version int, published_doi string"


def _item(spark, rows):
    return spark.createDataFrame([(i, x, x, s, run) for i, x, s, run in rows], "id string, title string, content_hash string, sources array<string>, run int").withColumns(
        {"first_seen": (F.lit(1_700_000_000) + F.col("run") * 86400).cast("timestamp"), "is_superseded": F.lit(False), "is_cancelled": F.lit(False), "location": F.lit(None).cast("string"), "starts_at": F.lit(None).cast("timestamp"),
         "has_registration": F.lit(False), "preprint_version": F.lit(None).cast("int"), "published_doi": F.lit(None).cast("string")}
    )


def test_runs_of_a_stream_survive_crashes(spark, tmp_path, monkeypatch):
    runs = [
        [("a", "A", ["s"], 0), ("b", "B", ["h"], 0), ("c", "C", ["s", "h"], 0), ("a", "A", ["s"], 0)],
        [("b", "B2", ["h"], 1)],  # s is down: a stays, c goes, since h would have had it
        [("a", "A", ["s"], 2), ("d", "D", ["s"], 2)],  # all is well: b is really gone
    ]
    down = {0: [], 1: ["s"], 2: []}

    def reports_of(batch):
        run = batch.agg(F.max("run")).collect()[0][0]
        return spark.createDataFrame([(x, int(x in down[run])) for x in ("s", "h")], "source string, failed_requests int")

    def go(name, crashes):
        src, path = tmp_path / f"{name}-in", str(tmp_path / name)
        real, left = store.publish, list(crashes)

        def sometimes(*a, **b):
            if left and left.pop(0) == "before":
                raise RuntimeError("killed before publishing")
            out = real(*a, **b)
            if left and left.pop(0) == "after":
                raise RuntimeError("killed after publishing")
            return out

        monkeypatch.setattr(store, "publish", sometimes)
        seen = []
        for n, rows in enumerate(runs):
            _item(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
            for _ in range(4):
                stream = spark.readStream.schema(_item(spark, runs[0]).schema).parquet(str(src))
                try:
                    streams.run_stream(stream, reports_of, path, "campus", f"{path}-ck").awaitTermination()
                    break
                except Exception as e:
                    assert "killed" in str(e)
            seen.append({(r.id, r.title, r.status, str(r.first_seen)) for r in store.read_snapshot(spark, path, "campus").collect()})
        monkeypatch.setattr(store, "publish", real)
        return seen, len(store.versions(spark, path))

    calm, versions = go("calm", [])
    assert [{x[:3] for x in s} for s in calm] == [{("a", "A", "new"), ("b", "B", "new"), ("c", "C", "new")}, {("a", "A", "unchanged"), ("b", "B2", "updated")}, {("a", "A", "unchanged"), ("d", "D", "new")}]
    assert versions == 3 and {x[3] for x in calm[2] if x[0] == "a"} == {x[3] for x in calm[0] if x[0] == "a"}
    assert go("crashing", ["before", "x", "after", "before", "x", "x"]) == (calm, 3)


def test_keyed_state_of_a_shuffled_replayed_and_restarted_stream(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["save", "attend", "dismiss", "track", "more", "less"]
    rows = [(i, f"u{rng.randrange(3)}", f"i{rng.randrange(2)}", rng.choice(kinds), rng.choice([-2, 2, 15, -15]), 1_700_000_000 + i * 20 + rng.randrange(15)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, u string, i string, k string, d int, s long").withColumn("ts", F.timestamp_seconds("s"))
    want_marks = {(r.u, r.i): tuple(r)[2:] for r in state.marks(df, "u", "i", "k", ["ts", "id"]).collect()}
    want_bias = {(r.u, r.i): r.bias for r in state.bias_fold(df, "u", "i", "d", ["ts", "id"]).collect()}
    # files hold events out of order by up to some minutes, and some again
    batches, size = [], 80
    for n in range(0, 400, size):
        part = rows[n : n + size] + [rows[j] for j in range(max(0, n - 15), n, 4)]
        rng.shuffle(part)
        batches.append(part)
    for a, b in zip(batches, batches[1:]):  # the last of a file come in the next one
        late = [r for r in a if rng.random() < 0.1 and r[5] > max(x[5] for x in a) - 300]
        for r in late:
            a.remove(r)
            b.append(r)
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    got = {"marks": {}, "bias": {}}
    for part in batches:
        spark.createDataFrame(part, "id long, u string, i string, k string, d int, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(src))
        for name, make in (("marks", lambda e: keyed.marks(e, "u", "i", "k", "ts", "id")), ("bias", lambda e: keyed.bias(e, "u", "i", "d", "ts", "id"))):
            stream = spark.readStream.schema(df.schema).parquet(str(src))
            keep = lambda batch, _, name=name: got[name].update({(r.u, r.i): tuple(r)[2:] for r in batch.collect()})
            streams.snapshot_batches(make(stream), keep, f"{ck}-{name}", "update").awaitTermination()  # a new query each time: a restart
    assert got["marks"] == want_marks and {k: v[0] for k, v in got["bias"].items()} == want_bias


def test_folds_of_hot_keys_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    kinds = ["save", "attend", "dismiss", "track", "more", "less", None]
    rows = [("hot" if rng.random() < 0.9 else f"u{i % 7}", "i", rng.choice(kinds), rng.choice([2, -2, 7, -9, 30]), rng.randrange(10**6), i) for i in range(900)]
    df = spark.createDataFrame(rows, "u string, i string, k string, d int, at int, n int").repartition(5)
    want, bias = {}, {}
    for u, _, k, d, _, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        want[u] = keyed.mark_step(want.get(u, [False, False, False, False, None]), k)
        bias[u] = max(-20, min(20, bias.get(u, 0) + d))
    for chunk in (4096, 8):
        monkeypatch.setattr(state, "CHUNK", chunk)
        assert {r.u: list(r)[2:] for r in state.marks(df, "u", "i", "k", ["at", "n"]).collect()} == want
        assert {r.u: r.bias for r in state.bias_fold(df, "u", "i", "d", ["at", "n"]).collect()} == bias


def test_all_members_of_a_paper_are_merged(spark):
    none = lambda t: F.lit(None).cast(t)
    rows = [  # three sources of one DOI whose smallest key is the same, and one that knows only the PMID
        ("pubmed", ["doi:10.1/x", "pmid:1"], "A study of tuberculosis selection", "", 0, None, False, [("Doe", "L1")], "1", None, ["Selection", "tb"], 0),
        ("openalex", ["doi:10.1/x", "openalex:w9"], "A study of tuberculosis selection", "codon model " * 40, 77, "Journal", True, [("Doe", None), ("Roe", None), ("Poe", "L2")], None, "W9", ["selection", "host"], 1),
        ("crossref", ["doi:10.1/x"], "A Study", "short", 5, "Other journal", False, [("Doe", None), ("Roe", None), ("Moe", None)], None, None, ["new"], 2), ("arxiv", ["pmid:1"], "Another title", "x", None, None, False, [], "1", None, ["TB"], 3),
    ]
    raw = spark.createDataFrame(rows, "source string, identity array<string>, title string, abstract string, cited_by int, journal string, is_open_access boolean, authors array<struct<name:string,affiliation:string>>, pmid string, openalex_id string, tags array<string>, ord long").withColumns({
        "doi": F.lit("10.1/x"), "kind": F.lit("journal-article"), "published_doi": none("string"), "published_date": F.lit("2026-01-20").cast("timestamp"), "references": F.array().cast("array<string>"), "open_access_url": F.when(F.col("is_open_access"), "oa"),
        "preprint_version": F.when(F.col("source") == "arxiv", 2).when(F.col("source") == "pubmed", 0), "published_in": none("string"), "url": F.concat(F.lit("u-"), "source"), "pmcid": none("string"), "arxiv_id": none("string"), "topics": F.array().cast("array<string>"),
        "is_superseded": F.lit(False), "external_id": F.concat(F.lit("e-"), "source"),
    })
    raw = raw.unionByName(raw.where("source = 'crossref'"))  # a row that comes twice
    one = ingest.research(raw, None, F.lit("2026-02-01").cast("timestamp")).collect()
    assert len(one) == 1
    r = one[0]
    assert (len(r.abstract) > 400, r.cited_by, r.journal, r.is_open_access, r.open_access_url, r.pmid, r.openalex_id, r.preprint_version) == (True, 77, "Journal", True, "oa", "1", "W9", 2)
    assert [a.name for a in r.authors] == ["Doe", "Roe", "Poe"] and r.url == "u-openalex" and r.title == "A study of tuberculosis selection"
    assert r.sources == ["openalex", "pubmed", "crossref", "arxiv"] and [x.external_id for x in r.source_refs] == ["e-openalex", "e-pubmed", "e-crossref", "e-arxiv"]
    assert r.tags == ["selection", "host", "tb", "new"] and r.identity == ["doi:10.1/x", "openalex:w9", "pmid:1"]
    again = ingest.research(raw.repartition(5), None, F.lit("2026-02-01").cast("timestamp")).first()
    assert again == r


def test_all_members_of_an_event_are_merged(spark):
    none = lambda t: F.lit(None).cast(t)
    rows = [("calendar", "event:c-1", "Google hackathon", "free pizza provided", None, ["all"], None, False), ("listing", "event:c-1", "Google hackathon", "pizza", (30.6, -96.3), ["staff", "students"], "https://meet", True), ("calendar", "event:c-2", "Google hackathon", "", None, [], None, False)]
    raw = spark.createDataFrame(rows, "source string, k string, title string, summary string, coordinates struct<lat:double,lon:double>, audience array<string>, online_url string, has_registration boolean").withColumns({
        "identity": F.array("k"), "organizer": F.lit("CS"), "starts_at": F.lit("2026-02-02 18:00:00").cast("timestamp"), "ends_at": none("timestamp"), "deadline_at": none("timestamp"), "location": F.lit("Hall"), "cost": none("string"), "tags": F.array(F.lit("t")),
        "event_types": F.array("source"), "is_cancelled": F.col("k") == "event:c-2", "is_online": F.lit(False), "compensation": F.when(F.col("source") == "listing", "$5"), "url": F.concat(F.lit("u-"), "source"),
    }).drop("k")
    r = ingest.campus(raw, F.lit("2026-02-01").cast("timestamp"), "registry", "listing", "leagues").collect()
    assert len(r) == 1
    r = r[0]
    assert (tuple(r.coordinates), r.audience, r.online_url, r.compensation, r.has_registration, r.is_cancelled, r.food.tier, sorted(r.event_types)) == ((30.6, -96.3), ["staff", "students"], "https://meet", "$5", True, True, "confirmed", ["calendar", "listing"])


def test_copies_of_a_festival_keep_their_fields(spark):
    none = lambda t: F.lit(None).cast(t)
    rows = [("event:a-1", "Club Crawl Fall 2026 - Chess", "Chess", "free pizza provided", None), ("event:b-2", "Club Crawl Fall 2026 - Go", "Go", "", "https://meet"), ("event:c-3", "Club Crawl Fall 2026", "Club Crawl", "come", None), ("event:d-4", "Club Crawl Fall 2027 - Go", "Go", "hackathon", None)]
    raw = spark.createDataFrame(rows, "k string, title string, organizer string, summary string, online_url string").withColumns({
        "source": F.lit("calendar"), "identity": F.array("k"), "starts_at": F.when(F.col("title").contains("2026"), F.lit("2026-02-02 18:00:00")).otherwise("2026-02-03 18:00:00").cast("timestamp"), "ends_at": none("timestamp"), "deadline_at": none("timestamp"), "location": F.lit("Hall"),
        "cost": none("string"), "tags": F.array("organizer"), "event_types": F.array().cast("array<string>"), "is_cancelled": F.lit(False), "is_online": F.col("online_url").isNotNull(), "has_registration": F.lit(False),
    }).drop("k")
    festival = dict(pattern=r"(?i)^club crawl\s+((?:fall|spring)\s+\d{4})(?:\s*[-:]\s*(.*))?$", name="Club Crawl {}", umbrella="Club Crawl")
    got = {r.title: r for r in ingest.campus(raw, F.lit("2026-02-01").cast("timestamp"), "registry", "listing", "leagues", festival).collect()}
    r = got["Club Crawl Fall 2026"]
    assert (r.online_url, r.is_online, r.food.tier, r.category, r.organizer, r.identity) == ("https://meet", True, "confirmed", "clubs", "Club Crawl", ["event:a-1", "event:b-2", "event:c-3"])
    assert r.summary == "2 participating organizations: Chess, Go." and {"Organization: Chess", "Organization: Go", "Chess", "Go", "Club Crawl"} == set(r.tags)
    single = ingest.normalize(raw, "campus", F.lit("2026-02-01").cast("timestamp")).where("title = 'Club Crawl Fall 2026'").first()
    assert r.content_hash != single.content_hash and "Club Crawl Fall 2027 - Go" in got


def test_order_of_a_list_by_relevance_then_time(spark):
    rows = [("a", "campus", 50, 3), ("b", "campus", 50, 1), ("c", "campus", 50, None), ("d", "campus", 60, 9), ("e", "campus", 50, 1), ("f", "research", 50, 1), ("g", "research", 50, 3)]
    from feedloom.operators import score

    df = spark.createDataFrame(rows, "id string, vertical string, relevance int, day int").withColumn("occurred_at", F.timestamp_seconds(F.col("day") * 86400))
    order = lambda v: [r.id for r in score.for_you(df.where(F.col("vertical") == v), least=50).collect()]
    assert order("campus") == ["d", "b", "e", "a", "c"] and order("research") == ["g", "f"]
    assert [r.id for r in score.for_you(df.where("vertical = 'campus'"), least=50, top=2).collect()] == ["d", "b"]


def test_ids_in_a_diff(spark):
    b = spark.createDataFrame([("1", "x", 0), ("1", "y", 1), ("2", "z", 0)], "id string, t string, ord int")
    a = spark.createDataFrame([("1", "old", 0), ("1", "y", 5), ("1", "mid", 3), ("10", "n", 0)], "id string, t string, ord int")
    got = {r.id: r.kind for r in snapshots.diff(b, a, ["t"]).collect()}
    assert got == {"1": "unchanged", "2": "removed", "10": "added"}
    ids = spark.createDataFrame([("10",), ("9",), ("b",), ("a1",), (None,)], "id string").orderBy(*snapshots.by_id())
    assert [r.id for r in ids.collect()][:2] == ["9", "10"] and [r.id for r in ids.collect()][-2:] == ["a1", "b"]


def test_merging_singles_and_ranked_lists(spark):
    df = spark.createDataFrame([("c", "m", ["b", "a", "b"], None)], "cluster string, id string, tags array<string>, note string")
    r = collapse.merge_members(df, F.struct("id"), {"tags": "folded_union", "note": "first"}).first()
    assert r.tags == ["b", "a", "b"] and r.note is None and r.members == 1
    assert [x.place for x in serve.ranked(spark.range(100), [F.desc("id")], "place").orderBy(F.desc("id")).collect()] == list(range(1, 101))
