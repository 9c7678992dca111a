"""Steps that were changed for round 3's projections: the same results, with less work for each text."""

import re
import unicodedata
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import text
from feedloom.operators import classify, eligible, pay, score, studies
from feedloom.plans import queries
from feedloom.rules import interests
from feedloom.streaming import feeds as streams
from feedloom.streaming import keyed


def _folded(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F)


def test_fold_every_sign(spark):
    rows = [(f"a{chr(c)}b",) for c in [*range(0x20, 0x600), *range(0x1E00, 0x2100), 0x212A, 0xFB01, 0xAC00, 0x1D400]]
    got = spark.createDataFrame(rows, "x string").select("x", text.fold_accents(F.col("x")).alias("y")).collect()
    assert len(got) == len(rows) and all(r.y == _folded(r.x) for r in got)


def test_latin_texts_stay_out_of_python(spark, monkeypatch):
    monkeypatch.setattr(text, "_fold_any", F.pandas_udf(lambda s: s.map(lambda x: x and "sent"), T.StringType()))
    got = spark.createDataFrame([("Éüñß çá",), ("ﬁ",)], "x string").select(text.fold_accents(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["Eunß ca", "sent"]


@pytest.mark.parametrize("lexicon", [["a b", "a b c", "b c d e", "c"], ["a b", "c d e", "x y"], ["a b c d e"], []])
def test_phrases_of_any_length(spark, lexicon):
    texts = ["a b c d e f", "b a", "c", "a", "", "a b", "x y z a b c", "c d e"]
    docs = spark.createDataFrame([(i, t.split(" ")) for i, t in enumerate(texts)] + [(98, []), (99, None)], "k int, w array<string>")
    rows = spark.createDataFrame([(p, p, len(p)) for p in lexicon], "phrase string, id string, weight int")
    got = {(r.k, r.id) for r in score.match_phrases(docs, "k", "w", rows).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in lexicon if f" {p} " in f" {t} " and len(p.split(" ")) <= 4}
def test_seeks_by_whole_phrases(spark):
    said = ["Paid study", "paid$study", "a $paid study$ here", "unpaid study", "volunteers needed, IRB", "volunteersneeded irb", "Take part in OUR study: $5 compensation", "study participants", "participate in a study", "participate in some study paid", ""]
    seeks = "participants? needed|seeking participants?|recruiting participants?|volunteers? needed|take part in (?:a|our|this) study|participate in (?:a|our|this) study|study participants?|paid study|clinical trial participants?"
    study = "research study|clinical trial|human subjects?|irb|compensation|paid|participant"

    def wanted(x):
        t = re.sub("[^a-z0-9$]+", " ", f"t {x} tag".lower())
        return all(re.search(f"(?<![a-z0-9_])(?:{p})(?![a-z0-9_])", t) is not None for p in (seeks, study))

    x = spark.createDataFrame([(s,) for s in said], "x string")
    got = x.select("x", classify.seeks_participants(F.lit("t"), F.col("x"), F.array(F.lit("tag")), F.lit(None).cast("string"), F.lit("c"), "r").alias("y")).collect()
    assert [r.y for r in got] == [wanted(r.x) for r in got] and {r.y for r in got} == {True, False}


def test_rules_by_first_words(spark):
    phrases = [p for r in interests.CAMPUS for p in r["patterns"]]
    x = spark.createDataFrame([(f" {a} {b} ",) for a, b in zip(phrases, [*phrases[5:], "x", "y", "z", "v", "w"])] + [(f" {p}x ",) for p in phrases] + [("  ",)], "h string")
    plain = F.array_compact(F.array(*[F.when(text.has_any(F.col("h"), r["patterns"]), F.lit(r["label"])) for r in interests.CAMPUS]))
    got = x.select(F.transform(score.matches(F.col("h"), interests.CAMPUS), lambda m: m["label"]).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got)


SAID = ["pacemaKer", "ſeizure", "İmplanted medical devices", "Men and WOMEN", "BMI 20 to 25", "no fasting; do not eat", "fMRI", "knee pain", "males or females", "boys only", "must be a man", "healthy adults with and without pain", "subject pool", "veterans with", "TBI", "nothing here"]


@pytest.mark.parametrize("title", ["", "Pregnancy and hypertension"])
def test_pieces_lose_no_match(monkeypatch, title):
    bodies = [f"exclusion: {a} . {b}" for a in SAID for b in SAID]
    fast = [eligible.eligibility(title, "", b, "18", "99") for b in bodies]
    monkeypatch.setattr(eligible.Phrases, "near", lambda self, low: True)
    assert fast == [eligible.eligibility(title, "", b, "18", "99") for b in bodies]


def test_tags_by_pieces(spark):
    said = [*SAID, "an AR set", "a car", "Webbased", "ON-CAMPUS", "in our lab", "f-MRI", "fMRI", "Double-blind", "HCI", "user experience", "patients with", "Virtual Meeting", "come to us", "interviewing", "questionnaires", None]
    x = spark.createDataFrame([(s,) for s in said], "x string")
    plain = F.array_compact(F.array(*[F.when(F.col("x").rlike(p), F.lit(k)) for k, p in studies.TAGS.items()]))
    got = x.select(studies.tags(F.col("x")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got) and any(r.a for r in got)


@pytest.mark.parametrize("start", ["Él", "él", "+49", "### der", "Der", "4443"])
def test_pay_ends_with_its_paragraph(start):
    body = f"<p>Participants will receive $40 for taking <b>part. Thank you.</b></p>\n<p>{start}&&& 4443578346646849$$$ un%%% ie</p>"
    assert pay.from_body(body)["guaranteed_max"] == 40.0
    assert pay.pay_sentences("<p>You will be paid,</p><ul><li>in all, $20</li></ul>") == ["You will be paid, in all, $20"]


def test_study_rows_of_any_text(spark, tmp_path):
    texts = ["Él&&& 4443578346646849$$$ un%%%", "Der 12", "+49 4443578346646849$$$", "", "ñu$$$ 12", "x", "Ça 9$"]
    rows = [(i, x, "fr", "web", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.pay for r in queries.study_rows(spark, str(tmp_path)).collect()} == {str(i): float(n % 90 + 10) for i, *_, n in rows}


class _Store:
    """State of one part in memory, with the calls counted."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, *_):
        mine = self.rows.setdefault(name, {})
        return SimpleNamespace(exists=lambda: bool(mine), getValue=lambda k: self._count(mine.get(k)), updateValue=lambda k, v: self._count(mine.update({k: v})), removeKey=lambda k: self._count(mine.pop(k)), iterator=lambda: iter(mine.items()))

    def getValueState(self, name, *_):
        mine = self.rows.setdefault(name, {})
        return SimpleNamespace(exists=lambda: bool(mine), update=lambda v: mine.update(v=v), clear=mine.clear)

    def registerTimer(self, ms):
        self.timers.append(ms)

    def _count(self, x):
        self.calls += 1
        return x


def test_one_call_folds_many_keys():
    fold, store = keyed.OrderedFold(0, lambda s, v: max(-3, min(3, s + v)), lambda s: (s,), ["total"]), _Store()
    fold.init(store)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    batch = lambda rows: iter([pd.DataFrame(rows, columns=["key", "at", "id", "value"])])
    said = lambda frames: {k: v for f in frames for k, v in f.itertuples(index=False)}
    rows = [(f"k{i}", 1_000_000 * s, s, v) for i in range(500) for s, v in ((3, -2), (1, 2), (2, 2))]
    frames = list(fold.handleInputRows((7,), batch(rows), at(0)))
    assert len(frames) == 1 and said(frames) == {f"k{i}": 1 for i in range(500)} and store.calls == 500 and store.timers == [3001]
    assert list(fold.handleExpiredTimer((7,), at(2500), None)) == [] and store.timers == [3001, 3001]  # what is not passed yet still waits
    assert set(store.rows["settled"].values()) == {("3", 2_000_000, 2)} and len(store.rows["waiting"]) == 500
    again = said(fold.handleInputRows((7,), batch([("k1", 1_000_000, 1, 2), ("k1", 4_000_000, 4, 2), ("k1", 3_000_000, 3, -2), ("new", 2_600_000, 9, 1)]), at(2500)))
    assert again == {"k1": 3, "new": 1} and len(store.timers) == 2  # settled events and those that wait come again in vain
    assert list(fold.handleExpiredTimer((7,), at(9000), None)) == [] and not store.rows["waiting"] and not store.rows["alarm"]
    assert store.rows["settled"][("k1",)] == ("3", 4_000_000, 4) and store.rows["settled"][("k2",)] == ("1", 3_000_000, 3)


def test_keys_of_any_columns(spark, tmp_path):
    keys = [(None, "a\"b\\é", 0), (5, None, 1), (5, "", 2), (None, None, 3), (2**60 + 1, "{}", 999_999)]
    rows = [(n * 10 + j, u, i, us, kind) for n, (u, i, us) in enumerate(keys) for j, kind in enumerate(["save", "attend", None, "less"][: n + 1])]
    df = spark.createDataFrame(rows, "id long, u long, i string, us long, k string").withColumns({"w": F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("us")), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))})
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    step, got = (lambda s, v: [*s, v]), {}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    fold = keyed.ordered_fold(stream, ["u", "i", "w"], "ts", "id", "k", [], step, lambda s: (str(s),), "said string")
    streams.snapshot_batches(fold, lambda b, _: got.update({tuple(r)[:-1]: r.said for r in b.withColumn("w", F.unix_micros("w")).collect()}), f"{tmp_path}/ck", "update").awaitTermination()
    assert got == {(u, i, 1_700_000_000_000_000 + us): str(["save", "attend", None, "less"][: n + 1]) for n, (u, i, us) in enumerate(keys)}
