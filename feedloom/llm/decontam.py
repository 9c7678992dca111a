"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words (lower-case ASCII letters, digits, any other character above ASCII).  Of each window of SPAN consecutive word 5-grams
(10 words in all) the smallest hash is kept.  Equal windows keep equal hashes, so documents and items that share 10 words
share a fingerprint.  A join on fingerprints names the documents that may share one; their windows are then looked up among the items' windows, with their
places, in one join on 128-bit hashes, and all words of the occurrences count as hit.  Neither join makes a pair of document and item but those that the result names.
Items of fewer than 10 words are one window; their own length's grams are joined in full, for each length that occurs.

Broadcasts happen only where a sum shows at most BROADCAST_BYTES; beyond it the same joins shuffle.

Defined results: null, empty and word-less texts have no words and hit nothing; items without id or words are left out; items
that repeat an id count once; rows that repeat an id are judged each on its own text; texts of any length are judged whole; extra columns are ignored, and
``stage`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize, own, session, table

GRAM, SPAN = 5, 6
WINDOW = GRAM + SPAN - 1
BROADCAST_BYTES = 16 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNT_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(t, F.lit("")), UPPER, LOW), GAPS), "")


def count_of(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.array_remove(F.split(F.coalesce(t, F.lit("")), COUNT_GAPS), "")).cast("long")


def _ahead(xs: Column, n: int, of) -> Column:
    """of(x[i], ..., x[i + n - 1]) for each i that has them all."""
    whole = F.transform(xs, lambda x, i: of(x, *[F.get(xs, i + j) for j in range(1, n)]))
    return F.slice(whole, 1, F.greatest(F.size(xs) - (n - 1), F.lit(0)))


def fingerprints(words: Column) -> Column:
    """Distinct smallest 5-gram hashes of the windows of 10 words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: _ahead(h, GRAM, lambda *x: F.xxhash64(*x))
    return _let(hashes, lambda h: _let(grams(h), lambda g: F.array_distinct(_ahead(g, SPAN, lambda *x: F.least(*x)))))


def grams_of(words: Column, n: int) -> Column:
    """Distinct hashes of all runs of n words."""
    one = (lambda h: h) if n == 1 else (lambda h: _ahead(h, n, lambda *x: F.xxhash64(*x)))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.array_distinct(one(h)))


def windows_of(words: Column, n: int) -> Column:
    """Both hashes of every run of n words, in order."""

    def rolled(*salt: Column) -> Column:
        return _let(F.transform(words, lambda w: F.xxhash64(*salt, w)), lambda h: h if n == 1 else _ahead(h, n, lambda *x: F.xxhash64(*x)))

    return F.zip_with(rolled(), rolled(F.lit(1)), lambda a, b: F.struct(a.alias("h"), b.alias("g")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only behind a sum of bytes."""
    wide = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in df.schema]
    size = df.agg(F.sum(sum(wide[1:], wide[0]) + 16)).collect()[0][0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_hit, items (sorted distinct ids as strings) for the documents that share a window.

    Fingerprints alone, without items, name the documents that take part; then each of these meets all windows of the items in one join on hashes
    of 128 bits: the places of windows that match give the hit words, and the distinct pairs of document and item the items.
    """
    session(docs.sparkSession)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("iw")).where("size(iw) > 0").distinct()
    items = materialize(items.withColumn("span", F.least(F.lit(WINDOW), F.size("iw"))))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_ = lambda df: F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("th") == F.col("pt"))
    spans = sorted(r[0] for r in items.select("span").distinct().collect())  # WINDOW values at most
    found = None
    for n in spans:
        own = items.where(F.col("span") == n)
        make = fingerprints if n == WINDOW else (lambda w, n=n: grams_of(w, n))
        theirs = materialize(own.select(F.explode(make(F.col("iw"))).alias("fp")).distinct())
        ours = keyed.select("doc_id", "th", F.explode(make(words_of("text"))).alias("fp"))
        near = materialize(ours.join(_small(theirs), "fp", "left_semi").select("doc_id", "th").distinct())
        windows = materialize(own.select("item_id", F.explode(windows_of(F.col("iw"), n)).alias("w")).select("item_id", "w.h", "w.g").distinct())
        some = keyed.join(_small(near.toDF("pd", "pt")), id_(keyed), "left_semi")
        placed = some.select("doc_id", "th", F.posexplode(windows_of(words_of("text"), n)).alias("at", "w")).select("doc_id", "th", "at", "w.h", "w.g")
        met = materialize(placed.join(_small(windows.select("h", "g").distinct()), ["h", "g"], "left_semi").distinct())
        places = met.groupBy("doc_id", "th").agg(F.collect_list(F.sequence(F.col("at"), F.col("at") + n - 1)).alias("runs"))
        pairs = met.select("doc_id", "th", "h", "g").distinct().join(_small(windows), ["h", "g"]).groupBy("doc_id", "th").agg(F.collect_set("item_id").alias("ids"))
        both = places.select("doc_id", "th", F.array_distinct(F.flatten("runs")).alias("places")).join(pairs.toDF("pd", "pt", "ids"), id_(places)).select("doc_id", "th", "places", "ids")
        found = both if found is None else found.unionByName(both)
    if found is None:
        return keyed.select("doc_id", "th", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).where("false")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return found.groupBy("doc_id", "th").agg(F.size(union("places")).cast("long").alias("n_hit"), F.array_sort(union("ids")).alias("items"))


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    per = hits(docs, table(spark, sf_dir, "benchmark")).toDF("pd", "pt", "n_hit", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), count_of("text").alias("n_words"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("th") == F.col("pt")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark, with all their columns."""
    id_, th = free_name(docs, "id"), free_name(docs, "th")
    per = hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(id_), F.col("th").alias(th))
    key = F.xxhash64("text")
    return docs.join(per, F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(th)), "left_anti").select(*own(docs))
