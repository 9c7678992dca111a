"""Tables that are published as a whole: immutable folders and a manifest that says which of them count.

A write goes to folders that nothing else uses; what readers see changes only when the next manifest is created, in one step and only if no one else has created it.  A run that dies in between leaves
the table as it was, and its folders are ignored until ``expire`` removes them.  A manifest names a folder for each part, so a writer replaces the parts it touches and carries the others over:
a vertical that was skipped keeps its snapshot, and an upsert rewrites the buckets of its keys alone.  Manifests are small: a line for each part.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published first: read again, and write again."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions that are still there, oldest first."""
    fs, where = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest) of the latest or a given version; (0, nothing) before the first.  A manifest: parts (name to folder), notes (name to a value, such as the last batch that counts)."""
    found = versions(spark, path)
    at = found[-1] if version is None and found else version or 0
    if not at:
        return 0, {"parts": {}, "notes": {}}
    fs, where = _fs(spark, f"{path}/manifest/{at:012d}")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return at, json.loads(text)


def folder(path: str) -> str:
    """A folder for one write, that no other write uses."""
    return f"{path}/data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, after: int, parts: dict[str, str | None], notes: dict | None = None) -> int:
    """Make version ``after + 1``: the manifest of ``after`` with ``parts`` and ``notes`` replaced (None takes a part out).  Raises ``Conflict`` where that version exists."""
    fs, final = _fs(spark, f"{path}/manifest/{after + 1:012d}")
    if fs.exists(final):
        raise Conflict(f"version {after + 1} of {path} is already published")
    _, old = read(spark, path, after)
    merged = {k: v for k, v in (old["parts"] | parts).items() if v is not None}
    text = json.dumps({"parts": merged, "notes": old["notes"] | (notes or {})}, sort_keys=True)
    fs, draft = _fs(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    # a rename is one step on the file systems this is for, and fails onto a file that exists
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {after + 1} of {path} is already published")
    return after + 1


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the latest ``keep`` versions and delete the folders that none of them names, those of writes that died among them.  Not while a write is under way.  Returns how many folders went."""
    found = versions(spark, path)
    for v in found[: max(0, len(found) - keep)]:
        fs, where = _fs(spark, f"{path}/manifest/{v:012d}")
        fs.delete(where, False)
    used = {f.split("/data/", 1)[1].split("/", 1)[0] for v in found[-keep:] for f in read(spark, path, v)[1]["parts"].values()}
    fs, where = _fs(spark, f"{path}/data")
    gone = 0
    for x in fs.listStatus(where) if fs.exists(where) else []:
        if x.getPath().getName() not in used:
            gone += fs.delete(x.getPath(), True)
    return gone


# --- Snapshots by vertical -----------------------------------------------------------------------------------------


def write_snapshot(spark: SparkSession, path: str, vertical: str, tables: dict[str, DataFrame], fetched_at: str, notes: dict | None = None) -> int:
    """Publish a vertical's tables (items, changes, reports, ...) together; all other verticals keep theirs, whatever their age."""
    version, _ = read(spark, path)
    parts = {}
    for name, df in tables.items():
        parts[f"{vertical}/{name}"] = folder(path)
        df.write.parquet(parts[f"{vertical}/{name}"])
    return publish(spark, path, version, parts, {f"{vertical}/fetched_at": fetched_at} | {f"{vertical}/{k}": v for k, v in (notes or {}).items()})


def read_snapshot(spark: SparkSession, path: str, vertical: str, name: str = "items") -> DataFrame | None:
    """A table of the vertical's latest snapshot; None before its first run, or where it has been lost: a run can begin anew without it."""
    where = read(spark, path)[1]["parts"].get(f"{vertical}/{name}")
    try:
        return spark.read.parquet(where) if where else None
    except PySparkException as lost:
        if lost.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def note(spark: SparkSession, path: str, vertical: str, name: str = "fetched_at"):
    return read(spark, path)[1]["notes"].get(f"{vertical}/{name}")


# --- Tables of records by key --------------------------------------------------------------------------------------


def upsert(batch: DataFrame, path: str, key: str, stamp: str, client: str, batch_id: int | None = None, buckets: int = 64) -> int:
    """A batch's records into the table at ``path``: of each key the one with the latest stamp, then the largest client id, stays.  Returns how many buckets were written.

    The table lies in ``buckets`` buckets by the key's hash; only those of the batch's keys are read and written, so a batch costs what its buckets hold and not the table.  ``batch_id``: a batch that
    has been published before changes nothing when it comes again.  ``buckets`` holds for the table's life.
    """
    spark = batch.sparkSession
    version, old = read(spark, path)
    if batch_id is not None and batch_id <= old["notes"].get("batch", -1):
        return 0
    held = int(old["notes"].get("buckets", buckets))
    if held != buckets:
        raise ValueError(f"{path} has {held} buckets")
    number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")
    rows = batch.select("*", number)
    touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
    before = [old["parts"][str(b)] for b in touched if str(b) in old["parts"]]
    both = rows.unionByName(spark.read.parquet(*before).select("*", number), allowMissingColumns=True) if before else rows
    names = [c for c in both.columns if c != "__bucket"]
    best = both.groupBy("__bucket", F.col(key).alias("__key")).agg(F.max_by(F.struct(*names), F.struct(stamp, client)).alias("r")).select("__bucket", "r.*")
    out = folder(path)
    best.repartition("__bucket").write.partitionBy("__bucket").parquet(out)
    publish(spark, path, version, {str(b): f"{out}/__bucket={b}" for b in touched}, {"buckets": buckets} | ({"batch": batch_id} if batch_id is not None else {}))
    return len(touched)


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """All records of an upserted table, or None before the first."""
    parts = read(spark, path)[1]["parts"]
    return spark.read.parquet(*sorted(parts.values())) if parts else None
