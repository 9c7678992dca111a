"""Small plan helpers that the operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, release, shared_dir, tidy  # noqa: F401

#: Rows in an Arrow batch that goes to Python: texts can be long, so batches are short.
ARROW_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on; the cluster's own choice of folders stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few driver-side rows as a table, without Python workers."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no input column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its own columns of these names (whatever their case) renamed to a free name: ``shard`` becomes ``__shard``."""
    taken = {c.lower(): c for c in df.columns}
    for n in names:
        if n in taken:
            df = df.withColumnRenamed(taken[n], free_name(df, n))
    return df
