"""Tables, shared folder and Arrow settings for the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Python workers get a few hundred whole texts at a time, whatever their length.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``.  A session on one machine that names none uses
    its warehouse folder; a cluster that names none is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identifies a row by id and content, so that a repeated id with another text stays apart; never null."""
    return F.concat_ws(":", F.col(id_col).cast("string"), F.hex(F.xxhash64(text_col)), F.hex(F.xxhash64(F.length(text_col), F.col(text_col))))


#: Stands for a null id while ids pass through Python, where null would turn integers into floats.
NO_ID = -(1 << 63)


def id_in(col: str) -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NO_ID).cast("bigint"))


def id_out(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID).cast("bigint"))
