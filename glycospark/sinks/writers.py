"""Writers."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.blocks import Carry, Keys, scan
from ..operators.leaderboard import best_by_metric, summarise
from ..operators.splits import split_id
from ..session import settle


def partition_number(index: Column, size: int = 400) -> Column:
    """Partition of a patient from its numeric index."""
    return F.floor(index / size).cast("int")


def patient_index(col: Column) -> Column:
    """Trailing number of a canonical patient id."""
    return F.regexp_extract(col.cast("string"), r"(\d+)$", 1).cast("long")


def append_partitioned(df: DataFrame, path: str, size: int = 400, mode: str = "append") -> None:
    """Append to parquet partitioned by patient index // ``size`` (SNK1)."""
    out = df.withColumn("partition", partition_number(patient_index(F.col("p_num")), size))
    # clustered by partition and patient, so that a task writes few partitions; a large patient is split by time
    keys = ["partition", "p_num", *[c for c in ("datetime",) if c in df.columns]]
    out.repartitionByRange(*keys).write.mode(mode).partitionBy("partition").option("compression", "snappy").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, size: int = 400, rows_per_file: int = 2_000_000, files_per_partition: int | None = None
) -> None:
    """Same layout, clustered by partition and time so files stay bounded (SNK2).

    Range partitioning on (partition, patient, time) also splits a patient who
    holds much of the table.
    """
    out = df.withColumn("partition", partition_number(patient_index(F.col("p_num")), size))
    keys = ["partition", "p_num", "datetime"]
    ranged = out.repartitionByRange(files_per_partition, *keys) if files_per_partition else out.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option(
        "compression", "snappy"
    ).partitionBy("partition").parquet(path)


#: Bytes that a value of a type of fixed width takes in memory.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory: the widths of its values, texts by their bytes, arrays by eight bytes an entry."""
    sizes = []
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(name)), F.lit(0)))
        elif kind.startswith(("array", "map")):
            sizes.append(8 * F.greatest(F.coalesce(F.size(F.col(name)), F.lit(0)), F.lit(0)))
        else:
            sizes.append(F.lit(_WIDTHS.get(kind, 8)))
    return sum(sizes[1:], sizes[0]).cast("bigint")


def pack_patients(sizes: DataFrame, patients_per_file: int, bytes_per_file: int) -> DataFrame:
    """(partition, p_num, batch): each patient goes to the first file with room, the largest first.

    ``sizes``: partition, p_num, bytes; a partition holds a fixed number of patients, so a
    task packs no more than these.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "p_num"], ascending=[False, True])
        room, count, batch = [], [], []
        for size in pdf["bytes"].tolist():
            fits = (k for k in range(len(room)) if room[k] >= size and count[k] < patients_per_file)
            k = next(fits, len(room))
            if k == len(room):
                room.append(bytes_per_file)
                count.append(0)
            room[k] -= size
            count[k] += 1
            batch.append(f"b{k:03d}")
        return pdf[["partition", "p_num"]].assign(batch=batch)

    kinds = dict(sizes.dtypes)
    return sizes.groupBy("partition").applyInPandas(pack, f"partition {kinds['partition']}, p_num {kinds['p_num']}, batch string")


def write_packed(df: DataFrame, path: str, size: int = 400, patients_per_file: int = 100, mb_per_file: float = 500.0) -> None:
    """The layout in files of a bounded number of patients and bytes, ``partition=/batch=`` (SNK2).

    Bytes are those of the rows in memory, see :func:`row_bytes`.  Patients are packed into
    files, longest first; one that does not fit into a file is cut along its time into
    pieces that do, each a file of its own.
    """
    limit = int(mb_per_file * 1e6)
    rows = df.withColumns({"partition": partition_number(patient_index(F.col("p_num")), size), "_bytes": row_bytes(df)})
    sizes = settle(rows.groupBy("partition", "p_num").agg(F.sum("_bytes").alias("bytes"), F.max("_bytes").alias("_widest")), "sizes")
    whole = pack_patients(sizes.where(F.col("bytes") <= limit).drop("_widest"), patients_per_file, limit)
    large = rows.join(sizes.where(F.col("bytes") > limit).select("p_num", "_widest"), "p_num")
    # rows before a row fill so many pieces; a row that straddles two stays within the bound
    large = scan(large, Keys(rows=1_000_000), _upto=Carry("sum", F.col("_bytes")))
    piece = F.floor((F.col("_upto") - F.col("_bytes")) / F.greatest(F.lit(1), F.lit(limit) - F.col("_widest")))
    large = large.withColumn("batch", F.concat_ws("_", F.col("p_num").cast("string"), F.format_string("%06d", piece)))
    every = rows.join(whole, ["partition", "p_num"]).select(*df.columns, "partition", "batch").unionByName(large.select(*df.columns, "partition", "batch"))
    out = every.repartition("partition", "batch").sortWithinPartitions("partition", "batch", "p_num", "datetime")
    out.write.mode("overwrite").option("compression", "snappy").partitionBy("partition", "batch").parquet(path)


def write_series(df: DataFrame, path: str, dataset: str) -> None:
    """Processed series below ``dataset=``, sorted by patient and time (SNK3)."""
    out = df.withColumn("dataset", F.lit(dataset)).repartitionByRange("p_num", "datetime").sortWithinPartitions("p_num", "datetime")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def split_path(root: str, params: Mapping) -> str:
    return f"{root}/split={split_id(params)}"


def write_split(df: DataFrame, root: str, params: Mapping) -> str:
    """Labelled rows below a folder named after the split's parameters (SNK4)."""
    path = split_path(root, params)
    df.write.mode("overwrite").partitionBy("part").parquet(path)
    return path


def read_split(spark: SparkSession, root: str, params: Mapping) -> DataFrame | None:
    """The stored split of exactly these parameters, or None."""
    path = split_path(root, params)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_results(
    summary: DataFrame, episodes: DataFrame, by_step: DataFrame, path: str, metadata: Mapping[str, str] = {}
) -> None:
    """Three tiers (SNK5): run summary, per-episode scalars, arrays with by-step vectors."""
    labelled = summary.withColumns({k: F.lit(v) for k, v in metadata.items()})
    labelled.write.mode("overwrite").json(f"{path}/results_summary")
    arrays = [f.name for f in episodes.schema.fields if f.dataType.typeName() == "array"]
    episodes.drop(*arrays).write.mode("overwrite").parquet(f"{path}/episodes")
    keys = [c for c in ("run", "episode_id", "p_num") if c in episodes.columns]
    episodes.select(*keys, *arrays).write.mode("overwrite").parquet(f"{path}/forecasts")
    by_step.write.mode("overwrite").parquet(f"{path}/by_step")


def write_leaderboards(runs: DataFrame, path: str, metric: str = "rmse") -> None:
    """Summary, best by model and best by model and data set as CSV (SNK6); run tables are small."""
    tables = {
        "summary": summarise(runs, metric),
        "best_by_model": best_by_metric(runs, ["model"], metric),
        "best_by_model_dataset": best_by_metric(runs, ["model", "dataset"], metric),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
