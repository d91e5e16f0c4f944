"""Readers for the raw export layouts and the processed tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions.timefn import parse_flexible, round_slot
from ..functions.units import clamp_sentinel
from ..operators.align import first_by, floor_bins, join_bins_keep_last, join_sources, last_by, regularize
from ..operators.blocks import text_rank
from ..operators.clean import offset_stamp, parse_stamps, require_columns, suspend_rate
from ..session import settle

# --- text tables ---------------------------------------------------------------------


def pipe_table(spark: SparkSession, path: str, schema: StructType, require: Sequence[str] = ()) -> DataFrame:
    """A pipe-delimited table with header; columns are matched by position."""
    return require_columns(spark.read.csv(path, schema=schema, sep="|", header=True, enforceSchema=True), require)


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The frame, or an error when it has no row; the check is part of the plan."""
    n = df.limit(1).agg(F.count("*").alias("n")).select(
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"{what} is empty"))).otherwise(F.col("n")).alias("n")
    )
    return df.where(n.scalar() > 0)


def pump_trial(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """CGM, basal and bolus tables of a pump trial (SRC1)."""
    read = lambda name, schema, need: pipe_table(spark, f"{folder}/{name}", schema, need)
    return {
        "cgm": read("cgm", S.PUMP_CGM, ("PtID", "DataDtTm", "CGM")),
        "basal": read("basal", S.PUMP_BASAL, ("PtID", "DataDtTm", "CommandedBasalRate")),
        "bolus": read("bolus", S.PUMP_BOLUS, ("PtID", "DataDtTm", "BolusAmount")),
    }


def clean_pump_trial(tables: Mapping[str, DataFrame], step: int = 300, divisor: float = 18.0) -> DataFrame:
    """Floored bins per source, CGM on a regular grid, insulin joined to it (AGG1, JOIN1)."""
    ready = {n: parse_stamps(d.withColumnRenamed("PtID", "p_num"), "DataDtTm_adjusted", "DataDtTm") for n, d in tables.items()}
    order = F.col("datetime")
    known = {n: d.where(F.col("datetime").isNotNull()) for n, d in ready.items()}
    cgm = floor_bins(known["cgm"], step, [F.avg("CGM").alias("bg_mM"), first_by("Period", order).alias("period")])
    bolus = floor_bins(known["bolus"], step, [F.sum("BolusAmount").alias("dose_units"), first_by("BolusType", order).alias("bolus_type")])
    basal = floor_bins(known["basal"], step, [last_by("CommandedBasalRate", order).alias("rate")])
    grid = regularize(cgm.withColumn("datetime", F.timestamp_seconds("slot").cast("timestamp_ntz")).drop("slot"), step)
    slotted = grid.withColumn("slot", F.unix_seconds(F.col("datetime").cast("timestamp")))
    return join_sources(slotted, bolus, basal).drop("slot").withColumn("bg_mM", F.col("bg_mM") / F.lit(divisor))


def device_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Device log and demographics (SRC2)."""
    log = pipe_table(spark, f"{folder}/log", S.DEVICE_LOG, ("PtID", "DeviceDtTm", "CGMVal"))
    return log.withColumn("datetime", parse_flexible(F.col("DeviceDtTm"))), pipe_table(spark, f"{folder}/screening", S.SCREENING)


def insulin_bins(log: DataFrame, step: int = 300) -> DataFrame:
    """Basal, bolus and meal bolus of all device rows per rounded slot (AGG3)."""
    dose = sum((F.coalesce(c, F.lit(0.0)) for c in ("BasalDelivPrev", "BolusDelivPrev", "MealBolusDelivPrev")), F.lit(0.0))
    rows = log.withColumnRenamed("PtID", "p_num").withColumn("slot", round_slot(F.col("datetime"), step))
    return rows.groupBy("p_num", "slot").agg(F.sum(dose).alias("dose_units"))


def clean_device_frame(log: DataFrame, screening: DataFrame, step: int = 300) -> DataFrame:
    """CGM rows with the insulin of their slot and demographics (SRC2, JOIN2, JOIN3)."""
    cgm = cgm_history(log).withColumn("food_g", F.lit(0.0))
    rows = join_bins_keep_last(cgm, insulin_bins(log, step), step, F.col("datetime")).drop("slot")
    rows = rows.fillna(0.0, ["dose_units"])
    demo = screening.select(F.col("PtID").alias("p_num"), F.col("DiagAge").alias("age_at_diagnosis"), F.col("Sex").alias("sex"))
    return rows.join(demo, "p_num", "left")


def cgm_history(log: DataFrame) -> DataFrame:
    """CGM-only extract: sentinels clamped, one row per patient and stamp (SRC3)."""
    rows = log.where(F.col("CGMVal").isNotNull()).withColumn("bg_mg_dl", clamp_sentinel(F.col("CGMVal")))
    meal = F.trim(F.coalesce("MealSize", F.lit("")))
    picked = rows.groupBy(F.col("PtID").alias("p_num"), "datetime").agg(
        F.min(F.struct("bg_mg_dl", meal.alias("meal_size_text"))).alias("_r")
    )
    return picked.select("p_num", "datetime", "_r.*")


def insulin_history(log: DataFrame, shift_s: int = 300) -> DataFrame:
    """Insulin-only extract, stamped one step earlier: delivery was for the step before (SRC3)."""
    dose = sum((F.coalesce(c, F.lit(0.0)) for c in ("BasalDelivPrev", "BolusDelivPrev", "MealBolusDelivPrev")), F.lit(0.0))
    stamp = F.col("datetime") - F.make_dt_interval(secs=F.lit(shift_s))
    return log.select(F.col("PtID").alias("p_num"), stamp.alias("datetime"), dose.alias("dose_units"))


def sensor_csv(spark: SparkSession, folder: str, name_part: str = "DataRTCGM") -> DataFrame:
    """All CSV files of a tree whose name holds ``name_part``, united by column name (SRC4).

    Each file has its own header, and columns may stand in any order; what a file lacks is
    NULL.  Files that are not UTF-8 are read as Latin-1.  Lines are read as text, so that
    large files are split and one scan finds headers and encodings.  A header is parsed once
    for its file, to where each column stands; only the distinct column names reach the
    planner.  Fields may hold line breaks within quotes; see :func:`_records`.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": f"*{name_part}*"}
    meta = F.col("_metadata")
    lines = spark.read.options(**options).text(folder).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_start"))
    lines = lines.withColumn("_n", F.monotonically_increasing_id())
    files = lines.groupBy("_file").agg(
        F.min_by("value", F.struct("_start", "_n")).alias("_head"),
        F.bool_or(~F.is_valid_utf8("value")).alias("_latin"),
        F.bool_or(_quotes("value") % 2 == 1).alias("_broken"),
    )
    files = settle(files.withColumn("_head", F.regexp_replace("_head", "^\ufeff", "")), "files")
    commas = F.length("_head") - F.length(F.replace("_head", F.lit(",")))
    seen = files.agg(F.max(commas).alias("commas"), F.bool_or("_broken").alias("broken")).first()
    if seen["commas"] is None:
        raise ValueError(f"no CSV file with {name_part!r} in its name below {folder}")
    width = seen["commas"] + 1
    cells = lambda text: F.from_csv(text, ", ".join(f"c{i} STRING" for i in range(width)), {"escape": '"'})
    flat = lambda c: F.array(*[F.col(f"{c}.c{i}") for i in range(width)])
    files = files.withColumn("_h", cells(F.col("_head"))).withColumn("_names", flat("_h"))
    opened = files.select(F.posexplode("_names").alias("place", "name")).where(F.col("name").isNotNull())
    names = [r["name"] for r in opened.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]
    where = F.array(*[F.array_position("_names", F.lit(n)).cast("int") for n in names])
    files = files.select("_file", "_head", "_latin", "_broken", where.alias("_where"))

    rows = lines.join(files, "_file").withColumn("value", F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value")))
    if seen["broken"]:
        whole = rows.where(~F.col("_broken")).select("value", "_head", "_where")
        rows = whole.unionByName(_records(rows.where("_broken")).join(files, "_file").select("value", "_head", "_where"))
    rows = rows.where(~((F.regexp_replace("value", "^\ufeff", "") == F.col("_head")) | (F.trim("value") == "")))
    rows = rows.withColumn("_c", cells(F.col("value"))).select("_where", flat("_c").alias("_cells"))
    at = lambda i: F.get("_where", F.lit(i))
    return rows.select(*[F.when(at(i) > 0, F.get("_cells", at(i) - 1)).alias(n) for i, n in enumerate(names)])


def _quotes(col: str) -> Column:
    """Quotes in a line of any encoding."""
    text = F.decode(F.col(col).cast("binary"), "ISO-8859-1")
    return F.length(text) - F.length(F.replace(text, F.lit('"')))


def _records(lines: DataFrame) -> DataFrame:
    """Lines (value, _file, _start, _n) put together where a quoted field goes on, as (_file, value).

    A line goes on the one before if the quotes ahead of it in its file are odd in number.
    They are counted within the blocks in which Spark reads a file and carried over them by
    one row a block, so that a large file is split, wherever its records end.  A record
    belongs to its first line; its line breaks are line feeds.
    """
    lines = settle(lines.select("value", "_file", "_start", "_n", _quotes("value").alias("_q")), "lines")
    here = Window.partitionBy("_file", "_start").orderBy("_n")
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_file", "_start").agg(F.sum("_q").alias("_q"))
    blocks = blocks.select("_file", "_start", F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_ahead"))
    ahead = F.col("_ahead") + F.coalesce(F.sum("_q").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(blocks, ["_file", "_start"]).withColumn("_first", F.when(ahead % 2 == 0, F.col("_n")))
    marked = settle(marked.select("value", "_file", "_start", "_n", "_first"), "marked")
    ends = marked.groupBy("_file", "_start").agg(F.max("_first").alias("_l"))
    ends = ends.select("_file", "_start", F.last("_l", True).over(before).alias("_carried"))
    own = F.coalesce(F.last("_first", True).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    joined = marked.join(ends, ["_file", "_start"]).withColumn("_record", own)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"])
    return joined.groupBy("_file", "_record").agg(F.array_join(parts, "\n").alias("value")).drop("_record")


def sensor_report(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per expected column: whether the files have it, and in how many rows it is set (SRC4)."""
    present = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in df.columns).alias("present"), (F.count(c) if c in df.columns else F.lit(0)).cast("bigint").alias("n_set")) for c in expected])
    return df.agg(present.alias("_r")).select(F.inline("_r"))


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def wide_lag_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV of lag columns (SRC5); the schema comes from the header alone."""
    return spark.read.csv(path, header=True)


def day_offset_events(tables: Mapping[str, DataFrame], base: str = "2020-01-01") -> DataFrame:
    """Bolus, wizard, CGM and basal rows in one schema (SRC6, SET1, PRJ7, PRJ14).

    Columns a table lacks are typed NULLs; negative day offsets are left out.
    """
    stamp = offset_stamp(F.col("DeviceDtTmDaysFromEnroll"), F.col("DeviceTm"), base)
    fields: dict[str, dict[str, Column]] = {
        "bolus": {
            "bolusType": F.col("BolusType"), "normalBolus": F.col("Normal"), "expectedNormalBolus": F.col("ExpectedNormal"),
            "extendedBolus": F.col("Extended"), "expectedExtendedBolus": F.col("ExpectedExtended"),
        },
        "wizard": {
            "bgInput": F.col("BgInput"), "foodG": F.col("CarbInput"), "iob": F.col("InsulinOnBoard"),
            "cr": F.col("InsulinCarbRatio"), "isf": F.col("InsulinSensitivity"),
        },
        "cgm": {"bgMgdl": F.col("GlucoseValue")},
        "basal": {
            "rate": suspend_rate(F.col("BasalType"), F.col("Rate")), "basalDurationMins": F.col("Duration") / 60_000,
            "suprBasalType": F.col("SuprBasalType"), "suprRate": F.col("SuprRate"),
        },
    }
    keep = {"cgm": F.col("GlucoseValue").isNotNull() & (F.col("RecordType") == "CGM")}
    parts = []
    for name, cols in fields.items():
        rows = tables[name].where((F.col("DeviceDtTmDaysFromEnroll") >= 0) & keep.get(name, F.lit(True)))
        parts.append(rows.select(F.col("PtID").alias("pid"), stamp.alias("date"), F.lit(name).alias("tableType"),
                                 *[c.alias(n) for n, c in cols.items()]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = ["pid", "date", "tableType"] + [c for cols in fields.values() for c in cols]
    return union.select(*order)


def day_offset_export(spark: SparkSession, folder: str) -> DataFrame:
    return day_offset_events({n: pipe_table(spark, f"{folder}/{n}", s, ("PtID",)) for n, s in S.DAY_OFFSET.items()})


# --- app tables -------------------------------------------------------------------------


def app_events(readings: DataFrame, messages: DataFrame, groups: DataFrame, patients: Sequence[str] | None = None) -> DataFrame:
    """Readings and messages of all or some patients in one frame (SRC7, JOIN4, SET2)."""
    who = groups.select("gid", "p_num")
    if patients is not None:
        who = who.where(F.col("p_num").isin(*patients))
    bg = readings.join(who, "gid").select("date", "bgl", "trend", "source", "p_num")
    texts = messages.join(who, "gid").withColumnRenamed("type", "msg_type").drop("gid", "id")
    return bg.unionByName(texts, allowMissingColumns=True)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in parallel ranges of a numeric column (SRC7)."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties={k: str(v) for k, v in options.items()}
    )


def patient_predicates(groups: DataFrame, parts: int, key: str = "gid", weight: str | None = None) -> list[str]:
    """Conditions on the database's index of patients that split a table into ranges of like size (SRC7).

    ``groups`` is the patient index, one row a patient, with the number of its rows in
    ``weight`` if known.  Every key meets exactly one condition.  Bounds come from running
    sums over the index, which is as long as there are patients; only the bounds reach the
    driver.
    """
    size = F.col(weight).cast("double") if weight else F.lit(1.0)
    ids = groups.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(size).alias("_n"))
    ranked = text_rank(ids, key, "_place") if dict(ids.dtypes)[key] == "string" else ids.withColumn("_place", F.col(key))
    total = ids.agg(F.sum("_n").alias("all")).select("all").scalar()
    upto = F.sum("_n").over(Window.orderBy("_place"))  # a row a patient
    share = F.floor((upto - F.col("_n")) * parts / F.nullif(total, F.lit(0.0)))
    firsts = ranked.withColumn("_part", F.least(share, F.lit(parts - 1))).groupBy("_part").agg(F.min(key).alias("first"))
    bounds = [r["first"] for r in firsts.where("_part > 0").orderBy("first").collect()]
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    edges = [None, *map(text, bounds), None]
    return [" AND ".join([f"{key} >= {a}"] * (a is not None) + [f"{key} < {b}"] * (b is not None)) or f"{key} IS NOT NULL" for a, b in zip(edges, edges[1:])]


def jdbc_by_patient(spark: SparkSession, url: str, table: str, predicates: Sequence[str], **options) -> DataFrame:
    """A database table read with one task for each condition of :func:`patient_predicates` (SRC7).

    Filters and the choice of columns that follow are handed to the database.
    """
    return spark.read.jdbc(url, table, predicates=list(predicates), properties={"pushDownPredicate": "true", **{k: str(v) for k, v in options.items()}})


def patient_map(groups: DataFrame) -> DataFrame:
    """Distinct (group, patient) pairs (SRC8)."""
    return groups.select("gid", "p_num").distinct().orderBy("gid", "p_num")


def numbered_patients(groups: DataFrame, prefix: str = "app", gid: str = "gid") -> DataFrame:
    """``{prefix}_{n}`` by sorted group id, from 0 (WIN24)."""
    ids = groups.select(F.col(gid).cast("string").alias(gid)).distinct()
    number = F.concat(F.lit(f"{prefix}_"), F.col("_before").cast("string"))
    return text_rank(ids, gid, "_before").select(gid, number.alias("p_num"))


# --- processed tables ----------------------------------------------------------------------


def processed_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, patients: Sequence | None = None, validate: bool = True, size: int = 400
) -> DataFrame:
    """Partitioned parquet with column and patient pruning (SRC9, SRC10).

    A list of patients also names their partitions (index // ``size``), so that the others
    are not read.
    """
    df = spark.read.parquet(path)
    if patients is not None:
        df = df.where(F.col("p_num").isin(*patients))
        indices = [re.search(r"(\d+)$", str(p)) for p in patients]
        if "partition" in df.columns and all(indices):
            df = df.where(F.col("partition").isin(*sorted({int(m[1]) // size for m in indices})))
    if columns:
        df = df.select(*columns)
    return not_empty(df, path) if validate else df


def processed_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Per-patient CSV ``{pid}_full*.csv``, files or folders of that name; the id comes from the name (SRC11)."""
    df = spark.read.csv(f"{folder}/*_full*.csv", schema=schema, header=True)
    return df.withColumn("p_num", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)_full[^/]*(?:/[^/]*)?$", 1))


# --- registry --------------------------------------------------------------------------------

Reader = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named readers with a description (SRC18)."""

    def __init__(self) -> None:
        self._readers: dict[str, tuple[Reader, str]] = {}

    def register(self, name: str, reader: Reader, about: str = "") -> None:
        self._readers[name] = (reader, about)

    def names(self) -> list[str]:
        return sorted(self._readers)

    def about(self, name: str) -> str:
        return self._find(name)[1]

    def load(self, spark: SparkSession, name: str, path: str, view: bool = False) -> DataFrame:
        df = self._find(name)[0](spark, path)
        if view:
            df.createOrReplaceTempView(name)
        return df

    def _find(self, name: str) -> tuple[Reader, str]:
        if name not in self._readers:
            raise ValueError(f"unknown data set {name!r}; known: {self.names()}")
        return self._readers[name]


DEFAULT = Registry()
DEFAULT.register("pump_trial", lambda s, p: clean_pump_trial(pump_trial(s, p)), "pipe-delimited pump trial")
DEFAULT.register("device_log", lambda s, p: clean_device_frame(*device_log(s, p)), "pipe-delimited device log")
DEFAULT.register("sensor_csv", sensor_csv, "tree of sensor CSV files")
DEFAULT.register("wide_lag", wide_lag_csv, "wide CSV with lag columns")
DEFAULT.register("day_offset", day_offset_export, "tables with enrolment-day offsets")
DEFAULT.register("processed", processed_parquet, "processed series as parquet")
