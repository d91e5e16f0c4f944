"""Streams over the driver tables: each runs once over the files that have arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import insulin_kernel
from ..session import scratch
from ..streaming import feeds as Fd
from .catalog import R, STEP, SER, Tables, epoch, query, r, round_slot_sql, series
from .q_sources import _canon


def _feed(t: Tables, df: DataFrame, columns=None, patients=None) -> DataFrame:
    path = scratch(t.spark, "feed")
    df.repartitionByRange("datetime").write.parquet(path)
    return Fd.read_feed(t.spark, path, df.schema, columns, patients)


def _drain(t: Tables, stream: DataFrame) -> DataFrame:
    """Write a stream to parquet until the feed is used up, and read it back."""
    out, mark = scratch(t.spark, "out"), scratch(t.spark, "mark")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark)
    q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


def _heartbeat(df: DataFrame, days: int) -> DataFrame:
    """One row of no patient, long after all others: it moves the watermark past them."""
    last = df.agg((F.max("datetime") + F.make_dt_interval(F.lit(days))).alias("datetime"))
    return last.select(*[c if c == "datetime" else F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes])


@query("str1_incremental_append", "SELECT CAST(user_id // 10 AS INTEGER) AS \"partition\", count(*) AS n FROM events GROUP BY 1")
def str1(t: Tables):
    out = scratch(t.spark, "str1")
    Fd.append_feed(_feed(t, _canon(t), ["p_num", "event_id"]), out, scratch(t.spark, "mark"), 10).awaitTermination()
    return t.spark.read.parquet(out).groupBy("partition").agg(F.count("*").alias("n"))


@query("str2_online_regularisation", f"""
WITH {SER} SELECT p_num, {round_slot_sql('us', STEP)} AS t, {R('avg(nullif(bg, 0))')} AS bg_mM, {R('coalesce(sum(food), 0)')} AS food_g FROM ser GROUP BY ALL""")
def str2(t: Tables):
    src = series(t).select("p_num", F.col("datetime").cast("timestamp").alias("datetime"), "bg_mM", "food_g")
    path = scratch(t.spark, "feed")
    src.write.parquet(path)
    _heartbeat(src, 60).write.mode("append").parquet(path)
    bins = _drain(t, Fd.online_bins(Fd.read_feed(t.spark, path, src.schema), STEP, "30 days"))
    return bins.where("p_num IS NOT NULL").select("p_num", epoch(), r("bg_mM").alias("bg_mM"), r("food_g").alias("food_g"))


_DELAY_DAYS = 5


@query("str2_late_rows_dropped", f"""
WITH {SER}, b AS (SELECT p_num, {round_slot_sql('us', STEP)} AS t, count(*) AS n FROM ser GROUP BY ALL)
SELECT p_num, t, n FROM b WHERE (t + {STEP} // 2) * 1000000 <= (SELECT max(us) FROM ser) // 1000 * 1000 - {_DELAY_DAYS} * 86400000000""")
def str2_late(t: Tables):
    """A second append brings rows from before the watermark: they change nothing that was written."""
    src = series(t).select("p_num", F.col("datetime").cast("timestamp").alias("datetime"), F.lit(1).alias("n"))
    path, out, mark = (scratch(t.spark, x) for x in ("feed", "out", "mark"))
    src.write.parquet(path)
    for late in (False, True):
        if late:
            src.groupBy("p_num").agg(F.min("datetime").alias("datetime"), F.max("n").alias("n")).write.mode("append").parquet(path)
        bins = Fd.online_bins(Fd.read_feed(t.spark, path, src.schema), STEP, f"{_DELAY_DAYS} days")
        q = bins.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark)
        q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("p_num", epoch(), F.col("n").cast("bigint").alias("n"))


@query("str2_bins_and_late_rows", f"""
WITH {SER}, n AS (SELECT max(us) // 1000000 AS newest FROM ser), f AS (SELECT p_num, min(us) AS us FROM ser GROUP BY p_num),
b AS (SELECT p_num, {round_slot_sql('us', STEP)} AS t, count(*) AS n, avg(bg) AS bg FROM ser GROUP BY ALL),
e AS (SELECT f.p_num, f.us // 1000000 AS t, {round_slot_sql('f.us', STEP)} AS slot FROM f)
SELECT 'bin' AS kind, p_num, t, n AS n_rows, {R('bg')} AS bg_mM FROM b, n WHERE t + {STEP} // 2 <= newest - {_DELAY_DAYS * 86_400}
UNION ALL
SELECT 'late', p_num, t, 1, 5.0 FROM e, n WHERE slot + {STEP} // 2 <= newest - {_DELAY_DAYS * 86_400}""")
def str2_two_sinks(t: Tables):
    """The earliest stamp of each patient comes again at the end: a late row wherever its slot is closed."""
    src = series(t).select("p_num", F.col("datetime").cast("timestamp").alias("datetime"), "bg_mM")
    path, bins, late, mark = (scratch(t.spark, x) for x in ("feed", "bins", "late", "mark"))
    src.write.parquet(path)
    for again in (False, True):
        if again:
            src.groupBy("p_num").agg(F.min("datetime").alias("datetime"), F.lit(5.0).alias("bg_mM")).write.mode("append").parquet(path)
        feed = Fd.bins_with_late(Fd.read_feed(t.spark, path, src.schema), STEP, ["bg_mM"], _DELAY_DAYS * 86_400, 10_000 * 86_400)
        Fd.to_two_sinks(feed, bins, late, mark).awaitTermination()
    found = [t.spark.read.parquet(p).select(F.lit(k).alias("kind"), "p_num", F.col("epoch").alias("t"), "n_rows", r("bg_mM").alias("bg_mM")) for k, p in (("bin", bins), ("late", late))]
    return found[0].unionByName(found[1])


_KERNEL = insulin_kernel(60)[1]
_ONLINE = f"""{SER}, h AS (SELECT p_num, us // 3600000000 * 3600 AS epoch, avg(bg) AS bg, sum(dose) AS dose FROM ser GROUP BY ALL),
s AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER w = 3600 THEN 0 ELSE 1 END AS brk FROM h WINDOW w AS (PARTITION BY p_num ORDER BY epoch)),
i AS (SELECT a.p_num, a.epoch, sum(b.dose * [{", ".join(map(repr, _KERNEL))}][(a.epoch - b.epoch) // 3600 + 1]) AS iob
  FROM h a JOIN h b ON b.p_num = a.p_num AND b.epoch <= a.epoch AND a.epoch - b.epoch < 10800 AND b.dose > 0 GROUP BY ALL),
o AS (SELECT s.p_num, s.epoch, {R('bg')} AS bg_mM, CAST(sum(brk) OVER (PARTITION BY s.p_num ORDER BY s.epoch) - 1 AS INTEGER) AS segment_no, {R('coalesce(iob, 0)')} AS iob
  FROM s LEFT JOIN i USING (p_num, epoch))"""


def _hourly(t: Tables) -> DataFrame:
    second = F.unix_seconds(F.col("datetime").cast("timestamp"))
    slot = F.timestamp_seconds(second - F.pmod(second, F.lit(3600)))
    return series(t).groupBy("p_num", slot.alias("datetime")).agg(F.avg("bg_mM").alias("bg_mM"), F.sum("dose_units").alias("dose_units"))


@query("str3_ordered_segments", f"WITH {_ONLINE} SELECT * FROM o WHERE epoch <= (SELECT max(epoch) FROM h) - {_DELAY_DAYS * 86_400}")
def str3_ordered(t: Tables):
    """Rows arrive up to five days late, in three lots, and come out in order."""
    src = _hourly(t)
    path, out, mark = (scratch(t.spark, x) for x in ("feed", "out", "mark"))
    delay = F.pmod(F.xxhash64("p_num", "datetime"), F.lit(_DELAY_DAYS * 86_400 - 1))
    arrival = F.unix_seconds("datetime") + delay
    span = src.agg(F.min(F.unix_seconds("datetime")).alias("lo"), F.max(F.unix_seconds("datetime")).alias("hi")).select(F.struct("lo", "hi")).scalar()
    src = src.withColumn("_s", span).withColumn("lot", F.least(F.lit(2), F.floor((arrival - F.col("_s.lo")) * 3 / (F.col("_s.hi") - F.col("_s.lo") + 1)))).drop("_s")
    for lot in range(3):
        src.where(F.col("lot") == lot).drop("lot").write.mode("append").parquet(path)
        feed = Fd.ordered_state(Fd.read_feed(t.spark, path, src.drop("lot").schema), 3600, f"{_DELAY_DAYS} days")
        q = feed.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark)
        q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("p_num", "epoch", r("bg_mM").alias("bg_mM"), "segment_no", r("iob").alias("iob"))


@query("str3_online_segments", f"WITH {_ONLINE} SELECT * FROM o")
def str3(t: Tables):
    src = _hourly(t)
    out = _drain(t, Fd.online_state(_feed(t, src), 3600))
    return out.select("p_num", "epoch", r("bg_mM").alias("bg_mM"), "segment_no", r("iob").alias("iob"))
