"""Ordered work on one long series, cut into time blocks.

A window partitioned by the patient alone would sort a whole patient in one task,
and one patient may hold a third of the table.  Everything ordered is therefore
partitioned by (patient, time block) instead:

* :func:`halo` copies the few rows near a block edge into the neighbouring block.
  It serves every operator that looks a bounded time back or ahead, with a single
  shuffle and no join.
* :func:`scan` serves unbounded look-back and look-ahead (running sums, last and
  next known value).  Each block is reduced to one summary row; only these
  summaries, whose number per patient is bounded by the calendar, are windowed by
  patient, and the carried values are joined back to the block.

On a regular grid a block holds at most ``block / step`` rows.  A raw series may have any
number of rows in a time; :func:`cut` then takes ranges of like row count for blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefn import seconds
from ..session import scratch, settle

DAY = 86_400
WEEK = 7 * DAY
BLOCK, OWN = "_blk", "_own"


@dataclass(frozen=True)
class Keys:
    """How a long table is grouped, ordered and cut."""

    by: tuple[str, ...] = ("p_num",)
    time: str = "datetime"
    tie: tuple[str, ...] = ()
    block: int = WEEK
    #: Rows that a block may hold; 0 if the time bounds them, as on a grid.
    rows: int = 0

    def second(self) -> Column:
        return seconds(F.col(self.time))

    def block_of(self, second: Column) -> Column:
        return F.floor(second / F.lit(self.block)).cast("long")

    def order(self) -> list[Column]:
        return [F.col(c) for c in (self.time, *self.tie)]

    def order_key(self) -> Column:
        return F.struct(*self.order())

    def window(self):
        """Rows of one (patient, block) in time order."""
        return Window.partitionBy(*self.by, BLOCK).orderBy(*self.order())

    def window_back(self):
        return Window.partitionBy(*self.by, BLOCK).orderBy(*[c.desc() for c in self.order()])


def cut(df: DataFrame, keys: Keys) -> tuple[DataFrame, bool]:
    """The rows with their block, and whether blocks are ranges of rows instead of times.

    Blocks are spans of ``keys.block`` seconds.  With ``keys.rows``, one aggregate looks at
    the fullest of them; if it holds more, the table is cut into ranges of like row count in
    the order of (key, time, tie) and written to the shared folder with their numbers.  So a
    patient with most of the rows in one day is spread like any other.  Only rows that are
    equal in all of these stay together.
    """
    timed = df.withColumn(BLOCK, keys.block_of(keys.second()))
    if not keys.rows:
        return timed, False
    sizes = timed.groupBy(*keys.by, BLOCK).agg(F.count("*").alias("n"))
    seen = sizes.agg(F.max("n").alias("fullest"), F.sum("n").alias("all")).first()
    if (seen["fullest"] or 0) <= keys.rows:
        return timed, False
    parts = -(-2 * seen["all"] // keys.rows)  # bounds come from a sample, so aim at half
    ranged = df.repartitionByRange(int(parts), *keys.by, keys.time, *keys.tie)
    return settle(ranged.withColumn(BLOCK, F.spark_partition_id().cast("long")), "ranges"), True


def halo(df: DataFrame, keys: Keys, back: int = 0, ahead: int = 0) -> DataFrame:
    """Copy rows into every block whose own rows may look at them.

    ``back`` and ``ahead`` are the seconds a row looks back and ahead.  Compute on
    ``keys.window()`` and finish with :func:`own`.
    """
    base, ranged = cut(df, keys)
    if ranged:
        return _halo_of_ranges(base, keys, back, ahead)
    first = keys.block_of(keys.second() - F.lit(ahead))
    last = keys.block_of(keys.second() + F.lit(back))
    spread = base.withColumnRenamed(BLOCK, "_home").withColumn(BLOCK, F.explode(F.sequence(first, last)))
    return spread.withColumn(OWN, F.col(BLOCK) == F.col("_home")).drop("_home")


def _halo_of_ranges(base: DataFrame, keys: Keys, back: int, ahead: int) -> DataFrame:
    """The same where blocks are ranges of rows.

    The ranges of a key follow each other in time, so those within reach of one are its
    neighbours, a few to either side; the rows of a range are tested against these only.
    """
    by, t = list(keys.by), keys.second()
    parts = settle(base.groupBy(*by, BLOCK).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")), "parts")
    beside = 2
    while True:
        w = Window.partitionBy(*by).orderBy(BLOCK)
        # a row at r belongs to the ranges from the one that still looks ahead to it to the one that still looks back
        reach = lambda q: (q["_lo"] - back <= F.col("_hi")) & (q["_hi"] + ahead >= F.col("_lo"))
        near = parts.withColumn("_all", F.collect_list(F.struct(BLOCK, "_lo", "_hi")).over(w.rowsBetween(-beside, beside)))
        outer = lambda k: F.coalesce(reach(F.lag(F.struct("_lo", "_hi"), k).over(w)), F.lit(False))
        near = near.withColumn("_more", outer(beside + 1) | outer(-beside - 1))
        if near.where("_more").isEmpty():
            break
        beside *= 2
    near = near.select(*by, F.col(BLOCK).alias("_home"), F.filter("_all", reach).alias("_near"))
    rows = base.withColumnRenamed(BLOCK, "_home").withColumn("_t", t).join(near, [*by, "_home"])
    hit = F.filter("_near", lambda q: (q[BLOCK] == F.col("_home")) | (F.col("_t") >= q["_lo"] - back) & (F.col("_t") <= q["_hi"] + ahead))
    spread = rows.withColumn(BLOCK, F.explode(F.transform(hit, lambda q: q[BLOCK])))
    return spread.withColumn(OWN, F.col(BLOCK) == F.col("_home")).drop("_home", "_near", "_t")


def own(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(OWN, BLOCK)


@dataclass(frozen=True)
class Carry:
    """One ordered result over the whole series of a key.

    ``sum``    running sum up to and including the row
    ``total``  sum over the whole series
    ``last``   last non-NULL value up to and including the row
    ``prev``   last non-NULL value strictly before the row
    ``next``   first non-NULL value strictly after the row
    ``first``  first non-NULL value of the whole series
    ``final``  last non-NULL value of the whole series
    ``low``    least value of the whole series
    ``high``   greatest value of the whole series

    ``prev`` of a struct is a plain lag, because a struct is never NULL.
    """

    kind: str
    value: Column


def scan(df: DataFrame, keys: Keys, **carries: Carry) -> DataFrame:
    """Add one column per :class:`Carry`."""
    base, _ = cut(df, keys)
    for name, c in carries.items():
        base = base.withColumn(f"_v_{name}", c.value)

    kinds = {name: c.kind for name, c in carries.items()}
    reduced, carried = [], []
    across = Window.partitionBy(*keys.by).orderBy(BLOCK)
    across_back = Window.partitionBy(*keys.by).orderBy(F.col(BLOCK).desc())
    whole = Window.partitionBy(*keys.by)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across_back.rowsBetween(Window.unboundedPreceding, -1)
    for name, kind in kinds.items():
        v, s = F.col(f"_v_{name}"), F.col(f"_s_{name}")
        at = F.when(v.isNotNull(), keys.order_key())
        if kind in ("sum", "total"):
            reduced.append(F.sum(v).alias(f"_s_{name}"))
        elif kind in ("last", "prev", "final"):
            reduced.append(F.max_by(v, at).alias(f"_s_{name}"))
        elif kind in ("next", "first"):
            reduced.append(F.min_by(v, at).alias(f"_s_{name}"))
        elif kind in ("low", "high"):
            reduced.append((F.min if kind == "low" else F.max)(v).alias(f"_s_{name}"))
        else:
            raise ValueError(f"unknown carry kind {kind!r}")
        carried.append(
            {
                "sum": lambda s=s: F.coalesce(F.sum(s).over(before), F.lit(0)),
                "total": lambda s=s: F.sum(s).over(whole),
                "last": lambda s=s: F.last(s, True).over(before),
                "prev": lambda s=s: F.last(s, True).over(before),
                "next": lambda s=s: F.last(s, True).over(after),
                "first": lambda s=s: F.min_by(s, F.when(s.isNotNull(), F.col(BLOCK))).over(whole),
                "final": lambda s=s: F.max_by(s, F.when(s.isNotNull(), F.col(BLOCK))).over(whole),
                "low": lambda s=s: F.min(s).over(whole),
                "high": lambda s=s: F.max(s).over(whole),
            }[kind]().alias(f"_c_{name}")
        )
    summary = base.groupBy(*keys.by, BLOCK).agg(*reduced)
    summary = summary.select(*keys.by, BLOCK, *carried)

    w, wb = keys.window(), keys.window_back()
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "sum": lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0)),
        "last": lambda v: F.last(v, True).over(upto),
        "prev": lambda v: F.last(v, True).over(past),
        "next": lambda v: F.last(v, True).over(wb.rowsBetween(Window.unboundedPreceding, -1)),
    }
    rows = base.select(
        *df.columns,
        BLOCK,
        *[local[k](F.col(f"_v_{n}")).alias(f"_l_{n}") for n, k in kinds.items() if k in local],
    )
    joined = rows.join(summary, [*keys.by, BLOCK])
    out = []
    for name, kind in kinds.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out.append((here + there).alias(name))
        elif kind in local:
            out.append(F.coalesce(here, there).alias(name))
        else:
            out.append(there.alias(name))
    return joined.select(*df.columns, *out)


def affine_scan(
    df: DataFrame,
    keys: Keys,
    value: Column,
    factor: Callable[[Column], Column],
    adds: dict[str, Callable[[Column, Column], Column]],
    slowest: float,
) -> DataFrame:
    """Linear recurrences down the rows with a known value, one column per entry of ``adds``.

    At a known row, ``state = factor(gap) * state + add(gap, value)``, where the gap is the
    number of seconds since the known row before (NULL at the first one, whose state before
    is 0).  A row without a value repeats the state before it; ahead of all values it is
    NULL.  Factors lie above 0 and at or below ``slowest`` < 1.

    Affine maps compose to affine maps.  Within a block, running sums of the additions,
    weighted by the decay since the block's first known row, give each row's map; the decay
    over a block must stay above exp(-600).  A block's map is one summary row.  Those are
    composed along the series by doubling: a round puts together each map and the one as
    many blocks before as it already spans.  So few rounds are needed that what lies further
    back has lost its weight in double precision.
    """
    x, t, known = F.col("_x"), F.col("_t"), F.col("_x").isNotNull()
    w = keys.window()
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(known, t)
    rows = df.withColumns({BLOCK: keys.block_of(keys.second()), "_t": keys.second(), "_x": value})
    rows = rows.withColumns({"_p": F.last(at, True).over(past), "_any": F.last(at, True).over(upto).isNotNull()})
    gap = t - F.col("_p")
    later = known & F.col("_p").isNotNull()
    rows = rows.withColumn("_m", F.coalesce(F.sum(F.when(later, -F.log(factor(gap)))).over(upto), F.lit(0.0)))
    rows = rows.withColumns({f"_s_{n}": F.coalesce(F.sum(F.when(later, add(gap, x) * F.exp("_m"))).over(upto), F.lit(0.0)) for n, add in adds.items()})

    order = F.when(known, keys.order_key())
    ends = rows.groupBy(*keys.by, BLOCK).agg(
        F.min_by(F.struct("_t", "_x"), order).alias("_first"), F.max_by(F.struct("_t", "_m", *[f"_s_{n}" for n in adds]), order).alias("_last")
    )
    # blocks without values stand apart, so that the others are neighbours
    filled = Window.partitionBy(*keys.by, "_full").orderBy(BLOCK)
    ends = ends.withColumn("_full", F.col("_first").isNotNull())
    ends = ends.withColumn("_g", F.col("_first._t") - F.lag("_last._t").over(filled))
    ends = ends.withColumns({"_f1": F.coalesce(factor(F.col("_g")), F.lit(0.0)), "_decay": F.exp(-F.col("_last._m"))})
    ends = ends.withColumns({f"_g_{n}": add(F.col("_g"), F.col("_first._x")) for n, add in adds.items()})
    ends = ends.withColumns({"_a": F.col("_f1") * F.col("_decay"), **{f"_b_{n}": (F.col(f"_g_{n}") + F.col(f"_last._s_{n}")) * F.col("_decay") for n in adds}})
    for r in range(max(1, math.ceil(math.log2(math.log(1e-18) / math.log(slowest))))):
        before = lambda c, r=r: F.coalesce(F.lag(c, 1 << r).over(filled), F.lit(0.0))
        ends = ends.withColumns({"_la": before("_a"), **{f"_lb_{n}": before(f"_b_{n}") for n in adds}})
        ends = ends.withColumns({"_a": F.col("_a") * F.col("_la"), **{f"_b_{n}": F.col(f"_b_{n}") + F.col("_a") * F.col(f"_lb_{n}") for n in adds}})
    ends = ends.withColumns({f"_in_{n}": F.lag(f"_b_{n}").over(filled) for n in adds})
    every = Window.partitionBy(*keys.by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    state = {f"_h_{n}": F.coalesce(F.col("_f1") * F.col(f"_in_{n}"), F.lit(0.0)) + F.col(f"_g_{n}") for n in adds}
    earlier = {f"_e_{n}": F.last(F.when(F.col("_full"), F.col(f"_b_{n}")), True).over(every) for n in adds}
    ends = ends.withColumns({**state, **earlier}).select(*keys.by, BLOCK, *state, *earlier)

    joined = rows.join(ends, [*keys.by, BLOCK])
    here = {n: F.when(F.col("_any"), F.exp(-F.col("_m")) * (F.col(f"_h_{n}") + F.col(f"_s_{n}"))).otherwise(F.col(f"_e_{n}")) for n in adds}
    return joined.select(*df.columns, *[c.alias(n) for n, c in here.items()])


def number_rows(df: DataFrame, keys: Keys, rn: str = "rn", n: str | None = "n_rows") -> DataFrame:
    """Row number from 1 within the series, and the length of the series."""
    carries = {rn: Carry("sum", F.lit(1).cast("long"))}
    if n:
        carries[n] = Carry("total", F.lit(1).cast("long"))
    return scan(df, keys, **carries)


def spread_range(
    bounds: DataFrame, by: Sequence[str], low: str, high: str, step: int | Column, out: str, chunk: int = 4096
) -> DataFrame:
    """One row per slot from ``low`` to ``high`` and its position from 0.

    The range is opened in chunks, so no row ever carries a long array.
    """
    width = F.lit(step) if isinstance(step, int) else step
    top = F.floor((F.col(high) - F.col(low)) / width).cast("long")
    pieces = bounds.withColumn("_top", top).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_top") / chunk).cast("long")))
    )
    first = F.col("_c") * chunk
    rows = pieces.withColumn("pos", F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("_top")))))
    return rows.withColumn(out, (F.col(low) + F.col("pos") * width).cast("long")).drop("_c", "_top")


def keep_last(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the last in ``order``; a partial aggregate, no sort (WIN22)."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in by else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


# --- small one-row results and global order ----------------------------------


def with_row(df: DataFrame, one_row: DataFrame, out: str) -> DataFrame:
    """Attach a one-row aggregate as a struct column, as a scalar subquery."""
    return df.withColumn(out, one_row.select(F.struct(*one_row.columns).alias(out)).scalar())


def hash_rank(df: DataFrame, hash_col: str, tie: str, place: str = "place", total: str = "n_total") -> DataFrame:
    """Global rank by a hex digest without a global sort.

    The first three digits name one of 4096 buckets; rows are numbered inside their
    bucket and shifted by the size of the earlier buckets.
    """
    cut = df.withColumn("_b", F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int"))
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    sizes = sizes.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias(total)
    )
    w = Window.partitionBy("_b").orderBy(hash_col, tie)
    ranked = cut.withColumn("_rn", F.row_number().over(w)).join(sizes, "_b")
    return ranked.withColumn(place, F.col("_rn") + F.col("_off")).drop("_b", "_rn", "_off")


def text_rank(names: DataFrame, col: str, out: str) -> DataFrame:
    """Number of smaller names for each of a table of distinct names, without a global sort.

    The names are cut into ranges of like size, whatever they have in common, and written
    to the shared folder with the number of their range; a name's rank is its place in its
    range after the sizes of the ranges before.
    """
    spark = names.sparkSession
    path = scratch(spark, "ranges")
    names.repartitionByRange(col).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1
    ranked = ranged.withColumn("_in", place).join(sizes, "_part")
    return ranked.select(*names.columns, (F.col("_in") + F.col("_off")).alias(out))


def value_prefix(
    df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], levels: int = 10, spread: DataFrame | None = None
) -> DataFrame:
    """Sums over all rows with a smaller value, per key, without a global sort.

    ``df`` has one row per (key, value).  Approximate percentiles of ``spread``
    (default: ``df``) cut the value axis into 2**levels buckets of like size; sums
    run inside a bucket and are shifted by the totals of the earlier buckets.
    ``sums`` maps output to input column; outputs leave the row itself out,
    ``{output}_total`` is the sum over the key.
    """
    buckets = 2**levels
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)
    bounds = (df if spread is None else spread).agg(cuts.alias("_q")).select("_q").scalar()
    # binary search: the number of cuts below the value, one bit per step
    cut = df.withColumn("_q", bounds).withColumn("_b", F.lit(0))
    for bit in reversed(range(levels)):
        step = 2**bit
        cut = cut.withColumn("_b", F.col("_b") + F.when(F.get("_q", F.col("_b") + (step - 1)) < F.col(value), step).otherwise(0))
    cut = cut.drop("_q")
    totals = cut.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    totals = totals.select(
        *by,
        "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(every).alias(f"{n}_total") for n in sums],
    )
    inner = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    joined = local.join(totals, [*by, "_b"])
    out = {n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums}
    return joined.withColumns(out).drop("_b", *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


#: Values of a group that one task sorts.
SORTABLE = 1_000_000
_CELLS = 64


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], limit: int = SORTABLE) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size, by selection.

    Groups of up to ``limit`` values are sorted.  For a larger one, approximate percentiles
    with a proven error give a bracket around each quantile; what lies below is counted,
    and only the values inside go on.  Brackets that still hold too many distinct values are
    cut into cells, and the cells with the wanted ranks go on, until all are small.  A round
    leaves a fixed share, so the rounds grow with the logarithm of the group.  ``by`` must
    not be NULL.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v"), F.lit(0).alias("_one"))
    keys = keys or ["_one"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n").alias("m")).first()["m"] or 0
    names = list(wanted)
    if largest <= limit:
        counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
        total = F.sum("_k").over(Window.partitionBy(*keys))
        found = _picked(counts.withColumn("_n", total), keys, {n: wanted[n] for n in names})
    else:
        small = rows.join(sizes.where(F.col("_n") <= limit), keys).groupBy(*keys, "_v").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
        found = _picked(small, keys, wanted)
        inside = _bracketed(rows, sizes.where(F.col("_n") > limit), keys, wanted, limit)
        parts = [_picked(inside.where(F.col("_q") == i), keys, {n: wanted[n]}) for i, n in enumerate(names)]
        large = parts[0]
        for part in parts[1:]:
            large = large.join(part, keys)
        found = found.unionByName(large)
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *names)


def _ranks(n: Column, q: float) -> tuple[Column, Column]:
    place = F.lit(float(q)) * (n - 1)
    return F.floor(place), F.least(F.floor(place) + 1, n - 1)


def _picked(counts: DataFrame, keys: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles from counts per value, ``_k`` of ``_n`` in all; a NULL value stands for all that is smaller."""
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    aggs = []
    for name, q in wanted.items():
        for tag, rank in zip(("lo", "hi"), _ranks(F.col("_n"), q)):
            here = (F.col("_upto") - F.col("_k") <= rank) & (rank < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}_{name}"))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    mix = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        mix.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return out.select(*keys, *mix)


def _bracketed(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], wanted: dict[str, float], limit: int) -> DataFrame:
    """For each large group and quantile ``_q`` the counts of the values around it, and of all below as one NULL row."""
    accuracy, margin = 10_000, 1e-3
    probs = [min(1.0, max(0.0, q + side * margin)) for q in wanted.values() for side in (-1, 1)]
    large = rows.join(sizes, keys)
    ends = large.groupBy(*keys).agg(F.percentile_approx("_v", probs, accuracy).alias("_p"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # a group too small for its margin to cover the ranks beside a quantile goes on whole
    sure = F.col("_n") * (margin - 1 / accuracy) > 2
    brackets = []
    for i, q in enumerate(wanted.values()):
        lo = F.when(sure & F.lit(q > margin), F.col("_p")[2 * i]).otherwise(F.col("_min"))
        hi = F.when(sure & F.lit(q < 1 - margin), F.col("_p")[2 * i + 1]).otherwise(F.col("_max"))
        brackets.append(F.struct(F.lit(i).alias("_q"), lo.alias("lo"), hi.alias("hi")))
    ends = settle(ends.join(sizes, keys).select(*keys, F.array(*brackets).alias("_b")), "brackets")
    met = large.join(ends, keys).withColumn("_in", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])))
    met = met.withColumn("_v", F.when(F.col("_v") >= F.col("_in.lo"), F.col("_v")))
    counts = settle(met.groupBy(*keys, F.col("_in._q").alias("_q"), "_v").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")), "inside")
    group = [*keys, "_q"]
    while (counts.groupBy(*group).agg(F.count("*").alias("m")).agg(F.max("m").alias("m")).first()["m"] or 0) > limit:
        cuts = counts.groupBy(*group).agg(F.percentile_approx("_v", [i / _CELLS for i in range(1, _CELLS)], accuracy).alias("_cuts"))
        celled = counts.join(cuts, group).withColumn("_cell", F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v")))))
        cells = celled.groupBy(*group, "_cell").agg(F.sum("_k").alias("_sum"))
        before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 65 rows
        cells = cells.withColumn("_below", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        place = F.element_at(F.array(*[F.lit(float(q)) for q in wanted.values()]), F.col("_q") + 1) * (F.col("_n") - 1)
        first, last = F.floor(place), F.least(F.floor(place) + 1, F.col("_n") - 1)
        celled = celled.join(cells, [*group, "_cell"])
        holds = (F.col("_below") <= last) & (first < F.col("_below") + F.col("_sum")) & (F.col("_cell") >= 0)
        low = F.col("_below") + F.col("_sum") <= first
        kept = celled.where(holds | low).withColumn("_v", F.when(holds, F.col("_v")))
        counts = settle(kept.groupBy(*group, "_v").agg(F.sum("_k").alias("_k"), F.first("_n").alias("_n")), "inside")
    return counts
