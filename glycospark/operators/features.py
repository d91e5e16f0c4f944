"""Basal roll-over, on-board kernels, smoothing, imputation and CGM features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kernels import as_exponentials, carb_kernel, insulin_kernel
from ..functions.timefn import cyclic, from_seconds, micros, seconds, weekday
from .blocks import affine_scan, halo, number_rows, own, scan, text_rank, value_prefix, with_row, BLOCK, Carry, Keys, OWN
from .clean import same_resolution

GRID_KEYS = Keys()


# --- basal -------------------------------------------------------------------


def rollover_automated(df: DataFrame, step: int, keys: Keys = GRID_KEYS) -> DataFrame:
    """The last known rate keeps running and adds to every row's dose (WIN12)."""
    rows_per_hour = 3600 // step
    filled = scan(df, keys, _rate=Carry("last", F.col("rate")))
    extra = F.coalesce(F.col("_rate") / rows_per_hour, F.lit(0.0))
    return filled.withColumn("dose_units", F.col("dose_units") + extra).drop("_rate")


def rollover_temp(df: DataFrame, step: int, keys: Keys = GRID_KEYS) -> DataFrame:
    """A rate runs for its duration or until the next rate (WIN13).

    A rate without duration adds nothing but still ends the one before it.
    """
    rows_per_hour = 3600 // step
    t = keys.second()
    order = F.when(
        F.col("rate").isNotNull(),
        F.struct(F.col("rate").alias("r"), F.col("basal_duration_mins").alias("d"), t.alias("t")),
    )
    carried = scan(df, keys, _o=Carry("last", order))
    rows = F.floor(F.col("_o.d") / (step / 60))
    active = F.col("_o.d").isNotNull() & ((t - F.col("_o.t")) / step < rows)
    extra = F.when(active, F.col("_o.r") / rows_per_hour).otherwise(0.0)
    return carried.withColumn("dose_units", F.col("dose_units") + extra).drop("_o")


def rollover(df: DataFrame, step: int, delivery: str | None, keys: Keys = GRID_KEYS) -> DataFrame:
    if "rate" not in df.columns:
        return df
    if "dose_units" not in df.columns:
        raise ValueError("basal roll-over needs a dose_units column")
    if delivery == "temp":
        if "basal_duration_mins" not in df.columns:
            raise ValueError("temporary basal needs a basal_duration_mins column")
        return rollover_temp(df, step, keys)
    if delivery == "automated":
        return rollover_automated(df, step, keys)
    raise ValueError(f"unknown basal delivery {delivery!r}: temp or automated")


# --- kernels -----------------------------------------------------------------


def convolve(
    df: DataFrame,
    value: str,
    kernels: Mapping[str, Sequence[float]],
    step: int,
    keys: Keys = GRID_KEYS,
    positive_only: bool = False,
) -> DataFrame:
    """Sum the kernel responses of all amounts on every grid row they reach (JOIN8).

    Each amount is opened into its few target slots, summed per slot with partial
    aggregation, and met by an equi join on the slot; rows without any get 0.
    """
    by = list(keys.by)
    names = list(kernels)
    weights = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, vs)]) for vs in zip(*kernels.values())])
    t = keys.second()
    amounts = df.where(F.col(value) > 0 if positive_only else F.col(value).isNotNull() & (F.col(value) != 0))
    opened = amounts.select(*by, t.alias("_t"), F.col(value).alias("_v"), F.posexplode(weights).alias("_k", "_w"))
    target = (F.col("_t") + F.col("_k") * step).alias("_t")
    sums = opened.select(*by, target, *[(F.col("_v") * F.col(f"_w.{n}")).alias(n) for n in names])
    sums = sums.groupBy(*by, "_t").agg(*[F.sum(n).alias(n) for n in names])
    joined = df.drop(*names).withColumn("_t", t).join(sums, [*by, "_t"], "left").drop("_t")
    return joined.fillna(0.0, names)


def convolve_grid(
    df: DataFrame, responses: Mapping[str, Mapping[str, Sequence[float]]], step: int, keys: Keys = GRID_KEYS,
    positive_only: Sequence[str] = (), decays: Mapping[str, Sequence[float]] = {},
) -> DataFrame:
    """Kernel sums on a complete grid: one halo, no join (JOIN8).

    ``responses`` maps an amount column to its named kernels.  On a complete grid a lag of
    k rows is a lag of k steps, and a short kernel is a sum of lags.  A long one that is a
    sum of exponentials with the given ``decays`` is a few differences of running sums,
    however many steps it has.
    """
    longest = max(len(k) for ks in responses.values() for k in ks.values())
    w = keys.window()
    lags, out = {}, {}
    near = halo(df, keys, back=(longest - 1) * step)
    sums: list[str] = []
    for value, kernels in responses.items():
        amount = F.when(F.col(value) > 0, F.col(value)) if value in positive_only else F.col(value)
        amount = F.coalesce(amount, F.lit(0.0))
        size = max(len(v) for v in kernels.values())
        terms = _exponential_terms(kernels, decays.get(value, ()), keys.block // step + longest) if size > _LAGS else None
        if terms:
            near, made = _running_sums(near, value, amount, size, {(d, q) for ts, _ in terms.values() for _, d, q in ts}, w)
            sums += made
            for name, (ts, extra) in terms.items():
                out[name] = sum((F.lit(c) * F.col(_sum_name(value, d, q)) for c, d, q in ts), F.lit(extra) * amount)
            continue
        for k in range(size):
            lags[f"_l_{value}_{k}"] = F.coalesce(F.lag(amount, k).over(w), F.lit(0.0)) if k else amount
        for name, weights in kernels.items():
            parts = [F.col(f"_l_{value}_{k}") * F.lit(float(x)) for k, x in enumerate(weights) if x != 0]
            out[name] = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    near = near.withColumns(lags) if lags else near
    return own(near.withColumns(out).drop(*lags, *sums))


#: Longer kernels are not written as a lag for each step.
_LAGS = 48


def _exponential_terms(kernels: Mapping[str, Sequence[float]], decays: Sequence[float], rows: int):
    """The kernels' terms, if all are sums of exponentials whose powers over a block's rows are doubles."""
    if not decays or any(q <= 0 or -math.log(q) * rows > 600 for q in decays):
        return None
    terms = {name: as_exponentials(weights, decays) for name, weights in kernels.items()}
    return terms if all(terms.values()) and len({len(k) for k in kernels.values()}) == 1 else None


def _sum_name(value: str, d: int, q: float) -> str:
    return f"_e_{value}_{d}_{str(q).replace('.', '_')}"


def _running_sums(near: DataFrame, value: str, amount: Column, size: int, basis: set[tuple[int, float]], w) -> tuple[DataFrame, list[str]]:
    """For each (d, q) the sum of ``k**d * q**k`` times the amount k rows ago, over the last ``size`` rows.

    With the row's number i in its block, q**i * sum(u / q**j) is the sum over all rows
    before; what is older than the kernel is the same sum at the row where it ends.  Growing
    weights keep the older part the smaller one, so the difference loses no digits.
    """
    number = "_i"
    near = near.withColumns({number: F.row_number().over(w).cast("double"), "_u": amount})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    qs = sorted({q for _, q in basis})
    raw = {}
    for n, q in enumerate(qs):
        grown = F.col("_u") * F.pow(F.lit(q), -F.col(number))
        raw[f"_r0_{n}"] = F.sum(grown).over(run)
        if (1, q) in basis:
            raw[f"_r1_{n}"] = F.sum(grown * F.col(number)).over(run)
    near = near.withColumns(raw)
    near = near.withColumns({c: F.col(c) - F.coalesce(F.lag(c, size).over(w), F.lit(0.0)) for c in raw})
    out = {}
    for d, q in basis:
        n = qs.index(q)
        back = F.pow(F.lit(q), F.col(number))
        total = F.col(f"_r0_{n}")
        out[_sum_name(value, d, q)] = back * (F.col(number) * total - F.col(f"_r1_{n}") if d else total)
    return near.withColumns(out).drop(number, "_u", *raw), list(out)


def convolve_bins(
    bins: DataFrame, responses: Mapping[str, Mapping[str, Sequence[float]]], step: int, keys: Keys = GRID_KEYS,
    positive_only: Sequence[str] = (), decays: Mapping[str, Sequence[float]] = {}, slot: str = "slot",
) -> DataFrame | None:
    """The rows of the complete grid that an amount reaches, with the sums of :func:`convolve_grid` (JOIN8).

    ``bins`` has the filled slots, before :func:`~.align.densify`; on all other rows of the
    grid the sums are 0.  None if a kernel is no sum of exponentials.

    Every amount is two events of its block: it comes, and a kernel's length later it goes.
    Between two events the running sums of the weighted amounts do not change, so windows
    run over events only.  Then each event opens the slots up to the next one in place: the
    grid is neither shuffled nor sorted, and what no amount reaches is never made.
    """
    by, at = list(keys.by), F.col("_at")
    size = {v: max(len(k) for k in ks.values()) for v, ks in responses.items()}
    terms = {v: _exponential_terms(ks, decays.get(v, ()), keys.block // step + size[v]) for v, ks in responses.items()}
    if not all(terms.values()):
        return None
    rest = [c for c in bins.columns if c not in (*by, slot)]
    edges = Keys(tuple(by), "_dt", (), keys.block)
    known = scan(bins.withColumn("_dt", from_seconds(F.col(slot))), edges, _first=Carry("first", F.col(slot)), _end=Carry("final", F.col(slot))).drop("_dt")

    start = F.col(BLOCK) * keys.block
    place = (F.col(slot) - start) / F.lit(float(step))  # of the amount's own slot, negative if that lies in the block before
    amount = {v: F.coalesce(F.when(F.col(v) > 0, F.col(v)) if v in positive_only else F.col(v), F.lit(0.0)) for v in responses}
    basis = {v: sorted({q for ts, _ in terms[v].values() for _, _, q in ts}) for v in responses}
    deltas: dict[str, tuple[str, Column]] = {}
    for v in responses:
        for n, q in enumerate(basis[v]):
            grown = amount[v] * F.pow(F.lit(q), -place)
            deltas[f"_d0_{v}_{n}"] = (v, grown)
            if any((d, p) == (1, q) for ts, _ in terms[v].values() for _, d, p in ts):
                deltas[f"_d1_{v}_{n}"] = (v, grown * place)
    live = {v: (amount[v] != 0).cast("long") for v in responses}
    own_slot = F.struct(*rest, *[amount[v].alias(f"_u_{v}") for v in responses])

    def event(when: Column, sign: int, of: Sequence[str], here: Column) -> Column:
        return F.struct(
            when.cast("long").alias("_at"), (sum((live[v] for v in of), F.lit(0)) * sign).alias("_n"), here.alias("_own"),
            *[(x * float(sign) if v in of else F.lit(0.0)).alias(c) for c, (v, x) in deltas.items()],
        )

    reach = F.greatest(*[F.when(live[v] > 0, (size[v] - 1) * step).otherwise(0) for v in responses], F.lit(0))
    last = F.floor((F.col(slot) + reach) / F.lit(keys.block)).cast("long")
    copies = known.withColumn(BLOCK, F.explode(F.sequence(F.floor(F.col(slot) / F.lit(keys.block)).cast("long"), last)))
    goes = {v: F.col(slot) + size[v] * step for v in responses}
    left = [F.when((live[v] > 0) & (goes[v] < start + keys.block), event(goes[v], -1, [v], F.lit(None).cast(copies.select(own_slot.alias("x")).schema["x"].dataType))) for v in responses]
    events = copies.withColumn("_e", F.explode(F.array_compact(F.array(event(F.col(slot), 1, list(responses), own_slot), *left))))
    merged = events.groupBy(*by, BLOCK, F.col("_e._at").alias("_at")).agg(
        F.first("_first").alias("_first"), F.first("_end").alias("_end"), F.max_by("_e._own", F.col("_e._own").isNotNull()).alias("_own"),
        F.sum("_e._n").alias("_n"), *[F.sum(f"_e.{c}").alias(c) for c in deltas],
    )
    w = Window.partitionBy(*by, BLOCK).orderBy("_at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = merged.withColumns({"_n": F.sum("_n").over(run), "_next": F.lead("_at").over(w), **{c: F.sum(c).over(run) for c in deltas}})
    since = F.greatest(at, start)
    until = F.least(F.coalesce("_next", start + keys.block), start + keys.block, F.col("_end") + step) - step
    live_rows = sums.where(F.col("_n") > 0).withColumns({"_since": since, "_until": until}).where("_since <= _until")
    opened = live_rows.withColumn(slot, F.explode(F.sequence("_since", "_until", F.lit(step).cast("long"))))

    here = F.col(slot) == at
    opened = opened.withColumn("_i", (F.col(slot) - start) / F.lit(float(step)))
    opened = opened.withColumns({f"_q_{v}_{n}": F.pow(F.lit(q), F.col("_i")) for v in responses for n, q in enumerate(basis[v])})
    out = {}
    for v in responses:
        for name, (ts, extra) in terms[v].items():
            parts = []
            for c, d, q in ts:
                n = basis[v].index(q)
                total = F.col(f"_d0_{v}_{n}")
                parts.append(F.lit(c) * F.col(f"_q_{v}_{n}") * (F.col("_i") * total - F.col(f"_d1_{v}_{n}") if d else total))
            out[name] = sum(parts, F.lit(extra) * F.when(here, F.coalesce(F.col(f"_own._u_{v}"), F.lit(0.0))).otherwise(0.0))
    position = ((F.col(slot) - F.col("_first")) / step).cast("long").alias("pos")
    return opened.select(*by, slot, position, *[F.when(here, F.col(f"_own.`{c}`")).alias(c) for c in rest], *[x.alias(c) for c, x in out.items()])


def carbs_on_board(df: DataFrame, step: int, keys: Keys = GRID_KEYS) -> DataFrame:
    avail, cob = carb_kernel(step // 60)
    return convolve(df, "food_g", {"carb_availability": avail, "cob": cob}, step, keys)


def insulin_on_board(df: DataFrame, step: int, keys: Keys = GRID_KEYS) -> DataFrame:
    avail, iob = insulin_kernel(step // 60)
    return convolve(df, "dose_units", {"insulin_availability": avail, "iob": iob}, step, keys, positive_only=True)


def null_where_absent(df: DataFrame, probe: str, outputs: Sequence[str], by: Sequence[str] = ("p_num",)) -> DataFrame:
    """NULL the outputs of every patient who never has a value in ``probe`` (PHY3)."""
    seen = df.groupBy(*by).agg(F.bool_or(F.col(probe).isNotNull()).alias("_seen"))
    out = df.join(seen, list(by))
    return out.withColumns({c: F.when(F.col("_seen"), F.col(c)) for c in outputs}).drop("_seen")


def time_of_day(df: DataFrame, col: str = "datetime") -> DataFrame:
    s, c = cyclic(F.col(col))
    return df.withColumn("hour_sin", s).withColumn("hour_cos", c)


SUPPORTED_COVARIATES = ("hour_sin", "hour_cos")


def future_covariates(
    df: DataFrame, steps: int, step: int, cols: Sequence[str] = SUPPORTED_COVARIATES, last: str = "datetime"
) -> DataFrame:
    """Covariates known in advance for the next ``steps`` rows after each stamp (CAL2)."""
    unknown = sorted(set(cols) - set(SUPPORTED_COVARIATES))
    if unknown:
        raise ValueError(f"cannot know {unknown} in advance; supported: {list(SUPPORTED_COVARIATES)}")
    ahead = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.withColumn(last, from_seconds(seconds(F.col(last)) + F.col("step") * step))
    return time_of_day(ahead, last).drop(*[c for c in SUPPORTED_COVARIATES if c not in cols])


# --- smoothing ---------------------------------------------------------------


def moving_average(
    df: DataFrame, rows: int, step: int, col: str = "bg_mM", keys: Keys = GRID_KEYS, out: str = "moving_average"
) -> DataFrame:
    """Trailing mean over ``rows`` grid rows, at least one known value (WIN14)."""
    reach = (rows - 1) * step
    w = keys.window().rowsBetween(-(rows - 1), 0)
    return own(halo(df, keys, back=reach).withColumn(out, F.avg(col).over(w)))


def centred_average(
    df: DataFrame,
    rows: int,
    step: int,
    min_periods: int | None = None,
    weights: Sequence[float] | None = None,
    col: str = "bg_mM",
    keys: Keys = GRID_KEYS,
    out: str = "smoothed",
    centre: bool = True,
) -> DataFrame:
    """Centred mean, NULL until ``min_periods`` known values are in the window (WIN15).

    With ``weights`` (one per window row) it is the weighted mean; a window with a
    missing row is NULL then.
    """
    ahead = (rows - 1) // 2 if centre else 0
    back = rows - 1 - ahead
    need = rows if min_periods is None else min_periods
    source = halo(df, keys, back=back * step, ahead=ahead * step)
    base = keys.window()
    w = base.rowsBetween(-back, ahead)
    if weights is None:
        value = F.when(F.count(col).over(w) >= need, F.avg(col).over(w))
    else:
        terms = [
            F.lag(col, -k).over(base) * F.lit(float(x))
            for k, x in zip(range(-back, ahead + 1), weights)
        ]
        value = F.when(F.count(col).over(w) >= rows, sum(terms[1:], terms[0]) / F.lit(float(sum(weights))))
    return own(source.withColumn(out, value))


def exponential_average(
    df: DataFrame,
    step: int,
    alpha: float = 0.3,
    adjust: bool = True,
    col: str = "bg_mM",
    keys: Keys = GRID_KEYS,
    out: str = "smoothed",
) -> DataFrame:
    """Exponential smoothing (WIN16).

    The adjusted form is a ratio of two decaying sums.  The recursive form renormalises
    over missing rows: after a gap of g rows the state weighs (1 - alpha)**g against
    alpha.  Both are linear recurrences, see :func:`affine_scan`; however slow the decay,
    a block holds no more rows than the keys' block has, and nothing is copied between
    blocks.  A row without a value repeats the result before it.
    """
    keep, x = 1.0 - alpha, F.col(col)
    if not keep > 0:
        return scan(df, keys, **{out: Carry("last", x)})
    # the decay over a block must stay within the range of doubles
    rows = max(1, min(keys.block // step, int(200 / -math.log(keep))))
    k = Keys(keys.by, keys.time, keys.tie, rows * step)
    old = lambda gap: F.pow(F.lit(keep), gap / step)
    if adjust:
        adds = {"_top": lambda gap, v: v, "_bottom": lambda gap, v: F.lit(1.0)}
        sums = affine_scan(df, k, x, old, adds, keep)
        return sums.withColumn(out, F.col("_top") / F.col("_bottom")).drop("_top", "_bottom")
    share = lambda gap: old(gap) / (old(gap) + alpha)
    return affine_scan(df, k, x, share, {out: lambda gap, v: F.when(gap.isNull(), v).otherwise((1 - share(gap)) * v)}, keep)


# --- CGM features ------------------------------------------------------------


def cgm_features(df: DataFrame, keys: Keys = GRID_KEYS, col: str = "bg_mM") -> DataFrame:
    """Rate of change, 1 h and 3 h statistics, range flags and calendar parts (WIN17).

    Time windows are centred and half-open, (t - h, t + h].
    """
    prev = scan(df, keys, _p=Carry("prev", F.struct(F.col(col).alias("v"), micros(F.col(keys.time)).alias("t"))))
    near = halo(prev, keys, back=5400, ahead=5400).withColumn("_us", micros(F.col(keys.time)))
    half, v = 1_000_000, F.col(col)
    span = lambda secs: Window.partitionBy(*keys.by, BLOCK).orderBy("_us").rangeBetween(-(secs * half - 1), secs * half)
    h1, h3 = span(1800), span(5400)
    mins = (F.col("_us") - F.col("_p.t")) / F.lit(60_000_000)
    hour = F.hour(keys.time)
    out = near.withColumns(
        {
            "glucose_roc": F.try_divide(v - F.col("_p.v"), mins),  # NULL between readings of one stamp
            "mean_1h": F.avg(v).over(h1),
            "std_1h": F.stddev_samp(v).over(h1),
            "mean_3h": F.avg(v).over(h3),
            "std_3h": F.stddev_samp(v).over(h3),
        }
    )
    out = out.withColumns(
        {
            "cv_3h": F.when(F.col("mean_3h") != 0, F.col("std_3h") / F.col("mean_3h")),
            "is_severe_hypo": (v < 3.0).cast("int"),
            "is_hypo": (v < 3.9).cast("int"),
            "in_range": v.between(3.9, 10.0).cast("int"),
            "is_hyper": (v > 10.0).cast("int"),
            "is_severe_hyper": (v > 13.9).cast("int"),
            "hour": hour,
            "weekday": weekday(F.col(keys.time)),
            "is_weekend": (weekday(F.col(keys.time)) >= 5).cast("int"),
            "time_of_day": F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening"),
        }
    )
    return own(out.drop("_us", "_p"))


def lag_features(
    df: DataFrame, step: int, lags: int = 48, lead: int = 12, roc_lags: int = 5, col: str = "bg_mM", keys: Keys = GRID_KEYS
) -> DataFrame:
    """Lags, the target ahead and lagged rates of change; complete rows only (WIN18)."""
    back = max(lags, roc_lags + 1) * step
    near = halo(df, keys, back=back, ahead=lead * step)
    w = keys.window()
    out = {f"lag_{i}": F.lag(col, i).over(w) for i in range(1, lags + 1)}
    out["target"] = F.lead(col, lead).over(w)
    for i in range(1, roc_lags + 1):
        out[f"roc_lag_{i}"] = (F.lag(col, i).over(w) - F.lag(col, i + 1).over(w)) / (step / 60)
    return own(near.withColumns(out)).dropna(subset=[col, *out])


# --- imputation --------------------------------------------------------------


def impute(
    df: DataFrame, columns: Sequence[str], methods: Mapping[str, str] | None = None, keys: Keys = GRID_KEYS, pos: str = "pos"
) -> DataFrame:
    """Fill by column-name rule (WIN19).

    bg and hr columns: linear or nearest by position inside the known range; step
    columns: 0; cals columns: the patient's minimum; any other column is left alone.
    """
    how = {"bg": "linear", "hr": "linear", **(methods or {})}
    carries, kinds = {}, {}
    for c in columns:
        kind = next((k for k in ("bg", "hr", "step", "cals") if k in c.lower()), None)
        if kind in ("bg", "hr"):
            known = F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("k"), F.col(c).alias("v")))
            carries[f"_a_{c}"], carries[f"_b_{c}"] = Carry("last", known), Carry("next", known)
        kinds[c] = kind
    out = scan(df, keys, **carries) if carries else df
    lows = [c for c, k in kinds.items() if k == "cals"]
    if lows:
        floor = df.groupBy(*keys.by).agg(*[F.min(c).alias(f"_min_{c}") for c in lows])
        out = out.join(floor, list(keys.by))
    for c, kind in kinds.items():
        if kind in ("bg", "hr"):
            a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
            share = (F.col(pos) - a["k"]) / (b["k"] - a["k"])
            linear = a["v"] + (b["v"] - a["v"]) * share
            nearest = F.when(F.col(pos) - a["k"] <= b["k"] - F.col(pos), a["v"]).otherwise(b["v"])
            inside = a.isNotNull() & b.isNotNull()
            fill = nearest if how[kind] == "nearest" else linear
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).when(inside, fill))
        elif kind == "step":
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
        elif kind == "cals":
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_min_{c}")))
    return out.select(*df.columns)


def reduce_features(
    df: DataFrame, interval_mins: int, x: Sequence[str], y: Sequence[str], methods: Mapping[str, str] | None = None, keys: Keys = GRID_KEYS
) -> DataFrame:
    """Patients of one sampling interval, reduced to x and y columns and imputed (PRJ23)."""
    columns = [*x, *(c for c in y if c not in x)]
    rows = number_rows(same_resolution(df, interval_mins, columns), keys, rn="pos", n=None)
    return impute(rows, columns, methods, keys).select("p_num", "datetime", *columns)


def fill_covariates(df: DataFrame, columns: Sequence[str], keys: Keys) -> DataFrame:
    """Forward fill, then 0; a covariate that is absent becomes 0 (WIN20)."""
    have = [c for c in columns if c in df.columns]
    filled = scan(df, keys, **{f"_f_{c}": Carry("last", F.col(c)) for c in have}) if have else df
    out = {c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) if c in have else F.lit(0.0) for c in columns}
    return filled.withColumns(out).drop(*[f"_f_{c}" for c in have])


def stack_targets(df: DataFrame, targets: Sequence[str], series: str = "segment_id") -> DataFrame:
    """One sub-series ``{series}__{column}`` per target column (WIN21)."""
    rest = [c for c in df.columns if c not in targets]
    long = df.unpivot(rest, list(targets), "target_name", "target")
    return long.withColumn("item_id", F.concat_ws("__", F.col(series).cast("string"), F.col("target_name")))


def rank_normalised(df: DataFrame, columns: Sequence[str], out: str = "rank_score") -> DataFrame:
    """Mean over columns of (average rank - 1) / (n - 1) (WIN23).

    Ranks come from the counts of the distinct values, not from sorted rows.
    """
    scored = df
    for c in columns:
        counts = df.groupBy(c).agg(F.count("*").alias("_k")).where(F.col(c).isNotNull())
        ranked = value_prefix(counts, [], c, {"_less": "_k"})
        place = (F.col("_less") + (F.col("_k") - 1) / 2) / (F.col("_less_total") - 1)
        ranks = ranked.select(F.col(c).alias("_key"), place.alias(f"_r_{c}"))
        scored = scored.join(ranks, F.col(c) == F.col("_key"), "left").drop("_key")
    mean = sum((F.col(f"_r_{c}") for c in columns[1:]), F.col(f"_r_{columns[0]}")) / len(columns)
    return scored.withColumn(out, mean).drop(*[f"_r_{c}" for c in columns])


def encode_categories(df: DataFrame, col: str, out: str) -> DataFrame:
    """NULL becomes "Unknown"; codes follow the sorted categories from 0 (PRJ25)."""
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit("Unknown")))
    codes = text_rank(filled.select(col).distinct(), col, "_before")
    return filled.join(codes.select(col, F.col("_before").cast("int").alias(out)), col)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation over the whole table (PRJ24)."""
    stats = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("std", F.stddev_pop))])
    joined = with_row(df, stats, "_st")
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_st.mean_{c}")) / F.col(f"_st.std_{c}") for c in columns}
    return joined.withColumns(scaled).drop("_st")


def unscale(scaled: Column, mean: Column, std: Column) -> Column:
    return scaled * std + mean


def window_scale(context: Column, floor: float = 0.1) -> tuple[Column, Column]:
    """Mean and population deviation (at least ``floor``) of an array (PRJ24)."""
    n = F.size(context)
    mean = F.aggregate(context, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(context, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return mean, F.greatest(F.sqrt(var), F.lit(floor))
