"""Forecast episodes: fixed-length windows cut from long series.

An episode is one row holding its context and target arrays.  Rows are sent to the
few windows they belong to and gathered per (patient, window), so the size of a
group is the window length and never depends on the patient.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefn import floor_slot, from_seconds, seconds
from .align import densify
from .blocks import Carry, Keys, keep_last, number_rows, scan
from .gaps import interpolate_small_gaps

DAY = 86_400


def on_grid(df: DataFrame, step: int, order: Column | None = None) -> DataFrame:
    """Reindex on the floored grid: duplicates keep their last row, off-grid rows vanish.

    ``order`` says which row of one stamp is the last; without it the last one read is.
    """
    ranked = df.withColumn("_read", F.monotonically_increasing_id())
    single = keep_last(ranked, ["p_num", "datetime"], F.col("_read") if order is None else order).drop("_read")
    slot = floor_slot(F.col("datetime"), step)
    cols = [c for c in df.columns if c not in ("p_num", "datetime")]
    # the grid spans all stamps, but only stamps on it bring their values
    on = seconds(F.col("datetime")) == slot
    exact = on & (F.date_format("datetime", "SSSSSS") == "000000")
    bins = single.groupBy("p_num", slot.alias("slot")).agg(*[F.max(F.when(exact, F.col(c))).alias(c) for c in cols])
    return densify(bins, step).withColumn("datetime", from_seconds(F.col("slot"))).drop("slot")


def _window_rows(
    grid: DataFrame, ctx: int, fh: int, step: int, anchor_every: int = DAY
) -> DataFrame:
    """Send each grid row to every anchor whose window holds it; ``k`` is its place in it."""
    t = seconds(F.col("datetime"))
    first = F.floor((t - F.lit((fh - 1) * step) - 1) / anchor_every).cast("long") + 1
    last = F.floor((t + F.lit(ctx * step)) / anchor_every).cast("long")
    rows = grid.withColumn("_t", t).where(first <= last).withColumn("_n", F.explode(F.sequence(first, last)))
    anchor = F.col("_n") * anchor_every
    return rows.withColumn("_anchor", anchor).withColumn("k", ((F.col("_t") - anchor) / step + ctx).cast("int"))


def _gather(rows: DataFrame, by: Sequence[str], cols: Sequence[str], ctx: int, fh: int) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct("k", *cols)))
    out = rows.groupBy(*by).agg(packed.alias("_w"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == ctx + fh)


def _field(col: str, part: Column) -> Column:
    return F.transform(part, lambda r: r[col])


def midnight_episodes(
    df: DataFrame,
    ctx: int,
    fh: int,
    step: int = 300,
    target: str = "bg_mM",
    covariates: Sequence[str] = (),
    max_gap: int = 11,
    order: Column | None = None,
    gridded: bool = False,
) -> DataFrame:
    """Episodes anchored at midnight (EPI1); ``usable`` is false for skipped anchors.

    Small gaps are filled once per series.  A window is usable when no NULL is left
    and both of its outer rows were known before filling: a run cut by the edge of
    the window has only one known neighbour inside it.  ``gridded`` input already is
    a complete grid of ``step`` seconds, as ``regularize`` gives, and is not gridded again.
    """
    if target not in df.columns:
        raise ValueError(f"no target column {target!r} among {df.columns}")
    have = [c for c in covariates if c in df.columns]
    if gridded:
        grid = df.select("p_num", "datetime", target, *have)
    else:
        grid = on_grid(df.select("p_num", "datetime", target, *have, *_order_cols(df, order, target, have)), step, order)
    filled = interpolate_small_gaps(grid, max_gap, step, target, out="_y")
    rows = _window_rows(filled, ctx, fh, step)
    eps = _gather(rows, ["p_num", "_anchor"], [target, "_y", *have], ctx, fh)
    w = F.col("_w")
    missing = F.exists(_field("_y", w), lambda v: v.isNull())
    edges = F.element_at(w, 1)[target].isNotNull() & F.element_at(w, -1)[target].isNotNull()
    holes = F.exists(_field(target, w), lambda v: v.isNull())
    usable = ~missing & edges if max_gap > 0 else ~holes
    context, future = F.slice(w, 1, ctx), F.slice(w, ctx + 1, fh)
    cov_maps = F.create_map(*[x for c in have for x in (F.lit(c), _field(c, future))]) if have else None
    out = eps.select(
        "p_num",
        from_seconds(F.col("_anchor")).alias("anchor"),
        usable.alias("usable"),
        (usable & holes).alias("interpolated"),
        _field("_y", context).alias("context"),
        _field("_y", future).alias("target"),
        *[_field(c, context).alias(f"context_{c}") for c in have],
        *([cov_maps.alias("future_cov")] if have else []),
    )
    return out


def _order_cols(df: DataFrame, order: Column | None, target: str, have: Sequence[str]) -> list[str]:
    return [] if order is None else [c for c in df.columns if c not in ("p_num", "datetime", target, *have)]


def episode_stats(episodes: DataFrame) -> DataFrame:
    """Anchors, skipped and interpolated episodes per patient (EPI1)."""
    return episodes.groupBy("p_num").agg(
        F.count("*").alias("total_anchors"),
        F.count_if(~F.col("usable")).alias("skipped_bg_nan"),
        F.count_if("interpolated").alias("interpolated_episodes"),
    )


def usable(episodes: DataFrame) -> DataFrame:
    return episodes.where("usable").drop("usable", "interpolated")


def covariate_episodes(
    df: DataFrame, ctx: int, fh: int, covariates: Sequence[str], step: int = 300, target: str = "bg_mM",
    min_coverage: float = 0.5, order: Column | None = None, keys: Keys = Keys(),
) -> DataFrame:
    """Midnight episodes that need covariate coverage (EPI2).

    At least one covariate must be known in half of the context.  Context and
    forecast are each filled forward, then with 0: every row carries its last known
    value and stamp, and a value from before the part it is used in counts as 0.
    """
    have = [c for c in covariates if c in df.columns]
    grid = on_grid(df, step, order)
    t = seconds(F.col("datetime"))
    known = {f"_f_{c}": Carry("last", F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), t.alias("t")))) for c in have}
    rows = _window_rows(scan(grid, keys, **known), ctx, fh, step)
    eps = _gather(rows, ["p_num", "_anchor"], [target, *have, *known], ctx, fh)
    w = F.col("_w")
    context, future = F.slice(w, 1, ctx), F.slice(w, ctx + 1, fh)
    covered = [F.size(F.filter(_field(c, context), lambda v: v.isNotNull())) / ctx >= min_coverage for c in have]
    enough = covered[0]
    for c in covered[1:]:
        enough = enough | c
    since = lambda c, part, start: F.transform(
        part, lambda r: F.when(r[f"_f_{c}"]["t"] >= start, r[f"_f_{c}"]["v"]).otherwise(0.0)
    )
    start = F.col("_anchor") - ctx * step
    filled = {f"context_{c}": since(c, context, start) for c in have}
    return eps.where(enough & ~F.exists(_field(target, w), lambda v: v.isNull())).select(
        "p_num",
        from_seconds(F.col("_anchor")).alias("anchor"),
        _field(target, context).alias("context"),
        _field(target, future).alias("target"),
        *[v.alias(k) for k, v in filled.items()],
        *[F.element_at(v, -1).alias(k.replace("context_", "anchor_")) for k, v in filled.items()],
        F.create_map(*[x for c in have for x in (F.lit(c), since(c, future, F.col("_anchor")))]).alias("future_cov"),
    )


def patient_episodes(df: DataFrame, patients: DataFrame, ctx: int, fh: int, **kw) -> DataFrame:
    """Usable episodes of a list of patients (EPI3); the list filters before the windows."""
    return usable(midnight_episodes(df.join(patients, "p_num", "left_semi"), ctx, fh, **kw))


def row_windows(
    df: DataFrame, ctx: int, fh: int, stride: int | None = None, target: str = "bg_mM", keys: Keys = Keys(),
    skip_nulls: bool = False, pos: str | None = None, cols: Sequence[str] = (),
) -> DataFrame:
    """Sliding windows by row position, stride ``fh`` unless given (EPI4, EPI5).

    ``pos`` is an existing 0-based position (a grid has one); without it the rows
    are numbered first.  With ``skip_nulls`` windows holding a NULL are dropped.
    """
    stride = stride or fh
    by = list(keys.by)
    numbered = df.withColumn("_p", F.col(pos).cast("long")) if pos else number_rows(df, keys, "_rn", None).withColumn("_p", F.col("_rn") - 1)
    size = ctx + fh
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - (size - 1)) / stride)).cast("long")
    last = F.floor(F.col("_p") / stride).cast("long")
    rows = numbered.where(first <= last).withColumn("window_no", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("k", (F.col("_p") - F.col("window_no") * stride).cast("int"))
    eps = _gather(rows, [*by, "window_no"], [keys.time, target, *cols], ctx, fh)
    w = F.col("_w")
    if skip_nulls:
        eps = eps.where(~F.exists(_field(target, w), lambda v: v.isNull()))
    return eps.select(
        *by,
        "window_no",
        F.element_at(w, ctx + 1)[keys.time].alias("anchor"),
        _field(target, F.slice(w, 1, ctx)).alias("context"),
        _field(target, F.slice(w, ctx + 1, fh)).alias("target"),
        *[_field(c, F.slice(w, 1, ctx)).alias(f"context_{c}") for c in cols],
    )


def packed_blocks(df: DataFrame, length: int, target: str = "bg_mM", keys: Keys = Keys()) -> DataFrame:
    """Back-to-back windows over the known rows; the rest at the end is left out (EPI6)."""
    known = df.where(F.col(target).isNotNull())
    numbered = number_rows(known, keys, "_rn", None)
    rows = numbered.withColumn("block_no", F.floor((F.col("_rn") - 1) / length).cast("long")).withColumn(
        "k", ((F.col("_rn") - 1) % length).cast("int")
    )
    eps = _gather(rows, [*keys.by, "block_no"], [target], length, 0)
    return eps.select(*keys.by, "block_no", _field(target, F.col("_w")).alias("values"))


def day_night_rows(
    df: DataFrame, context: tuple[int, int] = (6, 24), forecast: tuple[int, int] = (0, 6)
) -> DataFrame:
    """Rows with the day they belong to and their role (EPI7).

    A row may serve as context of one day and as forecast of another; it is never
    compared with other rows, only labelled.
    """
    (c0, c1), (f0, f1) = context, forecast
    for name, (a, b) in (("context", context), ("forecast", forecast)):
        if not (0 <= a <= 24 and 0 <= b <= 24):
            raise ValueError(f"{name} hours must lie between 0 and 24")
    hour, day = F.hour("datetime"), F.to_date("datetime")
    before = F.date_sub(day, 1)
    if c1 == 24:
        ctx = [(hour >= c0, day)]
    elif c0 < c1:
        ctx = [((hour >= c0) & (hour < c1), day)]
    else:
        ctx = [(hour >= c0, day), (hour < c1, before)]
    if f0 == 0:
        fc = [(hour < f1, before)] if f1 < 24 else [(F.lit(False), before)]
    elif f0 < f1:
        fc = [((hour >= f0) & (hour < f1), day)]
    else:
        fc = [(hour >= f0, day), (hour < f1, before)]
    entries = [
        F.when(cond, F.struct(own_day.alias("episode_date"), F.lit(role).alias("role")))
        for role, pairs in (("context", ctx), ("forecast", fc))
        for cond, own_day in pairs
    ]
    rows = df.withColumn("_e", F.explode(F.array_compact(F.array(*entries))))
    return rows.select(*df.columns, "_e.episode_date", "_e.role")


def day_night_pairs(df: DataFrame, context=(6, 24), forecast=(0, 6), target: str = "bg_mM", order: Sequence[str] = ()) -> DataFrame:
    """Context and forecast arrays per day that has both (EPI7).

    Only days on which the patient has rows of their own anchor an episode.
    """
    rows = day_night_rows(df, context, forecast)
    item = F.struct("datetime", *order, target)
    pick = lambda role: _field(target, F.sort_array(F.collect_list(F.when(F.col("role") == role, item))))
    out = rows.groupBy("p_num", "episode_date").agg(
        pick("context").alias("context"), pick("forecast").alias("target"),
        F.bool_or(F.to_date("datetime") == F.col("episode_date")).alias("_own"),
    )
    return out.where((F.size("context") > 0) & (F.size("target") > 0) & F.col("_own")).drop("_own")


def training_pairs(
    df: DataFrame, min_context: int = 10, target_rows: int = 6, ctx: int = 24,
    target: str = "bg_mM", keys: Keys = Keys(), context=(6, 24), forecast=(0, 6), pos: str | None = None,
) -> DataFrame:
    """Day/night pairs with length rules; patients without any fall back to rolling windows (EPI8)."""
    pairs = day_night_pairs(df, context, forecast, target, keys.tie)
    complete = ~F.exists("target", lambda v: v.isNull()) & (F.size("target") >= target_rows)
    good = pairs.where((F.size("context") >= min_context) & complete).select(
        "p_num", F.lit("day_night").alias("kind"), F.col("episode_date").cast("timestamp_ntz").alias("start"),
        "context", F.slice("target", 1, target_rows).alias("target"),
    )
    rest = df.join(good.select("p_num").distinct(), "p_num", "left_anti")
    rolling = row_windows(rest, ctx, target_rows, None, target, keys, skip_nulls=True, pos=pos)
    every = good.unionByName(
        rolling.select("p_num", F.lit("rolling").alias("kind"), F.col("anchor").alias("start"), "context", "target")
    )
    return every


def episode_ids(episodes: DataFrame, by: str = "p_num", order: str = "anchor") -> DataFrame:
    """``{patient}::ep{number}`` in anchor order (EPI10); episodes are daily, so few per patient."""
    w = Window.partitionBy(by).orderBy(order)
    number = F.row_number().over(w) - 1
    return episodes.withColumn("episode_id", F.format_string("%s::ep%03d", F.col(by).cast("string"), number))


def panel(episodes: DataFrame, step: int, trim: int | None = None, context: str = "context") -> DataFrame:
    """Flat context rows for batch prediction, trimmed to the last ``trim`` (EPI9, EPI10)."""
    ctx = F.slice(F.col(context), -trim, trim) if trim else F.col(context)
    rows = episodes.select("episode_id", "anchor", F.size(ctx).alias("_n"), F.posexplode(ctx).alias("k", "bg_mM"))
    stamp = from_seconds(seconds(F.col("anchor")) + (F.col("k") - F.col("_n")) * step)
    return rows.select("episode_id", "k", stamp.alias("datetime"), "bg_mM")


def known_future(episodes: DataFrame, covariates: Sequence[str], step: int) -> DataFrame:
    """Flat rows of the covariates over the forecast (EPI9)."""
    zipped = F.arrays_zip(*[F.col("future_cov")[c].alias(c) for c in covariates])
    rows = episodes.select("episode_id", "anchor", F.posexplode(zipped).alias("k", "_c"))
    stamp = from_seconds(seconds(F.col("anchor")) + F.col("k") * step)
    return rows.select("episode_id", "k", stamp.alias("datetime"), *[F.col("_c")[c].alias(c) for c in covariates])


def export_episodes(episodes: DataFrame, step: int) -> DataFrame:
    """Long form with segment label, step and hours from the anchor (EPI11)."""
    rows = episodes.select(
        "p_num", "anchor", F.size("context").alias("_n"), F.posexplode(F.concat("context", "target")).alias("_i", "bg_mM")
    )
    k = F.col("_i") - F.col("_n")
    return rows.select(
        "p_num",
        "anchor",
        F.when(k < 0, "context").otherwise("forecast").alias("segment"),
        k.alias("step"),
        (k * step / 3600).alias("hours_from_anchor"),
        "bg_mM",
    )


def has_hypo(target: Column, threshold: float = 3.9) -> Column:
    return F.array_min(target) < threshold


def label_split_type(episodes: DataFrame, held: DataFrame, col: str = "p_num") -> DataFrame:
    """``patient`` for held-out patients, else ``temporal`` (EPI13)."""
    flag = held.select(col).distinct().withColumn("_h", F.lit(True))
    joined = episodes.join(flag, col, "left")
    return joined.withColumn("split_type", F.when(F.col("_h"), "patient").otherwise("temporal")).drop("_h")


def wide_export(episodes: DataFrame, ids: Sequence[str], length: int) -> DataFrame:
    """One column per listed episode, one row per step; wrong lengths are left out (EPI14)."""
    full = F.concat("context", "target")
    rows = episodes.where(F.col("episode_id").isin(*ids) & (F.size(full) == length)).select(
        "episode_id", F.posexplode(full).alias("step", "value")
    )
    return rows.groupBy("step").pivot("episode_id", list(ids)).agg(F.first("value"))


def attach_covariate(panel_rows: DataFrame, series: DataFrame, cols: Sequence[str], on: Sequence[str] = ("p_num", "datetime")) -> DataFrame:
    """Look covariates up by patient and stamp (JOIN15)."""
    return panel_rows.join(series.select(*on, *cols), list(on), "left")
