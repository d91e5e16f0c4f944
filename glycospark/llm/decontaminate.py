"""Benchmark decontamination by winnowed word n-grams, in DataFrame functions only.

Every window of ``span`` consecutive benchmark words keeps one fingerprint, the minimum
hash of its k-grams.  A text keeps the minimum of each of its windows in the same way, so
a shared window always shares its fingerprint.  Fingerprints are joined; each hit is
extended to the whole window by comparing words, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, row_key, settle, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
SHARE = 20  # a text counts as contaminated from one hit word in so many
#: Benchmark windows that may be broadcast: at most a few dozen MB with their words.
BROADCAST_WINDOWS = 100_000
SIEVE_BITS = 1 << 28  # 32 MB


def words(text: Column) -> Column:
    """Words of a text, lower case in ASCII."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _combined(df: DataFrame, col: str, sizes: set[int], kind: str, op: Callable[[Column, Column], Column]) -> tuple[DataFrame, dict[int, str]]:
    """df with an array for each size, by name: entry i combines entries i to i + size - 1 of ``col``.

    Sizes double; one in between overlaps two halves, so ``op`` may see an entry twice.
    Entries that reach past the end mean nothing.
    """
    names, have = {1: col}, 1
    grow = lambda of, by: F.zip_with(names[of], F.slice(names[of], by + 1, F.size(names[of])), op)
    for size in sorted(sizes):
        while 2 * have <= size:
            df = df.withColumn(f"{col}_{kind}{2 * have}", grow(have, have))
            names[2 * have], have = f"{col}_{kind}{2 * have}", 2 * have
        if size not in names:
            df = df.withColumn(f"{col}_{kind}{size}", grow(have, size - have))
            names[size] = f"{col}_{kind}{size}"
    return df, names


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per window of each length over ``_w``: ``_n``, ``_at`` (from 0), ``_fp``, beside the columns of df.

    A window keeps the minimum hash of its k-grams; k is about half a window.  All lengths
    come from one pass over the words.  The outer explodes keep Spark from copying the
    array expressions into a filter below.
    """
    given = df.columns
    k_of = {n: (n + 1) // 2 for n in lengths}
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df, grams = _combined(df, "_h", set(k_of.values()), "gram", lambda a, b: F.xxhash64(a, b))
    mins = {}
    for k in sorted(set(k_of.values())):
        widths = {n - k + 1: n for n in lengths if k_of[n] == k}
        df, least = _combined(df, grams[k], set(widths), "min", lambda a, b: F.least(a, b))
        mins |= {n: F.slice(least[w], 1, F.greatest(F.size("_w") - (n - 1), F.lit(0))) for w, n in widths.items()}
    df = df.select(*given, F.posexplode_outer(F.array(*[mins[n] for n in lengths])).alias("_i", "_mins"))
    df = df.select(*given, F.element_at(F.array(*map(F.lit, lengths)), F.col("_i") + 1).alias("_n"), F.posexplode_outer("_mins").alias("_at", "_fp"))
    return df.where("_at IS NOT NULL").withColumn("_fp", F.col("_fp").bitwiseXOR(F.col("_n").cast("bigint")))


def _windows(items: DataFrame, span: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct benchmark windows with their fingerprint, kept in the shared folder; their counts by length.

    An item of fewer words is one window, so lengths are 1 to ``span``: the counts are a
    few numbers, whatever the size of the benchmark.
    """
    items = items.withColumn("_own", F.least(F.size("_w"), F.lit(span))).where("_own > 0")
    lengths = sorted(r[0] for r in items.select("_own").distinct().collect())
    if not lengths:
        return None, {}
    out = _fingerprints(items, lengths).where("_n = _own").select("_item", "_n", "_fp", F.slice("_w", F.col("_at") + 1, F.col("_n")).alias("_ww"))
    out = settle(out.distinct(), "windows")
    counts = {r[0]: r[1] for r in out.groupBy("_n").agg(F.count("*")).collect()}
    return out, counts


def _sifted(rows: DataFrame, prints: DataFrame, count: int) -> DataFrame:
    """rows whose ``_fp`` may be among ``prints``: all that are, and a few that are not.

    A bitmap of 16 bits a fingerprint, at most ``SIEVE_BITS``, is broadcast in pieces of 4 KB.
    """
    bits = min(SIEVE_BITS, 1 << max(15, (16 * count - 1).bit_length()))
    place = F.pmod("_fp", F.lit(bits)) + 1
    sieve = prints.select(place.alias("_x")).groupBy(F.bitmap_bucket_number("_x").alias("_piece"))
    sieve = F.broadcast(sieve.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits")))
    met = rows.withColumns({"_piece": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(sieve, "_piece")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per text with a shared window: ``_key``, n_hit, items (sorted item ids).

    Both frames need the named columns only.  Null and wordless texts, an empty table and
    an empty benchmark have no hits; rows equal in id and text share a key and one row.
    """
    bench, counts = _windows(items.select(F.col(item_col).cast("string").alias("_item"), words(text_of(text_col)).alias("_w")), span)
    docs = docs.select(row_key(id_col, text_col).alias("_key"), words(text_of(text_col)).alias("_w"))
    found = None
    if counts:
        lengths, total = sorted(counts), sum(counts.values())
        windows = bench.select("_fp", "_ww").distinct()
        rows = docs
        if total <= BROADCAST_WINDOWS:
            windows = F.broadcast(windows)
        else:  # first find the texts by their fingerprints, then take words along for those only
            prints = bench.select("_fp").distinct()
            grams = _sifted(_fingerprints(docs, lengths).select("_key", "_fp"), prints, total).distinct()
            rows = docs.join(grams.join(prints, "_fp", "left_semi").select("_key").distinct(), "_key", "left_semi")
        hit = _fingerprints(rows, lengths).join(windows, "_fp").where(F.slice("_w", F.col("_at") + 1, F.col("_n")) == F.col("_ww"))
        found = hit.select("_key", "_at", "_n", "_ww").distinct()
    if found is None:
        return docs.select("_key", F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    found = settle(found, "hits")
    # hit words: walk the windows from left to right and count what each one adds
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["_at"] + x["_n"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["_at"] + x["_n"] - F.greatest(acc["end"], x["_at"]))).alias("n"),
    )
    covered = found.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("_at", "_n"))).alias("_spans"))
    covered = covered.select("_key", F.aggregate("_spans", start, step, lambda acc: acc["n"]).alias("n_hit"))
    named = found.select("_key", "_n", "_ww").distinct().join(bench.select("_n", "_ww", "_item"), ["_n", "_ww"])
    named = named.groupBy("_key").agg(F.sort_array(F.collect_set("_item")).alias("items"))
    return covered.join(named, "_key", "left")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, share: int = SHARE, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per text: id, n_words, n_hit, n_items, items, contaminated.

    * A null or wordless text has no words and no hits; so has a null or wordless item.
    * A null item id marks words as hit, but is in no list of items.
    * Repeated rows each get their row; equal ids with other texts are judged apart.
    * An empty benchmark leaves every text clean; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col), row_key(id_col, text_col).alias("_key"), F.size(F.array_remove(F.split(text_of(text_col), RAW_SEPARATORS), "")).cast("long").alias("n_words"))
    out = rows.join(hits(docs, items, span, id_col=id_col, text_col=text_col, item_col=item_col), "_key", "left").drop("_key")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    flagged = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", flagged.alias("contaminated"))


#: The separators before lower-casing; both cut a text into equally many words.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, share: int = SHARE, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, whose text is not contaminated."""
    n_words = F.size(F.array_remove(F.split(text_of(text_col), RAW_SEPARATORS), ""))
    hit = hits(docs, items, span, id_col=id_col, text_col=text_col, item_col=item_col).select(F.col("_key").alias("_llm_key"), F.col("n_hit").alias("_llm_hit"))
    keyed = docs.withColumn("_llm_key", row_key(id_col, text_col))
    kept = keyed.join(hit, "_llm_key", "left").where(F.col("_llm_hit").isNull() | (F.col("_llm_hit") * share < n_words))
    return kept.select(*docs.columns)
