"""Near-duplicate classes by circulant MinHash.

One random permutation scatters the shingles of a text over a circle of slots; a second
one, read at the slot and at each of the following ones, gives all coordinates of the
signature: shifting the second permutation by one slot is the next hash function.  So a
shingle costs one contiguous read instead of a hash for each coordinate.

Signatures are banded.  Texts that meet in a band are candidates, and candidates are
confirmed on their full shingle sets.  Texts with the same set are one node from the
start.  A band links its members to its most central node first; only members that are
still in different components are compared with each other, and in crowded bands only
pairs that a bound on their shared shingles allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_in, id_out, settle
from .components import components
from .hashing import Spans, as_long, mix

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 32  # a pair at the threshold stays unseen with probability 5e-6
SLOTS = 1 << 20
#: A band with more nodes than this is searched with the bounds on shared shingles.
CROWD = 64
#: Bitmaps of so many 64-bit words bound what two nodes of a crowded band share.
MAP_WORDS = 32


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_211)
    first = rng.permutation(SLOTS).astype(np.uint32)
    second = rng.permutation(SLOTS).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: ROWS * BANDS - 1]]), ROWS * BANDS)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text.

    Words are what white space of ASCII separates, A-Z in lower case.  A text of fewer
    words than ``size`` is one shingle; a null or blank text has none.
    """
    lowered = [(t or "").encode().lower() for t in texts]  # bytes lower only A-Z
    buffer = b" ".join(lowered) + b" "
    data = np.frombuffer(buffer, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0 : len(edge) // 2 * 2 : 2], edge[1::2]
    hashes = Spans(data).hash(starts, ends)
    limits = np.cumsum([len(x) + 1 for x in lowered])
    first = np.searchsorted(starts, np.concatenate([[0], limits[:-1]]))
    last = np.searchsorted(starts, limits)
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled += mix(hashes[k : n - size + 1 + k] + np.uint64(k + 1)) if len(rolled) else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(mix(hashes[a:b]))) + b - a & (1 << 64) - 1], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first, windows = _permutations()
    turn = np.uint64(0x9E3779B97F4A7C15)
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for pdf in batches:
        ids, n, low, high, bands = [], [], [], [], []
        for i, s in zip(pdf["id"], shingle_sets(list(pdf["text"]))):
            ids.append(i)
            n.append(len(s))
            low.append(int(as_long(mix(s).sum(keepdims=True))[0]))
            high.append(int(as_long(mix(s + turn).sum(keepdims=True))[0]))
            if not len(s):
                bands.append(None)
                continue
            slots = first[(s >> np.uint64(44)).astype(np.int64)]
            signature = windows[slots[:4096]].min(axis=0)
            for k in range(4096, len(slots), 4096):
                np.minimum(signature, windows[slots[k : k + 4096]].min(axis=0), out=signature)
            rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
            key = seeds.copy()
            for r in range(ROWS):
                key = mix(key + rows[:, r])
            bands.append(as_long(key))
        yield pd.DataFrame({"id": ids, "n": n, "low": low, "high": high, "bands": bands})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = shingle_sets(list(pdf["text"]))
        bits = []
        for s in sets:
            bitmap = np.zeros(64 * MAP_WORDS, dtype=bool)
            bitmap[(s % np.uint64(len(bitmap))).astype(np.int64)] = True
            bits.append(np.packbits(bitmap).view(np.int64))
        yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets], "bits": bits})


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sets are alike enough."""
    for pdf in batches:
        keep = []
        for a, b in zip(pdf["sa"], pdf["sb"]):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]] if len(pdf) else pdf[["a", "b"]]


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked.  Two joins on plain tables, so that Spark can split a node in many pairs."""
    pairs = settle(pairs, "pairs")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return settle(both.select("a", "b", "sa", "sb").mapInPandas(_shared, "a bigint, b bigint"), "links")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id``, n_shingles, component_id, kept.

    Two texts are linked if their shingle sets share ``PERCENT`` of their union;
    component_id is the smallest id that links lead to, the text's own included, and kept
    marks the text that has this id.

    * Null, empty and blank texts have no shingles and no links; each is its own class.
    * Rows with equal id are one document to this operator, whatever their texts: they
      share their links, and all of them are kept or none.
    * A null id takes no part: null class, kept.
    * An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = texts.mapInPandas(_signatures, "id bigint, n bigint, low bigint, high bigint, bands array<bigint>")
    signed = settle(signed.withColumn("id", id_out("id")), "signatures")
    known = signed.where("id IS NOT NULL AND n > 0")
    nodes = settle(known.groupBy("n", "low", "high").agg(F.min("id").alias("node")), "nodes")
    # the node of each id; equal sets are equal nodes
    member = known.join(nodes, ["n", "low", "high"]).select("id", "node").distinct()
    same_id = member.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))

    reps = known.join(nodes.select("node"), F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "n", "bands")
    banded = settle(reps.select("node", "n", F.explode("bands").alias("band")).distinct(), "bands")
    crowds = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).where("first <> last")
    banded = settle(banded.join(settle(crowds.select("band", "size"), "crowds"), "band"), "banded")
    # the hub of a band is its node with the most company over all bands, the one nearest to the rest
    company = settle(banded.groupBy("node").agg(F.sum("size").alias("company")), "company")
    central = F.max(F.struct("company", -F.col("node"))).alias("central")
    hubs = banded.join(company, "node").groupBy("band").agg(central).select("band", (-F.col("central.col2")).alias("hub"))
    banded = settle(banded.join(settle(hubs, "hubs"), "band"), "banded")
    sets = texts.join(banded.select(F.col("node").alias("id")).distinct(), "id", "left_semi").mapInPandas(_sets, "id bigint, n bigint, shingles binary, bits array<bigint>")
    sets = settle(sets, "sets")

    stars = banded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = _confirm(stars, sets).unionByName(same_id)
    roots = settle(components(links), "roots")

    placed = settle(
        banded.join(roots.withColumnRenamed("id", "node"), "node", "left").select("band", "size", "node", "n", F.coalesce("root", "node").alias("root")),
        "placed",
    )
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = settle(placed.join(split, "band", "left_semi"), "open")
    rest = _pairs_of_small(open_.where(F.col("size") <= CROWD)).unionByName(_pairs_of_large(open_.where(F.col("size") > CROWD), sets))
    more = _confirm(rest.distinct().join(stars, ["a", "b"], "left_anti"), sets)
    if not more.isEmpty():
        roots = settle(components(more.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))), "roots")

    roots = roots.select("id", F.col("root").alias("component_id"))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(roots, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _pairs_of_small(open_: DataFrame) -> DataFrame:
    """Pairs of unlinked nodes of a band, sizes permitting; bands here hold few nodes."""
    a = open_.select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    b = open_.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    fits = (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na"))
    return a.join(b, (a["band"] == b["band"]) & fits).select("a", "b").distinct()


def _pairs_of_large(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for crowded bands, where most pairs are alike but not enough.

    Two nodes share at most the bits set in both their bitmaps plus what collides within
    either.  A link needs (100 + p) * shared >= p * (na + nb); pairs whose bound is below
    that are no links.
    """
    words = [f"w{k}" for k in range(MAP_WORDS)]
    ones = lambda cols: reduce(lambda x, y: x + y, map(F.bit_count, cols))
    maps = sets.select(F.col("id").alias("node"), *[F.get("bits", F.lit(k)).alias(w) for k, w in enumerate(words)])
    room = settle(open_.join(maps, "node").withColumn("beyond", F.col("n") - ones([F.col(w) for w in words])), "room")
    a, b = (room.select("band", *[F.col(x).alias(f"{side}_{x}") for x in ("node", "n", "root", "beyond", *words)]) for side in "ab")
    both = ones([F.col(f"a_{w}").bitwiseAND(F.col(f"b_{w}")) for w in words]) + F.least("a_beyond", "b_beyond")
    enough = (100 + PERCENT) * F.least("a_n", "b_n", both) >= PERCENT * (F.col("a_n") + F.col("b_n"))
    fits = (F.col("a_node") > F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & enough
    return a.join(b, (a["band"] == b["band"]) & fits).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class."""
    gone = near_classes(docs, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("id").alias("_llm_id")).distinct()
    return docs.join(settle(gone, "gone"), docs[id_col].cast("bigint") == F.col("_llm_id"), "left_anti")
