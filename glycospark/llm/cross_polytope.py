"""Near duplicates of embeddings by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard transform and
takes the axis it comes nearest to.  A table joins several hashes into one bucket.  A
vector enters its own bucket of each table and those that it misses most narrowly
(multiprobe); vectors that share any bucket are candidates, and all candidates are
verified by their cosine in double precision.

Equal vectors are one node with a count.  Only buckets with company are compared.  A
bucket is cut into blocks of bounded size and each pair of blocks is a small matrix
product in one task, whatever the bucket holds.  No pairs leave a task: a node's links are
counted in the least bucket that both ends share, and what a task hands on is counts and
one edge a node to the least node of its component there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .components import components
from .hashing import as_long, mix

COSINE = 0.93
#: Buckets that a vector enters in each table.
PROBES = 6
#: Tables for three hashes each.  A further hash makes a pair meet less often in a table,
#: which so many times more tables make up for: at 64 dimensions a pair at the threshold
#: stays unseen with a probability of 2e-5.
TABLES, MORE_TABLES = 8, 1.75
LEAST_HASHES = 3
#: Buckets of a table for each node of the largest label, so that random vectors rarely meet.
SPARSE = 8
#: Nodes of a bucket that are compared at a time.
BLOCK = 256
#: Axes that multiprobe weighs for each hash.
_NEAREST = 4


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """Rows under the pseudo-random rotation number ``which``; columns must be a power of two.

    Sums are taken element by element in a fixed order, so that every executor and batch
    agrees on every bit.
    """
    size = x.shape[1]
    signs = np.random.default_rng([20_241, which, size]).integers(0, 2, (3, size)) * 2.0 - 1.0
    for row in signs:
        x = x * row
        step = 1
        while step < size:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
    return x


def tables(hashes: int) -> int:
    return round(TABLES * MORE_TABLES ** (hashes - LEAST_HASHES))


def hashes_for(nodes: int, size: int) -> int:
    """Hashes of a table for vectors of ``size`` entries, ``nodes`` of them under one label."""
    hashes = LEAST_HASHES
    while (2 * _padded(size)) ** hashes < SPARSE * nodes:
        hashes += 1
    return hashes


def _padded(size: int) -> int:
    """Entries after filling up with zeros: a power of two, and enough for signs to make many rotations."""
    return max(64, 1 << (size - 1).bit_length())


def buckets(x: np.ndarray, base: np.ndarray, hashes: int) -> np.ndarray:
    """Buckets of each row, ``PROBES`` for each table; ``base`` is what else must be equal.

    The probes of a table are the combinations of near axes that lose least against the
    nearest ones, each axis by the square of what it falls short.
    """
    size = _padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    # combinations of one axis for each hash, at most two of them not the nearest
    combos = np.array([c for c in itertools.product(range(_NEAREST), repeat=hashes) if sum(k > 0 for k in c) <= 2])
    n = tables(hashes)
    seeds = _seeds(n * hashes)
    rows = np.arange(len(x))[:, None]
    out = np.empty((len(x), n, PROBES), dtype=np.uint64)
    for t in range(n):
        lost = np.zeros((len(x), len(combos)))
        axes = []
        for k in range(hashes):
            y = rotated(x, t * hashes + k)
            y = np.concatenate([y, -y], axis=1)
            order = _top(y, _NEAREST)
            top = np.take_along_axis(y, order, axis=1)
            lost += np.square(top[:, :1] - top)[:, combos[:, k]]
            axes.append(mix(order.astype(np.uint64) + seeds[t * hashes + k]))
        best = np.argsort(lost, axis=1, kind="stable")[:, :PROBES]
        key = base[:, None] + seeds[t * hashes]
        for k in range(hashes):
            key = mix(key + axes[k][rows, combos[best, k]])
        out[:, t] = key
    return out


def _top(y: np.ndarray, near: int) -> np.ndarray:
    """Places of the ``near`` greatest entries of each row, falling; ties by place."""
    y = y.copy()
    rows = np.arange(len(y))
    places = []
    for _ in range(near):
        best = y.argmax(axis=1)
        places.append(best)
        y[rows, best] = -np.inf
    return np.stack(places, axis=1)


def _enter(hashes: int):
    """Buckets of nodes, as a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch)
            found = np.zeros((batch.num_rows, tables(hashes) * PROBES), dtype=np.int64)
            for at in rows.by_length():
                found[at] = as_long(buckets(rows.unit(at), rows.base[at].view(np.uint64), hashes).reshape(len(at), -1))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "fp": batch.column("fp"), "buckets": _lists(found)})

    return run


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)[: len(matrix) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


class _Rows:
    """Vectors of a batch; rows of one length form a matrix."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        vectors = batch.column("vector")
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        self.offsets = vectors.offsets.to_numpy()
        self.flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        self.base = batch.column("base").to_numpy() if "base" in batch.schema.names else None

    def by_length(self) -> list[np.ndarray]:
        lengths = np.diff(self.offsets)
        return [np.flatnonzero(lengths == k) for k in np.unique(lengths)]

    def unit(self, at: np.ndarray) -> np.ndarray:
        """Rows of one length, each over its norm; scaled first, so that no square overflows."""
        size = self.offsets[at[0] + 1] - self.offsets[at[0]]
        x = self.flat[self.offsets[at][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come in order of ``cols``, and the bounds of the groups."""
    rest, waiting, rows = None, [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < 4096:
                continue
        if not rows:
            continue
        table = pa.Table.from_batches(waiting)
        key = np.column_stack([table.column(c).to_numpy() for c in cols])
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if batch is None:
            yield table, np.concatenate([[0], cuts, [len(key)]])
            return
        if len(cuts):  # the last group may go on
            yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            rest = table.slice(cuts[-1])
            waiting = pa.Table.from_batches(rest.combine_chunks().to_batches()).to_batches()
            rows = rest.num_rows


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows: a block with itself, or one block with another."""
    for table, bounds in _groups(batches, ["bucket", "lo", "hi"]):
        rows = _Rows(table)
        unit = rows.unit(np.arange(table.num_rows)) if len(rows.by_length()) == 1 else None
        bucket, lo, hi, own, node, fp, weight = (table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "own", "node", "fp", "w"))
        shared = table.column("shared").combine_chunks()
        shared = (shared.chunk(0) if isinstance(shared, pa.ChunkedArray) else shared).flatten().to_numpy().reshape(table.num_rows, -1, PROBES)
        out: list[tuple[np.ndarray, ...]] = []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if last - first < 2:
                continue
            x = unit[first:last] if unit is not None else rows.unit(np.arange(first, last))  # a bucket's vectors are of one length
            if lo[first] == hi[first]:
                a, b = np.nonzero(np.triu(x @ x.T >= COSINE, 1))
            else:
                left = int(np.searchsorted(own[first:last], hi[first]))  # rows come by block
                a, b = np.nonzero(x[:left] @ x[left:].T >= COSINE)
                b = b + left
            if len(a):
                new = _least_common(shared[first:last], a, b, bucket[first])
                a, b = a[new], b[new]
            if len(a):
                out.append(_linked(a, b, node[first:last], fp[first:last], weight[first:last]))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("node", "fp", "links", "root"), (np.concatenate(c) for c in zip(*out)))))


def _least_common(shared: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs share no lesser bucket; 0 stands for a bucket without company."""
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 2048):
        x, y = shared[a[k : k + 2048]], shared[b[k : k + 2048]]
        same = (x[:, :, :, None] == y[:, :, None, :]) & ((x != 0) & (x < bucket))[:, :, :, None]
        out[k : k + 2048] = ~same.any(axis=(1, 2, 3))
    return out


def _linked(a: np.ndarray, b: np.ndarray, node: np.ndarray, fp: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes with links: how many rows they are linked with, and the least node of their component."""
    links = np.zeros(len(node), dtype=np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    root = node.copy()
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (root == before).all():
            break
    some = links > 0
    return node[some], fp[some], links[some], root[some]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: ``id``, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and their cosine is ``COSINE`` or
    more.  n_links counts the other rows linked with this one; component_id is the smallest
    id that links lead to, the row's own included, and kept marks the row that has this id.

    * Vectors that are null, empty or zero, or hold null or non-finite entries, and rows
      without a label link with nothing.  Vectors of different length are not compared.
    * Equal vectors of one label are linked and count as a row each.
    * Rows with equal id and different vectors share their component, and are kept or not together.
    * A null id takes no part: no links, null class, kept.
    * An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    takes = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)
    # 0.0 and -0.0 are one number
    whole = rows.where(takes).withColumn("vector", F.transform(v, lambda c: c + F.lit(0).cast("float")))
    whole = settle(whole.withColumn("fp", F.xxhash64("label", "vector")), "whole")
    nodes = settle(whole.groupBy("fp", "label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("w")).withColumn("base", F.xxhash64("label", F.size("vector"))), "nodes")

    most = nodes.groupBy("base").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).agg(F.max(F.struct("n", "size")).alias("top")).first()["top"]
    hashes = hashes_for(most["n"], most["size"]) if most else LEAST_HASHES
    entered = settle(nodes.select("node", "fp", "base", "vector").mapInArrow(_enter(hashes), "node bigint, fp bigint, buckets array<bigint>"), "entered")
    entries = entered.select("node", "fp", F.posexplode("buckets").alias("slot", "bucket"))
    company = settle(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "company")
    placed = entries.join(company, "bucket").groupBy("node", "fp").agg(F.collect_list(F.struct("slot", "bucket", "size")).alias("places"))  # no more than slots
    slots = F.transform(F.sequence(F.lit(0), F.lit(tables(hashes) * PROBES - 1)), lambda k: F.coalesce(F.map_from_entries(F.transform("places", lambda p: F.struct(p["slot"], p["bucket"])))[k], F.lit(0)))
    placed = settle(placed.withColumn("shared", slots).join(nodes.select("node", "fp", "w", "vector"), ["node", "fp"]), "placed")

    spread = placed.select("node", "fp", "w", "vector", "shared", F.explode(F.array_distinct(F.transform("places", lambda p: F.struct(p["bucket"], p["size"])))).alias("p"))
    blocks = F.ceil(F.col("p.size") / BLOCK).cast("int")
    spread = spread.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node", "fp"), blocks).cast("int")})
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(F.col("p.bucket").alias("bucket"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "fp", "w", "shared", "vector")
    found = spread.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own")
    found = settle(found.mapInArrow(_compare, "node bigint, fp bigint, links bigint, root bigint"), "found")

    links = found.groupBy("node", "fp").agg(F.sum("links").alias("links"))
    classes = nodes.join(links, ["node", "fp"], "left").select("fp", "label", "vector", "node", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    linked = settle(whole.join(classes, ["fp", "label", "vector"]).select("id", "fp", "node", "n_links"), "linked")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked.select(F.col("id").alias("a"), F.col("node").alias("b")))
    roots = components(edges).select("id", F.col("root").alias("component_id"))
    alone = rows.where(~F.coalesce(takes, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"))
    out = linked.select("id", "n_links").unionByName(alone).join(roots, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
