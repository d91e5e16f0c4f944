"""Fingerprints by a randomised edit embedding.

A walk reads a text and, at each step, writes the character it stands on; whether it then
moves on is a random bit of the step number and the character, the same for all texts.
Two walks that an edit has put out of step soon meet again, so a small edit distance
becomes a small Hamming distance of what they write.  A fingerprint samples the walk at
random step numbers, at a rate that halves with each doubling of the walk's length: the
samples of a coarser rate are among those of a finer one, so any two can be compared.

Fingerprints of near texts are found by bands of sampled positions and confirmed by their
own likeness; equal fingerprints are one node from the start.  A band links its members to
its smallest node first.  Only bands whose members are still apart are looked into: small
ones pair by pair, crowded ones after they have been cut by bands of further samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_in, id_out, settle, text_of
from .components import components
from .hashing import as_long, mix

SAMPLES = 128  # a fingerprint has this many samples up to twice as many
PERIOD = 1 << 14  # the random bits repeat after so many steps
CLASSES = 256  # characters are told apart by a hash
CHUNK = 1024  # characters of each text that are walked at once
NEAR = 0.75
BAND = 8  # samples of a band
BANDS = 32  # a pair at NEAR meets in one with a probability of 0.966, at 0.8 of 0.997, at 0.85 of 0.99996
#: A band with more nodes that are still apart is cut by bands of further samples, so many times.
CROWD, CUTS, DEEPER = 64, 12, 4


def _bits() -> np.ndarray:
    """Steps until the walk leaves a character, by class and step number (modulo the period)."""
    rng = np.random.default_rng(1207)
    moves = rng.random((CLASSES, PERIOD)) < 0.5
    moves[:, -1] = True
    place = np.where(moves, np.arange(PERIOD), PERIOD)
    following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
    return (following - np.arange(PERIOD) + 1).astype(np.int64).ravel()


def _sampled(steps: int) -> np.ndarray:
    """Rates of the sampling at which each step number is still a sample: trailing zeros of its hash."""
    h = mix(np.arange(steps, dtype=np.uint64) + np.uint64(77))
    low = h & (~h + np.uint64(1))
    return np.log2(low.astype(np.float64)).astype(np.int64)


class Embedder:
    """Walks many texts in step."""

    def __init__(self):
        self.waits = _bits()
        self.grow(1 << 16)

    def grow(self, steps: int) -> None:
        self.depth = _sampled(steps)
        self.samples = [np.flatnonzero(self.depth >= rate) for rate in range(int(self.depth.max()) + 1)]

    def fingerprints(self, texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(rate, step numbers, hashed characters) of each text's samples."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        classes = [(c * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8) for c in codes]
        order = sorted(range(len(texts)), key=lambda k: -len(codes[k]))
        sizes = np.array([len(codes[k]) for k in order], dtype=np.int64)
        steps = np.zeros(len(texts), dtype=np.int64)
        reached: list[list[np.ndarray]] = [[] for _ in texts]
        for start in range(0, int(sizes[0]) if len(sizes) else 0, CHUNK):
            active = int(np.searchsorted(-sizes, -start, side="left"))
            width = int(min(CHUNK, sizes[0] - start))
            block = np.zeros((width, active), dtype=np.int64)
            for column, k in enumerate(order[:active]):
                part = classes[k][start : start + width]
                block[: len(part), column] = part
            block *= PERIOD
            walked = np.empty((width + 1, active), dtype=np.int64)
            walked[0] = steps[:active]
            at = np.empty(active, dtype=np.int64)
            for row in range(width):
                np.bitwise_and(walked[row], PERIOD - 1, out=at)
                at += block[row]
                np.take(self.waits, at, out=at)
                np.add(walked[row], at, out=walked[row + 1])
            steps[:active] = walked[width]
            for column, k in enumerate(order[:active]):
                reached[k].append(walked[1 : 1 + min(width, len(codes[k]) - start), column].copy())
        out = []
        for k, code in enumerate(codes):
            ends = np.concatenate(reached[k]) if reached[k] else np.empty(0, dtype=np.int64)
            total = int(ends[-1]) if len(ends) else 0
            if total > len(self.depth):
                self.grow(1 << (total - 1).bit_length())
            rate = 0
            while total >> rate >= 2 * SAMPLES:
                rate += 1
            when = self.samples[rate]
            when = when[: np.searchsorted(when, total)]
            seen = code[np.searchsorted(ends, when, side="right")] if total else np.empty(0, dtype=np.uint32)
            marks = (mix(seen.astype(np.uint64) ^ (when.astype(np.uint64) << np.uint64(24))) >> np.uint64(60)).astype(np.uint8)
            out.append((rate, when, marks))
        return out

    def likeness(self, a: tuple, b: tuple) -> float:
        """Share of equal samples at the coarser of both rates; 1 for two empty texts."""
        rate = max(a[0], b[0])
        (wa, ma), (wb, mb) = ((w[keep], m[keep]) for _, w, m in (a, b) for keep in [self.depth[w] >= rate])
        n = max(len(wa), len(wb))
        if not n:
            return float(len(a[1]) == len(b[1]) == 0)
        both = min(len(wa), len(wb))
        return float((ma[:both] == mb[:both]).sum() / n)


def as_string(print_: tuple) -> str:
    """Rate and samples as text: equal for equal texts."""
    rate, _, marks = print_
    return f"{rate:x}:" + "".join("0123456789abcdef"[m] for m in marks.tolist())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """docs in ranges of falling id: ``part``, id, text, and whether the row belongs to the range or only follows it.

    Also the range of an id, as a column of ``id``.

    The bounds are quantiles of the ids.  Each range also gets the first row of the next
    one, so that every text meets its successor in one task without an order of the whole
    table; the last range gets the first row of all.
    """
    rows = docs.select(id_in(id_col).alias("id"), text_of(text_col).alias("text"))
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.2 / wanted)))
    edges = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds]).cast("array<bigint>")
    # ranges count down with the id; a range holds its upper bound
    part = F.lit(len(bounds)) - F.size(F.filter(edges, lambda e: e < F.col("id")))
    rows = rows.withColumn("part", part)
    firsts = settle(rows.groupBy("part").agg(F.max("id").alias("id")), "firsts")
    # as many rows as there are ranges
    falling = Window.orderBy("part")
    follow = firsts.select(F.coalesce(F.lag("part").over(falling), F.max("part").over(Window.partitionBy(F.lit(1)))).alias("before"), "id")
    follow = F.broadcast(settle(follow, "follow"))
    extra = rows.drop("part").join(follow, "id").groupBy("before", "id").agg(F.min("text").alias("text"))
    extra = extra.select("id", "text", F.col("before").alias("part"), F.lit(True).alias("follows"))
    return rows.withColumn("follows", F.lit(False)).unionByName(extra), part


ROWS, CHARS = 1500, 6_000_000  # texts are walked together up to these bounds

PRINTS = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id bigint"
_PACKED = "part int, id bigint, sha binary, packed binary, follows boolean, component bigint"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed for the way to their range, with a digest to order equal ids by."""
    press = zstandard.ZstdCompressor(level=1)
    for pdf in batches:
        raws = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        yield pd.DataFrame(
            {"part": pdf["part"], "id": pdf["id"], "sha": [hashlib.sha256(r).digest() for r in raws], "packed": [press.compress(r) for r in raws], "follows": pdf["follows"], "component": pd.Series([None] * len(raws), dtype=object)}
        )


def _pairs_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task, by range and falling id, with fingerprints against the row that follows."""
    embedder = Embedder()
    unpack = zstandard.ZstdDecompressor()
    held: list[tuple] = []
    known: tuple[int, int] = (0, 0)

    def flush(rows: list[tuple]) -> pd.DataFrame:
        prints = embedder.fingerprints([r[2] for r in rows])
        own = [k for k in range(len(rows) - 1) if not rows[k][3]]
        changed = [edited(rows[k][2], rows[k + 1][2]) for k in own]
        after = embedder.fingerprints(changed)
        out = [
            (
                rows[k][1],
                len(rows[k][2]),
                hashlib.sha256(text.encode()).hexdigest(),
                as_string(prints[k]),
                as_string(then),
                embedder.likeness(prints[k], then),
                embedder.likeness(prints[k], prints[k + 1]),
                rows[k][4],
            )
            for k, text, then in zip(own, changed, after)
        ]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PRINTS.split(", ")])

    chars = 0
    for pdf in batches:
        classes = [None if c is None or c != c else int(c) for c in pdf["component"]]
        for part, i, packed, follows, component in zip(pdf["part"].tolist(), pdf["id"].tolist(), pdf["packed"], pdf["follows"].tolist(), classes):
            if component is not None:
                known = (i, component)
                continue
            text = unpack.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""
            held.append((part, i, text, follows, known[1] if known[0] == i else i))
            chars += len(text)
            if len(held) > ROWS or chars > CHARS:
                yield flush(held)
                held, chars = [held[-1]], len(text)
    if held:
        yield flush(held)


def fingerprints_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: its fingerprint, and how near an edited text and the next text are.

    The next text is the one with the next smaller id (after the smallest the largest);
    rows of equal id follow in the order of their digests.  A null text is an empty one, a
    null id comes after all others.  Near values are 0 to 1, and 1 for two empty texts.
    With ``classes`` (id, component_id), as :func:`near_classes` gives them, there is also a
    component_id; a null id has none.  An empty table gives an empty result; other columns
    are ignored.
    """
    shown = [c.split()[0] for c in PRINTS.split(", ")][: None if classes is not None else -1]
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], PRINTS).select(shown).withColumnRenamed("id", id_col)
    rows, part = _ranges(docs, id_col, text_col)
    ranges = rows.select("part", "id", "text", "follows").mapInPandas(_pack, _PACKED)
    if classes is not None:
        # classes of other texts travel along and come before the rows of their ids
        none = F.lit(None).cast("binary")
        ranges = ranges.unionByName(classes.where("component_id <> id").select(part.alias("part"), "id", none.alias("sha"), none.alias("packed"), F.lit(False).alias("follows"), F.col("component_id").alias("component")))
    ranges = ranges.repartition("part").sortWithinPartitions("part", "follows", F.desc("id"), F.desc_nulls_last("component"), "sha")
    out = ranges.select("part", "id", "packed", "follows", "component").mapInPandas(_pairs_in_order, PRINTS).select(shown)
    if classes is not None:
        out = out.withColumn("component_id", F.when(id_out("id").isNotNull(), F.col("component_id")))
    return out.withColumn("id", id_out("id")).withColumnRenamed("id", id_col)


# --- near texts -------------------------------------------------------------------

NODES = "id bigint, rate int, steps int, marks binary, bands array<bigint>"


class Bander:
    """Keys of bands: samples picked by the hash of their step, at a rate that near texts share."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder
        self.picks: dict[tuple[int, int, int, int], np.ndarray] = {}

    def chosen(self, level: int, count: int, first: int, width: int) -> np.ndarray:
        """Places of the samples of each band among the first ``count`` of a rate: the ``first`` to ``first + width`` by hash."""
        key = (level, count, first, width)
        if key not in self.picks:
            steps = self.embedder.samples[level][:count].astype(np.uint64)
            order = np.argsort(mix(steps[None, :] * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)[:, None]), axis=1, kind="stable")
            self.picks[key] = np.sort(order[:, first : first + width], axis=1)
        return self.picks[key]

    def levels(self, rate: int, total: int) -> list[int]:
        """The next coarser rate, and the own one of a text that is short for its rate: one of the two is that of any near text."""
        return [rate + 1] if rate and total >> rate >= 1.4 * SAMPLES else [rate, rate + 1]

    def keys(self, rate: int, when: np.ndarray, marks: np.ndarray, first: int = 0, width: int = BAND) -> list[tuple[int, np.ndarray]]:
        """(rate, a key for each band) at the rates where near texts meet."""
        out = []
        for level in self.levels(rate, int(when[-1]) + 1 if len(when) else 0):
            keep = self.embedder.depth[when] >= level
            steps, seen = when[keep].astype(np.uint64), marks[keep].astype(np.uint64)
            if len(steps) <= first:
                continue
            at = self.chosen(level, len(steps), first, width)
            out.append((level, mix(mix(steps[at] * np.uint64(16) + seen[at]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) + np.uint64(level * BANDS))))
        return out


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    embedder = Embedder()
    bander = Bander(embedder)
    for pdf in batches:
        found = embedder.fingerprints(list(pdf["text"]))
        bands = [np.concatenate([as_long(k) for _, k in bander.keys(*p)] or [np.empty(0, dtype=np.int64)]) for p in found]
        yield pd.DataFrame({"id": pdf["id"], "rate": [p[0] for p in found], "steps": [len(p[1]) for p in found], "marks": [np.packbits(np.unpackbits(p[2][:, None], axis=1)[:, 4:]).tobytes() for p in found], "bands": bands})


def _unpacked(embedder: Embedder, rate: int, count: int, marks: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """A fingerprint from what a node keeps of it."""
    while len(embedder.samples) <= rate or len(embedder.samples[rate]) < count:
        embedder.grow(2 * len(embedder.depth))
    nibbles = np.unpackbits(np.frombuffer(marks, dtype=np.uint8)).reshape(-1, 4)[:count]
    return rate, embedder.samples[rate][:count], np.packbits(np.pad(nibbles, ((0, 0), (4, 0))), axis=1)[:, 0]


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    embedder = Embedder()
    for pdf in batches:
        keep = []
        for ra, sa, ma, rb, sb, mb in zip(pdf["ra"], pdf["sa"], pdf["ma"], pdf["rb"], pdf["sb"], pdf["mb"]):
            keep.append(embedder.likeness(_unpacked(embedder, ra, sa, ma), _unpacked(embedder, rb, sb, mb)) >= NEAR)
        yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]] if len(pdf) else pdf[["a", "b"]]


def _further(depth: int):
    """Finer bands of the nodes of crowded ones: each of ``CUTS`` adds further samples to the band's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = Embedder()
        bander = Bander(embedder)
        for pdf in batches:
            bands, nodes, roots = [], [], []
            for band, node, root, rate, count, marks in zip(pdf["band"].tolist(), pdf["node"].tolist(), pdf["root"].tolist(), pdf["rate"], pdf["steps"], pdf["marks"]):
                cuts = bander.keys(*_unpacked(embedder, rate, count, marks), BAND + (depth - 1) * DEEPER, DEEPER)
                keys = np.concatenate([k[:CUTS] for _, k in cuts] or [np.zeros(1, dtype=np.uint64)])
                bands.append(mix(keys + np.array(band, dtype=np.int64).view(np.uint64)))
                nodes.append(np.full(len(keys), node))
                roots.append(np.full(len(keys), root))
            if bands:
                yield pd.DataFrame({"band": as_long(np.concatenate(bands)), "node": np.concatenate(nodes), "root": np.concatenate(roots)})

    return run


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``(id, component_id)``: classes of texts whose fingerprints are alike by ``NEAR``, found by bands.

    component_id is the smallest id that links lead to, the text's own included.

    * Empty and null texts have no fingerprint to compare: each is its own class.
    * Null ids take no part and are not returned.
    * Rows with equal id are one row; they share the links of all their texts.
    * Texts that share no band are not compared, see ``BANDS``.  Members of a band of more
      than ``crowd`` nodes that are still apart must also share one of ``CUTS`` finer bands,
      which a pair at ``NEAR`` does with a probability of 0.99 for each band that it shares.
    * An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).where("id IS NOT NULL")
    prints = settle(texts.where("text <> ''").mapInPandas(_prints, NODES), "prints")
    look = ["rate", "steps", "marks"]
    nodes = settle(prints.groupBy(*look).agg(F.min("id").alias("node"), F.min("bands").alias("bands")), "nodes")
    same = prints.join(nodes.select(*look, "node"), look).where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub")
    banded = settle(banded.join(settle(hubs, "hubs"), "band"), "banded")
    looks = settle(nodes.join(banded.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max(F.struct(*look)).alias("p")).select("node", "p.*"), "looks")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: looks.select(F.col("node").alias(x), F.col("rate").alias(f"r{x}"), F.col("steps").alias(f"s{x}"), F.col("marks").alias(f"m{x}"))
        both = settle(pairs, "pairs").join(side("a"), "a").join(side("b"), "b")
        return settle(both.mapInPandas(_near, "a bigint, b bigint"), "links")

    links = confirmed(banded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()).unionByName(same)
    roots = settle(components(links), "roots")
    open_ = banded.select("band", "node").join(roots.withColumnRenamed("id", "node"), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    pairs = []
    for depth in range(1, 4):
        open_ = settle(open_, "open")
        sizes = open_.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n")
        sizes = settle(sizes, "sizes")
        pairs.append(_apart(open_.join(sizes.where(F.col("n") <= crowd), "band")))
        crowded = open_.join(sizes.where(F.col("n") > crowd).select("band"), "band", "left_semi")
        if crowded.isEmpty():
            break
        open_ = crowded.join(looks, "node").mapInPandas(_further(depth), "band bigint, node bigint, root bigint").distinct()
    else:
        # texts alike in all these samples, and yet apart: pair by pair
        pairs.append(_apart(open_))
    rest = pairs[0]
    for more in pairs[1:]:
        rest = rest.unionByName(more)
    more = confirmed(rest.distinct())
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    return texts.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component_id"))


def _apart(open_: DataFrame) -> DataFrame:
    """Pairs of nodes of a band that no links join yet."""
    a, b = (open_.select("band", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return a.join(b, (a["band"] == b["band"]) & (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b"))).select("a", "b").distinct()
