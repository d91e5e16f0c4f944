"""Removal of byte strings that occur twice, by prefix doubling of ranks.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes.  The
rank of a position tells the bytes that start there, the first ``QUARTER`` of a half to
begin with; a position's rank and the rank one length further on make the pair that is its
rank of the double length.  Each round brings equal ranks together in Spark, and positions
whose rank is unique are done: 25, 50 and 100 bytes, and then the pairs of 100 bytes that
make up ``LENGTH``.  Ranks are 64-bit fingerprints.

Not every position takes part, which would be many times the input.  Each window of
``LENGTH`` bytes points to one anchor in its first half, the position with the least rank
of the first round, so that equal windows point to equal anchors, and the bytes up to a
half behind an anchor lie within the window.  An anchor whose rank is unique at any length
ends all windows that point to it.  Anchors whose whole surroundings, the windows that point
to them, occur twice need no last round either.  For the rest each window gets its pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_in, id_out, settle, text_of
from .hashing import Spans, as_long, mix

HALF = 100
LENGTH = 2 * HALF
QUARTER = HALF // 4  # bytes of the first round
#: Anchors of one rank with more different surroundings than this are compared row by row in Spark.
CROWD = 20_000

_LOW = np.uint64(0xFFFFFFFF)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of so many neighbours."""
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Text:
    """One text with its anchors: where they are, and the first and last window that points to each."""

    def __init__(self, raw: bytes):
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.windows = max(0, len(self.data) - LENGTH + 1)
        if not self.windows:
            self.anchor = self.first = self.last = np.empty(0, dtype=np.int64)
            self.rank = np.empty(0, dtype=np.uint64)
            return
        self.spans = Spans(self.data)
        at = np.arange(len(self.data) - HALF + 1)
        ranks = self.spans.hash(at, at + QUARTER)
        least = _least(ranks & ~_LOW | at.astype(np.uint64), LENGTH - HALF + 1)
        points = (least & _LOW).astype(np.int64)
        change = np.flatnonzero(points[1:] != points[:-1]) + 1
        self.first = np.concatenate([[0], change])
        self.last = np.concatenate([change - 1, [self.windows - 1]])
        self.anchor = points[self.first]
        self.rank = ranks[self.anchor]

    def ranks_at(self, offset: int, size: int) -> np.ndarray:
        """Ranks of so many bytes, so far behind the anchors."""
        return self.spans.hash(self.anchor + offset, self.anchor + offset + size) if self.windows else self.rank

    def around(self) -> np.ndarray:
        """Hash of all bytes of the windows of each anchor, and of where it lies in them."""
        return mix(self.spans.hash(self.first, self.last + LENGTH) + (self.anchor - self.first).astype(np.uint64))


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [_Text(t.encode()) for t in pdf["text"]]
        sizes = [len(t.anchor) for t in texts]
        yield pd.DataFrame(
            {
                "id": np.repeat(pdf["id"].to_numpy(), sizes),
                "version": np.repeat(pdf["version"].to_numpy(), sizes),
                "place": np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, dtype=np.int64)]).astype(np.int32),
                "rank": _column([t.rank for t in texts]),
                "then_25": _column([t.ranks_at(QUARTER, QUARTER) for t in texts]),
                "then_50": _column([t.ranks_at(2 * QUARTER, 2 * QUARTER) for t in texts]),
            }
        )


def _column(parts: list[np.ndarray]) -> np.ndarray:
    return as_long(np.concatenate(parts or [np.empty(0, dtype=np.uint64)]))


def _doubled(rows: DataFrame, following: str) -> DataFrame:
    """A round: positions whose rank occurs twice, each with its rank paired with the one that follows."""
    return settle(_repeated(rows).withColumn("rank", F.xxhash64("rank", following)).drop(following), "round")


def _repeated(rows: DataFrame) -> DataFrame:
    twice = rows.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    return rows.join(settle(twice, "twice"), "rank", "left_semi")


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, v, text, places in zip(pdf["id"].tolist(), pdf["version"].tolist(), pdf["text"], pdf["places"]):
            t, k = _Text(text.encode()), np.unique(places)
            rows.append((np.full(len(k), i), np.full(len(k), v), k, as_long(t.ranks_at(0, HALF)[k]), as_long(t.around()[k])))
        if rows:
            yield pd.DataFrame({c: np.concatenate([r[j] for r in rows]) for j, c in enumerate(("id", "version", "place", "rank", "around"))})


ASK, FULL = 1, 2  # states of an anchor, added to four times its place


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes around the anchors that need the second round."""
    for pdf in batches:
        rows = []
        for i, v, text, states in zip(pdf["id"].tolist(), pdf["version"].tolist(), pdf["text"], pdf["states"]):
            states = np.unique(states)
            if not (states & ASK).any():
                continue
            raw = text.encode()
            t = _Text(raw)
            ranks = as_long(t.ranks_at(0, HALF))
            for state in states[states & ASK > 0].tolist():
                k = state >> 2
                a, b = int(t.first[k]), int(t.last[k])
                rows.append((int(ranks[k]), i, v, k, int(t.anchor[k]) - a, bool(state & FULL), raw[a : b + LENGTH]))
        yield pd.DataFrame(rows, columns=["rank", "id", "version", "place", "before", "full", "bytes"])


def _pair_ranks(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank pairs of all windows of the rows, with the number of each one's row; the anchor's place and rank count too."""
    buffer = b"".join(pdf["bytes"])
    sizes = pdf["bytes"].map(len).to_numpy(dtype=np.int64)
    windows = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(pdf)), windows)
    within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(np.cumsum(sizes) - sizes, windows) + within
    spans = Spans(buffer)
    pair = mix(spans.hash(start, start + HALF)) + spans.hash(start + HALF, start + LENGTH)
    left = (pdf["before"].to_numpy()[row] - within).astype(np.int64).view(np.uint64)
    return mix(mix(pair) + left * np.uint64(0x9FB21C651E98DF25) + pdf["rank"].to_numpy().view(np.uint64)[row]), row


def _second_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows that occur twice among the anchors of equal rank; rows come sorted by rank."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal surroundings come once, marked as full
        pdf = pdf.drop_duplicates(["rank", "before", "bytes"]).reset_index(drop=True)
        pair, row = _pair_ranks(pdf)
        full = pdf["full"].to_numpy(dtype=bool)
        _, which = np.unique(pair, return_inverse=True)
        twice = np.bincount(which, weights=1 + full[row])[which] > 1
        cuts = np.split(twice, np.flatnonzero(np.diff(row)) + 1) if len(row) else []
        out = [(pdf["id"][k], pdf["version"][k], pdf["place"][k], np.packbits(cuts[k]).tobytes()) for k in np.flatnonzero(~full) if cuts[k].any()]
        return pd.DataFrame(out, columns=["id", "version", "place", "found"])

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf["rank"].iloc[-1]
        done = pdf[pdf["rank"] != last]
        if len(done):
            yield solve(pd.concat([*held, done], ignore_index=True))
            held = []
        elif held and held[-1]["rank"].iloc[-1] != last:
            yield solve(pd.concat(held, ignore_index=True))
            held = []
        held.append(pdf[pdf["rank"] == last])
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        pair, row = _pair_ranks(pdf.reset_index(drop=True))
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        offset = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        yield pd.DataFrame({"pair": as_long(pair), "offset": offset.astype(np.int32)} | {c: pdf[c].to_numpy()[row] for c in ("id", "version", "place", "full")})


def _pack_offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for offsets in pdf["offsets"]:
            bits = np.zeros(HALF + 2, dtype=bool)
            bits[offsets] = True
            found.append(np.packbits(bits).tobytes())
        yield pdf[["id", "version", "place"]].assign(found=found)


FOUND = "id bigint, version int, place int, found binary"


def _found_in_crowds(asked: DataFrame) -> DataFrame:
    """The second round as joins, for ranks with very many surroundings."""
    rows = settle(asked.mapInPandas(_window_rows, "pair bigint, offset int, id bigint, version int, place int, full boolean"), "windows")
    twice = rows.groupBy("pair").agg(F.sum(F.when(F.col("full"), 2).otherwise(1)).alias("n")).where("n > 1").select("pair")
    hits = rows.where("NOT full").join(settle(twice, "twice"), "pair", "left_semi")
    return hits.groupBy("id", "version", "place").agg(F.collect_set("offset").alias("offsets")).mapInPandas(_pack_offsets, FOUND)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, v, text, states, found in zip(pdf["id"].tolist(), pdf["version"].tolist(), pdf["text"], pdf["states"], pdf["found"]):
            raw = text.encode()
            t, edge = _Text(raw), np.zeros(len(raw) + 1, dtype=np.int64)
            for state in np.unique(states).tolist():
                if state & FULL:
                    edge[t.first[state >> 2]] += 1
                    edge[t.last[state >> 2] + LENGTH] -= 1
            for one in found if found is not None else []:
                k = one["place"]
                bits = np.unpackbits(np.frombuffer(one["found"], dtype=np.uint8))[: int(t.last[k] - t.first[k]) + 1]
                starts = np.flatnonzero(bits) + int(t.first[k])
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            out.append((i, v, int(gone.sum()), spans, t.data[~gone].tobytes()))
        yield pd.DataFrame(out, columns=["id", "version", "n_removed", "n_spans", "kept"])


def cut_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Texts that lose bytes: ``id`` (as it passes Python), version, n_removed, n_spans, kept (binary)."""
    texts = docs.select(id_in(id_col).alias("id"), F.hash(text_of(text_col)).alias("version"), text_of(text_col).alias("text"))
    anchors = settle(texts.mapInPandas(_anchors, "id bigint, version int, place int, rank bigint, then_25 bigint, then_50 bigint"), "anchors")
    left = _doubled(_doubled(anchors, "then_25"), "then_50")
    mine = _repeated(left).groupBy("id", "version").agg(F.collect_set("place").alias("places"))
    involved = settle(texts.join(settle(mine, "mine"), ["id", "version"]), "involved")

    around = settle(involved.mapInPandas(_surroundings, "id bigint, version int, place int, rank bigint, around bigint"), "around")
    kinds = settle(around.groupBy("rank", "around").agg(F.count("*").alias("n"), F.min("id").alias("teller")), "kinds")
    ranks = kinds.groupBy("rank").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    kinds = settle(kinds.join(settle(ranks, "ranks"), "rank"), "kinds")
    state = F.when(F.col("n") > 1, FULL).otherwise(0) + F.when((F.col("least") == 1) & (F.col("kinds") > 1) & (F.col("id") == F.col("teller")), ASK).otherwise(0)
    states = around.join(kinds, ["rank", "around"]).select("id", "version", (F.col("place") * 4 + state).alias("state")).where(F.pmod("state", F.lit(4)) > 0)
    states = settle(states.groupBy("id", "version").agg(F.collect_set("state").alias("states")), "states")

    known = settle(involved.drop("places").join(states, ["id", "version"]), "known")
    asked = known.mapInPandas(_asked, "rank bigint, id bigint, version int, place int, before int, full boolean, bytes binary")
    asked = settle(asked, "asked")
    crowded = settle(asked.groupBy("rank").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("rank"), "crowded")
    few = asked.join(crowded, "rank", "left_anti").repartition("rank").sortWithinPartitions("rank").mapInPandas(_second_round, FOUND)
    found = settle(few.unionByName(_found_in_crowds(asked.join(crowded, "rank", "left_semi"))), "found")
    found = found.groupBy("id", "version").agg(F.collect_set(F.struct("place", "found")).alias("found"))
    cut = known.join(settle(found, "found"), ["id", "version"], "left").mapInPandas(_remove, "id bigint, version int, n_removed bigint, n_spans bigint, kept binary")
    return cut.where("n_removed > 0")


def substring_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts count as UTF-8; null is empty.  Texts shorter than ``LENGTH`` bytes keep all, and
    matches do not reach over texts.
    Repeated rows are occurrences of each other, so all of them lose what they share.  An
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        id_in(id_col).alias("id"),
        F.hash(text_of(text_col)).alias("version"),
        F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"),
        F.sha2(text_of(text_col), 256).alias("whole"),
    )
    cut = cut_texts(docs, id_col=id_col, text_col=text_col, crowd=crowd).select("id", "version", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).distinct()
    out = rows.join(settle(cut, "cut"), ["id", "version"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(id_out("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
