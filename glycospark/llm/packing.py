"""Best-fit packing of token sequences by matching the large ones first.

Only lengths decide a packing, and there are at most ``capacity`` of them.  So the bins
are planned on the histogram of lengths: pieces above a third of the capacity, of which a
bin takes two at most, are matched greedily; smaller ones go, by falling length, to the
fullest bin that still takes them.  The plan says for each run of ranks within a length
where it goes; Spark ranks the pieces within their length and looks that up.  The plan
does not grow with the corpus.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_in, id_out, settle

CAPACITY = 2048
END = 0  # the id that closes each document
#: Pieces of one length are ranked in groups of about so many.
GROUP = 500

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=4)
def _encoder(ranks: str, tokenizer: str, pattern: str):
    """A function from text to ids.

    The ids are those of the tokenizer file; the rank file holds the same vocabulary for a
    faster library.  Only texts that spell out a special token need the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    full = Tokenizer.from_file(tokenizer)
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as ids and ``END``, cut into pieces of ``capacity``; only the first one may be shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(*files)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"].tolist(), pdf["text"]):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id_in(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(cut, PIECES).withColumn("doc_id", id_out("doc_id"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, per bin, first bin, offset), sorted.

    The pieces of a length from its first rank on fill bins from the first bin on, so many
    per bin, from the offset on.
    """
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first bin, bins)
    rows, bins = [], 0

    def put(size: int, per_bin: int, n: int, first: int, room: int) -> None:
        """n bins from ``first`` with ``room`` left take ``per_bin`` pieces each."""
        rows.append((size, used[size], per_bin, first, capacity - room))
        used[size] += n * per_bin
        left[size] -= n * per_bin
        if room > per_bin * size:
            gaps.setdefault(room - per_bin * size, []).append((first, n))

    third = capacity // 3
    for size in sorted((s for s in left if s > third), reverse=True):
        while left[size]:
            most = size if left[size] > 1 else size - 1  # a last piece has no partner of its own length
            other = next((t for t in range(min(most, capacity - size), third, -1) if left.get(t)), None)
            if other == size:
                n = left[size] // 2
                put(size, 2, n, bins, capacity)
            elif other is None:
                n = left[size]
                put(size, 1, n, bins, capacity)
            else:
                n = min(left[size], left[other])
                put(size, 1, n, bins, capacity)
                gaps[capacity - size].pop()  # just added: these bins get the partner at once
                if not gaps[capacity - size]:
                    del gaps[capacity - size]
                put(other, 1, n, bins, capacity - size)
            bins += n
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            room = min((g for g in gaps if g >= size), default=None)
            if room is None:
                room, first = capacity, bins
                most = max(1, left[size] // (capacity // size))
                bins += most
            else:
                first, most = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
            per_bin = room // size
            full = min(most, left[size] // per_bin)
            if full:
                put(size, per_bin, full, first, room)
            if full < most and left[size]:
                put(size, left[size], 1, first + full, room)
                full += 1
            if full < most:
                gaps.setdefault(room, []).append((first + full, most - full))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence, no sequence above capacity."""
    cut = settle(cut, "pieces")
    lengths = settle(cut.groupBy("length").agg(F.count("*").alias("_count")), "lengths")  # at most ``capacity`` rows
    layout = plan({r[0]: r[1] for r in lengths.collect()}, capacity)
    # a length is ranked in groups, as many as it has pieces for; their sizes are summed up within the length
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.floor(F.col("_count") / GROUP) + 1)
    salted = cut.join(F.broadcast(lengths), "length").withColumn("_salt", salt).drop("_count")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = settle(salted.withColumn("_rank", F.row_number().over(order) - 1), "ranked")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    offsets = settle(sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = layout[:, 0] << 44 | layout[:, 1]
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            _, first, per_bin, bin_, offset = layout[np.searchsorted(starts, size << 44 | rank, side="right") - 1].T
            out = pdf[columns].copy()
            out["sequence_id"] = bin_ + (rank - first) // per_bin
            out["offset"] = offset + (rank - first) % per_bin * size
            yield out

    ranked = ranked.withColumn("doc_id", id_in("doc_id")).select(*columns, "_rank")
    return ranked.mapInPandas(place, f"{PIECES}, sequence_id bigint, offset bigint").withColumn("doc_id", id_out("doc_id"))


def pack_texts(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack the texts of docs: one row per piece.

    A null or empty text is the closing id alone.  Repeated rows and null ids are packed
    like others; an empty table gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, files, capacity, id_col=id_col, text_col=text_col), capacity)
