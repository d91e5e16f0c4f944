"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; where its high bits are zero a chunk may end.
The cut depends on the last 32 bytes alone, so an insertion moves the chunks behind it
without changing them.  Chunks with equal digests are repeats; a run of repeated chunks
counts from ``RUN`` bytes on, which keeps chance repeats of single chunks out, or if it is
a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_in, id_out, settle, text_of
from .hashing import mix

LEAST, MOST = 16, 96  # bytes of a chunk; the last of a text may be shorter
BITS = 4  # a cut is allowed at one of 2**BITS places
RUN = 100

_GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a UTF-8 text; no character is cut."""
    if not len(data):
        return []
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted gears
        longer = rolled.copy()
        longer[shift:] += rolled[:-shift] << np.uint32(shift)
        rolled = longer
    whole = np.ones(len(data) + 1, dtype=bool)
    whole[:-1] = data & 0xC0 != 0x80
    allowed = np.flatnonzero((rolled >> np.uint32(32 - BITS) == 0) & whole[1:]) + 1
    ends, last, n = [], 0, len(data)
    for p in [*allowed.tolist(), n]:
        while p - last > MOST:
            last += MOST
            while not whole[last]:
                last -= 1
            ends.append(last)
        if p - last >= LEAST and p < n:
            ends.append(p)
            last = p
    if last < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, versions, starts, sizes, digests, lasts = [], [], [], [], [], []
        for i, v, text in zip(pdf["id"].tolist(), pdf["version"].tolist(), pdf["text"]):
            raw = text.encode()
            ends = cuts(np.frombuffer(raw, dtype=np.uint8))
            begins = [0, *ends[:-1]]
            ids.append(np.full(len(ends), i))
            versions.append(np.full(len(ends), v))
            starts += begins[: len(ends)]
            sizes += [b - a for a, b in zip(begins, ends)]
            lasts += [b == len(raw) for b in ends]
            digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins, ends)]
        yield pd.DataFrame(
            {
                "id": np.concatenate(ids).astype(np.int64) if ids else [],
                "version": np.concatenate(versions).astype(np.int32) if ids else [],
                "start": np.array(starts, dtype=np.int32),
                "size": np.array(sizes, dtype=np.int32),
                "digest": np.array(digests, dtype=np.uint64).view(np.int64),
                "last": np.array(lasts, dtype=bool),
            }
        )


SPANS = "array<struct<start:int,end:int,again:boolean>>"


def _runs(found: pd.Series) -> pd.Series:
    """Runs of adjoining repeated chunks, long ones and whole texts, split where a first copy meets a repeat."""
    out = []
    for chunks in found:
        rows = sorted((c["start"], c["size"], c["digest"], c["again"], c["last"]) for c in chunks)
        seen, runs, run, whole = set(), [], [], False
        for start, size, digest, again, last in [*rows, (-1, 0, 0, False, False)]:
            if run and (start < 0 or run[-1][1] != start):
                if run[-1][1] - run[0][0] >= RUN or run[0][0] == 0 and whole:
                    runs += run
                run = []
            run.append((start, start + size, again or digest in seen))
            seen.add(digest)
            whole = last
        joined = []
        for start, end, again in runs:
            if joined and joined[-1][1] == start and joined[-1][2] == again:
                joined[-1] = (joined[-1][0], end, again)
            else:
                joined.append((start, end, again))
        out.append([{"start": a, "end": b, "again": x} for a, b, x in joined])
    return pd.Series(out)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text with a repeated passage: ``id``, ``version`` (a hash of the text), runs (start, end, again) in bytes.

    ``again`` is false for the copy that stays: the one in the smallest id, and there the first.
    """
    texts = docs.select(id_in(id_col).alias("id"), F.hash(text_of(text_col)).alias("version"), text_of(text_col).alias("text"))
    chunks = settle(texts.mapInPandas(_chunks, "id bigint, version int, start int, size int, digest bigint, last boolean"), "chunks")
    twice = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("digest", "first")
    found = chunks.join(settle(twice, "twice"), "digest").withColumn("again", F.col("id") != F.col("first"))
    found = found.groupBy("id", "version").agg(F.collect_set(F.struct("start", "size", "digest", "again", "last")).alias("found"))
    return found.select("id", "version", pandas_udf(_runs, SPANS)("found").alias("runs")).where(F.size("runs") > 0)


def passage_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_shared, n_removed, n_spans, spans.

    n_shared counts the bytes in repeated runs, n_removed those of them that another copy
    stands for; spans lists the latter as start:end.  A null text is empty; empty texts have
    no runs, texts shorter than ``RUN`` only if the whole text is repeated.  Rows with equal id and text are one text and keep their first copy
    alike; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(id_in(id_col).alias("id"), F.hash(text_of(text_col)).alias("version"), F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"))
    out = rows.join(settle(repeats(docs, id_col=id_col, text_col=text_col), "runs"), ["id", "version"], "left")
    runs = F.coalesce("runs", F.array().cast(SPANS))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, r: acc + r["end"] - r["start"])
    out = out.withColumn("runs", runs).withColumn("gone", F.filter("runs", lambda r: r["again"]))
    spans = F.concat_ws(",", F.transform("gone", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))))
    return out.select(id_out("id").alias(id_col), "n_bytes", total("runs").alias("n_shared"), total("gone").alias("n_removed"), F.size("gone").cast("bigint").alias("n_spans"), spans.alias("spans"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, the repeats cut out of their texts."""

    @pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, gone):
            raw, at, kept = text.encode(), 0, []
            for s in spans:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out)

    keyed = docs.withColumns({"_llm_id": id_in(id_col), "_llm_version": F.hash(text_of(text_col))})
    gone = settle(repeats(docs, id_col=id_col, text_col=text_col), "runs").select(F.col("id").alias("_llm_id"), F.col("version").alias("_llm_version"), F.filter("runs", lambda r: r["again"]).alias("_llm_gone"))
    out = keyed.join(gone, ["_llm_id", "_llm_version"], "left")
    changed = F.when(F.size("_llm_gone") > 0, cut(text_of(text_col), F.coalesce("_llm_gone", F.array().cast(SPANS)))).otherwise(F.col(text_col))
    return out.withColumn(text_col, changed).select(*docs.columns)
