"""Chunk dedup against a plain recomputation of cuts, runs and spans."""

import collections
import os

import numpy as np
import pytest

from glycospark.llm import chunk_dedup as C
from glycospark.llm.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"


def plain_cuts(raw):
    """Byte by byte: the hash of the last 32 bytes, a bounded chunk, no character cut."""
    gear = [int(g) for g in C._GEAR]
    whole = lambda p: p == len(raw) or raw[p] & 0xC0 != 0x80
    ends, last = [], 0
    for p in range(1, len(raw) + 1):
        rolled = sum(gear[raw[p - 1 - k]] << k for k in range(min(32, p))) % 2**32
        at_end = p == len(raw)
        if not at_end and not (rolled >> (32 - C.BITS) == 0 and whole(p)):
            continue
        while p - last > C.MOST:
            last += C.MOST
            while not whole(last):
                last -= 1
            ends.append(last)
        if at_end:
            if last < p:
                ends.append(p)
        elif p - last >= C.LEAST:
            ends.append(p)
            last = p
    return ends


def plain_report(texts):
    chunks = {}
    owners = collections.defaultdict(list)
    for i, text in texts.items():
        raw = (text or "").encode()
        ends = plain_cuts(raw)
        chunks[i] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)]
        for _, _, piece in chunks[i]:
            owners[piece].append(i)
    out = {}
    for i, own in chunks.items():
        size, seen, runs, run = len((texts[i] or "").encode()), set(), [], []
        for a, b, piece in [*own, (None, None, None)]:
            repeated = a is not None and len(owners[piece]) > 1
            if repeated:
                run.append((a, b, min(owners[piece]) != i or piece in seen))
                seen.add(piece)
            elif run:
                if run[-1][1] - run[0][0] >= C.RUN or run[0][0] == 0 and run[-1][1] == size:
                    runs += run
                run = []
        spans = []
        for a, b, again in runs:
            if again and spans and spans[-1][1] == a:
                spans[-1][1] = b
            elif again:
                spans.append([a, b])
        out[i] = (size, sum(b - a for a, b, _ in runs), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans))
    return out


def report(rows):
    return {r.doc_id: (r.n_bytes, r.n_shared, r.n_removed, r.n_spans, r.spans) for r in rows}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = report(all_queries()[0]["op2_chunk_dedup"](spark, FOLDER).collect())
    want = plain_report(texts)
    assert got == want and sum(w[2] > 0 for w in want.values()) > 10


def test_made_documents(spark):
    """Shared passages at shifting places, repeats within a text, short whole texts, many bytes a character."""
    rng = np.random.default_rng(8)
    words = ["river", "été", "日本", "stone", "and", "naïve", "🙂", "walk", "of", "late"]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared, twice = prose(90), prose(60)
    texts = {k: prose(int(rng.integers(1, 60))) for k in range(20)}
    texts |= {30 + k: prose(k) + " " + shared + " " + prose(5 + k) for k in range(6)}
    texts |= {40: twice + " . " + twice, 41: "tiny", 42: "tiny", 43: None, 44: "", 45: "", 46: "ab" * 400, 47: "ab" * 300}
    got = report(C.passage_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == plain_report(texts)
    assert all(got[30 + k][2] >= 100 for k in range(1, 6)) and got[42][1:4] == (4, 4, 1)


@pytest.mark.parametrize("raw", [b"", b"a", b"a" * 500, "é".encode() * 300, bytes(range(97, 123)) * 30])
def test_cuts(raw):
    assert C.cuts(np.frombuffer(raw, dtype=np.uint8)) == plain_cuts(raw)
