"""Quality classifier: averaged vectors of hashed words and character n-grams under a softmax.

A text is the mean of the learned vectors of its words, word pairs and subwords, each
hashed to one of ``BUCKETS`` rows.  Subwords are the 3- and 4-grams of a word's characters,
the bounds of the word included, so none reaches over white space or cuts a character.  Vectors and softmax weights are trained
together by stochastic gradient descent in numpy, in one task over a bounded sample of
labelled texts.  As nothing stands between the mean and the softmax, scoring needs only
the difference of the two logits per bucket: a table of ``BUCKETS`` floats, which is all
that reaches the driver and the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import settle
from .hashing import Spans, mix

BUCKETS = 1 << 16
WIDTH = 12
EPOCHS = 10
RATE = 0.5
#: The classifier learns from at most so many labelled texts, the first by a hash of their id.
SAMPLE = 4000


_BOUND = np.uint32(0x110000)  # no code point


def _features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Per text the buckets of its features, in uint16."""
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = list(_subwords(text or ""))
        words = _words(raw)
        if len(words):
            parts.append(mix(words) >> np.uint64(48))
            # equal neighbours all fall into one bucket, so repetition shows whatever the word
            parts.append(mix((words[1:] ^ words[:-1]) + np.uint64(1)) >> np.uint64(48))
        yield np.concatenate(parts).astype(np.uint16) if parts else np.empty(0, dtype=np.uint16)


#: Characters of a text that are cut into subwords at a time; a part ends at white space.
_PART = 1 << 19


def _subwords(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character 3- and 4-grams of ``<word>``, in 16 bits."""
    start = 0
    while len(text) - start > _PART:
        end = max(text.rfind(c, start, start + _PART) for c in " \t\n\v\f\r")
        if end <= start:
            break  # one word as long as a part
        yield from _grams(text[start:end])
        start = end
    yield from _grams(text[start:])


def _grams(text: str) -> Iterator[np.ndarray]:
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    # runs of white space are one bound
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    blank, codes = blank[keep], codes[keep]
    codes = np.where(blank, _BOUND, codes) * np.uint32(0x9E3779B1)
    if len(codes) < 3:
        return
    inner = ~blank[1:-1]
    three = ((codes[:-2] * np.uint32(31) + codes[1:-1]) * np.uint32(0x85EBCA77)) ^ (codes[2:] >> np.uint32(3))
    three *= np.uint32(0xC2B2AE3D)
    yield three[inner] >> np.uint32(16)
    if len(codes) > 3:
        four = (three[:-1] ^ (codes[3:] >> np.uint32(5))) * np.uint32(0x27D4EB2F)
        yield four[inner[:-1] & inner[1:]] >> np.uint32(16)


def _words(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return Spans(data).hash(edge[::2], edge[1::2]) if len(edge) else np.empty(0, dtype=np.uint64)


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Logit differences per bucket, and the bias as the last number."""
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((2, WIDTH), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, share, label = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            own = vectors[buckets]
            mean = share @ own
            logits = weights @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            step = (rate * error).astype(np.float32)
            back = step @ weights
            weights -= np.outer(step, mean)
            bias -= step
            # the usual gradient divides by the number of features, and would hardly move the vectors of long texts
            vectors[buckets] = own - np.outer(share * np.float32(min(len(share), 1000)), back)
    return np.concatenate([vectors @ (weights[1] - weights[0]), [bias[1] - bias[0]]]).astype(np.float32)


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for pdf in batches:
        for i, label, f in zip(pdf["id"], pdf["label"], _features(list(pdf["text"]))):
            buckets, count = np.unique(f, return_counts=True)
            if len(f):
                rows.append((int(i), int(f.sum(dtype=np.int64)), buckets, (count / len(f)).astype(np.float32), int(label)))
    rows.sort(key=lambda r: r[:2])
    if len({r[4] for r in rows}) == 2:
        yield pd.DataFrame({"model": [_train([r[2:] for r in rows]).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Learn from ``labels`` (id, 0 or 1) of ``docs``; the model is an array of ``BUCKETS`` + 1 floats.

    Takes at most ``sample`` labelled ids.  Null ids, null labels and ids with both labels
    are left out, repeated rows count once or as often as their text does.  Unless both
    labels occur the model is all zeros, and every score 0.5.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    # bounded by ``sample``, so it may be broadcast
    chosen = F.broadcast(settle(known.orderBy(F.xxhash64("id"), "id").limit(sample), "sample"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    found = settle(texts.repartition(1).mapInPandas(_fit, "model binary"), "model").collect()
    return np.frombuffer(found[0]["model"], dtype=np.float32) if found else np.zeros(BUCKETS + 1, dtype=np.float32)


def scorer(model: np.ndarray):
    """A column function: text to the probability of label 1.  A null text scores as an empty one."""
    table, bias = model[:-1], float(model[-1])

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        logits = [bias + (float(table[f].mean()) if len(f) else 0.0) for f in _features(texts)]
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -700, 700))), dtype="float64")

    return score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Labels of held-out ids are never seen.  Null, empty and long texts get a score like any
    other; an empty table gives an empty result; further columns are no input of a score.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    out = docs.select(id_col, held_out(id_col).alias("held_out"), scorer(model)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that score 0.5 or more.

    Null and empty texts score by the bias alone; repeated rows stay or go together; an
    empty table gives an empty result.  Without labels of both kinds all rows stay.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    return docs.where(scorer(model)(F.col(text_col).cast("string")) >= 0.5)
