"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text, all hashed into 2 ** BITS places: word 1- and 2-grams of the words as they stand; and 1-, 2- and 3-grams of
word classes, where a class is the word with every run of capitals, of other letters and of digits as one sign, or "=" for a word that
repeats the one before. Unseen words still fall into classes that were seen. Each of the two blocks holds square roots of
relative frequencies, so the length of a text has no weight. A score is the logistic of one sparse dot product.

Training is bounded on purpose: at most `most_labelled` labelled rows, those with the smallest seeded hash of their id, are read by
one task, which sees them in hash order for `epochs` passes with per-coordinate FTRL-proximal steps. Scoring reads every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, hashes_of, mixed

BITS = 18
MOST_LABELLED = 12_000
EPOCHS = 3
THRESHOLD = 0.3
_MASK = np.uint64((1 << BITS) - 1)
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Upper case, lower case (and all beyond ASCII) and digits become one letter each.
_SHAPE = bytes.maketrans(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + bytes(range(48, 58)), b"A" * 26 + b"a" * (26 + 128) + b"0" * 10)
_RUNS = re.compile(rb"([Aa0])\1+")


class _Classes(dict):
    """Hash of a word class, remembered; emptied at `most`."""

    def __init__(self, most: int = 50_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, shape: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[shape] = xxhash.xxh3_64_intdigest(shape + b"\0")
        return value


_SAME = np.uint64(xxhash.xxh3_64_intdigest(b"=\0"))


def _block(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    places = (mixed(np.concatenate(parts)) & _MASK).astype(np.int64)
    found, n = np.unique(places, return_counts=True)
    return found, np.sqrt(n / len(places)).astype(np.float32)


def features(text: str | None, classes: _Classes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; no places for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    w = hashes_of(data.split())
    if not len(w):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    c = np.fromiter(map(classes.__getitem__, _RUNS.sub(rb"\1", data.translate(_SHAPE)).split()), np.uint64, len(w))
    c[1:][w[1:] == w[:-1]] = _SAME
    with np.errstate(over="ignore"):
        a = _block([w, w[:-1] * _P + w[1:]])
        b = _block([c ^ _R, (c[:-1] * _P + c[1:]) ^ _Q, (c[:-2] * _P + c[1:-1]) * _Q + c[2:]])
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


def _ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of 2 ** BITS places and, last, of the constant."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def train(labelled: DataFrame, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Weights from rows (_order long, _text string, _label int), read in that order by one task. No rows: zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, examples = _Classes(), []
        for b in batches:
            for text, y in zip(b["_text"], b["_label"], strict=True):
                i, x = features(text, classes)
                # two blocks may share a place: their values add up
                i, where = np.unique(np.append(i, 1 << BITS), return_inverse=True)
                examples.append((i, np.bincount(where, np.append(x, np.float32(1))), int(y)))
        if examples:
            yield pd.DataFrame({"weights": [_ftrl(examples, epochs, alpha, beta, l1, l2).astype("<f4").tobytes()]})

    rows = labelled.repartition(1).sortWithinPartitions("_order", "_text", "_label").mapInPandas(run, "weights binary").collect()
    return np.frombuffer(rows[0][0], "<f4") if rows else np.zeros((1 << BITS) + 1, np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column | None = None, most: int = MOST_LABELLED, seed: int = 17) -> DataFrame:
    """At most `most` rows (_order, _text, _label). Ids with several labels have the smallest; null ids and labels are left out.

    Repeated rows count once; rows that share an id but not the text are examples of their own, under the same bound.
    """
    ids = labels.select(column(id_col).alias("_id"), column(label_col).cast("int").alias("_label"))
    ids = ids.filter("_id is not null and _label is not null")
    ids = ids if where is None else ids.filter(where)
    ids = ids.groupBy("_id").agg(F.min("_label").alias("_label"))
    ids = ids.withColumn("_order", F.xxhash64(F.lit(seed), "_id")).orderBy("_order", "_id").limit(most)
    ids = F.broadcast(ids)
    rows = docs.select(column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_key"), column(text_col).alias("_text"))
    # the bound holds for rows, not only for ids
    chosen = rows.join(ids, "_id").select("_order", "_id", "_key").distinct().orderBy("_order", "_id", "_key").limit(most).drop("_order")
    texts = rows.join(F.broadcast(chosen), ["_id", "_key"]).groupBy("_id", "_key").agg(F.first("_text").alias("_text"))
    return texts.join(ids, "_id").select("_order", "_text", "_label")


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs and score, 0 to 1, of the whole text. Null and empty texts get the score of the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS + 1 floats, 1 MB
    names = [f"_c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, w = _Classes(), shared.value
        for b in batches:
            out = np.empty(len(b))
            for k, text in enumerate(b["_text"]):
                i, x = features(text, classes)
                out[k] = float(np.sum(w[i] * x, dtype=np.float64)) + float(w[-1])
            yield b[names].assign(score=1 / (1 + np.exp(-np.clip(out, -35, 35))))

    inner = docs.select(*(column(c).alias(n) for c, n in zip(keep, names, strict=True)), column(text_col).alias("_text"))
    schema = ", ".join([*(f"{n} {inner.schema[n].dataType.simpleString()}" for n in names), "score double"])
    return inner.mapInPandas(run, schema).toDF(*keep, "score")


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Trains on labelled rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0) and scores every row of docs.

    An empty label table gives every text 0.5. Scores depend on the text alone, so repeated texts have equal scores. Columns other
    than the named ones aren't read.
    """
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    weights = train(labelled_sample(docs, labels, id_col, text_col, label_col, fold != 0))
    return score(docs, weights, keep, text_col)
