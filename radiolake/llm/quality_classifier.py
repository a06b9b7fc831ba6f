"""Quality classifier: naive Bayes support vectors.

The features are indicators of n-grams over a text's shape: letters become one of two classes (small, capital), digits
and blanks one each, runs of a class one character, signs stay; an n-gram that occurs 2, 4, 8... times has an indicator
for each. Indicators are scaled by the log ratio of their class frequencies (the naive Bayes part), and a linear model
with hinge loss is fitted to the scaled rows by dual coordinate descent. The shapes are the same in every language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, staged
from radiolake.llm.labels import calibrated, fold, probability, sample

FOLDS, HELD_OUT = 3, 1
#: Bound of the labelled documents that the model is fitted to.
MOST_DOCUMENTS = 12_000
#: Longest n-gram, highest doubling that has an indicator, and number of hashed features (two to this power).
LONGEST, DOUBLINGS, BITS = 4, 8, 18
#: Smoothing of the class counts; cost of a margin error; passes over the rows.
ALPHA, COST, PASSES = 1.0, 1.0, 12
#: Characters that are looked at together; a text longer than this is counted piece by piece.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each Latin-1 code point; higher ones count as small letters."""
    table = np.arange(256)
    for code in range(256):
        c = chr(code)
        table[code] = 1 if c.islower() or (c.isalpha() and not c.isupper()) else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else code
    return table.astype(np.uint32)


CLASSES = _classes()


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; an empty text has none."""
    keys, counts = [], []
    for at in range(0, len(text), PIECE):
        # pieces overlap so that n-grams across their border are seen
        codes = np.frombuffer(text[max(0, at - 16) : at + PIECE].encode("utf-32-le"), np.uint32)
        shape = np.where(codes < 256, CLASSES[np.minimum(codes, 255)], 1).astype(np.uint64)
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
        gram = np.zeros(len(shape), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(shape) < n:
                break
            gram = gram[: len(shape) - n + 1] * np.uint64(257) + shape[n - 1 :] + np.uint64(1)
            found, times = np.unique(gram, return_counts=True)
            keys.append(found)
            counts.append(times)
    if not keys:
        return np.zeros(0, np.int32)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    level = np.minimum(np.log2(times).astype(np.int64), DOUBLINGS)
    each = np.repeat(np.arange(len(found)), level + 1)
    rise = np.arange(len(each)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    mixed = (found[each] * np.uint64(16) + rise.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss linear support vector machine over rows of unit length.

    Each step solves one row's dual variable exactly and keeps the weights up to date; rows go in a fixed random order.
    """
    w, a = np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = [np.append(scale[r], 1.0) for r in rows]
    values = [v / np.sqrt(v @ v) for v in values]
    places = [np.append(r, len(scale)) for r in rows]
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            margin = y[i] * (w[places[i]] @ values[i]) - 1
            new = min(max(a[i] - margin, 0.0), COST)
            if new != a[i]:
                w[places[i]] += (new - a[i]) * y[i] * values[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """The model of feature rows and 0/1 labels. With one label alone, scores are its smoothed share."""
    ones = y > 0
    share = (ones.sum() + 1) / (len(y) + 2)
    model = {"weights": np.zeros(1 << BITS), "scale": np.zeros(1 << BITS), "bias": 0.0, "slope": 0.0, "intercept": float(np.log(share / (1 - share)))}
    if not 0 < ones.sum() < len(y):
        return model
    counts = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(c)]), minlength=1 << BITS) + ALPHA for c in (ones, ~ones)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratio[(counts[0] == ALPHA) & (counts[1] == ALPHA)] = 0.0
    w = dual_descent(rows, ratio, np.where(ones, 1.0, -1.0))
    model |= {"weights": w[:-1], "scale": ratio, "bias": float(w[-1])}
    model["slope"], model["intercept"] = calibrated(np.array([margin(r, model) for r in rows]), y)
    return model


def margin(row: np.ndarray, model: dict) -> float:
    values = model["scale"][row]
    return float((values @ model["weights"][row] + model["bias"]) / np.sqrt(values @ values + 1.0))


def learn(labelled: DataFrame) -> dict:
    """The model from at most ``MOST_DOCUMENTS`` rows of ``text`` and ``y``, fitted in one task, which that bounds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["row", "y"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y = [], []
        for batch in batches:
            found += [np.array(x, np.int32) for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        model = fit(found, np.array(y, float)) if found else fit([], np.zeros(0))
        used = np.flatnonzero(model["scale"] != 0).astype(np.int32)
        columns = [used, model["weights"][used], model["scale"][used], np.array([model["bias"], model["slope"], model["intercept"]])]
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["used", "weights", "scale", "rest"])

    gathered = staged(labelled.select("text", "y").mapInArrow(rows, "row array<int>, y double"))
    got = gathered.coalesce(1).mapInArrow(one, "used array<int>, weights array<double>, scale array<double>, rest array<double>").collect()
    model = fit([], np.zeros(0))
    if got:
        used = np.array(got[0]["used"], np.int64)
        model["weights"][used], model["scale"][used] = got[0]["weights"], got[0]["scale"]
        model["bias"], model["slope"], model["intercept"] = got[0]["rest"]
    return model


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) for each row of ``docs``, from its whole text alone.

    Null and empty texts have no indicator and get the score of the bias; repeated rows score alike; other columns are
    not read; an empty table gives no rows. The model, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = np.array([margin(features(v.as_py() or ""), own) for v in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(x, own["slope"], own["intercept"]))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(sample(docs, labels, "quality", FOLDS, HELD_OUT, MOST_DOCUMENTS))
    return score(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
