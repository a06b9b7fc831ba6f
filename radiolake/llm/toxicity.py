"""Toxicity by a weighted lexicon, matched after folding look-alikes, normalised by length, with exception phrases.

Lexicon, weights and exceptions are learned from labelled documents. A text is folded: compatibility forms, accents,
look-alike letters and digits or signs that stand for letters become plain letters. One Aho-Corasick automaton finds
all terms and phrases; a term inside an exception phrase doesn't count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, staged
from radiolake.llm.labels import calibrated, fold, probability, sample

FOLDS, HELD_OUT = 5, 0
#: Bounds of what is learned from, and of what is learned.
MOST_DOCUMENTS, MOST_TERMS, MOST_EXCEPTIONS = 20_000, 2_000, 2_000
#: A term's weight is the lower end of its log odds ratio, so many standard errors down; terms below are left out.
ERRORS, LEAST_WEIGHT = 3.0, 0.5
#: An exception phrase has a term, occurs in so many harmless documents, and isn't likelier in toxic ones.
LEAST_HARMLESS = 3
# Look-alike letters (Cyrillic, Greek) and digits or signs, with the letters that they stand for. l, 1, !
# and | fold to i, in texts and in terms alike, as either may be meant. A sign counts as a letter only before one, so
# that one which ends a word or a sentence stays what it is.
LOOKALIKE = {
    "а": "a", "в": "b", "г": "r", "е": "e", "є": "e", "з": "z", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n",
    "р": "p", "ѕ": "s", "с": "c", "т": "t", "у": "y", "х": "x", "ц": "u", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b",
    "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
FOLD = str.maketrans(LOOKALIKE | DIGITS | {chr(mark): None for mark in range(0x300, 0x370)})
SIGN = re.compile(r"[@$!|+](?=\w)")


def folded(text: str) -> str:
    """Words of a text in folded form, joined by single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return " ".join(SIGN.sub(lambda m: SIGNS[m[0]], text.lower().translate(FOLD)).split())


WORD = re.compile(r"\w+")


def _counts(df: DataFrame, phrases: dict[str, float] | None = None) -> DataFrame:
    """Documents by term and label; with ``phrases``, the two-word phrases around its terms instead of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(folded(text))
                if phrases is None:
                    found = set(words)
                else:
                    found = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in phrases or b in phrases}
                terms += found
                toxic += [int(y)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64())], names=["term", "toxic"])

    return df.select("text", "y").mapInArrow(run, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))


def learn(labelled: DataFrame) -> dict:
    """The model from rows of ``text`` and ``y``: terms with weights, exception phrases, slope and intercept.

    Only the strongest terms and phrases come to the driver, at most the documented numbers, and one margin for each
    labelled row. With no labelled rows, or one label alone, scores are that label's smoothed share.
    """
    labelled = staged(labelled)
    size = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, t = float(size["n"]), float(size["t"] or 0)
    toxic, harmless = F.col("t"), F.col("n") - F.col("t")
    odds = F.log((toxic + 0.5) / (t - toxic + 0.5)) - F.log((harmless + 0.5) / (n - t - harmless + 0.5))
    error = F.sqrt(1 / (toxic + 0.5) + 1 / (harmless + 0.5))
    weighed = _counts(labelled).withColumn("weight", odds - ERRORS * error).where(F.col("weight") >= LEAST_WEIGHT)
    weights = {r["term"]: r["weight"] for r in weighed.orderBy(F.desc("weight"), "term").limit(MOST_TERMS).collect()}
    harmless_phrases = _counts(labelled, weights).where((harmless >= LEAST_HARMLESS) & (odds <= 0)) if weights else None
    exceptions = [r["term"] for r in harmless_phrases.orderBy(F.desc(harmless), "term").limit(MOST_EXCEPTIONS).collect()] if weights else []
    model = {"weights": weights, "exceptions": exceptions, "slope": 0.0, "intercept": float(np.log((t + 1) / (n - t + 1)))}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.margin(x) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "y"])

    if weights and 0 < t < n:
        rows = labelled.select("text", "y").mapInArrow(margins, "x double, y double").toPandas()
        model["slope"], model["intercept"] = calibrated(rows["x"].to_numpy(), rows["y"].to_numpy())
    return model


class Lexicon:
    """The automaton of a model's terms and phrases."""

    def __init__(self, model: dict):
        self.automaton = ahocorasick.Automaton()
        for term, weight in [*model["weights"].items(), *[(p, None) for p in model["exceptions"]]]:
            self.automaton.add_word(term, (len(term), weight))
        self.automaton.make_automaton()
        self.empty = not model["weights"]

    def margin(self, text: str) -> float:
        """Weights of the terms that stand as whole words outside exceptions, over a slowly growing function of length."""
        flat = folded(text)
        if self.empty or not flat:
            return 0.0
        terms, excepted = [], []
        for end, (length, weight) in self.automaton.iter(flat):
            start = end - length + 1
            if (start == 0 or not _inside(flat[start - 1])) and (end + 1 == len(flat) or not _inside(flat[end + 1])):
                (excepted if weight is None else terms).append((start, end, weight))
        total, k = 0.0, 0
        excepted.sort()
        reach = -1
        for start, end, weight in sorted(terms):
            while k < len(excepted) and excepted[k][0] <= start:
                reach = max(reach, excepted[k][1])
                k += 1
            total += weight if end > reach else 0.0
        return total / (1 + np.log1p((flat.count(" ") + 1) / 100))


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) for each row of ``docs``, from its text alone.

    Null and empty texts have no terms and score as a text without any; repeated rows score alike; other columns are
    not read; an empty table gives no rows. The model is a few hundred KB at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for batch in batches:
            x = np.array([lexicon.margin(v.as_py() or "") for v in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(x, model["slope"], model["intercept"]))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(sample(docs, labels, "toxic", FOLDS, HELD_OUT, MOST_DOCUMENTS))
    return score(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
