"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word is a run of letters and digits, or a run of one sort of other characters, so that
``word$$$`` is two words.  The features of a text are the hashed one- and two-word runs with
their counts, scaled to length one; all upper-case words also count under one feature, and
words that repeat the one before them under another: these are the two classes of n-grams
that single n-grams can't tell of words not seen in training.  The model is one vector of weights, and a score is the
logistic function of the sparse dot product of that vector with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches

BITS = 18
BIAS = 1 << BITS

_CLASSES = np.full(256, 4, np.uint8)
_CLASSES[list(b" \t\n\r\x0b\x0c")] = 0
_CLASSES[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASSES[list(b".,;:'\"?-()")] = 2
_CLASSES[list(b"!")] = 3
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SHOUTED, _REPEATED = W.U64(0x5851F42D4C957F2D), W.U64(0xB7E151628AED2A6B)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text, without repeats, and their values."""
    data = W.utf8(text)
    starts, ends, hashes = W.words(W.LOWER[data], _CLASSES)
    if not len(hashes):
        return np.array([BIAS]), np.ones(1)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    repeated = int((hashes[1:] == hashes[:-1]).sum())
    grams = np.concatenate((hashes, W.shingles(hashes, 2) if len(hashes) > 1 else hashes[:0], np.full(int(shouted.sum()), _SHOUTED), np.full(repeated, _REPEATED)))
    numbers, counts = np.unique((grams >> W.U64(64 - BITS)).astype(np.int64), return_counts=True)
    values = counts / np.sqrt(float((counts.astype(float) ** 2).sum()))
    return np.append(numbers, BIAS), np.append(values, 1.0)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, passes: int = 6, positive_share: float = 0.7, seed: int = 7) -> np.ndarray:
    """Weights by FTRL-proximal updates, one example at a time.

    A coordinate keeps z and n, the sums of its adjusted and of its squared gradients; its
    weight is 0 while |z| <= l1, else (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2).
    Examples of label 1 together carry ``positive_share`` of the weight, so that a text with
    no evidence either way leans to label 1.
    """
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(n[at])) / alpha + l2))

    share = sum(y for *_, y in examples) / max(len(examples), 1)
    cost = {1: positive_share / max(share, 1e-9), 0: (1 - positive_share) / max(1 - share, 1e-9)}
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(examples)):
            at, values, label = examples[k]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values * min(cost[label], 20.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, seed: int = 7) -> np.ndarray:
    """Train on a sample of the labelled documents whose expected size ``max_rows`` bounds.

    Only labels 0 and 1 of ids that are not held out are drawn, by a hash of the id, each
    label at a rate of its own so that either can make up half the sample.  The drawn labels
    are few whatever the size of the tables, so they are broadcast to the documents.  Counts
    of features, not texts, reach the driver.  An id that has both labels, or several texts,
    is an example of each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    counted = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return np.zeros(BIAS + 1)
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000.0
    rate = F.create_map(*[F.lit(x) for label, n in counted.items() for x in (label, min(1.0, 0.475 * max_rows / n))])
    drawn = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(marks.filter(draw < rate[F.col("label")])), "id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "at": [a.astype(np.int32).tobytes() for a, _ in made], "value": [v.astype(np.float32).tobytes() for _, v in made]})

    got = sorted(drawn.mapInPandas(extract, "id long, label int, at binary, value binary").collect(), key=lambda r: (r["id"], r["label"]))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), r["label"]) for r in got], seed=seed)


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no features but the bias, and get its score.  All columns
    stay; a column that is already called ``score_col`` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # (2**BITS + 1) floats: one megabyte

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in texts:
            made = [features(t) for t in batch]
            margins = np.array([float(w[at] @ values) for at, values in made])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(margins, -35, 35))))

    return docs.withColumn(score_col, scored(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels are learnt only from rows that are not held out (CRC-32 of the id modulo 5 is
    not 0); nothing but the text enters a score.  Without any labelled row all scores are
    0.5.  Repeated rows are scored each, null texts as empty ones.
    """
    weights = fit(docs, labels, max_rows=max_rows)
    return score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), weights).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their columns."""
    return score(docs, fit(docs, labels, max_rows=max_rows), score_col="__score").filter(F.col("__score") >= threshold).select(*docs.columns)
