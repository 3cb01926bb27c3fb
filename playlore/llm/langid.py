"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of different runs of one to ``ORDER`` characters that
both contain (a blended-spectrum presence kernel), divided by the root of the product of the
same number for each text with itself.  Landmarks are a few texts of every language; a text
is represented by its kernel values against them, whitened by the landmarks' own kernel
matrix (the Nystroem map).  Kernel ridge regression of one language against the rest is then
a linear ridge regression in that space.

A text shares with a landmark only runs that some landmark has, so its kernel values are the
product of its presence row over the landmarks' runs with their presence matrix.  Scoring
multiplies batches of presence rows by that matrix and by the whitened dual weights; as the
product of the two matrices doesn't depend on the text, it is formed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .quality import held_out

ORDER = 3
#: Runs are sorted in stretches of this many characters, so only their codes grow with a text.
STRETCH = 1 << 20
UNKNOWN = "und"
#: Languages that one model can learn.
LANGUAGES = 1000


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_IS_LETTER = _letters()


def has_letter(text: object) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def runs(text: str) -> np.ndarray:
    """The distinct runs of one to three characters of a text, each as a 64-bit number.

    Letters are lower-cased, and every stretch of other characters counts as one space.
    A character takes 21 bits, so the numbers stand for the runs without collisions.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _IS_LETTER[code]
    stays = letter.copy()
    stays[0] = True
    stays[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[stays]
    found = []
    for start in range(0, len(code), STRETCH):
        part = code[max(0, start - ORDER + 1) : start + STRETCH].astype(np.int64)
        key = part
        found.append(_distinct(key))
        for n in range(1, ORDER):
            if len(part) > n:
                key = (key[:-1] << 21) | part[n:]
                found.append(_distinct(key))
    merged = np.concatenate(found)
    return _distinct(merged) if len(code) > STRETCH else merged


def _shared(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``vocabulary`` of those keys that it has."""
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, keys)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == keys]


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: np.ndarray  # runs of the landmarks, sorted
    weights: np.ndarray  # (runs, languages): presence matrix times whitened dual weights

    def scores(self, texts: list[str], batch: int = 64) -> np.ndarray:
        """(texts, languages): values of the one-versus-rest regressions."""
        out = np.zeros((len(texts), len(self.languages)))
        for start in range(0, len(texts), batch):
            part = texts[start : start + batch]
            presence = np.zeros((len(part), len(self.vocabulary)), np.float32)
            norms = np.empty(len(part))
            for i, text in enumerate(part):
                keys = runs(text)
                norms[i] = np.sqrt(len(keys))
                presence[i, _shared(keys, self.vocabulary)] = 1
            out[start : start + batch] = (presence @ self.weights) / norms[:, None]
        return out


def train(examples: list[tuple[np.ndarray, str]], *, landmarks: int = 40, ridge: float = 0.1) -> LanguageModel:
    """Fit on (runs, language) pairs; the first ``landmarks`` of each language are landmarks."""
    languages = sorted({language for _, language in examples})
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    left = dict.fromkeys(languages, landmarks)
    chosen = []
    for keys, language in examples:
        if left[language] > 0:
            left[language] -= 1
            chosen.append(keys)
    vocabulary = np.unique(np.concatenate(chosen))

    def presence(rows: list[np.ndarray]) -> np.ndarray:
        made = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, keys in enumerate(rows):
            made[i, _shared(keys, vocabulary)] = 1 / np.sqrt(max(len(keys), 1))
        return made

    base = presence(chosen)
    value, vector = np.linalg.eigh((base @ base.T).astype(float))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    space = np.concatenate([presence([k for k, _ in examples[i : i + 256]]) @ base.T for i in range(0, len(examples), 256)]) @ whiten
    # One language against the rest, each side with half of the weight.
    marked = np.array([[language == other for other in languages] for _, language in examples])
    dual = np.zeros((space.shape[1], len(languages)))
    for j in range(len(languages)):
        yes = marked[:, j]
        cost = np.where(yes, 0.5 / max(yes.sum(), 1), 0.5 / max((~yes).sum(), 1)) * len(examples)
        weighted = space * cost[:, None]
        dual[:, j] = np.linalg.solve(space.T @ weighted + ridge * np.eye(space.shape[1]), weighted.T @ np.where(yes, 1.0, -1.0))
    return LanguageModel(languages, vocabulary, (base.T.astype(float) @ (whiten @ dual)).astype(np.float32))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 250, landmarks: int = 40, ridge: float = 0.1, seed: int = 11) -> LanguageModel:
    """Train on rows that aren't held out, ``rows_per_language`` of each language in expectation.

    Rows are drawn by a hash of id and seed at a rate for each language, counted over all
    rows.  Their distinct runs, not their texts, reach the driver.
    """
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, 3, 1)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counted) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not counted:
        return train([])
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counted.items()) for x in (lang, min(1.0, rows_per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000.0
    drawn = known.filter(draw < rate[F.col("lang")])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[np.array([has_letter(t) for t in batch["text"]], bool)]
            yield pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "keys": [runs(t).tobytes() for t in batch["text"]]})

    got = drawn.mapInPandas(extract, "id long, lang string, keys binary").toPandas().sort_values(["id", "lang"], kind="stable")
    return train([(np.frombuffer(k, np.int64), lang) for k, lang in zip(got["keys"], got["lang"], strict=True)], landmarks=landmarks, ridge=ridge)


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score in a struct column ``language``, which replaces one of that name.

    Of languages with equal scores the first by name is predicted.
    ``und`` with score 0 stands where the text is null or has no letter, and where the model
    has learnt no language.  The score is the softmax of the regressions at the language.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x runs of the landmarks: a few megabytes

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            plain = [t if has_letter(t) else "" for t in texts]
            asked = [i for i, t in enumerate(plain) if t] if own.languages else []
            names, scores = [UNKNOWN] * len(plain), np.zeros(len(plain))
            if asked:
                raw = own.scores([plain[i] for i in asked])
                soft = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                best = soft.argmax(axis=1)
                for i, j, s in zip(asked, best, soft.max(axis=1), strict=True):
                    names[i], scores[i] = own.languages[j], s
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("language", language(F.col(text_col)))


def languages(docs: DataFrame, *, rows_per_language: int = 250, landmarks: int = 40) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document.

    Held out are ids whose CRC-32 as text leaves 1 modulo 3; the others, where they have a
    language, are learnt from.  Only the text enters a prediction.  Rows that repeat are
    predicted each; a null or letterless text, and an empty model, give ``und`` and 0.
    """
    model = fit(docs, rows_per_language=rows_per_language, landmarks=landmarks)
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
