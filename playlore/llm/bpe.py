"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge can only ever produce a vocabulary token, so two neighbouring bytes that stand side
by side in no token of the vocabulary are never merged across: between them a cut is
certain.  The pairs that do occur in tokens are read once from the vocabulary, as a table of
256 x 256 bits.  A text is cut in three steps that don't change its encoding:

1. at added tokens, which the library takes out before anything else;
2. by the vocabulary's own pattern into pieces, which are merged independently;
3. inside each piece wherever two bytes are forced apart, into fragments.

Fragments are encoded independently and their ids are concatenated.  A fragment is what the
library's model merges; the pieces' ids are remembered for the most recent pieces of the
task, in a bounded memory, since most words recur.  However long a run without white space
is, only its fragments reach the merge loop.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import bounded_batches

#: The pattern that splits text before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids one task remembers, and the longest piece that is remembered.
REMEMBERED, LONGEST = 500_000, 64
# Tasks are what runs in parallel here; threads of the library's own in each of them only
# wait for one another.
os.environ["TOKENIZERS_PARALLELISM"] = "false"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the
    characters from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


class _Counts(dict):
    """piece -> its number of tokens; a piece that isn't known counts 0 and is noted."""

    def __init__(self) -> None:
        self.noted: list[str | int] = []

    def __missing__(self, piece: str | int) -> int:
        self.noted.append(piece)
        return 0

    def met(self) -> list[str | int]:
        """The unknown pieces met since this was last asked, as often as they were met."""
        noted, self.noted = self.noted, []
        return noted


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        # Characters of the texts that are encoded together; a longer text is encoded by itself.
        self.together = 2 * remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.character = byte_characters()
        value = {c: b for b, c in enumerate(self.character)}
        self.token_bytes: dict[int, bytes] = {}
        joined = np.zeros((256, 256), bool)
        for token, number in spec["model"]["vocab"].items():
            raw = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
            self.token_bytes[number] = raw
            pair = np.frombuffer(raw, np.uint8)
            joined[pair[:-1], pair[1:]] = True
        self.forced = ~joined
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {number: content.encode() for content, number in self.added.items()}
        self.merger = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
        self.pieces = regex.compile(PATTERN)
        self.cut_added = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.character)})
        self.known: dict[str | int, bytes] = {}
        self.counts = _Counts()

    def fragments(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Pieces cut wherever two bytes are forced apart, and each piece's number of fragments."""
        raw = b"".join(pieces)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.forced[data[:-1], data[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        edges = [0, *at.tolist()]
        counts = np.diff(np.concatenate(([0], np.searchsorted(at, ends, side="right"))))
        return [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], counts

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of pieces: all their fragments, encoded in one call and joined again."""
        parts, counts = self.fragments([p.encode("utf-8") for p in pieces])
        distinct = list(dict.fromkeys(parts))
        encoded = self.merger.encode_batch_fast([d.decode("latin-1").translate(self.table) for d in distinct], add_special_tokens=False)
        packed = {d: array("I", e.ids).tobytes() for d, e in zip(distinct, encoded, strict=True)}
        made, at = {}, 0
        for piece, count in zip(pieces, counts.tolist(), strict=True):
            made[piece] = packed[parts[at]] if count == 1 else b"".join([packed[x] for x in parts[at : at + count]])
            at += count
        return made

    def _split(self, text: str) -> list[str | int]:
        """Pieces of a text in order; an added token is its id."""
        if self.cut_added is None or not any(c in text for c in self.added):
            return self.pieces.findall(text)
        out: list[str | int] = []
        for part in self.cut_added.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self.pieces.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= self.together):
                size += len(texts[stop])
                stop += 1
            out += self._encode_together(texts[start:stop])
            start = stop
        return out

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        """Encode a few texts: what their pieces lack in the memory is learnt in one call."""
        known = self.known
        split = [self._split(text) for text in texts]
        fresh = set().union(*(set(pieces).difference(known) for pieces in split))
        known |= {p: p.to_bytes(4, "little") for p in fresh if isinstance(p, int)}
        known |= self._learn([p for p in fresh if isinstance(p, str)])
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if len(known) > self.remembered:
            known.clear()
        for p in fresh:
            if isinstance(p, str) and len(p) > LONGEST:
                known.pop(p, None)
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """How many tokens each text has; only numbers are remembered of the pieces."""
        out: list[int] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= self.together):
                size += len(texts[stop])
                stop += 1
            out += self._count_together(texts[start:stop])
            start = stop
        return out

    def _count_together(self, texts: list[str]) -> list[int]:
        """Counts of a few texts: known pieces are added at once, the others are noted, learnt and added then."""
        counts, totals, missing = self.counts, [], []
        for text in texts:
            totals.append(sum(map(counts.__getitem__, self._split(text))))
            missing.append(counts.met())
        fresh = list(dict.fromkeys(p for m in missing for p in m))
        if not fresh:
            return totals
        made = {p: 1 for p in fresh if isinstance(p, int)}
        pieces = [p for p in fresh if isinstance(p, str)]
        if pieces:
            parts, cut = self.fragments([p.encode("utf-8") for p in pieces])
            distinct = list(dict.fromkeys(parts))
            encoded = self.merger.encode_batch_fast([d.decode("latin-1").translate(self.table) for d in distinct], add_special_tokens=False)
            tokens = dict(zip(distinct, map(len, encoded), strict=True))
            sums = np.add.reduceat(np.fromiter(map(tokens.__getitem__, parts), np.int64, len(parts)), np.cumsum(cut) - cut)
            made |= dict(zip(pieces, sums.tolist(), strict=True))
        if len(counts) + len(made) > self.remembered:
            counts.clear()
        counts.update((p, c) for p, c in made.items() if isinstance(p, int) or len(p) <= LONGEST)
        return [total + sum(map(made.__getitem__, m)) for total, m in zip(totals, missing, strict=True)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[tuple[str, int], ForcedBoundaryBPE] = {}


def coder(path: str, remembered: int = REMEMBERED) -> ForcedBoundaryBPE:
    """The coder of a vocabulary file, made once in each Python process."""
    if (path, remembered) not in _coders:
        _coders[path, remembered] = ForcedBoundaryBPE(path, remembered)
    return _coders[path, remembered]


def clean(text: object) -> str:
    return text if isinstance(text, str) else ""


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "token_ids", remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with the ids of the whole text; null texts count as empty and have none.

    ``vocabulary`` is a path that every executor can open.  A column that is already called
    ``ids_col`` is replaced.  With fewer pieces ``remembered`` a task takes less memory and more time.
    """
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary, remembered)
        for batch in texts:
            yield pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids in own.encode_batch([clean(t) for t in batch])])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def count(text_col: str, vocabulary: str) -> Column:
    """Number of tokens of the whole text of a column; null texts have none."""

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary)
        for batch in texts:
            yield pd.Series(own.count_batch([clean(t) for t in batch]), dtype="int64")

    return tokens(F.col(text_col))


def decode(docs: DataFrame, vocabulary: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null ids give the empty text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary)
        for batch in lists:
            yield pd.Series([own.decode([] if x is None else list(x)) for x in batch])

    return docs.withColumn(text_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoded text, for every row.

    The ids are decoded from the array that was encoded, in the same task, so that neither
    ids nor texts travel.  A null or empty text has no tokens and decodes to the empty text.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(vocabulary)
        for batch in batches:
            rows = []
            for packed in own.encode_batch([clean(t) for t in batch["text"]]):
                ids = np.frombuffer(packed, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **{c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(both, schema)
