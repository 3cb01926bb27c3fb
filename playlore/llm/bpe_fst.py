"""Byte-level BPE by a finite-state transducer that is determinised as it is used.

A byte-pair encoder merges the pair of least rank, leftmost first.  So a row of tokens is the
encoding of its bytes exactly if each pair of neighbours, merged by itself, stays these two
tokens: a merge across a boundary depends on nothing but the two tokens beside it.  Every
prefix of a piece therefore has one encoding, and its last token is the one that may follow
the encoding of what stands before it.

The transducer without determinism guesses boundaries: a hypothesis is a row of complete
tokens and a node of the vocabulary's trie, inside the next token.  A byte moves every
hypothesis down the trie; those without a child die; the one whose node is a token that may
follow is complete and starts at the root again.  A state of the deterministic transducer is
the set of hypotheses that are alive, less the tokens at which they all begin: these are
emitted with the byte.  No hypothesis reaches back further than the longest token, which
bounds the lookahead.  States and their transitions are made when a text first needs them,
and are forgotten when there are too many.

Decoding streams: tokens drive a state machine over UTF-8, whose state is the unfinished
character, so text comes out after each token, and only whole characters.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: States and pieces that one Python process remembers, and the longest piece remembered.
STATES, REMEMBERED, LONGEST = 400_000, 500_000, 64
#: Pieces of one text that are held at once.
TOGETHER = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The bytes and ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """The encoder of a vocabulary of ranks, one piece of text at a time."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.raw = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner = {0}
        self.runs: dict[int, tuple] = {}
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                edge = node << 8 | byte
                self.inner.add(node)
                node = self.child.get(edge, 0)
                if not node:
                    node = self.child[edge] = nodes
                    nodes += 1
            self.token[node] = rank
        self.forget()

    def forget(self) -> None:
        """Start with no states but the first.

        A state is a number; what it stands for is the last token that is certain (-1: none)
        and its hypotheses, each of complete tokens that are not yet certain and a node of the
        trie.  The hypothesis at the root has nothing unfinished and comes last.
        """
        self.meaning: list[tuple[int, tuple]] = []
        self.number: dict[tuple[int, tuple], int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.state(-1, (((), 0),))

    def state(self, before: int, alive: tuple) -> int:
        key = before, alive
        made = self.number.setdefault(key, len(self.meaning))
        if made == len(self.meaning):
            self.meaning.append(key)
        return made

    def run(self, token: int) -> tuple[list[float], list[bytes], list[bytes]] | None:
        """How the merges build a token: the rank of each, and its first and last part before each and at the end.

        None if they make more than one token of its bytes.
        """
        if token not in self.runs:
            raw, ranks, never = self.raw[token], self.ranks, float("inf")
            parts = [raw[i : i + 1] for i in range(len(raw))]
            pairs = [ranks.get(raw[i : i + 2], never) for i in range(len(raw) - 1)]
            order, first, last = [], [parts[0]], [parts[-1]]
            while pairs and (least := min(pairs)) < never:
                at = pairs.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = ranks.get(parts[at] + parts[at + 1], never)
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
                order.append(least)
                first.append(parts[0])
                last.append(parts[-1])
            self.runs[token] = ([*order, never], first, last) if len(parts) == 1 else None
        return self.runs[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` after ``before`` (-1: after nothing) is what the merges make of both.

        The merges inside the two go by rank, those on the left first among equals, unless
        one across the boundary comes before them.
        """
        right = self.run(token)
        if right is None or before < 0:
            return right is not None
        known = self.follows.get((before, token))
        if known is None:
            (ranks, _, edges), (others, starts, _), never = self.run(before), right, float("inf")
            i = j = 0
            known = True
            while known and (i < len(ranks) - 1 or j < len(others) - 1 or i + j == len(ranks) + len(others) - 2):
                across = self.ranks.get(edges[i] + starts[j], never)
                known = not (across < ranks[i] and across <= others[j])
                if ranks[i] == others[j] == never:
                    break
                if ranks[i] <= others[j]:
                    i += 1
                else:
                    j += 1
            self.follows[before, token] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens on which all its hypotheses agree."""
        before, alive = self.meaning[state]
        child, inner, after, whole = self.child, self.inner, [], None
        for tokens, node in alive:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if whole is None and (token := self.token.get(node, -1)) >= 0 and self.may_follow(tokens[-1] if tokens else before, token):
                whole = (*tokens, token), 0
            if node in inner:
                after.append((tokens, node))
        if whole is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        after.append(whole)
        first, agreed = after[0][0], 0
        if first:
            agreed = min(len(tokens) for tokens, _ in after)
            while agreed and any(tokens[:agreed] != first[:agreed] for tokens, _ in after):
                agreed -= 1
        if agreed:
            before, after = first[agreed - 1], [(tokens[agreed:], node) for tokens, node in after]
        if all(tokens for tokens, _ in after):
            before = -1  # no hypothesis stands directly behind it
        made = self.moves[state << 8 | byte] = self.state(before, tuple(after)), first[:agreed]
        return made

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes in chunks, each as soon as it is certain."""
        state = 0
        for chunk in chunks:
            for byte in chunk:
                state, emitted = self.moves.get(state << 8 | byte) or self.step(state, byte)
                yield from emitted
                state = self.trimmed(state)
        yield from self.meaning[state][1][-1][0]

    def trimmed(self, state: int) -> int:
        """The state, after all states are forgotten if they are too many."""
        if len(self.meaning) <= self.most:
            return state
        meaning = self.meaning[state]
        self.forget()
        return self.state(*meaning)

    def encode(self, piece: bytes) -> array:
        """The tokens of one piece."""
        ids = array("I")
        state = 0
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.step(state, byte)
                if len(self.meaning) > self.most:
                    move = self.trimmed(move[0]), move[1]
                    moves = self.moves
            state, emitted = move
            if emitted:
                ids.extend(emitted)
        ids.extend(self.meaning[state][1][-1][0])
        return ids


class _Pieces(dict):
    """piece -> its packed ids, by the transducer; the pieces met last are remembered."""

    def __init__(self, transducer: Transducer, most: int):
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8")).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """The characters that one more byte completes after the unfinished ``held``, and what is unfinished then.

    A sequence that can't become a character is one replacement character as soon as that is
    known, and the byte which showed it is read afresh.
    """
    if held:
        lead = held[0]
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if len(held) == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if len(held) == 1 else 0xBF
        if not low <= byte <= high:
            text, rest = utf8_step(b"", byte)
            return "�" + text, rest
        held += bytes([byte])
        need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return (held.decode("utf-8"), b"") if len(held) == need else ("", held)
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")


class _Reading(dict):
    """token -> (text, next state) after one unfinished character; made when first asked for."""

    __slots__ = ("owner", "held")

    def __init__(self, owner: StreamDecoder, held: bytes):
        self.owner, self.held = owner, held

    def __missing__(self, token: int) -> tuple[str, _Reading]:
        text, held = "", self.held
        for byte in self.owner.raw[token]:
            more, held = utf8_step(held, byte)
            text += more
        made = self[token] = text, self.owner.reading(held)
        return made


class StreamDecoder:
    """Tokens to text, in whole characters, token by token."""

    def __init__(self, raw: dict[int, bytes]):
        self.raw = raw
        self.readings: dict[bytes, _Reading] = {}
        self.state = self.reading(b"")

    def reading(self, held: bytes) -> _Reading:
        if held not in self.readings:
            self.readings[held] = _Reading(self, held)
        return self.readings[held]

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that these tokens complete."""
        state, out = self.state, []
        for token in ids:
            text, state = state[token]
            out.append(text)
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """What is left of an unfinished character: one replacement character or nothing."""
        left, self.state = self.state.held, self.reading(b"")
        return "�" if left else ""


class Coder:
    """Texts to packed ids and back, for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str, states: int = STATES, remembered: int = REMEMBERED):
        self.transducer = Transducer(read_ranks(path), states)
        self.pieces = _Pieces(self.transducer, remembered)
        self.pattern = regex.compile(pattern)
        self.decoder = StreamDecoder(self.transducer.raw)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in stretches of bounded length."""
        if len(text) <= TOGETHER:
            yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, TOGETHER)):
            yield b"".join(map(self.pieces.__getitem__, some))

    def decode(self, stretches: Iterable[bytes]) -> Iterator[str]:
        """The text of packed ids; bytes that aren't UTF-8 become replacement characters."""
        for packed in stretches:
            yield self.decoder.feed(np.frombuffer(packed, "<u4").tolist())
        yield self.decoder.finish()


_coders: dict[tuple, Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of a vocabulary file, made once in each Python process."""
    if (path, pattern) not in _coders:
        # States are many and live long, so searching them for garbage finds nothing.
        gc.set_threshold(200_000, 50, 100)
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _clean(text: object) -> str:
    return text if isinstance(text, str) else ""


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of the whole text; null and empty texts have none.

    ``vocabulary`` is a path that every executor can open; each match of ``pattern`` is encoded
    by itself.  A column that is already called ``ids_col`` is replaced; rows that repeat are
    encoded each; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary, pattern)
        for batch in texts:
            yield pd.Series([np.frombuffer(b"".join(own.encode(_clean(t))), "<u4").astype(np.int32) for t in batch])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(docs: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null ids give the empty text."""
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)

    @F.pandas_udf("string")
    def text(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(vocabulary, pattern)
        for batch in lists:
            yield pd.Series(["".join(own.decode([np.asarray([] if x is None else x, "<u4").tobytes()])) for x in batch])

    return docs.withColumn(text_col, text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to, for every row.

    Ids are decoded in the task that encoded them, so neither they nor texts travel; a long
    text is encoded, hashed and decoded in stretches.  A null or empty text has no tokens and
    decodes to nothing; rows without an id, and rows that repeat, are answered each.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(vocabulary, pattern)

        def answer(text: str) -> tuple[int, str, str]:
            ids, decoded = hashlib.sha256(), hashlib.sha256()
            tokens = 0

            def told() -> Iterator[bytes]:
                nonlocal tokens
                for packed in own.encode(text):
                    ids.update(packed)
                    tokens += len(packed) // 4
                    yield packed

            for part in own.decode(told()):
                decoded.update(part.encode("utf-8"))
            return tokens, ids.hexdigest(), decoded.hexdigest()

        for batch in batches:
            rows = [answer(_clean(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    # Ids go as digits: a nullable long would pass through pandas as a float.
    told = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(both, schema)
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))
