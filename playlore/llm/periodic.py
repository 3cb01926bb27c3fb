"""Periodic runs of words: stretches that repeat themselves three times or more.

A run of period q that begins at word s and has length L means that the suffixes at s and
s + q agree for exactly L - q words.  The suffixes of a text, in order, have such agreements
between neighbours (LCP).  They are united as in Kruskal's algorithm, by decreasing LCP: a
class holds suffixes that agree for at least the present number of words, with its positions
in order.  When two classes unite, positions become neighbours that weren't before; a pair
of new neighbours at a distance no greater than the LCP repeats, and seeds a run.

* Two new neighbours come from the two classes, so they agree for exactly the present LCP:
  the run ends there, and nothing has to be compared to the right.
* With three repeats or more, the first two positions of a run a period apart are neighbours
  when they meet: a position between them would give the run a smaller period.  For the same
  reason the distance of neighbours is the smallest period.
* So a run is taken from the pair whose preceding words differ, and is found once.

A run of at least ``shortest`` words agrees with itself for at least two thirds of them, so
only positions whose next ``shortest - shortest // 3`` words come again in the text matter:
the others stay classes of one.  Most texts have none of them and end there.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The shortest run, in words, and the least number of repeats.
SHORTEST, REPEATS = 24, 3
#: Positions in one block of an ordered set.
BLOCK = 512


class OrderedSet:
    """Numbers in order, in blocks, so that one more moves no more than a block."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours before and after, -1 if there is none."""
        self.size += 1
        at = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[at]
        place = bisect_left(block, x)
        before = block[place - 1] if place else -1
        after = block[place] if place < len(block) else self.heads[at + 1] if at + 1 < len(self.heads) else -1
        block.insert(place, x)
        if not place:
            self.heads[at] = x
        if len(block) > BLOCK:
            self.blocks.insert(at + 1, block[BLOCK // 2 :])
            self.heads.insert(at + 1, block[BLOCK // 2])
            del block[BLOCK // 2 :]
        return before, after


def _named(values: np.ndarray) -> np.ndarray:
    """Equal values by one number, in the values' order, from 0."""
    return np.unique(values, return_inverse=True)[1]


def _paired(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twice the length: of each position and the one ``step`` further; past the end comes first."""
    behind = np.zeros(len(names), np.int64)
    behind[:-step] = names[step:] + 1
    return _named(names * (int(names.max()) + 2) + behind)


def repeated_stretches(words: np.ndarray, least: int) -> np.ndarray:
    """Whether the ``least`` words from each position on may come again: surely no where False.

    Stretches are compared by a hash of 64 bits, so equal ones always are equal here.
    """
    n = len(words) - least + 1
    if n < 2:
        return np.zeros(max(n, 0), bool)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed, length = np.zeros(n, np.uint64), 0
    power = mixed
    for bit in range(least.bit_length()):
        # ``power`` has the hashes of stretches of 2 ** bit words.
        if least >> bit & 1:
            hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + power[length : length + n]
            length += 1 << bit
        power = (power[: -(1 << bit)] * np.uint64(0x94D049BB133111EB)) ^ (power[1 << bit :] + (power[: -(1 << bit)] >> np.uint64(31))) if len(power) > 1 << bit else power
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The suffixes of a row of words in order, by doubling."""
    names, step = _named(words), 1
    while step < len(words) and int(names.max()) + 1 < len(words):
        names, step = _paired(names, step), step * 2
    return np.argsort(names, kind="stable")


def neighbour_lcp(words: np.ndarray, order: np.ndarray) -> array:
    """How many words each suffix shares with the one before it in order; 0 for the first."""
    text, n = array("q", words.tobytes()), len(words)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp, shared = array("q", bytes(8 * n)), 0
    for i, (j, k) in enumerate(zip(before.tolist(), place.tolist(), strict=True)):
        if j < 0:
            shared = 0
            continue
        most = n - max(i, j)
        while shared < most and text[i + shared] == text[j + shared]:
            shared += 1
        lcp[k] = shared
        if shared:
            shared -= 1
    return lcp


def runs(words: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    ``words`` are numbers, equal ones for equal words.  A run has its smallest period q, at
    least ``shortest`` words and ``repeats`` times q (three or more), and can't be extended.
    """
    if repeats < 3:
        raise ValueError("runs are found from three repeats on")
    least = shortest - shortest // repeats
    twice = np.flatnonzero(repeated_stretches(words, least))
    if not len(twice):
        return []
    # Only the stretches that come again, each parted from the next by a word of its own.
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + least, -1)
    kept = np.cumsum(inside[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], kept, [0]))))
    parts, places, fresh = [], [], int(words.max()) + 1
    for number, (a, b) in enumerate(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)):
        parts += [words[a:b], [fresh + number]]
        places += [np.arange(a, b), [-1]]
    return _kruskal(np.concatenate(parts).astype(np.int64), np.concatenate(places), words, least, shortest, repeats)


def _kruskal(words: np.ndarray, places: np.ndarray, whole: np.ndarray, least: int, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    order = suffix_order(words)
    lcp = np.frombuffer(neighbour_lcp(words, order), np.int64)
    joints = np.flatnonzero(lcp >= least)
    joints = joints[np.argsort(-lcp[joints], kind="stable")]
    position, shared = places[order].tolist(), lcp.tolist()
    leader = {k: k for k in {*joints.tolist(), *(joints - 1).tolist()}}
    classes = {k: OrderedSet(position[k]) for k in leader}
    word = whole.tolist()
    found = []

    def find(k: int) -> int:
        while leader[k] != k:
            leader[k] = k = leader[leader[k]]
        return k

    def seed(i: int, j: int, agree: int) -> None:
        """The run that two new neighbours give, if they are its first two positions."""
        period, length = j - i, j - i + agree
        if period <= agree and (i == 0 or word[i - 1] != word[j - 1]) and length >= max(shortest, repeats * period):
            found.append((i, length, period))

    for joint in joints.tolist():
        a, b = find(joint - 1), find(joint)
        if classes[a].size < classes[b].size:
            a, b = b, a
        leader[b] = a
        into, agree, last = classes[a], shared[joint], None
        came = list(classes.pop(b))
        for x, following in zip(came, [*came[1:], None], strict=True):
            before, after = into.insert(x)
            # Neighbours that came together were neighbours before, and the next to come may part two.
            if before >= 0 and before != last:
                seed(before, x, agree)
            if after >= 0 and (following is None or after < following):
                seed(x, after, agree)
            last = x
    return sorted(found, key=lambda run: (run[0], run[2]))


def split_words(text: object) -> list[bytes]:
    """The words of a text in UTF-8: what stands between ASCII white space.  Null has none."""
    return text.encode("utf-8").split() if isinstance(text, str) else []


def word_runs(words: list[bytes], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    hashed = np.fromiter(map(hash, words), np.int64, len(words))
    if not repeated_stretches(hashed, shortest - shortest // repeats).any():
        return []
    numbers: dict[bytes, int] = {}
    return runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), shortest, repeats)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most repeats; of equals the one that starts first, then of the smallest period."""
    return min(found, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def collapse(docs: DataFrame, *, text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with every run cut to its first period, and the runs in ``word_runs``.

    A text with a run becomes its kept words, one space between them; other texts stay as they
    are, null and empty ones too.  Rows that repeat are treated each, an empty table stays
    empty, and a column that is already called ``word_runs`` is replaced.
    """
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)

    @F.pandas_udf("text string, word_runs array<struct<start:long,length:long,period:long>>")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = split_words(text)
                found = word_runs(words, shortest, repeats)
                rows.append((b" ".join(collapsed(words, found)).decode("utf-8") if found else text if isinstance(text, str) else None, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]))
            yield pd.DataFrame(rows, columns=["text", "word_runs"])

    both = docs.drop("word_runs").withColumn("word_runs", made(F.col(text_col)))
    return both.withColumn(text_col, F.col("word_runs.text")).withColumn("word_runs", F.col("word_runs.word_runs"))


def with_repeats(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words of a document as the report has them: one document in ten repeats itself to its end.

    Which one, from where and by what period follows from the CRC-32 of the id's digits.  A
    document without an id stays as it is.
    """
    h = None if doc_id is None else zlib.crc32(doc_id.encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_REPORT = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of each document after ``with_repeats``, one row for every row.

    doc_id, n_runs; start, length, period and exponent_milli of the strongest run (null without
    runs); digests of all runs, as lines of start,length,period, and of the kept words with one
    space between them.  Null and empty texts have no words: no runs, and the digest of nothing.
    """
    bounded_batches(docs.sparkSession, rows=1000, size=16 << 20)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = with_repeats(split_words(text), doc_id)
                found = word_runs(words)
                best = strongest(found)
                told = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
                kept = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
                out.append((doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), told, kept))
            names = [c.split()[0] for c in _REPORT.split(", ")]
            made = pd.DataFrame(out, columns=names)
            yield made.astype({c: "Int64" for c in names[1:6]})

    # Ids go as digits: a nullable long would pass through pandas as a float.
    told = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, _REPORT)
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))
