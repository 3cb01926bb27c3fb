"""Near-duplicates by MinHash with tensored banding.

A document is its set of five-word shingles.  Half keys of ``WIDTH`` minhashes each are
computed, and a table is formed for every pair of half keys.  Two documents meet in some
table as soon as two of their half keys agree.  The number of half keys follows from the
similarity asked for (``tensoring``), so that a pair at just that similarity is missed with a
probability of at most ``MISSED``, and a pair of the same component usually has other ways
to be joined.  At 0.85 these are 14 half keys: 56 minhashes serve 91 tables of eight, where
separate tables would need 728.  At 0.8 they are 20, and 190 tables.

Documents with equal sets are one class, and all further work is on classes:

* a half key that no other class has can't take part in a meeting and is dropped before the
  pairs are formed, which leaves next to nothing of documents without near copies;
* in each bucket every class is paired with the smallest one only, so a bucket of n classes
  gives n - 1 pairs, however large it is;
* pairs whose sizes or minhashes rule the similarity out go; the others are confirmed on
  their full sets, and confirmed links are joined to components;
* only buckets that still hold classes of several components are looked at again, and there
  only pairs across components.  A pair belongs to the first half key that its classes share,
  so it is compared once whatever the number of tables it meets in.  The members of a half
  key are compared on their full sets in blocks of bounded size, and a block returns links
  that join components, so fewer than it has members, never the pairs it has compared.

Full sets are made only for classes that share a bucket.  Which these are reaches the scan
of the texts as a bitmap of bounded size, so the texts themselves are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches, written
from .components import components

WORDS = 5
WIDTH = 4
#: Hundredths of similarity from which documents are linked, unless it is given.
SIMILARITY = 85
#: How often a pair at the similarity may meet in no table, and may agree in too few minhashes.
MISSED, RULED_OUT = 6e-4, 2e-6
#: Classes and shingles of one side of a block.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Bits of the largest bitmap of ids; a word of 64 bits is a row, so at most 2**20 rows are broadcast.
BITMAP = 1 << 26

_CLASSES = W.byte_classes(separators=b" \t\n\x0b\x0c\r")


class Tensoring(NamedTuple):
    """A similarity in hundredths, its number of half keys, and the fewest minhashes that agree."""

    similarity: int
    halves: int
    least_agreeing: int

    def reached(self, part: Column | np.ndarray | int, whole: Column | np.ndarray | int) -> Column | np.ndarray | bool:
        return 100 * part >= self.similarity * whole


@lru_cache
def tensoring(similarity: int = SIMILARITY) -> Tensoring:
    """The fewest half keys that meet ``MISSED`` at a similarity, and the bound that meets ``RULED_OUT``."""
    if not 50 <= similarity <= 100:
        raise ValueError(f"a similarity of 50 to 100 hundredths is needed, not {similarity}")
    s = similarity / 100
    p, halves = s**WIDTH, 2
    while (1 - p) ** halves + halves * p * (1 - p) ** (halves - 1) > MISSED:
        halves += 1
    n, least, below = halves * WIDTH, 0, 0.0
    while (below := below + math.comb(n, least) * s**least * (1 - s) ** (n - least)) <= RULED_OUT:
        least += 1
    return Tensoring(similarity, halves, least)


@lru_cache
def _functions(many: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, many, dtype=np.int64).astype(W.U64) * W.U64(2) + W.U64(1)
    return a, rng.integers(1, 1 << 62, many, dtype=np.int64).astype(W.U64)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    return np.unique(W.shingles(W.words(W.LOWER[W.utf8(text)], _CLASSES)[2], WORDS))


def minhashes(shingles: np.ndarray, many: int) -> np.ndarray:
    """Upper halves of the least values under each of the hash functions, as 32-bit integers."""
    a, b = _functions(many)
    low = np.full(many, np.iinfo(np.uint64).max, W.U64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048, None]
        np.minimum(low, (part * a + b).min(axis=0), out=low)
    return (low >> W.U64(32)).astype(np.uint32).view(np.int32)


_SIGNED = "doc_id long, h long, n_shingles long, set_a long, set_b long, signature array<int>"


def _signatures(many: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text)
                digest = (s.sum(dtype=W.U64), W.mix(s ^ W.U64(0x5BD1E9955BD1E995)).sum(dtype=W.U64))
                rows.append((len(s), *(int(np.uint64(d).view(np.int64)) for d in digest), minhashes(s, many) if len(s) else None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_shingles", "set_a", "set_b", "signature"))}})

    return sign


def signatures(docs: DataFrame, how: Tensoring) -> DataFrame:
    """doc_id, hash of the text, size of the shingle set, 128-bit digest of the set, and minhashes."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(_signatures(how.halves * WIDTH), _SIGNED)


def _class_table(signed: DataFrame) -> DataFrame:
    return signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))


def _buckets(classes: DataFrame, how: Tensoring) -> DataFrame:
    """(bucket, half, key, rep), the first of the two half keys with it: the members of each table's buckets, less half keys that occur once."""
    halves = written(classes.select("rep", F.posexplode(_half_keys(how)).alias("half", "key")), "near-halves")
    shared = written(halves.groupBy("half", "key").agg(F.count("*").alias("c")).filter("c > 1").select("half", "key"), "near-shared")
    left = halves.join(shared, ["half", "key"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("half", "key"))).alias("held"))
    first = left.select("rep", "held", F.posexplode("held").alias("at", "one"))
    second = first.select("rep", "one", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("two"))
    return second.select(F.xxhash64("one.half", "two.half", "one.key", "two.key").alias("bucket"), "one.half", "one.key", "rep")


def _agreeing() -> Column:
    same = F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def _plausible(pairs: DataFrame, classes: DataFrame, how: Tensoring) -> DataFrame:
    """Pairs (a, b) that sizes and minhashes don't rule out."""
    a = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b"))
    sized = pairs.join(a, "a").join(b, "b").filter(how.reached(F.least("n_a", "n_b"), F.greatest("n_a", "n_b")))
    return sized.filter(_agreeing() >= how.least_agreeing).select("a", "b")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["doc_id"], "shingles": [shingle_set(t).tobytes() for t in batch["text"]]})


def sets_of(docs: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """(id, shingles) of the documents whose id is among ``ids(rep)``, and of a few others.

    A bit for each id's hash, in rows of 64, picks the documents where they are read.  When
    there are so many ids that the bitmap can't tell, it lets all through, which costs time
    but changes no result.
    """
    bits = min(BITMAP, 1 << max(10, (16 * many).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    one = F.lit(1).cast("long")
    bit = lambda p: F.call_function("shiftleft", one, F.pmod(p, F.lit(64)).cast("int"))
    marked = ids.select(place("rep").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit(F.col("p"))).alias("mask"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", place("doc_id").alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    picked = rows.join(F.broadcast(marked), "word").filter(F.col("mask").bitwiseAND(bit(F.col("p"))) != 0)
    bounded_batches(docs.sparkSession)
    return picked.select("doc_id", "text").mapInPandas(_sets, "id long, shingles binary")


def _confirm(how: Tensoring) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["of_a"], batch["of_b"], strict=True):
                x, y = np.frombuffer(x, W.U64), np.frombuffer(y, W.U64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(how.reached(common, len(x) + len(y) - common))
            yield batch.loc[linked, ["a", "b"]]

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, how: Tensoring) -> DataFrame:
    """Those of the pairs (a, b) of ids whose full shingle sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(b, "b").join(a, "a").mapInPandas(_confirm(how), "a long, b long")


def _block_links(rows: pd.DataFrame, how: Tensoring) -> pd.DataFrame:
    """Links across components between the two sides of a block, enough to join what they join.

    An index from shingle to members gives each member's number of shingles in common with
    all others at once.
    """
    rows = rows.drop_duplicates(["rep", "side"]).reset_index(drop=True)
    if rows["side"].nunique() == 1:  # a part with itself
        sides = [np.arange(len(rows))] * 2
    else:
        sides = [np.flatnonzero(rows["side"] == x) for x in (0, 1)]
    keys = np.stack(rows["keys"].to_list())
    half = int(rows["half"].iat[0])
    n, label = rows["n"].to_numpy(), rows["component"].to_numpy().copy()
    shingles = [np.frombuffer(x, W.U64) for x in rows["shingles"]]
    right = sides[1]
    owner = np.repeat(np.arange(len(right)), [len(shingles[i]) for i in right])
    tokens = np.concatenate([shingles[i] for i in right])
    order = np.argsort(tokens, kind="stable")
    owner, tokens = owner[order], tokens[order]
    found = []
    for i in sides[0]:
        same = keys[right] == keys[i]
        # The pair belongs here if this is the first half key that both share, and not the only one.
        due = same[:, half] & ~same[:, :half].any(axis=1) & (same.sum(axis=1) > 1) & (label[right] != label[i]) & how.reached(np.minimum(n[right], n[i]), np.maximum(n[right], n[i]))
        if not due.any():
            continue
        low, high = tokens.searchsorted(shingles[i]), tokens.searchsorted(shingles[i], "right")
        some = high > low
        held = [owner[a:b] for a, b in zip(low[some], high[some], strict=True)]
        common = np.bincount(np.concatenate(held), minlength=len(right)) if held else np.zeros(len(right), int)
        for j in np.flatnonzero(due & how.reached(common, n[right] + n[i] - common)):
            other = right[j]
            if label[other] != label[i]:
                found.append((rows["rep"].iat[i], rows["rep"].iat[other]))
                label[label == label[other]] = label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _half_keys(how: Tensoring) -> Column:
    return F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * WIDTH + 1, WIDTH)) for i in range(how.halves)])


def _links_across(buckets: DataFrame, classes: DataFrame, found: DataFrame, sets: DataFrame, how: Tensoring) -> DataFrame:
    """Confirmed links between components in buckets that hold several of them."""
    member = written(buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "half", "key", "rep", F.coalesce("component", "rep").alias("component")), "near-members")
    several = written(member.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select("bucket", "size"), "near-open")
    held = written(member.join(several, "bucket").select("bucket", "size", "half", "key", "rep", "component"), "near-held")
    # A bucket of two is one pair.
    two = held.filter("size = 2").groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).select("a", "b").distinct()
    pairs = confirmed(written(_plausible(two, classes, how), "near-two"), sets, how)
    # Larger buckets of one half key are compared together.
    more = written(held.filter("size > 2").select("half", "key", "rep", "component").distinct().join(classes.select("rep", "n", _half_keys(how).alias("keys")), "rep"), "near-more")
    cuts = more.groupBy("half", "key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("cuts"))
    cut = more.join(written(cuts, "near-cuts"), ["half", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    # Part i meets part j in the block (i, j), i <= j; the part with the smaller number is side 0.
    placed = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select(
        "half", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "rep", "component", "n", "keys"
    )
    blocks = placed.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("half", "key", "i", "j").applyInPandas(lambda rows: _block_links(rows, how), "a long, b long")
    return pairs.unionByName(blocks)


def links(docs: DataFrame, classes: DataFrame, how: Tensoring) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to join all that belong together."""
    buckets = written(_buckets(classes, how), "near-buckets")
    centres = written(buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1").select("bucket", "a"), "near-centres")
    shared = written(buckets.join(centres, "bucket").select("bucket", "half", "key", "a", "rep"), "near-shared-buckets")
    needed = written(shared.select("rep").distinct(), "near-needed")
    sets = written(sets_of(docs, needed, needed.count()), "near-sets")
    stars = shared.filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    known = written(confirmed(written(_plausible(stars, classes, how), "near-stars"), sets, how), "near-links")
    found = written(components(known), "near-components")
    return known.unionByName(written(_links_across(shared.drop("a"), classes, found, sets, how), "near-across"))


def _placed(docs: DataFrame, how: Tensoring) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles and component_id of every row.

    Sets are looked up by id.  If some id stands for several sets, that would mix them up, so
    all rows then get numbers of their own, and a component takes its smallest id afterwards.
    """
    signed = written(signatures(docs, how), "near-signed")
    sets = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[f(c).alias(f"{name}_{c}") for c in ("set_a", "set_b") for name, f in (("low", F.min), ("high", F.max))])
    if not sets.filter("low_set_a < high_set_a OR low_set_b < high_set_b").isEmpty():
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("h")), "near-rows")
        own = _placed(rows.filter("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text"), how)
        placed = own.select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(rows.select("row", "doc_id", "h"), "row")
        low = placed.groupBy("component_id").agg(F.min("doc_id").alias("low"))
        named = placed.join(low, "component_id").select("doc_id", "h", "n_shingles", F.col("low").alias("component_id"))
        return named.unionByName(signed.filter("doc_id IS NULL").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id")))
    classes = written(_class_table(signed), "near-classes")
    found = components(links(docs, classes, how))
    placed = written(classes.select("set_a", "set_b", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component")), "near-placed")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    rows = signed.select("doc_id", "h", "n_shingles", "set_a", "set_b")
    together = rows.filter(~alone).join(placed, ["set_a", "set_b"]).select("doc_id", "h", "n_shingles", F.col("component").alias("component_id"))
    return together.unionByName(rows.filter(alone).select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, *, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Words are runs without white space, after lower-casing A-Z; a text of one to four words
    has its whole sequence as only shingle.  Texts that are null or have no word have an
    empty set and are linked with nothing.  Two documents are linked at a similarity of at
    least ``similarity`` hundredths, and component_id is the smallest id that links reach.  A
    row without an id is linked with nothing: its component_id is null, and it is kept.  Rows
    that repeat an id are placed each by its own text.  Other columns are not read.  An empty
    table gives an empty result.
    """
    every = _placed(docs.select("doc_id", "text"), tensoring(similarity))
    return every.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the row with the smallest id.

    A row is known by its id and its text, so an id that also has another text takes nothing
    with it; if several texts have the smallest id, one of them stays.  Rows that repeat both
    are kept or dropped together, and rows without an id or without words are kept.
    """
    rows = written(_placed(docs.select("doc_id", "text"), tensoring(similarity)).filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h", "component_id"), "near-found")
    stays = rows.filter("doc_id = component_id").groupBy("component_id").agg(F.min("h").alias("stays"))
    gone = rows.join(stays, "component_id").filter("doc_id <> component_id OR h <> stays").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left_anti")
