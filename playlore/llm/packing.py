"""Best-fit packing into sequences of several permitted lengths.

Documents are measured in tokens, and those longer than the longest sequence are cut into
pieces of that length and a rest.  Pieces are dealt to groups of bounded size by a hash, and
each group is packed by itself: with tens of thousands of pieces in a group, packing it
alone wastes next to nothing, and no group grows with the corpus.

Within a group pieces come longest first.  A piece goes into the open bin that it leaves
least room in.  If none has room, a bin is opened, of the length with the least cost for
each unit that it would hold: for every permitted length it is tried which of the pieces
still to come would fill the bin up.  A bin costs a fixed amount, an amount for each unit,
and for attention an amount for each pair of units.  When all pieces are placed, every bin is
downsized to the cheapest permitted length that holds its contents.

What is best for one bin need not be best for all, so the lengths are also chosen for the
group as a whole: it is packed with each permitted length as the least that is opened, too,
and the packing of the least total cost is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import bounded_batches, written


@dataclass(frozen=True)
class Sizes:
    """Permitted sequence lengths and what a sequence of n units costs: fixed + n + n * n / pairs."""

    lengths: tuple[int, ...] = (256, 512, 1024, 2048, 4096)
    fixed: float = 32.0
    pairs: float = 32768.0

    def cost(self, n: int) -> float:
        return self.fixed + n + n * n / self.pairs

    def downsized(self, held: int) -> int:
        """The cheapest length that holds ``held`` units; of equally cheap ones the shortest."""
        return min((n for n in sorted(self.lengths) if n >= held), key=lambda n: (self.cost(n), n))


Packing = tuple[list[int], list[int], list[int]]


def _worth(sizes: list[int], falling: list[int], at: int, permitted: Sizes) -> int:
    """The length to open for piece ``at``: of the least cost for each unit that it is filled with."""
    best = None
    for length in sorted(permitted.lengths):
        if length < sizes[at]:
            continue
        held, last = sizes[at], at
        for _ in range(LOOK):
            # The longest of the pieces to come that still fits.
            last = bisect_left(falling, held - length, last + 1)
            if last >= len(sizes):
                break
            held += sizes[last]
        worth = permitted.cost(permitted.downsized(held)) / held
        if best is None or worth < best[0] - 1e-12:
            best = worth, length
    return best[1]


def pack_with(sizes: list[int], permitted: Sizes, least: int | None = None) -> Packing:
    """Best fit of pieces that come longest first; bins have the length ``least`` or more, or what ``_worth`` says."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    held: list[int] = []
    bins, offsets = [], []
    falling = [-size for size in sizes]
    lengths = sorted(permitted.lengths)
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            number = len(held)
            left = _worth(sizes, falling, i, permitted) if least is None else lengths[bisect_left(lengths, max(least, size))]
            held.append(0)
        bins.append(number)
        offsets.append(held[number])
        held[number] += size
        if left > size:
            insort(room, (left - size, number))
    return bins, offsets, [permitted.downsized(h) for h in held]


def best_fit(sizes: list[int], permitted: Sizes) -> Packing:
    """Bin and offset of each piece, and the capacity of each bin, at the least cost found.

    Pieces come longest first; of equally costly packings the one by look-ahead, then that of
    the shortest bins is kept.
    """
    made = [pack_with(sizes, permitted, least) for least in (None, *sorted(permitted.lengths))]
    return min(made, key=lambda packing: sum(map(permitted.cost, packing[2])))


def word_count(text: Column) -> Column:
    """Words of a text: runs without white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


#: Pieces that are tried for filling up a bin that is about to be opened.
LOOK = 32

_PACKED = "doc_id long, piece int, first long, size int, bin string, offset int, capacity int"


def _by_group(solve: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``solve`` for each group of rows that come sorted by ``part``; one group at a time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            for group, part in batch.groupby("part", sort=False):
                if waiting and waiting[-1]["part"].iat[0] != group:
                    yield solve(pd.concat(waiting))
                    waiting = []
                waiting.append(part)
        if waiting:
            yield solve(pd.concat(waiting))

    return run


def _placed(permitted: Sizes) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows["first"], rows["doc_id"].fillna(-1), -rows["size"]))]
        bins, offsets, capacities = best_fit(rows["size"].tolist(), permitted)
        group = rows["part"].iat[0]
        made = rows[["doc_id", "piece", "first", "size"]].astype({"doc_id": "Int64"})
        return made.assign(bin=[f"{group}-{b}" for b in bins], offset=offsets, capacity=[capacities[b] for b in bins])

    return solve


def pack(docs: DataFrame, *, permitted: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, group_rows: int = 20_000) -> DataFrame:
    """Where each document goes: doc_id, piece, first, size, bin, offset, capacity.

    A piece holds ``size`` units of its document from unit ``first`` on and stands at
    ``offset`` in its bin.  Units are words, or what the column ``size`` counts (``bpe.count``
    gives tokens).  Documents of no units (null and empty texts) have no piece.  Rows that
    repeat, and rows without an id, are packed each; pieces of one size go by id and then by
    first unit.  The same table is packed the same way whatever its partitions, but for ids and sizes
    that very many rows share (null ids, repeats): these are dealt by the number of their row, so
    that they don't come to one group.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession, rows=20_000, size=8 << 20)
    longest = max(permitted.lengths)
    units = word_count(F.col(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    # Filtered after it is written, as a filter would have the units counted a second time.
    sized = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), units.alias("units")), "pack-sized").filter("units > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("units") - 1, F.lit(longest).cast("long"))
    same = sized.groupBy(F.col("doc_id").alias("_id"), F.col("units").alias("_units")).agg(F.count("*").alias("n"))
    many = same.filter(F.col("n") > max(1, group_rows // 16)).select("_id", "_units", F.lit(True).alias("many"))
    marked = sized.join(many, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("units") == F.col("_units")), "left")
    salted = marked.select("doc_id", "units", F.when(F.col("many"), F.col("row")).alias("row"))
    pieces = salted.select("row", "doc_id", "units", F.posexplode(starts).alias("piece", "first")).select("row", "doc_id", "piece", "first", F.least(F.col("units") - F.col("first"), F.lit(longest)).cast("int").alias("size"))
    total = sized.agg(F.sum(F.ceil(F.col("units") / longest))).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    part = F.pmod(F.xxhash64("doc_id", "piece", "size", "row"), F.lit(groups)).alias("part")
    dealt = pieces.select("doc_id", "piece", "first", "size", part).repartition(groups, "part").sortWithinPartitions("part")
    return dealt.mapInPandas(_by_group(_placed(permitted)), _PACKED)


_SEQUENCE = "bin string, capacity int, used int, doc_ids array<long>, rows array<long>, pieces array<int>, starts array<int>, tokens array<int>"


def _filled(permitted: Sizes) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["tokens"].map(len).to_numpy()
        order = np.lexsort((rows["piece"], rows["row"], -size))
        rows, size = rows.iloc[order], size[order]
        bins, offsets, capacities = best_fit(size.tolist(), permitted)
        by_bin = np.lexsort((offsets, bins))
        rows, number, start = rows.iloc[by_bin], np.asarray(bins)[by_bin], np.asarray(offsets)[by_bin]
        cuts = np.flatnonzero(np.diff(number)) + 1
        ids = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None)
        parts = {c: np.split(rows[c].to_numpy(), cuts) for c in ("row", "piece", "tokens")} | {"id": np.split(ids.to_numpy(), cuts), "start": np.split(start, cuts)}
        tokens = [np.concatenate(list(p)) for p in parts["tokens"]]
        group = rows["part"].iat[0]
        columns = {
            "bin": [f"{group}-{b}" for b in range(len(capacities))],
            "capacity": capacities,
            "used": [len(t) for t in tokens],
            "doc_ids": [[None if i is None else int(i) for i in p] for p in parts["id"]],
            "rows": list(parts["row"]),
            "pieces": list(parts["piece"]),
            "starts": [p.astype(np.int32) for p in parts["start"]],
            "tokens": tokens,
        }
        return pd.DataFrame(columns)

    return solve


def sequences(docs: DataFrame, vocabulary: str, *, permitted: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text", group_rows: int = 5000, group_tokens: int = 1_000_000) -> DataFrame:
    """The packed training sequences themselves, one row each, with their tokens.

    ``tokens`` are those of the pieces in order; piece i of a sequence begins at ``starts[i]``
    and is piece ``pieces[i]`` of the document in row ``rows[i]``, whose id is ``doc_ids[i]``.
    Rows are numbered here, so null ids and repeated ones stay apart.  Texts that are null or
    empty are in no sequence.  A group holds about ``group_rows`` pieces and ``group_tokens``
    tokens, which a task holds as one.  Other columns are not read; an empty table gives no sequence.
    """
    longest = max(permitted.lengths)
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = written(encode(plain, vocabulary, ids_col="tokens", remembered=100_000).drop("text"), "pack-tokens").filter(F.size("tokens") > 0)
    told = encoded.agg(F.sum(F.ceil(F.size("tokens") / longest)).alias("pieces"), F.sum(F.size("tokens")).alias("tokens")).first()
    groups = max(1, -(-(told["pieces"] or 0) // group_rows), -(-(told["tokens"] or 0) // group_tokens))
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(longest))
    pieces = encoded.select("row", "doc_id", "tokens", F.posexplode(starts).alias("piece", "first")).select("row", "doc_id", "piece", F.slice("tokens", F.col("first") + 1, F.lit(longest)).alias("tokens"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(groups))).repartition(groups, "part").sortWithinPartitions("part")
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)
    return dealt.mapInPandas(_by_group(_filled(permitted)), _SEQUENCE)
