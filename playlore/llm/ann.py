"""Nearest neighbours by collision counting over query-aware hashes.

Vectors of one length are cut into blocks of bounded size.  A block is indexed by random
directions: for each, both ends of the block's projections are kept in sorted order.  A query
is projected on the same directions and uses those on which its own projection lies farthest
out: there the vectors with large inner products lie far out on the same side, and few others
do.  A window is opened from that end of each of these arrays.  A vector collides with the
query in an array if it lies in the window, and vectors with enough collisions are candidates.
If the candidates are too few, the windows are widened (virtual rehashing: only the parts of
the arrays that are new are counted).  Candidates are verified with their exact inner product
in double precision.

How many candidates are enough is measured, not set.  Each block asks its index for
neighbours of some of its own vectors, compares the answers with brute force and takes the
fewest candidates that find nearly all.  Of b blocks each has to find only its part of a
query's k nearest, so the more blocks there are, the fewer candidates each of them verifies;
and where the index tells near from far badly, more are verified, up to the whole block.

Vectors that are equal component by component are one entry of the index.  A query can't
need more than its ``k`` smallest ids and its own, so an entry carries only the k + 1
smallest ids, taken by partial aggregation: a vector that a third of all rows share costs as
much as any other.

The queries are a stated set and meet every block: block by block, each task first reads the
block's vectors, then streams the queries past them in Arrow batches.  Each query leaves a
block with k neighbours, and a last aggregation keeps the best k of all blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, written

#: Directions, in orthogonal sets, and how many at a time are projected on.
DIRECTIONS, AT_ONCE = 2048, 256
#: Ends of arrays in which a query opens windows, and in how many of them a candidate collides.
ENDS, COLLISIONS = 32, 5
#: Share of an array that is kept at either end.  Windows start with ``FIRST`` vectors and grow by ``STEP``.
DEPTH, FIRST, STEP = 1 / 8, 4, 1.2
#: Candidates wanted before windows stop widening, if nothing is measured: so many times k,
#: and this share of the block.  Up to WANTED times k vectors are compared without an index.
WANTED, SHARE = 10, 0.06
#: Shares that are tried, on how many neighbours of the block's own vectors, and which recall is enough.
SHARES = tuple(SHARE * 2 ** (x / 2) for x in range(-10, 7))
PROBED, ENOUGH = 1000, 0.955
#: Entries that are queries themselves are asked, if the block has so many; else any.
LEAST = 50
BLOCK = 16_384


def usable(vector: Column) -> Column:
    """Neither null, nor zero, nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class BlockIndex:
    """Both ends of the sorted projections of the vectors of one block."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.vectors = vectors
        count, dim = vectors.shape
        rng = np.random.default_rng(seed)
        sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-DIRECTIONS // dim))]
        self.directions = np.concatenate(sets, axis=1)[:, :DIRECTIONS].astype(np.float32)
        # The largest component is scaled to 1, so that no length overflows.
        self.scaled = scaled = (vectors / np.abs(vectors).max()).astype(np.float32)
        #: What rounding to single precision can change in the product of a vector and a query of length 1.
        self.rounding = (dim + 8) * 2.0**-23 * float(np.sqrt(np.einsum("ij,ij->i", scaled, scaled).max()))
        kept = min(count, max(int(DEPTH * count), 64))
        #: Positions from the upper end of each array inwards, then from the lower ends.
        self.order = np.empty((2, self.directions.shape[1], kept), np.min_scalar_type(count))
        for at in range(0, self.directions.shape[1], AT_ONCE):
            projected = np.ascontiguousarray((scaled @ self.directions[:, at : at + AT_ONCE]).T)
            for side, values in enumerate((-projected, projected)):
                ends = np.argpartition(values, kept - 1, axis=1)[:, :kept]
                inwards = np.argsort(np.take_along_axis(values, ends, axis=1), axis=1)
                self.order[side, at : at + AT_ONCE] = np.take_along_axis(ends, inwards, axis=1)
        self.order = self.order.reshape(-1, kept)
        self.widths = [FIRST]
        while self.widths[-1] < kept:
            self.widths.append(min(kept, int(self.widths[-1] * STEP) + 1))
        #: Number of the first width; it follows where the last query's windows were wide enough.
        self.start = 0
        #: Candidates that are enough; all vectors, until ``tune`` has measured it.
        self.wanted = count

    def tune(self, near: int, least: int, asked: np.ndarray) -> None:
        """Find how many candidates it takes to meet the ``near`` nearest of the block's vectors ``asked``.

        At least ``least`` are wanted.  If no share is enough, all vectors are verified.
        """
        count = len(self.vectors)
        near = min(near, count - 1)
        asked = asked[np.linspace(0, len(asked) - 1, min(-(-PROBED // near), len(asked))).astype(int)]
        scores = self.scaled[asked] @ self.scaled.T
        scores[np.arange(len(asked)), asked] = -np.inf
        nearest = np.argpartition(-scores, near - 1, axis=1)[:, :near]

        def recall(wanted: int) -> float:
            self.start = 0
            met = [np.isin(nearest[i], self.candidates(self.vectors[at], wanted)).mean() for i, at in enumerate(asked)]
            return float(np.mean(met))

        levels = [max(least, int(share * count)) for share in SHARES]
        first = bisect_left(levels, True, key=lambda wanted: recall(wanted) >= ENOUGH)
        self.wanted = levels[first] if first < len(levels) else count

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Positions of the vectors that collide often enough with the query, ``wanted`` of them at least.

        Only where even the widest windows bring too few together are all vectors taken.
        """
        count = len(self.vectors)
        if wanted >= count:
            return np.arange(count)
        projected = (query / np.abs(query).max()).astype(np.float32) @ self.directions
        projected = np.concatenate((projected, -projected))
        ends = self.order[np.argpartition(-projected, ENDS - 1)[:ENDS]]
        start, done = self.start, 0
        counts = np.zeros(count, np.int64)
        for step in range(start, len(self.widths)):
            width = self.widths[step]
            counts += np.bincount(ends[:, done:width].ravel(), minlength=count)
            found = np.flatnonzero(counts >= COLLISIONS)
            if len(found) >= wanted:
                break
            done = width
        else:
            return np.arange(count)
        self.start = max(0, step - 2 if step > start else start - 1)
        return found

    def best(self, query: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` of the vectors ``at`` with the largest inner products, any equal ones too, and the products.

        Single precision only leaves out what rounding can't bring back among them.
        """
        if len(at) > most:
            unit = (query / np.abs(query).max()).astype(np.float32)
            rough = (self.scaled if len(at) == len(self.scaled) else self.scaled[at]) @ unit
            at = at[rough >= np.partition(rough, len(at) - most)[len(at) - most] - 2 * self.rounding * float(np.sqrt(unit @ unit))]
        score = self.products(query, at)
        if len(at) > most:
            largest = score >= np.partition(score, len(at) - most)[len(at) - most]
            at, score = at[largest], score[largest]
        return at, score

    def products(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products in double precision, added in the order of the components."""
        return np.cumsum(self.vectors[at] * query, axis=1)[:, -1]


_FOUND = "query_id long, vec_id long, score double"


def _search(k: int, every: int, seed: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, index, vectors, ids = None, None, [], []
        for batch in batches:
            # A task may hold several blocks; within each the vectors come before the queries.
            for key, part in batch.groupby(["dim", "block"], sort=False):
                if key != block:
                    block, index, vectors, ids = key, None, [], []
                stored, asked = part[part["kind"] == 0], part[part["kind"] == 1]
                vectors += stored["vector"].to_list()
                ids += stored["ids"].to_list()
                if asked.empty or not vectors:
                    continue
                if index is None:
                    index = BlockIndex(np.array([np.asarray(v, float) for v in vectors]), seed)
                    owned = [np.asarray(x, np.int64) for x in ids]
                    first = np.array([x[0] for x in owned])
                    single = np.array([len(x) == 1 for x in owned])
                    if len(vectors) > WANTED * k:
                        # The block's part of the k nearest, and as many more as one deviation.
                        part_of_k = k / part["blocks"].iloc[0]
                        queries = np.flatnonzero(first % every == 0)
                        index.tune(min(k, int(np.ceil(part_of_k) + np.ceil(part_of_k**0.5))), k + 1, queries if len(queries) >= LEAST else np.arange(len(vectors)))
                rows = []
                for query_id, vector in zip(asked["at"], asked["vector"], strict=True):
                    query = np.asarray(vector, float)
                    at, score = index.best(query, index.candidates(query, index.wanted), k + 1)
                    if single[at].all():
                        vec, val = first[at], score
                    else:
                        vec = np.concatenate([owned[i] for i in at])
                        val = np.repeat(score, [len(owned[i]) for i in at])
                    other = vec != query_id
                    vec, val = vec[other], val[other]
                    top = np.lexsort((vec, -val))[:k]
                    rows.append((np.full(len(top), query_id), vec[top], val[top]))
                yield pd.DataFrame({"query_id": np.concatenate([r[0] for r in rows]), "vec_id": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows])})

    return search


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK, seed: int = 13) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own.  Nearest is the largest inner product; equal ones go by the smaller id.
    Vectors that are null or zero, or that hold a null or a non-finite component, take no
    part, nor do rows without an id.  Vectors of different lengths have no inner product:
    those of each length are searched among themselves.  Rows that repeat an id with another
    vector are candidates with each of them; a repeated query is asked for each vector and its
    answers merged.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=2000)
    plain = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # 0.0 for -0.0, so that equal vectors are equal bytes.
    plain = plain.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    # The k + 1 smallest ids of each vector: first within small groups, then over all.
    group = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256)
    keyed = plain.select("id", "vector", group.alias("same")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    narrow = keyed.select("same", "salt", "id").groupBy("same", "salt").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    several = written(narrow.groupBy("same").agg(F.sum("n").alias("n"), F.min("low").alias("low")), "ann-groups")
    repeated = keyed.select("same", "salt", "id").join(several.filter("n > 1").select("same"), "same")
    ranked = repeated.withColumn("r", F.row_number().over(Window.partitionBy("same", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    lists = ranked.groupBy("same").agg(smallest(F.collect_set("id")).alias("ids"))
    entries = written(
        several.join(lists, "same", "left").select("low", F.coalesce("ids", F.array("low")).alias("ids"), "same").join(keyed.select(F.col("id").alias("low"), "same", "vector"), ["low", "same"]).select("low", "ids", "vector", "same").dropDuplicates(["same"]),
        "ann-entries",
    )
    dim = F.size("vector").alias("dim")
    sizes = written(entries.groupBy(dim).agg(F.ceil(F.count("*") / block_rows).alias("blocks")), "ann-sizes")
    total = sizes.agg(F.sum("blocks")).first()[0] or 1
    columns = ["dim", "block", "blocks", "kind", "at", "ids", "vector"]
    stored = entries.withColumn("dim", dim).join(sizes, "dim").select("dim", F.pmod(F.xxhash64("low"), F.col("blocks")).alias("block"), "blocks", F.lit(0).alias("kind"), F.col("low").alias("at"), "ids", "vector")
    queries = plain.filter(F.col("id") % every == 0).withColumn("dim", dim).join(sizes, "dim")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(1).alias("kind"), F.col("id").alias("at"), F.array().cast("array<long>").alias("ids"), "vector")
    stream = stored.select(*columns).unionByName(asked.select(*columns)).repartition(max(1, min(total, 20_000)), "dim", "block").sortWithinPartitions("dim", "block", "kind", "at")
    found = stream.mapInPandas(_search(k, every, seed), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
