"""Truncated singular value decomposition of a sparse table by a randomised range finder.

Rows are ``(key, columns, weights)``: what stands in a row of the matrix, by column name.  Every
name has a row of Gaussian numbers that follows from it, so the first product of matrix and
random numbers needs no table of them.  Each round multiplies by the matrix and its transpose
and makes the result orthogonal by a tall-skinny QR: tasks reduce their rows to small triangles,
triangles are reduced together in few steps, and rows are divided by the last one.

What comes to the driver are triangles of (dims + a few) rows, and column vectors in blocks of
``COLUMNS`` names, by which the rows are multiplied in batches, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.functions.shared import checkpointed

#: Directions beyond those asked for, rounds, column names in one block, triangles that meet in one task.
MORE, ROUNDS, COLUMNS, MEET = 20, 4, 20_000, 16
#: Singular values below this share of the largest are taken as none.
NOTHING = 1e-10


def _gaussian(names: list[str], width: int, seed: int) -> np.ndarray:
    """The random numbers of some columns; the same for the same name everywhere."""
    return np.stack([np.random.default_rng([zlib.crc32(n.encode()), len(n), seed]).standard_normal(width) for n in names])


def _cells(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Row number, number of the name, names and weight of the cells of a batch, by name."""
    lengths = batch["columns"].map(len).to_numpy()
    codes, names = pd.factorize(np.concatenate(batch["columns"].to_list()), sort=False)
    row = np.repeat(np.arange(len(batch)), lengths)
    weight = np.concatenate([np.asarray(w, float) for w in batch["weights"]])
    order = np.argsort(codes, kind="stable")
    return row[order], codes[order], list(names), weight[order]


def _times(batch: pd.DataFrame, matrix: np.ndarray, at: dict[str, int]) -> np.ndarray:
    """The rows of a batch times some columns' vectors; columns that aren't among them count nothing."""
    row, code, names, weight = _cells(batch)
    number = np.array([at.get(n, -1) for n in names])[code]
    there = number >= 0
    out = np.zeros((len(batch), matrix.shape[1]))
    row, number, weight = row[there], number[there], weight[there]
    order = np.argsort(row, kind="stable")
    row, number, weight = row[order], number[order], weight[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(starts):
        out[row[starts]] = np.add.reduceat(matrix[number] * weight[:, None], starts)
    return out


def _triangle(rows: DataFrame, name: str, width: int) -> np.ndarray:
    """R of the QR decomposition of the vectors in a column, by reducing triangles."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, width))
        for batch in batches:
            if len(batch):
                held = np.linalg.qr(np.concatenate([held, np.concatenate([np.reshape(v, (-1, width)) for v in batch[name]])]), mode="r")
        if len(held):
            yield pd.DataFrame({name: [held.ravel()]})

    parts = checkpointed(rows.select(name).mapInPandas(reduce, f"{name} array<double>"))
    while (n := parts.rdd.getNumPartitions()) > MEET:
        parts = checkpointed(parts.repartition(-(-n // MEET)).mapInPandas(reduce, f"{name} array<double>"))
    last = [np.reshape(r[name], (-1, width)) for r in parts.collect()]
    return np.linalg.qr(np.concatenate(last), mode="r") if last else np.zeros((0, width))


def _divisor(triangle: np.ndarray) -> np.ndarray:
    """What vectors are multiplied by to be orthogonal; fewer columns where the rank is less."""
    _, s, vt = np.linalg.svd(triangle, full_matrices=False)
    kept = s > NOTHING * s[0] if len(s) else np.zeros(0, bool)
    return vt[kept].T / s[kept]


def _turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """Rows with their vectors ``y`` times a small matrix."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(y=list(np.stack(batch["y"].to_list()) @ by))

    return rows.mapInPandas(turn, rows.schema)


def _by_column(rows: DataFrame) -> DataFrame:
    """(name, y): for each column the sum of its rows' vectors by weight: the transpose times the rows' vectors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, code, names, weight = _cells(batch)
                y = np.stack(batch["y"].to_list())
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                yield pd.DataFrame({"name": names, "y": list(np.add.reduceat(y[row] * weight[:, None], starts))})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, total = None, None
        for batch in batches:
            for n, y in zip(batch["name"], batch["y"], strict=True):
                if n != name:
                    if total is not None:
                        yield pd.DataFrame({"name": [name], "y": [total]})
                    name, total = n, np.zeros(len(y))
                total = total + y
        if total is not None:
            yield pd.DataFrame({"name": [name], "y": [total]})

    parts = rows.select("columns", "weights", "y").mapInPandas(add, "name string, y array<double>")
    return checkpointed(parts.repartition("name").sortWithinPartitions("name").mapInPandas(join, "name string, y array<double>"))


def _by_row(rows: DataFrame, columns: DataFrame, width: int) -> DataFrame:
    """Rows with ``y`` as the matrix times the columns' vectors, block by block of columns."""
    numbered = checkpointed(columns.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-columns.count() // COLUMNS))))))
    blocks = [r["block"] for r in numbered.select("block").distinct().orderBy("block").collect()]
    out = rows.withColumn("y", F.array_repeat(F.lit(0.0), width))
    for block in blocks:
        held = numbered.filter(F.col("block") == block).select("name", "y").toPandas()
        matrix, at = np.stack(held["y"].to_list()), {n: i for i, n in enumerate(held["name"])}
        shared = rows.sparkSession.sparkContext.broadcast((matrix, at))

        def times(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matrix, at = shared.value
            for batch in batches:
                if len(batch):
                    yield batch.assign(y=list(np.stack(batch["y"].to_list()) + _times(batch, matrix, at)))

        out = checkpointed(out.mapInPandas(times, out.schema))
    return out


def decompose(rows: DataFrame, dims: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(key, z), the rows of U times Sigma, and the singular values, ``dims`` of them or as many as there are.

    ``rows(key, columns array<string>, weights array<double>)``; rows without columns have no place.
    """
    width = dims + MORE
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    rows = rows.filter(F.size("columns") > 0).select("key", "columns", "weights")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                names = list(dict.fromkeys(n for c in batch["columns"] for n in c))
                fresh = [n for n in names if n not in known]
                if len(known) > COLUMNS:
                    known, fresh = {}, names
                known |= dict(zip(fresh, _gaussian(fresh, width, seed), strict=True)) if fresh else {}
                matrix = np.stack([known[n] for n in names])
                yield batch.assign(y=list(_times(batch, matrix, {n: i for i, n in enumerate(names)})))

    kind = rows.schema["key"].dataType.simpleString()
    y = checkpointed(rows.mapInPandas(first, f"key {kind}, columns array<string>, weights array<double>, y array<double>"))
    if y.isEmpty():
        return y.select("key", F.col("y").alias("z")), np.zeros(0)
    for n in range(ROUNDS + 1):
        by = _divisor(_triangle(y, "y", width))
        q, width = _turned(y, by), by.shape[1]
        z = _by_column(q)
        if n < ROUNDS:
            by = _divisor(_triangle(z, "y", width))
            width = by.shape[1]
            y = _by_row(rows, _turned(z, by), width)
    # The matrix is about Q Zt, and Zt is Rt times orthogonal rows.
    u, s, _ = np.linalg.svd(_triangle(z, "y", width).T, full_matrices=False)
    kept = min(dims, int((s > NOTHING * s[0]).sum()))
    told = _turned(q, u[:, :kept] * s[:kept])
    return told.select("key", F.col("y").alias("z")), s[:kept]
