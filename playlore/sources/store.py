"""Tables in parts that are replaced whole, behind a pointer that names each part's current files.

A replacement writes the new files of its parts to a folder of its own, and then one small file
that says where every part is.  Until that file is there, readers see the table as it was, and
afterwards as it is: never half of it.  Nothing is deleted but by ``clean``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlore.functions.shared import exists, file_system


def bucket_of(user: Column | str = "user_id", buckets: int = 64) -> Column:
    """A listener's bucket, in four digits."""
    return F.format_string("%04d", F.pmod(F.xxhash64(user), F.lit(buckets)))


class PartStore:
    """A table of ``schema`` in ``folder``, in parts named by the column ``part`` of what is written.

    The pointer lists all parts, which are as many as the caller makes: buckets times periods,
    not listeners or rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, order: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.order = spark, folder.rstrip("/"), schema, order

    def _pointers(self) -> list[int]:
        if not exists(self.spark, f"{self.folder}/pointers"):
            return []
        system, path = file_system(self.spark, f"{self.folder}/pointers")
        names = [f.getPath().getName() for f in system.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> dict[str, str]:
        """part -> the version that holds it now."""
        numbers = self._pointers()
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{numbers[-1]}").first()[0]) if numbers else {}

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of all parts, or of some; parts that are not there have none."""
        now = self.current()
        wanted = now if parts is None else [p for p in dict.fromkeys(parts) if p in now]
        paths = [f"{self.folder}/{now[p]}/part={p}" for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, parts: Iterable[str]) -> None:
        """Let ``parts`` hold exactly ``rows``, which have a column ``part``; parts without rows are no more.

        Of two replacements at a time the later one fails, and can be made again.
        """
        numbers, before = self._pointers(), self.current()
        version = f"version-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema.fields]
        # By ranges, so that a large part is written by several tasks and read by its first columns.
        laid = rows.select(*columns, "part").repartitionByRange("part", *self.order).sortWithinPartitions("part", *self.order)
        laid.write.option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{version}")
        system, path = file_system(self.spark, f"{self.folder}/{version}")
        made = {f.getPath().getName().removeprefix("part=") for f in system.listStatus(path) if f.isDirectory()}
        gone = set(parts)
        if made - gone:
            raise ValueError(f"rows of parts that are not replaced: {sorted(made - gone)[:3]}")
        now = {p: v for p, v in before.items() if p not in gone} | dict.fromkeys(made, version)
        self._point(json.dumps(now), (numbers[-1] if numbers else 0) + 1)

    def _point(self, text: str, number: int) -> None:
        """Name the current versions, by a file that is there whole or not at all."""
        system, begun = file_system(self.spark, f"{self.folder}/pointers/begun-{uuid.uuid4().hex}")
        out = system.create(begun)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        _, there = file_system(self.spark, f"{self.folder}/pointers/{number}")
        if system.exists(there) or not system.rename(begun, there):
            system.delete(begun, False)
            raise RuntimeError(f"{self.folder} was replaced by another writer at the same time")

    def clean(self, keep: int = 2) -> int:
        """Drop pointers but for the newest ``keep``, and versions that none of these names; how many versions went."""
        numbers = self._pointers()
        kept = set()
        for n in numbers[-keep:]:
            kept |= set(json.loads(self.spark.read.text(f"{self.folder}/pointers/{n}").first()[0]).values())
        for n in numbers[:-keep]:
            system, path = file_system(self.spark, f"{self.folder}/pointers/{n}")
            system.delete(path, False)
        system, path = file_system(self.spark, self.folder)
        old = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().startswith("version-") and f.getPath().getName() not in kept]
        for p in old:
            system.delete(p, True)
        return len(old)


def parts_of(rows: DataFrame) -> list[str]:
    """The parts that rows with a column ``part`` belong to; they are few by construction."""
    return [r["part"] for r in rows.select("part").distinct().collect()]


class DayStore(PartStore):
    """Captured plays whose days are replaced whole, in parts by bucket of listeners and month.

    A part holds many listeners' days, so there is no folder for each, and a replacement writes the
    parts of its days once, without what they held of these days before.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int = 64):
        super().__init__(spark, folder, schema, ("user_id", "played_at"))
        self.buckets = buckets

    def part(self, at: Column | str = "played_at") -> Column:
        return F.concat(bucket_of("user_id", self.buckets), F.lit("-"), F.date_format(at, "yyyy-MM"))

    def parts_since(self, since: DataFrame) -> list[str]:
        """The parts that may hold days from ``since(user_id, first_day)`` on."""
        first = {r["bucket"]: r["month"] for r in since.groupBy(bucket_of("user_id", self.buckets).alias("bucket")).agg(F.date_format(F.min("first_day"), "yyyy-MM").alias("month")).collect()}
        return [p for p in self.current() if p[:4] in first and p[5:] >= (first[p[:4]] or "")]

    def replace_days(self, rows: DataFrame, days: DataFrame) -> None:
        """Let ``days(user_id, day)`` hold exactly ``rows``; other days stay."""
        parts = parts_of(days.select(self.part("day").alias("part")))
        if parts:
            day = F.to_date("played_at")
            rest = self.read(parts).withColumn("day", day).join(days, ["user_id", "day"], "left_anti")
            names = [f.name for f in self.schema.fields]
            self.replace(rest.select(*names).unionByName(rows.select(*names)).withColumn("part", self.part()), parts)
