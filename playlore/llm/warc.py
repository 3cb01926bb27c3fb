"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is one text write: a record is a header, an empty line and a payload, and two line
ends close it, which is the line separator of the writer.  So archives are part files of an
ordinary Spark write, on any file system, with its commit protocol.

Reading does not trust the magic ``WARC/1.1``, which may stand inside a payload.  Archives
are cut into byte ranges.  Each task finds every place in its range that looks like a
record's start and has a readable header, and emits that candidate's offset and its
successor's, which the header's length gives.  Within a range the successors are followed
at once, so each candidate knows the first offset its chain reaches outside the range.  On
these exits pointer jumping runs: starting from offset 0 of each archive, what is reachable
doubles its distance in every round, and the rounds are the logarithm of the number of
ranges of the largest archive.  A second look at the ranges then walks from the reachable
entries and reads the records; candidates inside payloads are never reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, written

MAGIC = b"WARC/1.1\r\n"
CLOSE = b"\r\n\r\n"
RANGE = 8 << 20
#: Bytes read at first for a header; a longer one is read on to its end.
HEADER = 64 << 10
#: Payloads of fewer bytes are always stored, however often they recur.
LEAST_REVISIT = 1000


def _record(kind: Column) -> Column:
    """The text of a record; lengths are of UTF-8 bytes."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    stored = kind == "response"
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20"))).otherwise(""),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(stored, F.lit("")).otherwise(line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">")))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(stored, F.col("bytes")).otherwise(0).cast("string")),
        F.lit("\r\n"),
        F.when(stored, F.col("payload")).otherwise(""),
    )


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write one record for each row of ``pages`` to archives in ``folder``.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
    largest id is a response and the others are revisits that refer to it; all smaller ones
    are responses.  A null payload counts as empty, a null address is left out.  Rows that
    repeat an id are records of their own.  A row without an id is a record with an empty
    number: a revisit where an equal payload has an id, else a response.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    keys = written(rows.filter(F.col("bytes") >= LEAST_REVISIT).select("id", "bytes", "digest"), "warc-keys")
    last = written(keys.groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-last")
    # Only the small keys are shuffled by digest; the payloads meet the decisions by id.
    again = (F.col("id") < F.col("refers_to")) | (F.col("id").isNull() & F.col("refers_to").isNotNull())
    revisits = written(keys.join(last, ["digest", "bytes"]).filter(again).select(F.col("id").alias("again"), F.col("digest").alias("same"), "refers_to").distinct(), "warc-revisits")
    decided = rows.join(revisits, rows["id"].eqNullSafe(revisits["again"]) & (rows["digest"] == revisits["same"]), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    decided.select(_record(kind).alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)


def _open(path: str):
    path = re.sub(r"^file:/+", "file:///", path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of a header at ``at`` and where its block begins; None if it isn't one."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(CLOSE, at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def _read_on(f, data: bytes, at: int) -> bytes:
    """``data``, with as much of the file after it as the header at ``at`` needs to end."""
    seen = at
    while data.find(CLOSE, seen) < 0 and (more := f.read(max(HEADER, len(data) - at))):
        seen = max(at, len(data) - len(CLOSE) + 1)
        data += more
    return data


def _candidates(path: str, start: int, size: int, archive: int) -> list[tuple[int, int]]:
    """(offset, successor) of everything in a range that looks like a record.

    A record follows the two line ends that close the one before it, so no header is looked
    for inside another and the range is gone through once, however long its headers are.
    """
    early = min(start, len(CLOSE))
    with _open(path) as f:
        f.seek(start - early)
        data = f.read(min(early + size + HEADER, archive - start + early))
        found, at = [], data.find(MAGIC, early)
        while 0 <= at < early + size:
            if start - early + at == 0 or data.endswith(CLOSE, 0, at):
                data = _read_on(f, data, at)
                if head := _header(data, at):
                    found.append((start - early + at, start - early + head[1] + int(head[0]["content-length"]) + 4))
            at = data.find(MAGIC, at + 1)
    return found


def ranges(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(path, file, start, size, archive) of the byte ranges of all archives; contents aren't read.

    ``file`` is a hash of the path that stands for it in the tables of offsets.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").filter("length > 0")
    cut = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    return cut.select("path", F.xxhash64("path").alias("file"), (F.col("part") * size).alias("start"), F.lit(size).cast("long").alias("size"), F.col("length").alias("archive"))


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, file, start, size, archive in zip(batch["path"], batch["file"], batch["start"], batch["size"], batch["archive"], strict=True):
            found = _candidates(path, start, size, archive)
            inside: dict[int, int] = {}
            for at, following in reversed(found):
                inside[at] = inside.get(following, following)
            yield pd.DataFrame({"file": file, "at": [a for a, _ in found], "leaves": [inside[a] for a, _ in found]}).astype({"file": "int64", "at": "int64", "leaves": "int64"})


def reachable(candidates: DataFrame, rounds: int) -> DataFrame:
    """(file, at) of range entries that the chain from offset 0 passes, by pointer jumping."""
    entry = candidates.select("file", F.col("leaves").alias("at")).union(candidates.select("file", F.lit(0).cast("long"))).distinct()
    jump = written(candidates.join(entry, ["file", "at"]).select("file", "at", "leaves"), "warc-jump")
    reached = written(jump.select("file").distinct().select("file", F.lit(0).cast("long").alias("at")), "warc-reached")
    for _ in range(rounds):
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = written(reached.union(onward).distinct(), "warc-reached")
        further = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        jump = written(jump.join(further, ["file", "leaves"]).select("file", "at", F.col("far").alias("leaves")), "warc-jump")
    return reached


_RECORD = "path string, at long, id long, uri string, record_type string, digest string, refers_to long, payload_bytes long, payload binary"


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdecimal() else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, size, archive, at in zip(batch["path"], batch["start"], batch["size"], batch["archive"], batch["at"], strict=True):
                rows = []
                with _open(path) as f:
                    while start <= at < min(start + size, archive):
                        f.seek(at)
                        head = _header(_read_on(f, f.read(HEADER), 0), 0)
                        if head is None:
                            raise ValueError(f"{path}: no record at byte {at} of {archive}")
                        fields, begin = head
                        length = int(fields["content-length"])
                        f.seek(at + begin)
                        payload = f.read(length)
                        if at + begin + length + 4 > archive:
                            raise ValueError(f"{path}: the record at byte {at} goes beyond the archive's {archive} bytes")
                        rows.append((path, at, _number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], hashlib.sha1(payload).hexdigest() if fields["warc-type"] == "response" else fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("warc-refers-to")), len(payload), payload if with_payload else None))
                        at += begin + length + 4
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["path", "at", "id", "uri", "record_type", "digest", "refers_to", "payload_bytes", "payload"])
    return made.astype({"at": "int64", "id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(spark: SparkSession, folder: str, *, range_bytes: int = RANGE, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``folder``: where they are, their fields and payloads.

    digest is computed from the payload of a response and taken from the header of a
    revisit, whose payload is empty.  A chain that doesn't end where its archive ends is an error.
    """
    cut = written(ranges(spark, folder, range_bytes), "warc-ranges")
    total = cut.agg(F.count("*").alias("n"), F.max("archive").alias("largest")).first()
    spread = cut.repartition(max(1, min(total["n"], 10_000)), "path", "start")
    found = written(spread.mapInPandas(_exits, "file long, at long, leaves long"), "warc-candidates")
    many = -(-(total["largest"] or 1) // range_bytes)
    reached = reachable(found, max(1, (many - 1).bit_length()))
    # Where an archive begins is read whether or not it looks like a record, to tell if it doesn't.
    starts = cut.filter("start = 0").select("file", F.col("start").alias("at"))
    first = reached.union(starts).withColumn("start", F.floor(F.col("at") / range_bytes) * range_bytes)
    # The chain enters a range once: at the least reachable offset in it.
    entries = first.groupBy("file", "start").agg(F.min("at").alias("at")).join(cut, ["file", "start"]).select("path", "start", "size", "archive", "at")
    return written(entries, "warc-entries").repartition(max(1, min(total["n"], 10_000)), "path", "start").mapInPandas(_reader(with_payload), _RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests are of full payloads: those of a response come from the bytes read
    back, and a revisit takes the length of the response that it refers to.  An empty table
    gives an empty result.  Rows without a page_id have a null one.  Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder)
    records = written(read_archives(spark, folder, with_payload=False).select("id", "record_type", "digest", "refers_to", "payload_bytes"), "warc-records")
    stored = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'")
    asked = again.select(F.col("refers_to").alias("id")).distinct()
    full = stored.join(asked, "id", "left_semi").groupBy(F.col("id").alias("refers_to")).agg(F.max("payload_bytes").alias("full"))
    resolved = again.join(written(full, "warc-full"), "refers_to").select("id", "full", "digest", "record_type", "refers_to")
    every = stored.select("id", F.col("payload_bytes").alias("full"), "digest", "record_type", "refers_to").unionByName(resolved)
    return every.select(F.col("id").alias("page_id"), F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
