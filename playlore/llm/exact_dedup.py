"""Exact duplicates through an extendible-hash index kept as files in the shared folder.

Only DataFrame operations run here.  What travels for every row is its id, hash and digest;
texts travel only where their hash is shared.

1. *Directory.*  It starts with one slot, depth 0 and one bucket.  As long as a bucket has more
   rows than its capacity the directory doubles: every slot becomes two, those of an
   overfull bucket go to a bucket each, one bit deeper, and the other pairs share theirs.
2. *Owner tasks.*  A bucket is a range of hashes, and one task owns it.  Texts whose hash
   another row has too are sent to the owner, which chains what has one hash and compares
   texts byte by byte: equal ones are one entry of the chain, different ones are several.  A
   hash that very many rows share is dealt to several owners, whose entries are compared once more.
3. *Bucket files.*  The entries, sorted by bucket and hash, are the index.  Hashes of one row
   are entries without a comparison.

A row's answer is its entry: its bucket comes from the directory, its chain from the hash,
and within the chain it is told by the digest.  Rows and index are both written tables when
they are joined, so adaptive execution splits the partition of a hot text.

Which hashes are shared reaches the scan of the texts as a bitmap of bounded size; when it is
too small to tell, more texts travel and the result is the same.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, written

#: Rows that a bucket holds at least before it splits; buckets are meant to be at most ``BUCKETS``.
CAPACITY, BUCKETS = 8192, 1 << 16
#: Bits of a hash that the directory can tell apart, and rows up to which it is broadcast.
DEEPEST, BROADCAST_DIRECTORY_ROWS = 24, 1 << 18
#: Rows of one hash that one owner takes; at most ``HOT`` hashes can have more than the rows over ``HOT``.
OWNED, HOT = 1000, 1 << 17
#: Bits of the largest bitmap; a word of 64 bits is a row, so at most 2**20 rows are broadcast.
BITMAP = 1 << 26


class Index(NamedTuple):
    """Entries (bucket, h, text_sha256, keep_id, group_size), keys (doc_id, h, text_sha256), slots and their depth."""

    entries: DataFrame
    keys: DataFrame
    slots: DataFrame
    depth: int
    shared: DataFrame
    bits: int


def text_hash(body: Column) -> Column:
    """The 64-bit hash by which texts are placed; equal hashes don't make texts equal."""
    return F.xxhash64(body)


def _prefix(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory of an extendible-hash index over the different ``hashes(h, n)`` of n rows each, and its depth in bits.

    Returns rows (slot, depth, bucket): slot is a prefix of the returned depth, bucket the
    first slot of the bucket that holds it, and depth the bucket's own depth.
    """
    held = written(hashes.groupBy(_prefix(F.col("h"), DEEPEST).alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("k")), "dedup-held")
    slots, depth = hashes.sparkSession.range(1).select(F.col("id").alias("slot"), F.lit(0).alias("depth")), 0
    while depth < DEEPEST:
        sizes = held.groupBy(F.call_function("shiftright", "p", F.lit(DEEPEST - depth)).alias("slot")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        # A bucket that has fewer bits than the directory wasn't overfull before, so it isn't now.
        # One hash can't be split, however many rows it has.
        overfull = F.coalesce((F.col("n") > capacity) & (F.col("k") > 1), F.lit(False))
        seen = slots.join(sizes, "slot", "left").withColumn("over", (F.col("depth") == depth) & overfull)
        seen = written(seen.select("slot", "depth", "over"), "dedup-slots")
        if seen.filter("over").isEmpty():
            break
        doubled = F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot")
        slots, depth = seen.select(doubled, (F.col("depth") + F.col("over").cast("int")).alias("depth")), depth + 1
    unused = F.lit(depth) - F.col("depth")
    return written(slots.withColumn("bucket", F.call_function("shiftleft", F.call_function("shiftright", "slot", unused), unused)), "dedup-directory"), depth


def _in_bucket(hashed: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    hashed = hashed.withColumn("slot", _prefix(F.col("h"), depth))
    return hashed.join(F.broadcast(slots) if 1 << depth <= BROADCAST_DIRECTORY_ROWS else slots, "slot").drop("slot", "depth")


def _word(h: Column, bits: int) -> Column:
    return F.floor(F.pmod(h, F.lit(bits)) / 64)


def _bit(h: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.pmod(h, F.lit(bits)), F.lit(64)).cast("int"))


def _maybe_shared(hashed: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """``hashed(h, ...)`` with ``__again``: whether another row may have the hash."""
    marked = hashed.withColumn("__word", _word(F.col("h"), bits)).join(F.broadcast(shared), "__word", "left")
    return marked.withColumn("__again", F.coalesce(F.col("__mask").bitwiseAND(_bit(F.col("h"), bits)) != 0, F.lit(False))).drop("__word", "__mask")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> Index:
    """Bucket files of the different texts of ``docs``, and what it takes to look rows up in them."""
    body = fold_ascii(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("h", text_hash(F.col("body")))
    keys = written(rows.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256")), "dedup-keys")
    hashes = written(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "dedup-hashes")
    told = hashes.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("shared")).first()
    bits = min(BITMAP, 1 << max(10, (16 * told["shared"]).bit_length()))
    again = hashes.filter("n > 1")
    shared = written(again.groupBy(_word(F.col("h"), bits).alias("__word")).agg(F.bit_or(_bit(F.col("h"), bits)).alias("__mask")), "dedup-shared")
    # Fewer than HOT hashes can have more rows than this; of such a hash a bucket counts the rows of one owner.
    rows_in_all = told["rows"] or 0
    owned = max(OWNED, rows_in_all // HOT + 1)
    slots, depth = directory(hashes.select("h", F.least("n", F.lit(owned)).alias("n")), capacity or max(CAPACITY, -(-rows_in_all // BUCKETS)))
    hot = again.filter(F.col("n") > owned).select("h", F.ceil(F.col("n") / owned).alias("owners"))
    travel = _maybe_shared(rows, shared, bits).filter("__again").join(F.broadcast(hot), "h", "left")
    dealt = _in_bucket(travel, slots, depth).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("owners", F.lit(1).cast("long"))))
    # The exchange is by bucket and part, and chaining and comparing happen where it leads to.
    chained = dealt.repartition("bucket", "part").groupBy("bucket", "part", "h", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("owners").alias("owners"))
    entry = ["bucket", "h", "text_sha256", "keep_id", "group_size"]
    pieces = written(chained.select("bucket", "h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size", F.when(F.col("owners") > 1, F.col("body")).alias("body")), "dedup-chains")
    merged = pieces.filter("body IS NOT NULL").groupBy("bucket", "h", "body").agg(F.min("text_sha256").alias("text_sha256"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # The bitmap may let hashes of one row through; they have their entry from the keys already.
    single = written(_in_bucket(hashes.filter("n = 1"), slots, depth).select("bucket", "h", "text_sha256", "keep_id", F.lit(1).cast("long").alias("group_size")), "dedup-single")
    compared = pieces.filter("body IS NULL").select(*entry).unionByName(merged.select(*entry)).join(single.select("h"), "h", "left_anti")
    entries = compared.unionByName(single).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h")
    return Index(written(entries.select(*entry), "dedup-index"), keys, slots, depth, shared, bits)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as the
    empty one.  Of equal texts the row with the largest id stays.  Rows that repeat an id
    and its text are kept or dropped together.  A null id loses against any other; where all
    ids of a group are null, keep_id is null and the rows are kept.  An empty table gives an
    empty result.  Other columns of ``docs`` are not read.
    """
    made = build_index(docs, id_col=id_col, text_col=text_col, capacity=capacity)
    found = _in_bucket(made.keys, made.slots, made.depth).join(made.entries, ["bucket", "h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row whose hash is its own stays where it is.  The others meet the index's entries by
    digest and id, so that equal ids with different texts do not stand in for each other.
    Rows that repeat both the id and the text are one row afterwards.
    """
    made = build_index(docs, id_col=id_col, text_col=text_col, capacity=capacity)
    named = lambda sha, keep: F.concat_ws(":", sha, F.coalesce(keep.cast("string"), F.lit("")))
    stays = made.entries.select(named(F.col("text_sha256"), F.col("keep_id")).alias("__row"))
    columns = F.struct(*[F.col(c) for c in docs.columns]).alias("__kept")
    hashed = docs.select(columns, F.col(id_col).alias("__id"), fold_ascii(F.col(text_col)).alias("__body")).withColumn("h", text_hash(F.col("__body")))
    marked = _maybe_shared(hashed, made.shared, made.bits)
    again = marked.filter("__again").select("__kept", named(F.sha2("__body", 256), F.col("__id")).alias("__row"))
    left = again.join(stays, "__row", "left_semi").dropDuplicates(["__row"])
    return marked.filter("NOT __again").select("__kept.*").unionByName(left.select("__kept.*"))
