"""A Merkle manifest of a dataset whose parents keep the hash's state before each child.

Leaves are digests of rows.  Within a tree, every ``FAN`` consecutive nodes have as their
parent the SHA-256 of their digests as hex text.  A digest is 64 characters then, one block of
SHA-256, so the hash's state between two children is its eight words and nothing else.  A
parent keeps a copy of them before each child slot.  To fold a changed child, the state of
its slot is resumed with the replacement and the siblings to its right only.

Trees are built in rounds.  Each takes blocks of ``FAN ** LEVELS`` consecutive nodes, hashes the
levels inside a block for many blocks at once, and leaves one node a block to the next round.
The blocks with their states are tables.  On the way back each block is joined with the path
above it, which is short and common to all its leaves.

Leaves are put in order by ranges, so a tree that holds a third of all rows is spread over many
tasks; positions come from counts by part of the range and tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, bounded_batches, written

#: Children of a node, and levels of nodes that a block covers.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(p: int, power: int) -> int:
    """The first 32 bits of the fraction of p's square (2) or cube (3) root."""
    scaled, low, high = p << (32 * power), 0, p << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


#: SHA-256's first state and round constants, from the primes as its standard defines them.
FIRST = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
ROUNDS = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n words) after one more block each (16 x n words)."""
    w = np.empty((64, block.shape[1]), np.uint32)
    w[:16] = block
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10)))
    w += ROUNDS[:, None]
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


#: The two hex digits of each byte, as big-endian halves of a word.
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], np.uint32)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block (16 x n words) that holds the hex text of digests (n x 32 bytes)."""
    pairs = _HEX[digests]
    return np.ascontiguousarray((pairs[:, ::2] << np.uint32(16) | pairs[:, 1::2]).T)


def _closing(blocks: np.ndarray) -> np.ndarray:
    """The last block of messages of so many whole blocks."""
    made = np.zeros((16, len(blocks)), np.uint32)
    made[0] = 0x80000000
    made[15] = blocks * 512
    return made


def _digest(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def parents(children: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of nodes (n x 32) and their states before each child slot (n x FAN x 8 words).

    ``children`` is n x FAN x 32; the first ``counts`` of each row are there.
    """
    n = len(children)
    state = np.repeat(FIRST[:, None], n, axis=1)
    kept = np.zeros((n, FAN, 8), np.uint32)
    for slot in range(int(counts.max(initial=0))):
        kept[:, slot] = state.T
        there = counts > slot
        state = np.where(there, compress(state, hex_block(children[:, slot])), state)
    return _digest(compress(state, _closing(counts))), kept


def fold(states: np.ndarray, replacements: np.ndarray, right: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Digests of parents with one child replaced: the state before its slot is resumed.

    ``states`` is n x 8 words, ``right`` (n x FAN x 32) holds the siblings after the slot from
    place 0 on.
    """
    state = compress(np.ascontiguousarray(states.T), hex_block(replacements))
    following = counts - slots - 1
    for k in range(int(following.max(initial=0))):
        there = np.flatnonzero(following > k)
        state[:, there] = compress(state[:, there], hex_block(right[there, k]))
    return _digest(compress(state, _closing(counts)))


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and its text; a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest (binary) of a row's fields, in order."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def _grouped(solve: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``solve`` for batches of rows that come sorted by ``keys``; a group is never split between two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            fresh = _starts(rows, keys)
            last = int(fresh[-1])
            if last:
                yield solve(rows.iloc[:last])
            waiting = rows.iloc[last:]
        if waiting is not None and len(waiting):
            yield solve(waiting)

    return run


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new group begins in sorted rows; null keys are equal."""
    new = np.zeros(len(rows), bool)
    for k in keys:
        value = rows[k]
        before = value.shift()
        new |= ((value != before) & ~(value.isna() & before.isna())).to_numpy(bool)
    new[:1] = True
    return np.flatnonzero(new)


def positions(nodes: DataFrame, order: list[str], payload: list[str], name: str) -> DataFrame:
    """tree, digest, payload and ``pos`` of nodes: their place, from 0, in the order of their ``tree``.

    Rows are dealt by ranges of tree and order and numbered within each part; what a tree has
    in earlier parts is added to its rows in the first place of a part, for one tree a part.
    Equal rows have places in any order.
    """
    spark = nodes.sparkSession
    bounded_batches(spark, rows=20_000, size=16 << 20)
    keys = ["tree", *order]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).select("tree", "digest", *payload)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, tree, reached, head = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            starts = _starts(batch, ["tree"])
            nth = np.arange(len(batch)) - np.repeat(starts, np.diff(np.append(starts, len(batch))))
            same = int(starts[1]) if len(starts) > 1 else len(batch)
            opening = batch["tree"].iat[0]
            if reached is not None:
                if opening == tree or (pd.isna(opening) and pd.isna(tree)):
                    nth[:same] += reached
                else:
                    head = False
            yield batch.assign(part=part, nth=nth, head=head & (np.arange(len(batch)) < same))
            head = head and same == len(batch)
            tree, reached = batch["tree"].iat[-1], int(nth[-1]) + 1

    numbered = written(ranged.mapInPandas(number, f"{schema}, part int, nth long, head boolean"), name)
    counted = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.bool_or("head").alias("head"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each part of the range that holds rows: as many as tasks, not as rows.
    moved = counted.withColumn("earlier", earlier).filter("head and earlier > 0").select("part", F.lit(True).alias("head"), "earlier")
    return numbered.join(F.broadcast(moved), ["part", "head"], "left").select(*ranged.columns, (F.col("nth") + F.coalesce("earlier", F.lit(0))).alias("pos"))


def _bytes(values: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, width)


def _levels(digests: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The top digest of each block, and for each level the children, counts and states of its nodes.

    Blocks stand one after another in ``digests``; ``whole`` says which are all of their tree, and
    so have no more levels than it takes to leave one node.
    """
    levels, now, count = [], digests, sizes
    alone = whole
    for _ in range(LEVELS):
        block = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(now)) - np.repeat(np.cumsum(count) - count, count)
        nodes = np.where(alone & (count == 1), 1, -(-count // FAN))
        before = np.cumsum(nodes) - nodes
        parent = before[block] + place // FAN
        total = int(nodes.sum())
        children, held = np.zeros((total, FAN, 32), np.uint8), np.bincount(parent, minlength=total)
        children[parent, place % FAN] = now
        made, kept = parents(children, held)
        done = np.repeat(alone & (count == 1), nodes)
        made[done] = children[done, 0]
        held[done] = 0  # a node that is passed on
        levels.append((children, held, kept))
        now, count = made, nodes
    return now, levels


def _rounds(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """Tables of blocks, from the leaves up: tree, number, top, sizes and the levels' children and states.

    ``nodes`` has tree, pos, digest and payload columns, which go into arrays of the first round's blocks.
    """
    spark = nodes.sparkSession
    tree_type = nodes.schema["tree"].dataType.simpleString()
    rounds: list[DataFrame] = []
    while True:
        kinds = {c: nodes.schema[c].dataType.simpleString() for c in payload}
        schema = ", ".join([f"tree {tree_type}, number long, top binary, levels array<struct<children:binary,counts:array<int>,states:binary>>", *(f"{c} array<{k}>" for c, k in kinds.items())])

        def solve(rows: pd.DataFrame, payload: list[str] = payload, names: tuple[str, ...] = tuple(kinds)) -> pd.DataFrame:
            starts = _starts(rows, ["tree", "number"])
            sizes = np.diff(np.append(starts, len(rows)))
            first = rows.iloc[starts]
            # A first block that isn't full is its whole tree; a full one has all its levels either way.
            top, levels = _levels(_bytes(rows["digest"], 32), sizes, ((first["number"] == 0) & (sizes < BLOCK)).to_numpy())
            out = {"tree": first["tree"].to_numpy(), "number": first["number"].to_numpy(), "top": [t.tobytes() for t in top]}
            cut, count = [], sizes
            for children, held, kept in levels:
                nodes_of = -(-count // FAN)
                edges = np.append(0, np.cumsum(nodes_of))
                cut.append([{"children": children[a:b].tobytes(), "counts": held[a:b].tolist(), "states": kept[a:b].tobytes()} for a, b in zip(edges[:-1], edges[1:], strict=True)])
                count = nodes_of
            out["levels"] = [list(x) for x in zip(*cut, strict=True)]
            bounds = np.append(starts, len(rows))
            for c in names:
                values = rows[c].astype(object).where(rows[c].notna(), None).tolist()
                out[c] = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return pd.DataFrame(out)

        dealt = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("number"), "pos", "digest", *payload).repartition("tree", "number").sortWithinPartitions("tree", "number", "pos")
        bounded_batches(spark, rows=8192, size=8 << 20)
        blocks = written(dealt.mapInPandas(_grouped(solve, ["tree", "number"]), schema), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        if not blocks.agg(F.max("number")).first()[0]:
            return rounds
        nodes, payload = blocks.select("tree", F.col("number").alias("pos"), F.col("top").alias("digest")), []


_STEP = "array<struct<slot:int,count:int,state:binary,children:binary>>"


def _unpacked(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level of many blocks: children, counts and states of its nodes, and where each block's nodes begin."""
    out = []
    for level in range(LEVELS):
        nodes = [x[level] for x in rows["levels"]]
        counts = [np.asarray(x["counts"], np.int64) for x in nodes]
        first = np.cumsum([0, *map(len, counts)])[:-1]
        children = _bytes(pd.Series([x["children"] for x in nodes]), 32).reshape(-1, FAN, 32)
        states = np.frombuffer(b"".join(x["states"] for x in nodes), np.uint32).reshape(-1, FAN, 8)
        out.append((children, np.concatenate(counts), states, first))
    return out


def _sizes(rows: pd.DataFrame) -> np.ndarray:
    """Nodes at the bottom of each block: a node that is passed on is one."""
    return np.array([max(sum(x[0]["counts"]), 1) for x in rows["levels"]])


def _below(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """A row for each node at the bottom of blocks: tree, pos, digest, payload, and its path to the root."""
    carried = ["root", "subroot"]
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in payload}
    schema = ", ".join([f"tree {blocks.schema['tree'].dataType.simpleString()}, pos long, digest binary", *(f"{c} {k}" for c, k in kinds.items()), f"path {_STEP}, root binary, subroot binary"])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            levels = _unpacked(rows)
            out = []
            for b, size in enumerate(_sizes(rows).tolist()):
                row = rows.iloc[b]
                for j in range(size):
                    path, at = [], j
                    for children, counts, states, first in levels:
                        node, slot = first[b] + at // FAN, at % FAN
                        if counts[node]:
                            path.append({"slot": slot, "count": int(counts[node]), "state": states[node, slot].tobytes(), "children": children[node, : counts[node]].tobytes()})
                        at //= FAN
                    digest = levels[0][0][levels[0][3][b] + j // FAN, j % FAN].tobytes()
                    out.append((row["tree"], int(row["number"]) * BLOCK + j, digest, *(row[c][j] for c in kinds), [*path, *row["path"]], *(row[c] for c in carried)))
            yield pd.DataFrame(out, columns=["tree", "pos", "digest", *kinds, "path", *carried])

    return blocks.mapInPandas(told, schema)


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's blocks with their ``path``, ``root`` and ``subroot``, which ``above`` has for the last round's."""
    for lower in reversed(rounds[:-1]):
        nodes = _below(above, []).select(F.col("tree").alias("_tree"), "pos", "path", "root", "subroot")
        above = lower.join(nodes, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("number") == F.col("pos"))).drop("_tree", "pos")
    return above


def _folded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Leaves of some blocks, the roots folded from their replacements, and the digests of their proofs."""
    levels, sizes = _unpacked(rows), _sizes(rows)
    block = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    children, _, _, first = levels[0]
    leaves = children[first[block] + place // FAN, place % FAN]
    changed = [x for own in rows["changed"] for x in own]
    now = leaves.copy()
    for i, x in enumerate(changed):
        if x is not None:
            now[i] = np.frombuffer(x, np.uint8)
    siblings, at = [], place
    for children, counts, states, first in levels:
        node, slot = first[block] + at // FAN, at % FAN
        live = np.flatnonzero(counts[node])
        now[live] = _resumed(now[live], children[node[live]], states[node[live], slot[live]], slot[live], counts[node[live]])
        # What stands beside a node is the same for all leaves under it.
        beside = {(n, s): _beside(children[n], int(counts[n]), s) for n, s in set(zip(node.tolist(), slot.tolist(), strict=True))}
        siblings.append([beside[key] for key in zip(node.tolist(), slot.tolist(), strict=True)])
        at = at // FAN
    paths = [list(p) for p in rows["path"]]
    for depth in range(max(map(len, paths), default=0)):
        with_it = np.array([len(p) > depth for p in paths])
        steps = [p[depth] if len(p) > depth else None for p in paths]
        padded = np.zeros((len(paths), FAN, 32), np.uint8)
        state, slot, count = np.zeros((len(paths), 8), np.uint32), np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        for b, step in enumerate(steps):
            if step is not None:
                slot[b], count[b] = step["slot"], step["count"]
                padded[b, : count[b]] = np.frombuffer(step["children"], np.uint8).reshape(-1, 32)
                state[b] = np.frombuffer(step["state"], np.uint32)
        live = np.flatnonzero(with_it[block])
        own = block[live]
        now[live] = _resumed(now[live], padded[own], state[own], slot[own], count[own])
    upper = [b"".join(_beside(np.frombuffer(s["children"], np.uint8).reshape(-1, 32), s["count"], s["slot"]) for s in p) for p in paths]
    proofs = [hashlib.sha256(b"".join(parts) + upper[b]).hexdigest() for b, *parts in zip(block.tolist(), *siblings, strict=True)]
    return leaves, now, proofs


def _beside(children: np.ndarray, count: int, slot: int) -> bytes:
    """The siblings of a slot, as hex text."""
    text = children[:count].tobytes().hex().encode()
    return text[: 64 * slot] + text[64 * (slot + 1) :]


def _resumed(now: np.ndarray, children: np.ndarray, states: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parents of replaced children, from the states before their slots and what is right of them."""
    if not len(now):
        return now
    beyond = np.minimum(slots[:, None] + 1 + np.arange(FAN), FAN - 1)
    return fold(states, now, np.take_along_axis(children, beyond[:, :, None], 1), slots, counts)


_VERIFIED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame) -> DataFrame:
    """Trees over ``leaves``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each.

    ``leaves`` has ``tree`` (a string or null), ``doc_id`` (long or null), ``digest`` (binary)
    and ``changed``, the digest that stands for the leaf when it is folded (null: its own).
    Within a tree leaves go by doc_id, null first, and equal ids by digest.  A leaf alone is its
    tree's root; trees go by name in UTF-8, null first, and their roots make one more tree.
    ``proof_sha256`` is over the siblings on the way up; ``verified`` says that folding gives root.
    """
    spark = leaves.sparkSession
    placed = positions(leaves.withColumn("id", F.col("doc_id").cast("string")), ["doc_id", "digest"], ["id", "changed"], "merkle-leaves")
    rounds = _rounds(placed, ["id", "changed"], "merkle-blocks")
    roots = rounds[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("top").alias("digest"))
    tops = _rounds(positions(roots, ["source"], ["source"], "merkle-roots"), ["source"], "merkle-tops")
    bounded_batches(spark, rows=32, size=8 << 20)
    nothing = F.expr(f"CAST(array() AS {_STEP})")
    highest = tops[-1].withColumn("path", nothing).withColumn("root", F.col("top")).withColumn("subroot", F.lit(None).cast("binary"))
    known = _below(_descend(tops, highest), ["source"]).select("source", "path", "root", F.col("digest").alias("subroot"))
    blocks = _descend(rounds, rounds[-1].join(known, F.col("tree").eqNullSafe(F.col("source"))).drop("source"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own, now, proofs = _folded(rows)
            per = _sizes(rows)
            root = [r for r, n in zip(rows["root"], per, strict=True) for _ in range(n)]
            yield pd.DataFrame({
                "id": [x for own_ids in rows["id"] for x in own_ids],
                "leaf": [x.tobytes().hex() for x in own],
                "subroot": [r.hex() for r, n in zip(rows["subroot"], per, strict=True) for _ in range(n)],
                "root": [r.hex() for r in root],
                "proof_sha256": proofs,
                "folded_root": [x.tobytes().hex() for x in now],
                "verified": [x.tobytes() == r for x, r in zip(now, root, strict=True)],
            })

    told = blocks.select("levels", "id", "changed", "path", "root", "subroot").mapInPandas(verified, _VERIFIED)
    return told.select(F.col("id").cast("long").alias("doc_id"), *(c.split()[0] for c in _VERIFIED.split(", ")[1:]))


#: The columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Leaves of documents, by source.  ``changed`` says for which rows a changed text is folded: A-Z in lower case.

    Null values count as such, also a null source or id; other columns are not read; rows that
    repeat are leaves each, and an empty table has none.
    """
    own = [F.col(c) for c in FIELDS]
    tampered = [*own[:-1], F.translate("text", UPPER, UPPER.lower())]
    digest = F.when(F.lit(False) if changed is None else changed, leaf_digest(tampered))
    made = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("digest"), digest.alias("changed"))
    return written(made, "merkle-digests")


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of documents; one in five, by the CRC-32 of its id's digits, is folded with its text tampered with."""
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(document_leaves(docs, F.coalesce(picked, F.lit(False))))
