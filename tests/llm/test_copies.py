"""Exact and near duplicates, neighbours, archives, packing, personal data."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playlore.llm import ann, components, exact_dedup, near_dedup, packing, pii, quality, warc
from playlore.llm.common import new_folder

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOC = "doc_id long, text string"


def _roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("capacity", "hash_values", "owned"), [(2, None, 50_000), (None, None, 3), (1, 3, 50_000), (4, 1, 5)])
def test_exact_groups_by_brute_force(spark, monkeypatch, capacity, hash_values, owned):
    """With few hash values the chains hold texts that differ, and only their bytes tell them apart."""
    monkeypatch.setattr(exact_dedup, "OWNED", owned)
    if hash_values:
        monkeypatch.setattr(exact_dedup, "text_hash", lambda body: F.shiftleft(F.pmod(F.xxhash64(body), F.lit(hash_values)), 60))
    rng = random.Random(3)
    pool = ["", None, "A b", "a B", "É", "é", "x" * 50_000, "X" * 50_000, "K", "k", *map(str, range(30))]
    texts = [rng.choice(pool) for _ in range(200)]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC + ", h int, body string")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, capacity=capacity).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(UPPER)].append(i)
    assert len(got) == 200
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs, capacity=capacity)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(max, groups.values())) and kept.columns == docs.columns


def test_exact_with_null_ids_repeats_and_nothing(spark):
    rows = [(None, "a"), (None, "A"), (5, "b"), (5, "b"), (None, "b")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 2, True), (0, 0, 2, True), (0, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, DOC)).count() == 2
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_directory_doubles_where_buckets_are_overfull(spark):
    hashes = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("n"))
    crowd = spark.range(1000).select(F.shiftrightunsigned(F.xxhash64("id"), 6).alias("h"), F.lit(1).alias("n"))  # all begin with six zeros
    slots, bits = exact_dedup.directory(hashes.union(crowd), 300)
    rows = slots.collect()
    assert bits > 6 and sorted(r.slot for r in rows) == list(range(1 << bits))
    assert all(r.bucket == r.slot >> (bits - r.depth) << (bits - r.depth) for r in rows)
    held = {r.bucket: r["count"] for r in hashes.union(crowd).select(F.shiftrightunsigned("h", 64 - bits).alias("slot")).join(slots, "slot").groupBy("bucket").count().collect()}
    assert max(held.values()) <= 300 and len({r.depth for r in rows}) > 1
    # No bucket was split for nothing: each pair of buckets of one parent holds more than a bucket may.
    depth = {r.bucket: r.depth for r in rows}
    for b, d in depth.items():
        sibling = b ^ (1 << (bits - d)) if d else None
        if sibling in depth and depth[sibling] == d:
            assert held.get(b, 0) + held.get(sibling, 0) > 300
    assert exact_dedup.directory(hashes.limit(0), 300)[1] == 0


def test_exact_groups_come_from_the_bucket_files(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], DOC)
    made = exact_dedup.build_index(docs, capacity=1)
    assert made.depth > 0 and {(r.keep_id, r.group_size) for r in made.entries.collect()} == {(2, 2), (3, 1)}
    assert made.entries.select("bucket").distinct().count() == 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == _roots(nodes, edges)


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _brute(rows, least=85):
    sets = _sets(rows)
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    edges = []
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                edges.append((i, j))
    return sets, _roots(sets, edges)


def _near_rows():
    """Groups of texts at all distances from a base, so that some only link through others."""
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(5000)
    rows, i = [], 0
    for size in (1, 2, 40, 150):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                base = copy
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "a b"), (i + 3, "A  b"), (i + 4, "a b c"), (i + 5, " \t\n"), (i + 6, "long " * 30_000)]
    return rows


def test_near_duplicates_by_brute_force(spark):
    rows = _near_rows()
    sets, roots = _brute(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in sets if got[i].component_id != roots[i]]
    assert not wrong
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (roots[i] == i) for i in sets)
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOC))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = _near_rows()
    roots = _brute(rows)[1]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == roots


def test_near_duplicates_without_ids_or_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_near_duplicates_where_an_id_has_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near, unique = base.replace("w50", "x"), " ".join(f"u{i}" for i in range(100))
    rows = [(3, base, 1), (5, base, 1), (5, unique, 1), (7, near, 1), (3, near, 1), (5, "", 1), (None, base, 1)]
    docs = spark.createDataFrame(rows, DOC + ", component_id int")
    kept = sorted((r.doc_id or 0, r.text[:2]) for r in near_dedup.drop_near_duplicates(docs).collect())
    assert len(kept) == 4 and kept[0] == (0, "w0") and kept[1][0] == 3 and kept[2:] == [(5, ""), (5, "u0")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 96, 0), (3, 96, 3), (3, 96, 3), (5, 0, 5), (5, 96, 3), (5, 96, 5), (7, 96, 3)]


def test_near_copies_from_four_fifths_leave_the_pipeline(spark):
    import corpus_pipeline

    assert near_dedup.tensoring(85)[1:] == (14, 33)
    # 104 words of which the last 10 (11 or 12) differ: 90 (89, 88) of 110 (111, 112) shingles are shared.
    rows = []
    for i in range(60):
        base, other = [f"b{i}w{k}" for k in range(104)], [f"c{i}w{k}" for k in range(104)]
        n = 10 + i % 3
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-n] + other[-n:]))]
    docs = spark.createDataFrame(rows, DOC)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    # 90 / 110 = 0.82 and 89 / 111 = 0.802 go; 88 / 112 = 0.79 stays, and so does all at 0.85.
    assert kept == {i for i in range(120) if i % 2 == 0 or i // 2 % 3 == 2}
    assert all(r.kept for r in near_dedup.near_duplicates(docs).collect())


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[200:260] = v[200]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(table, block_rows=1200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = v.astype(float)
    assert set(got) == set(range(0, 1500, 20))
    hits = []
    for q in got:
        score = x @ x[q]
        want = [j for j in np.lexsort((np.arange(len(x)), -np.round(score, 9))) if j != q][:20]
        hits.append(len(set(want) & {j for j, _ in got[q]}) / 20)
        assert len(got[q]) == 20 and all(abs(s - score[j]) < 1e-9 for j, s in got[q])
    assert np.mean(hits) >= 0.9
    same = [j for j, _ in got[200]][:20]
    assert same == list(range(201, 221))
    assert ann.nearest(table.limit(0)).count() == 0


def test_neighbours_through_the_index(spark):
    """Blocks of which the windows leave most out: no answer comes from reading a block whole."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((12_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = ann.BlockIndex(v[:6000], 13)
    read = [len(index.candidates(q, max(ann.WANTED * 20, int(ann.SHARE * 6000)))) / 6000 for q in v[:400:20]]
    assert np.mean(read) < 0.12 and max(read) < 0.3
    table = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(table, every=100, block_rows=6000).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, 12_000, 100):
        score = v @ v[q]
        score[q] = -9
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert len(got) == 120 and np.mean(hits) >= 0.9


def test_neighbours_count_few_collisions(monkeypatch):
    """A query reads far fewer entries of the arrays than a comparison with every vector has steps."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((8000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index, read = ann.BlockIndex(v, 13), []
    count = np.bincount
    monkeypatch.setattr(ann.np, "bincount", lambda x, **rest: (read.append(len(x)), count(x, **rest))[1])
    found = [index.candidates(q, int(ann.SHARE * 8000)) for q in v[:100]]
    assert sum(read) / 100 < 4 * 8000 and all(len(f) < 0.3 * 8000 for f in found)


def test_neighbours_in_more_blocks_verify_fewer_candidates():
    """The part of the nearest that a block has to find tells how many candidates are enough, whatever the vectors are like."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((3, 32))
    for v in (rng.standard_normal((6000, 32)), centres[rng.integers(0, 3, 6000)] + 0.1 * rng.standard_normal((6000, 32))):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        index, wanted = ann.BlockIndex(v, 13), []
        for near in (20, 2):
            index.tune(near, 21, np.arange(0, 6000, 20))
            wanted.append(index.wanted)
            hits = []
            for q in range(10, 6000, 60):
                score = v @ v[q]
                score[q] = -9
                at, _ = index.best(v[q], index.candidates(v[q], index.wanted), 21)
                hits.append(len(set(at.tolist()) & set(np.argsort(-score)[:near].tolist())) / near)
            assert np.mean(hits) >= 0.9
        assert 21 <= wanted[1] <= wanted[0]
        assert wanted[1] < wanted[0] or wanted[0] > 1000


def test_neighbours_of_each_length_and_of_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(200)] + [(1000, [1.0] * 5), (1020, [2.0] * 5), (1040, [1e200, 0.0, 1e200]), (1041, [1e-200, 1e-200, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = Counter(r.query_id for r in got)
    assert all(by[q] == 20 for q in range(0, 200, 20)) and by[1000] == by[1020] == by[1040] == 1
    assert {(r.query_id, r.vec_id, r.score) for r in got if r.query_id >= 1000} == {(1000, 1020, 10.0), (1020, 1000, 10.0), (1040, 1041, 1.0)}


MAGIC = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("size", [400, 5000, 1 << 20])
def test_archives_reject_magic_inside_payloads(spark, size):
    rows = [(i, f"http://a/{i}", MAGIC * (i % 5) + "é" * (i % 40)) for i in range(120)] + [(500, None, None), (501, "u\r\nX: y", MAGIC * 60), (502, "u", MAGIC * 60)]
    folder = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.id: r for r in warc.read_archives(spark, folder, range_bytes=size).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[i]
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (html or "")
    assert (got[501].record_type, got[501].refers_to) == ("revisit", 502) and got[502].record_type == "response"


@pytest.mark.parametrize("size", [5000, 1 << 20])
def test_archives_with_addresses_of_any_length(spark, size):
    rows = [(i, "data:" + "x" * (300_000 if i % 7 == 3 else 65_480 + i), f"page {i} " + MAGIC * (i % 3)) for i in range(30)]
    folder = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    got = {r.id: (r.uri, bytes(r.payload).decode()) for r in warc.read_archives(spark, folder, range_bytes=size).collect()}
    assert got == {i: (url, html) for i, url, html in rows}


@pytest.mark.parametrize("text", ["no record", MAGIC[5:] + "no record", MAGIC[5:-8]])
def test_archives_that_end_early_are_an_error(spark, text):
    folder = new_folder(spark, "warc-test")
    spark.createDataFrame([(text,)], "value string").write.option("lineSep", "\n").text(folder)
    with pytest.raises(Exception, match="no record at byte|goes beyond"):
        warc.read_archives(spark, folder).collect()


def test_archives_of_nothing_and_of_short_equal_pages(spark):
    shape = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], shape)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(1, "u", "ab", 1), (2, "u", "ab", 1), (None, "u", "x", 1), (None, None, None, 1)], shape + ", id int")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, 0, "response", None), (0, 1, "response", None), (1, 2, "response", None), (2, 2, "response", None)]


def test_archives_of_pages_without_ids_and_of_repeated_ones(spark):
    long, other = "y" * 1000, "z" * 1000
    rows = [(None, long), (None, long), (3, long), (3, long), (9, long), (None, other), (None, other), (5, "é" * 499), (6, "é" * 499), (7, "é" * 500), (8, "é" * 500)]
    got = warc.round_trip(spark.createDataFrame([(i, "u", t, "d", "k") for i, t in rows], "page_id long, url string, html string, digest string, payload string")).collect()
    want = [(0, 1000, "response", 0)] * 2 + [(0, 1000, "revisit", 9)] * 2 + [(3, 1000, "revisit", 9)] * 2 + [(5, 998, "response", 0), (6, 998, "response", 0), (7, 1000, "revisit", 8), (8, 1000, "response", 0), (9, 1000, "response", 0)]
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == want
    assert {r.payload_digest for r in got if r.page_id in (7, 8)} == {hashlib.sha1(("é" * 500).encode()).hexdigest()}


def test_packing_places_everything_once(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 100, 255, 256, 257, 5000, 9000]))) for i in range(300)] + [(1000, None), (None, "a b"), (7000, "x y"), (7000, "x y")]
    got = packing.pack(spark.createDataFrame(rows, DOC), group_rows=200).collect()
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split())
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r["size"]
        bins[r.bin].append(r)
    assert have == Counter({k: v for k, v in want.items() if v})
    sizes = packing.Sizes()
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r["size"]
        assert {r.capacity for r in held} == {sizes.downsized(at)}
    again = packing.pack(spark.createDataFrame(rows, DOC).repartition(7), group_rows=200)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0


def test_rows_that_repeat_are_dealt_over_all_groups(spark):
    rows = [(None, "a b c")] * 3000 + [(5, "a b")] * 3000 + [(i, "a") for i in range(100, 400)]
    got = packing.pack(spark.createDataFrame(rows, DOC).repartition(3), group_rows=200).collect()
    groups = Counter(r.bin.split("-")[0] for r in got)
    assert len(got) == 6300 and len(groups) == 32 and max(groups.values()) < 300
    assert Counter((r.doc_id, r["size"]) for r in got if r.doc_id is None or r.doc_id == 5) == {(None, 3): 3000, (5, 2): 3000}


def test_best_fit_takes_the_tightest_bin_and_downsizes():
    sizes = packing.Sizes(lengths=(4, 8), fixed=0.0, pairs=1e9)
    bins, offsets, capacity = packing.pack_with([7, 5, 3, 1], sizes, 8)
    assert bins[0] != bins[1] and bins[2] == bins[1] and bins[3] == bins[0] and capacity == [8, 8]
    assert packing.best_fit([3], sizes)[2] == [4]


def test_lengths_are_chosen_jointly_and_near_the_optimum():
    """Against all ways of dealing out a few pieces."""
    rng = random.Random(15)

    def least(sizes, permitted, held=()):
        if not sizes:
            return sum(permitted.cost(permitted.downsized(h)) for h in held)
        tried = [least(sizes[1:], permitted, (*held, sizes[0]))]
        for i, h in enumerate(held):
            if h + sizes[0] <= max(permitted.lengths):
                tried.append(least(sizes[1:], permitted, (*held[:i], h + sizes[0], *held[i + 1 :])))
        return min(tried)

    ratios = []
    for _ in range(150):
        permitted = packing.Sizes(lengths=(8, 12, 20, 32), fixed=rng.choice([0.5, 3.0, 10.0]), pairs=rng.choice([8.0, 64.0, 1e6]))
        sizes = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 7))), reverse=True)
        bins, offsets, capacity = packing.best_fit(sizes, permitted)
        held = Counter()
        for b, o, n in zip(bins, offsets, sizes, strict=True):
            assert o == held[b]
            held[b] += n
        assert capacity == [permitted.downsized(held[b]) for b in range(len(capacity))]
        ratios.append(sum(map(permitted.cost, capacity)) / least(sizes, permitted))
    assert max(ratios) < 1.35 and np.mean(ratios) < 1.03 and np.mean([r < 1 + 1e-9 for r in ratios]) > 0.75
    # The dear pairs of long bins and the dear start of short ones lead to different lengths for the same pieces.
    pieces = [8] * 12
    assert set(packing.best_fit(pieces, packing.Sizes(lengths=(8, 32), fixed=0.1, pairs=8.0))[2]) == {8}
    assert set(packing.best_fit(pieces, packing.Sizes(lengths=(8, 32), fixed=50.0, pairs=1e9))[2]) == {32}


def test_sequences_hold_all_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, f"text number {i} " * (i * 7 % 50), "t") for i in range(80)] + [(None, "no id"), (None, "no id"), (5, "another five"), (90, None), (91, ""), (92, "long words " * 9000)]
    docs = spark.createDataFrame([(r[0], r[1], "t") for r in rows], DOC + ", tokens string").repartition(3)
    got = packing.sequences(docs, path, group_rows=40).collect()
    back = defaultdict(dict)
    sizes = packing.Sizes()
    for r in got:
        assert r.used == len(r.tokens) <= r.capacity == sizes.downsized(r.used)
        for i, (row, doc, piece, start) in enumerate(zip(r.rows, r.doc_ids, r.pieces, r.starts, strict=True)):
            stop = r.starts[i + 1] if i + 1 < len(r.starts) else r.used
            back[row, doc][piece] = r.tokens[start:stop]
    texts = sorted((doc or -1, [t for k in sorted(p) for t in p[k]]) for (_, doc), p in back.items())
    assert texts == sorted((i or -1, lib.encode(t, add_special_tokens=False).ids) for i, t, *_ in rows if t)
    assert packing.sequences(docs.limit(0), path).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    d = re.sub("[^0-9]", "", m)
    if kind == "phone":
        return 9 <= len(d) <= 15
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return 12 <= len(d) <= 19 and total % 10 == 0


def test_base_spans_by_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "a@b.c.d%x@y.z q@w.e, ..@a-.b", "1.2.3.4.5.6.7.8 0001.2.3.4 999.1.1.1.1.1", "4111 1111-1111 1111 4111111111111111x " + "4" * 25, "+1 (555) 123-4567. ++123456789 +1-----2", "12 34 " * 2000, "a" * 30_000 + "@b.co"]
    texts += ["".join(rng.choice("0123456789 .-+@ab()é") for _ in range(rng.randrange(120))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], DOC + ", base string, body string")
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    kinds = list(PATTERNS)
    for i, t in enumerate(texts):
        found = sorted((m.start(), kinds.index(k), m.end()) for k in kinds for m in re.finditer(PATTERNS[k], t or "") if _valid(k, m[0]))
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
        assert hashlib.sha256(listed.encode()).hexdigest() == got[i].base_sha256, t
        assert [got[i]["n_" + k] for k in kinds] == [sum(x == j for _, x, _ in found) for j in range(4)]


def test_terms_that_give_a_value_away(spark):
    rows = [(i, f"report word{i} from zebulon about jo@x.org on day {i * 7} the end of it") for i in range(8)]
    rows += [(100 + i, f"the day was long and the report of {i} was about the end") for i in range(200)]
    rows += [(500, "zebulon stands alone"), (501, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], DOC + ", n_chars long")
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    marked = {rows[i][1][int(s.split(":")[1]) : int(s.split(":")[2])] for i in range(8) for s in got[i].spans.split(",")}
    assert "zebulon" in marked and "jo@x.org" in marked and not {"the", "report", "day", "about"} & marked
    assert got[100].spans == got[501].spans == ""
    # Eight of nine texts with the word are the value's, so it tells where the value isn't written, too.
    assert got[500].spans in ("removed:0:7", "term:0:7")
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "zebulon" not in clean[3].text and "[EMAIL]" in clean[3].text and clean[3].n_chars == len(clean[3].text)
    assert clean[100].text == rows[8][1] and clean[501].text is None


def test_terms_from_six_tenths_are_generalised_and_from_nine_removed(spark):
    rows = [(i, f"item{i} quorvath zebulon jo@x.org number{i} here") for i in range(10)]
    rows += [(i, f"zebulon stands alone {i}") for i in range(10, 40)] + [(i, f"quorvath stands alone {i}") for i in range(40, 44)]
    rows += [(i, f"something else {i}") for i in range(44, 1000)]
    got = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(rows, DOC)).collect()}
    # Shares log(1000 / 40) / log(1000 / 10) = 0.70 and log(1000 / 14) / log(1000 / 10) = 0.93.
    assert {"removed:6:14", "term:15:22"} <= set(got[3].split(","))
    # Ten of fourteen texts with the one word hold the value, ten of forty with the other.
    assert got[41] == "removed:0:8" and got[20] == ""


def test_running_totals_of_any_length(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.range(1).select(pii._running(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: x.cast("int")))).first()[0]
        assert got == np.cumsum(np.arange(n + 1)).tolist()
    assert spark.range(1).select(pii._running(F.array().cast("array<int>"))).first()[0] == []


def test_texts_of_very_many_matches(spark):
    text = "a@b.co 1.2.3.4 " * 4000
    docs = spark.createDataFrame([(1, text)], DOC)
    r = pii.pii_spans(docs).first()
    listed = ",".join(f"email:{15 * i}:{15 * i + 6},ip:{15 * i + 7}:{15 * i + 14}" for i in range(4000))
    assert (r.n_email, r.n_ip) == (4000, 4000) and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_copies_of_a_text_do_not_hide_its_terms(spark):
    texts = [f"item{i} zebulon jo@x.org number{i} here" for i in range(3)]
    rows = [(i, texts[0]) for i in range(1000)] + [(1000, texts[1]), (1001, texts[2])]
    rows += [(i, f"something else {i}") for i in range(1002, 3000)]
    got = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(rows, DOC)).collect()}
    assert all("removed:6:13" in got[i] for i in (0, 999, 1000, 1001))


def test_terms_at_the_ends_of_texts_and_far_from_the_value(spark):
    rows = [(i, f"item{i} on a@b.co John Smith") for i in range(4)] + [(10 + i, f"Alice Brown: c@d.co in item{i}") for i in range(4)]
    rows += [(20 + i, "Initech wrote. " + f"plain{i} words " * 60 + "to e@f.co") for i in range(4)]
    rows += [(30, " and ".join(f"near g@h.co globex far{i}" + " so on" * 40 for i in range(3)) + " hapax")]
    rows += [(i, f"plain words and something else {i}") for i in range(100, 1000)]
    got = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(rows, DOC)).collect()}
    marked = {i: {t[int(x[1]) : int(x[2])] for s in got[i].split(",") if (x := s.split(":")) and x[0] in ("term", "removed")} for i, t in rows if got[i]}
    assert {"John", "Smith"} <= marked[3] and {"Alice", "Brown"} <= marked[13] and "Initech" in marked[23]
    assert not {"words", "item3"} & (marked[3] | marked[13] | marked[23])
    assert "globex" in marked[30] and "hapax" not in marked[30]


def test_sanitising_keeps_rows_and_columns(spark):
    rows = [(None, "a@b.cc", "x", "y"), (1, "a@b.cc +1 555 123 4567", "x", "y"), (1, "a@b.cc +1 555 123 4567", "x", "y"), (2, "", "x", "y")]
    docs = spark.createDataFrame(rows, DOC + ", base string, value string")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == 4
    assert sorted(r.text for r in got.collect()) == ["", "[EMAIL]", "[EMAIL] [PHONE]", "[EMAIL] [PHONE]"]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_pipeline_stages_keep_the_documents_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    held = Counter()
    for r in made:
        for i, doc in enumerate(r.doc_ids):
            held[doc] += (r.starts[i + 1] if i + 1 < len(r.starts) else r.used) - r.starts[i]
    assert held == {r.doc_id: n for r in docs.collect() if (n := len(lib.encode(r.text or "", add_special_tokens=False).ids))}


def _masked(text):
    """The text with base matches replaced; of overlapping ones the first is."""
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if _valid(kind, m[0]))
    out, at = "", 0
    for start, k, end in found:
        if start >= at:
            out += text[at:start] + f"[{list(PATTERNS)[k].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.fit(docs, labels).astype(np.float32)
    texts = {}
    for r in docs.collect():
        at, values = quality.features(r.text)
        if 1 / (1 + np.exp(-float(weights[at] @ values))) >= 0.3:
            texts[r.doc_id] = r.text or ""
    last = {}
    for i in sorted(texts):
        last[texts[i].translate(UPPER)] = i
    rows = sorted((i, texts[i]) for i in last.values())
    sets, roots = _brute(rows, 80)
    rows = [(i, t) for i, t in rows if roots[i] == i]
    risky = {r.term for r in pii.risky_terms(spark.createDataFrame(rows, DOC)).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, sf).collect():
        for i, doc in enumerate(r.doc_ids):
            pieces[doc][r.pieces[i]] = r.tokens[r.starts[i] : r.starts[i + 1] if i + 1 < len(r.starts) else r.used]
    made = {doc: lib.decode([t for k in sorted(p) for t in p[k]], skip_special_tokens=False) for doc, p in pieces.items()}
    assert set(made) == {i for i, t in rows if t}
    plain = [(i, t) for i, t in rows if t and not risky & set(re.findall(r"\w+", t.lower()))]
    assert len(plain) > 0.7 * len(rows) and all(made[i] == _masked(t) for i, t in plain)


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    shape = "doc_id long, text string, lang string, source string, n_chars int, h string, tokens string, component_id string"
    odd = [(None, "plain words that nobody rejects at all", "en", "s", 38, "h", "t", "c"), (1, None, "en", "s", 0, "h", "t", "c"), (2, "", None, None, None, None, None, None), (3, "same text here", "en", "s", 14, "h", "t", "c"), (3, "other text there", "en", "s", 16, "h", "t", "c"), (4, "Same text here", "en", "s", 14, "h", "t", "c")]
    for name, rows in (("none", []), ("odd", odd)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        made = corpus_pipeline.run(spark, folder).collect()
        assert sorted((i is None, i) for r in made for i in r.doc_ids) == ([(False, 3), (False, 4), (True, None)] if rows else [])
