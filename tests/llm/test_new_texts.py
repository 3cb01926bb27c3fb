"""Periodic runs, the merge transducer and the Merkle manifest against brute force and the library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from playlore.llm import bpe_fst, merkle, periodic

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, source string, lang string, n_chars int, text string, word_runs string"


def _by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# ---- periodic runs


def _runs_by_force(words, shortest, repeats):
    found = []
    for period in range(1, len(words) // repeats + 1):
        i = 0
        while i + period < len(words):
            if words[i] != words[i + period]:
                i += 1
                continue
            end = i
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - i + period
            stretch = words[i : i + length]
            if length >= max(shortest, repeats * period) and not any(stretch[d:] == stretch[: length - d] for d in range(1, period)):
                found.append((i, length, period))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repetitive(rng):
    n = rng.randint(1, 150)
    words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(min(a + p, n), rng.randint(a, n)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        words = _repetitive(rng)
        for shortest, repeats in ((24, 3), (6, 3), (9, 4)):
            assert periodic.runs(np.array(words, np.int64), shortest, repeats) == _runs_by_force(words, shortest, repeats)


def test_runs_of_one_word_and_of_nothing():
    assert periodic.runs(np.zeros(5000, np.int64)) == [(0, 5000, 1)]
    assert periodic.word_runs([]) == [] and periodic.word_runs([b"a"] * 23) == []
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), repeats=2)


def test_an_ordered_set_knows_neighbours():
    rng = random.Random(4)
    numbers = rng.sample(range(10**6), 5000)
    own = periodic.OrderedSet(numbers[0])
    seen = [numbers[0]]
    for x in numbers[1:]:
        before, after = own.insert(x)
        if x % 50 == 0:
            assert before == max((y for y in seen if y < x), default=-1) and after == min((y for y in seen if y > x), default=-1)
        seen.append(x)
    assert list(own) == sorted(numbers)


def _report_by_force(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _runs_by_force(words, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        doc_id,
        len(found),
        *((*best, best[1] * 1000 // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_report_is_that_of_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "s", None, None, " ".join(rng.choice("ab é c") + str(rng.randrange(3)) for _ in range(rng.randint(0, 90))), "x") for i in range(150)]
    rows += [(None, None, None, None, "x " * 40, None), (7, "s", "en", 1, None, None), (7, "s", "en", 1, None, None), (8, "s", "en", 1, "a\x0b\x0cb\r\n" * 30, None), (2**60 + 1, "s", "en", 1, " ", None)]
    rows += [(1000 + i, "s", "en", 1, " ".join(f"w{j}" for j in range(200)), None) for i in range(60)]
    got = periodic.report(spark.createDataFrame(rows, DOCS))
    assert _by_text(map(tuple, got.collect())) == _by_text(_report_by_force(r[0], r[4]) for r in rows)
    assert periodic.report(spark.createDataFrame([], DOCS)).collect() == []


def test_collapse_keeps_the_first_period(spark):
    rows = [(1, "s", "en", 1, "intro " + "one two three " * 20 + "end", "old"), (2, "s", "en", 1, "plain  text", "old"), (3, "s", "en", 1, None, "old")]
    got = {r.doc_id: r for r in periodic.collapse(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == "intro one two three end" and [tuple(r) for r in got[1].word_runs] == [(1, 60, 3)]
    assert got[2].text == "plain  text" and got[2].word_runs == [] and got[3].text is None


# ---- the transducer


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe_fst.Coder(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("seed", range(4))
def test_transducer_gives_the_library_s_tokens(library, coder, seed):
    rng = random.Random(seed)
    tokens = list(coder.transducer.ranks)
    for k in range(400):
        made = (b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 7))), bytes(rng.choice(b"aeinst ro\xc3\xa9") for _ in range(rng.randint(1, 40))), rng.randbytes(rng.randint(1, 30)))[k % 3]
        want = library._core_bpe.encode_single_piece(made)
        assert coder.transducer.encode(made).tolist() == want
        cut = rng.randint(0, len(made))
        assert list(coder.transducer.stream([made[:cut], b"", made[cut:]])) == want


def test_lookahead_is_bounded_and_tokens_come_early(coder):
    text = (b"thequickbrownfoxjumps" * 300)[:6000]
    read = 0

    def chunks():
        nonlocal read
        for i in range(len(text)):
            read = i + 1
            yield text[i : i + 1]

    told = 0
    for token in coder.transducer.stream(chunks()):
        told += len(coder.transducer.raw[token])
        assert read - told <= max(map(len, coder.transducer.ranks))
    assert told == len(text)


def test_few_states_give_the_same_tokens(library):
    small = bpe_fst.Coder(RANKS, public_tokenizers.PATTERN, states=20, remembered=5)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "naïve", " 東京", "x" * rng.randint(1, 90), "1234", "\n\n", " don't"]) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(b"".join(small.encode(text)), "<u4").tolist() == library.encode_ordinary(text)
        assert "".join(small.decode(small.encode(text))) == text


def test_long_texts_are_encoded_in_stretches(library, coder, monkeypatch):
    monkeypatch.setattr(bpe_fst, "TOGETHER", 50)
    text = "naïve words, and 東京 again; " * 400 + "y" * 20_000
    assert np.frombuffer(b"".join(coder.encode(text)), "<u4").tolist() == library.encode_ordinary(text)


def test_streaming_decode_equals_the_replacing_decoder():
    rng = random.Random(5)
    some = [*(bytes([b]) for b in (0x41, 0x80, 0xBF, 0xC0, 0xC2, 0xE0, 0xA0, 0x9F, 0xED, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF)), "é".encode(), "東".encode(), "🎵".encode(), "🎵".encode()[:3], "東".encode()[:2]]
    raw = dict(enumerate(some))
    for _ in range(3000):
        ids = [rng.randrange(len(some)) for _ in range(rng.randint(0, 9))]
        decoder = bpe_fst.StreamDecoder(raw)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == b"".join(raw[i] for i in ids).decode("utf-8", "replace")


def test_round_trip_over_rows(spark, library):
    texts = ["", None, "Hello  world\t\n", "naïve 東京 🎵", "a" * 5000, " " * 300, "\x00\x01", "don't <|endoftext|>"] * 2
    rows = [(i if i else None, "s", "en", 1, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[4] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert _by_text(map(tuple, bpe_fst.round_trip(df, RANKS, public_tokenizers.PATTERN).collect())) == _by_text(want)
    both = bpe_fst.decode(bpe_fst.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") and r.token_ids == library.encode_ordinary(r.text or "") for r in both.collect())
    assert bpe_fst.round_trip(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).collect() == []


# ---- the Merkle manifest


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a : a + 16], i - a))
        i //= 16
    return out


def _manifest_by_force(rows):
    def leaf(r):
        return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def first_null(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=first_null)
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (first_null(r[0]), leaf(r)))
        trees[s] = _tree([leaf(r) for r in sources[s]])
    top = _tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            path = _path(trees[s], i) + _path(top, k)
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for run, j in path:
                now = _hash("".join(run[:j] + [now] + run[j + 1 :]))
            proof = _hash("".join("".join(run[:j] + run[j + 1 :]) for run, j in path))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def _documents(rng, sizes):
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) * 3 % 1000 + len(rows), source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Abc", "é X", "", None, "low"]), None) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1, "a": 16}, {"a": 17, "Z": 1, "é": 256, None: 257}, {"a": 5000, "b": 3}, {f"s{i}": 2 for i in range(300)}], ids=len)
def test_manifest_is_that_of_brute_force(spark, sizes):
    rows = _documents(random.Random(3), sizes)
    if len(sizes) == 2:
        rows += [(None, "a", "en", 1, "No Id", None)] * 20 + [rows[0]] * 5 + [(2**60 + 1, "a", None, None, "Far", None)]
    got = merkle.verify(spark.createDataFrame(rows, DOCS))
    assert _by_text(map(tuple, got.collect())) == _by_text(_manifest_by_force([r[:5] for r in rows]))


def test_states_resume_as_the_library_would():
    rng = np.random.default_rng(1)
    counts = np.array([1, 2, 7, 16, 16])
    children = rng.integers(0, 256, (5, 16, 32), dtype=np.uint8)
    made, states = merkle.parents(children, counts)
    for row, n in enumerate(counts):
        text = "".join(children[row, k].tobytes().hex() for k in range(n))
        assert made[row].tobytes().hex() == _hash(text)
        for slot in range(n):
            new = rng.integers(0, 256, (1, 32), dtype=np.uint8)
            right = np.zeros((1, 16, 32), np.uint8)
            right[0, : n - slot - 1] = children[row, slot + 1 : n]
            folded = merkle.fold(states[row : row + 1, slot], new, right, np.array([slot]), np.array([n]))
            assert folded[0].tobytes().hex() == _hash(text[: 64 * slot] + new.tobytes().hex() + text[64 * (slot + 1) :])
