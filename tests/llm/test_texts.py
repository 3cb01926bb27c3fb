"""Language, quality, tokens, licences: whole texts, nulls, held-out accuracy, exact round trips."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playlore.llm import bpe, langid, license_scan, quality
from playlore.llm import words as W

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a" * 20_000, "\x00\x01", "é́", "日本語 🎉"]


def _docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score string, language string")


def test_word_hashes_match_words_cut_by_hand():
    rng = random.Random(1)
    classes = W.byte_classes(separators=b" \n")
    text = "".join(rng.choice("abé \n") for _ in range(3000))
    starts, ends, hashes = W.words(W.utf8(text), classes)
    cut = [x for part in text.split("\n") for x in part.split(" ") if x]
    assert [text.encode()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == cut
    assert [W.word_hash(x, classes) for x in cut] == hashes.tolist()
    assert len(set(hashes.tolist())) == len(set(cut))


def test_shingles_of_short_texts_are_the_whole_sequence():
    h = W.words(W.utf8("a b c"), W.byte_classes(separators=b" "))[2]
    assert len(W.shingles(h, 5)) == 1 and len(W.shingles(h, 2)) == 2 and len(W.shingles(h[:0], 5)) == 0
    assert W.shingles(h[:2], 5)[0] != W.shingles(h, 5)[0]


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.languages(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    model = langid.train([(langid.runs("the cat and the dog"), "en"), (langid.runs("der hund und die katze"), "de")])
    got = {r.doc_id: r.language for r in langid.predict(_docs(spark, [*ODD, "1234 !?", "und der hund"]), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 4, 7)] == ["und"] * 5 and got[8].lang_pred == "de"
    assert langid.languages(_docs(spark, [])).count() == 0
    tied = langid.train([(langid.runs("abc"), "x"), (langid.runs("abc"), "w")])
    assert {r.language.lang_pred for r in langid.predict(_docs(spark, ["abc"]), tied).collect()} == {"w"}
    assert {r.lang_pred for r in langid.languages(_docs(spark, ["abc", "abc"], None)).collect()} == {"und"}


def test_kernel_values_are_shared_runs_over_norms():
    a, b = langid.runs("abc abd"), langid.runs("abd xyz")
    plain = lambda t: {(" " + t + " ")[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    assert len(a) == len(plain("abc abd"))
    assert len(np.intersect1d(a, b)) == len(plain("abc abd") & plain("abd xyz"))
    long = "ab cd " * 400_000
    assert set(langid.runs(long).tolist()) == set(langid.runs("ab cd ab cd").tolist())


def _run_set(text):
    plain = " ".join("".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split())
    plain = f" {plain} " if plain else " "
    return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def test_language_scores_by_brute_force():
    """Kernels from sets of runs, the whitened map and the regressions written out for a few texts."""
    rng = random.Random(8)
    letters = {"x": "abcde", "y": "cdefg", "z": "efghi"}
    say = lambda lang: "".join(rng.choice(letters[lang] + " ") for _ in range(40))
    examples = [(say(lang), lang) for _ in range(12) for lang in letters]
    asked = [say(lang) for lang in letters for _ in range(4)] + ["ab1cd", "é ü", "zzz"]
    model = langid.train([(langid.runs(t), lang) for t, lang in examples], landmarks=5, ridge=0.1)
    kernel = lambda a, b: len(_run_set(a) & _run_set(b)) / np.sqrt(len(_run_set(a)) * len(_run_set(b)))
    taken = {lang: [t for t, x in examples if x == lang][:5] for lang in letters}
    landmarks = [t for t, lang in examples if t in taken[lang]]
    base = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    value, vector = np.linalg.eigh(base)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    space = np.array([[kernel(t, b) for b in landmarks] for t, _ in examples]) @ whiten
    want = np.empty((len(asked), 3))
    for j, lang in enumerate(sorted(letters)):
        yes = np.array([x == lang for _, x in examples])
        weight = np.where(yes, 0.5 / yes.sum(), 0.5 / (~yes).sum()) * len(examples)
        dual = np.linalg.solve(space.T @ (space * weight[:, None]) + 0.1 * np.eye(space.shape[1]), space.T @ (weight * np.where(yes, 1, -1)))
        want[:, j] = np.array([[kernel(t, b) for b in landmarks] for t in asked]) @ whiten @ dual
    assert np.allclose(model.scores(asked), want, atol=2e-3)
    assert [model.languages[i] for i in want[:12].argmax(axis=1)] == [model.languages[i] for i in model.scores(asked[:12]).argmax(axis=1)]


def _plain_features(text):
    """Counts of one- and two-word runs, of shouted and of repeated words, by words cut with a regular expression."""
    cut = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|[.,;:'\"?()\-]+|!+|[^0-9A-Za-z.,;:'\"?()\-!\s\x80-\U0010ffff]+", text or "")
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    hashes = [np.uint64(W.word_hash(fold(w), quality._CLASSES)) for w in cut]
    pairs = [W.shingles(np.array([a, b]), 2)[0] for a, b in zip(hashes, hashes[1:])]
    extra = [quality._SHOUTED] * sum(len(w) > 1 and all("A" <= c <= "Z" for c in w) for w in cut) + [quality._REPEATED] * sum(a == b for a, b in zip(hashes, hashes[1:]))
    counts = {}
    for h in [*hashes, *pairs, *extra]:
        counts[int(h) >> (64 - quality.BITS)] = counts.get(int(h) >> (64 - quality.BITS), 0) + 1
    length = np.sqrt(sum(n * n for n in counts.values())) or 1.0
    return {k: n / length for k, n in counts.items()} | {quality.BIAS: 1.0}


def test_quality_features_and_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.limit(60).collect():
        margin = sum(float(np.float32(weights[k])) * v for k, v in _plain_features(r.text).items())
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-margin))) < 1e-4


def test_training_by_brute_force():
    """Follow-the-regularised-leader coordinate by coordinate, with plain numbers in dictionaries."""
    rng = random.Random(5)
    examples = []
    for _ in range(60):
        at = sorted(rng.sample(range(40), rng.randrange(1, 8)))
        examples.append((np.array([*at, quality.BIAS]), np.array([rng.random() for _ in at] + [1.0]), int(min(at) < 8)))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.5
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return (np.sign(z[k]) * l1 - z[k]) / ((beta + np.sqrt(n[k])) / alpha + l2)

    share = np.mean([y for *_, y in examples])
    cost = {1: min(0.7 / share, 20.0), 0: min(0.3 / (1 - share), 20.0)}
    order = np.random.default_rng(7)
    for _ in range(6):
        for k in order.permutation(len(examples)):
            at, values, label = examples[k]
            p = 1 / (1 + np.exp(-sum(weight(int(a)) * v for a, v in zip(at, values, strict=True))))
            for a, v in zip(map(int, at), values, strict=True):
                w, g = weight(a), (p - label) * v * cost[label]
                sigma = (np.sqrt(n.get(a, 0.0) + g * g) - np.sqrt(n.get(a, 0.0))) / alpha
                z[a], n[a] = z.get(a, 0.0) + g - sigma * w, n.get(a, 0.0) + g * g
    made = quality.train(examples)
    assert all(abs(made[a] - weight(a)) < 1e-9 for a in z) and np.count_nonzero(made) == sum(weight(a) != 0 for a in z)


def test_quality_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_texts_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(_docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    kept = quality.keep_good(_docs(spark, ODD), none)
    assert kept.count() == len(ODD) and kept.columns == _docs(spark, []).columns
    assert quality.quality_scores(_docs(spark, []), none).count() == 0


def test_quality_of_ids_with_both_labels(spark):
    docs = _docs(spark, ["plain words here", "BUY BUY !!! $$$"] * 20)
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)] + [(None, 1), (5, None)], "doc_id long, quality int")
    assert all(0 < r.score < 1 for r in quality.quality_scores(docs, labels).collect())


def test_training_moves_weights_towards_the_labels():
    good, bad = quality.features("plain words here"), quality.features("$$$ !!! $$$")
    w = quality.train([(*good, 1), (*bad, 0)] * 40)
    assert w[good[0]] @ good[1] > 0.5 and w[bad[0]] @ bad[1] < 0


def test_tokens_are_those_of_the_library():
    own, lib = bpe.ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["<|endoftext|>", "a<|endoftext|>  b<|endoftext", "I'll  we've\n\n x", "0" * 999 + "  "]
    texts += ["".join(rng.choice("ab \n\t'sé日🎉.,! ２ <|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert "�" in own.decode(own.encode("𐍈")[:1])


def test_tokens_of_texts_of_megabytes():
    own, lib = bpe.ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(6)
    some = ["the ", "Wörter", " 日本", "\n\n", "x" * 30, "<|endoftext|>", "é", "123 ", "'ll ", "\t"]
    texts = ["".join(rng.choice(some) for _ in range(400_000)), "".join(rng.choice("abcdeé日") for _ in range(1_000_000)), "short", "ab" * 300_000]
    got = own.encode_batch(texts)
    for text, packed in zip(texts, got, strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_tokens_are_counted(spark):
    docs = _docs(spark, ODD)
    assert [r[0] for r in docs.select(bpe.count("text", PATH)).collect()] == [len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_tokens_of_a_table(spark):
    got = {r.doc_id: r for r in bpe.round_trip(_docs(spark, ODD), PATH).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].decoded_sha256 == got[1].decoded_sha256
    there = bpe.decode(bpe.encode(_docs(spark, ODD), PATH), PATH).collect()
    assert [r.decoded for r in there] == [t or "" for t in ODD]


def test_forced_cuts_cross_no_token():
    own = bpe.ForcedBoundaryBPE(PATH)
    for raw in list(own.token_bytes.values())[:5000]:
        assert own.fragments([raw])[0] == [raw]


def test_matching_statistics_against_all_substrings():
    rng = random.Random(2)
    for _ in range(60):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 10))] for _ in range(3)]
        subs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        asked = [rng.randrange(4) for _ in range(25)]
        for i, (n, _) in enumerate(license_scan.SuffixAutomaton(known).longest(asked)):
            assert n == max([k for k in range(1, i + 2) if tuple(asked[i + 1 - k : i + 1]) in subs], default=0)


def test_counts_are_the_numbers_of_ids():
    rng = random.Random(15)
    texts = [t or "" for t in ODD] + ["<|endoftext|>a<|endoftext|>", "x" * 9000, "a b a b a", "日本語 🎉 'll\n\n  "]
    texts += ["".join(rng.choice("ab \n\t'sé日🎉.,! ２ <|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    for remembered in (5, 500_000):
        own = bpe.ForcedBoundaryBPE(PATH, remembered)
        want = [len(ids) // 4 for ids in own.encode_batch(texts)]
        assert own.count_batch(texts) == want == own.count_batch(texts)
    assert own.count_batch([]) == []


def test_licences_by_phrase_and_by_wording(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if len(t) > 300 and label == "mit")
    broken = mit.replace("free of charge", "entirely free").replace("and/or sell", "sell")
    texts = [*ODD, "The MIT License. CC-BY? mit license", "before " + broken + " after", "permission is hereby granted"]
    got = {r.doc_id: r for r in license_scan.scan_licences(_docs(spark, texts)).collect()}
    n = len(ODD)
    assert all(got[i].n_base == 0 and got[i].labels == "" and got[i].first_word is None for i in range(n))
    assert (got[n].n_base, got[n].base_labels, got[n].first_word, got[n].last_word, got[n].n_words) == (3, "cc-by,mit", 1, 5, 7)
    assert got[n + 1].base_labels == "" and got[n + 1].labels == "mit" and got[n + 1].spans[0]["first"] == 1
    assert got[n + 2].labels == "" and got[n + 2].score == 0


def test_everyday_words_are_no_licence(spark):
    plain = ["The record was released under the moon in June", "He sailed under the MIT banner", "This work is done. Licensed pilots fly under a creative sky, in common.", "permission is hereby granted, free of charge, to any person who asks"]
    named = ["this project is licensed under the GPL; see the license file", "x Released under the MIT License. y", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."]
    got = {r.doc_id: r for r in license_scan.scan_licences(_docs(spark, plain + named)).collect()}
    assert [got[i].labels for i in range(8)] == ["", "", "", "", "gpl", "mit", "cc-by", "cc-by"]
    assert got[4].score == 1.0 and got[0].score == 0.0


def test_common_licences_by_name_notice_and_identifier(spark):
    wanted = {
        "GNU Affero General Public License v3": "agpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl",
        "BSD 3-Clause License": "bsd",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.": "unlicense",
        "# SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl",
        "/* SPDX-License-Identifier: Apache-2.0 */": "apache",
        "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
        "Mozilla Public License": "mpl",
        "a boost for the software licence": "",
        "the identifier of a licence: mit": "",
        "free software released into the public domain": "",
        "Redistribution of source code": "",
        "library general public": "",
    }
    got = {r.doc_id: r.labels for r in license_scan.scan_licences(_docs(spark, list(wanted))).collect()}
    assert {t: got[i] for i, t in enumerate(wanted)} == {t: ("cc-by,cc-by-sa" if label == "cc-by-sa" and "CC-BY" in t else label) for t, label in wanted.items()}


def test_whole_templates_carry_their_own_label():
    scanner = license_scan.LicenceScanner()
    for label, text in license_scan.TEMPLATES:
        assert label in {x for _, _, x, _ in scanner.scan("words before it " + text + " and after")[2]}, text[:60]


def test_whole_short_templates_by_brute_force():
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(8)]
    scanner = license_scan.LicenceScanner([(f"l{i}", t) for i, t in enumerate(texts)], {"z z": "z"})
    for _ in range(40):
        words = [rng.choice("abcd") for _ in range(60)]
        found = {(a, b, x) for a, b, x, _ in scanner.spans(scanner.codes(license_scan.word_hashes(" ".join(words))))}
        want = {(i, i + len(t.split()), f"l{k}") for k, t in enumerate(texts) for i in range(60) if words[i : i + len(t.split())] == t.split() and len(t.split()) > 1}
        assert {x for x in found if x[1] - x[0] > 1} == want


def test_places_of_phrases_by_regular_expression(spark):
    rng = random.Random(4)
    some = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x9", "MIT", "License"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "-", ". ", "\x7f", "\n", "/", "  "]) for _ in range(rng.randrange(60))) for _ in range(300)] + [" ".join(["cc by"] * 40_000)]
    got = {r.doc_id: r for r in license_scan.scan_licences(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        hits = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({label for _, label in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize("run", [langid.languages, license_scan.scan_licences, lambda d: bpe.round_trip(d, PATH)])
def test_null_ids_and_repeated_rows(spark, run):
    rows = [(None, "the text", "en"), (1, "the text", "en"), (1, "the text", "en"), (2, None, None)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.count() == 4
