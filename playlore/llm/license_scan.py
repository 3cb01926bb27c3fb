"""Licence scan: matching statistics against a generalised suffix automaton, chained into spans.

All templates' words go into one suffix automaton.  Reading a text word by word through it
gives, at each word, the longest run ending there that occurs in some template.  Where such a
run can't be carried on and is long enough, it becomes an anchor in each template it occurs
in.  Anchors that follow each other in text and template, with short gaps, are chained, and a
chain that covers enough of its template is a span with that template's label.  A short
notice is made of everyday words, so it counts only when it stands there whole.

Only stretches whose neighbouring words are neighbours in some template go through the
automaton; a table of such pairs finds them for a whole text at once.  A stretch without
such pairs can hold no run of two words, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches
from .license_texts import PHRASES, TEMPLATES

#: Words of the shortest run that becomes an anchor; words skipped between anchors at most;
#: share of a template's words that a span covers at least.
ANCHOR, GAP, COVERED = 4, 12, 0.6
#: Templates of up to this many words must stand whole and without a gap.
SHORT = 15

_CLASSES = W.byte_classes(separators=bytes([*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, after lower-casing A-Z."""
    return W.words(W.LOWER[W.utf8(text)], _CLASSES)[2]


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of whole numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._add(last, symbol)
                self.ends[last].append((number, at + 1))
        # A shorter suffix ends wherever a longer one does.
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """Give the run of ``state`` and ``symbol`` a state that isn't longer than it."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state != -1 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        made = self._state(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = made
            state = self.link[state]
        if state != -1:
            target = self.next[state][symbol]
            self.link[made] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return made

    def longest(self, sequence: list[int]) -> list[tuple[int, int]]:
        """For each position the longest known run ending there: (length, state)."""
        out, state, length = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            out.append((length, state))
        return out


class LicenceScanner:
    """Templates, their automaton, and the phrases that count by themselves."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(word_hashes(p), label) for p, label in phrases.items()]
        hashed = [word_hashes(text) for _, text in templates]
        self.labels = [label for label, _ in templates]
        self.vocabulary = np.unique(np.concatenate([*hashed, *(p for p, _ in self.phrases)]))
        coded = [self.codes(h) for h in hashed]
        self.sizes = [len(c) for c in coded]
        self.neighbours = np.zeros((len(self.vocabulary) + 1,) * 2, bool)
        for c in coded:
            self.neighbours[c[:-1], c[1:]] = True
        self.phrase_codes = [(self.codes(h), label) for h, label in self.phrases]
        self.automaton = SuffixAutomaton([c.tolist() for c in coded])
        # A run ends with a template if that template's end is among the ends of its state's link path.
        made = self.automaton
        at_end: dict[int, list[tuple[int, int]]] = {}
        for number, c in enumerate(coded):
            if 0 < len(c) <= SHORT:
                state = 0
                for symbol in c.tolist():
                    state = made.next[state][symbol]
                at_end.setdefault(state, []).append((number, len(c)))
        self.closing: dict[int, list[tuple[int, int]]] = {}
        for state in sorted(range(1, len(made.length)), key=lambda s: made.length[s]):
            found = at_end.get(state, []) + self.closing.get(made.link[state], [])
            if found:
                self.closing[state] = found

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary; its size for every other word."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def places(self, codes: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        found = []
        for phrase, label in self.phrase_codes:
            n = len(codes) - len(phrase) + 1
            if n > 0:
                hit = np.ones(n, bool)
                for i, word in enumerate(phrase):
                    hit &= codes[i : i + n] == word
                found += [(int(at), label) for at in np.flatnonzero(hit)]
        return sorted(found)

    def anchors(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, word in text, word in template, words) of runs that can't be carried on."""
        pair = self.neighbours[codes[:-1], codes[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], pair.view(np.int8), [0]))))
        out = []
        least = min([ANCHOR, *self.sizes])
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start + 1 < least:
                continue
            runs = self.automaton.longest(codes[start : end + 1].tolist())
            for i, (length, state) in enumerate(runs):
                last = int(start) + i + 1
                # A short template inside a longer run is a shorter suffix of it: its own end is a state above.
                out += [(number, last - self.sizes[number], 0, self.sizes[number]) for number in self.whole(state, length)]
                if length >= ANCHOR and (i + 1 == len(runs) or runs[i + 1][0] <= length):
                    out += [(number, last - length, stop - length, length) for number, stop in self.automaton.ends[state] if self.sizes[number] > SHORT]
        return sorted(out)

    def whole(self, state: int, length: int) -> list[int]:
        """Short templates that end with the run of ``length`` words that ``state`` stands for."""
        return [number for number, size in self.closing.get(state, ()) if size <= length]

    def spans(self, codes: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, share of the template covered)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for number, at, inside, length in self.anchors(codes):
            by_template.setdefault(number, []).append((at, inside, length))
        found = []
        for number, anchors in by_template.items():
            if self.sizes[number] <= SHORT:
                found += [(at, at + length, self.labels[number], 1.0) for at, _, length in anchors]
                continue
            # best[i]: covered words, start of the chain that ends with anchor i
            best: list[tuple[int, int]] = []
            taken: list[bool] = []
            for i, (at, inside, length) in enumerate(anchors):
                cover, first, before = length, at, -1
                for j in range(i - 1, -1, -1):
                    p, q, n = anchors[j]
                    if at - p > GAP + self.sizes[number]:
                        break
                    gap_text, gap_template = at - p - n, inside - q - n
                    shared = max(0, -gap_text, -gap_template)
                    if p < at and q < inside and gap_text <= GAP and gap_template <= 4 * GAP and shared < length and best[j][0] + length - shared > cover:
                        cover, first, before = best[j][0] + length - shared, best[j][1], j
                best.append((cover, first))
                taken.append(False)
                if before >= 0:
                    taken[before] = True
            for (at, _, length), (cover, first), carried in zip(anchors, best, taken, strict=True):
                share = min(1.0, cover / self.sizes[number])
                if not carried and share >= COVERED:
                    found.append((first, at + length, self.labels[number], share))
        return sorted(set(found))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, places of phrases, and spans of a text."""
        codes = self.codes(word_hashes(text))
        if len(codes) < 2:
            return len(codes), [], []
        return len(codes), self.places(codes), self.spans(codes)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string,covered:double>>"


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licences found in every text.

    n_words counts the words of the whole text; n_base counts all places of phrases, with
    the smallest and largest first word (null if there are none); base_labels are the
    phrases' labels, labels also those of covered template spans (distinct, sorted, joined
    by commas; empty if there are none).  score is the largest share of a template that a
    span covers, and at least 0.5 where a phrase stands.  A null text counts as empty.  Rows
    that repeat and rows without an id are scanned each; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = LicenceScanner(templates, phrases)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, places, spans = scanner.scan(text)
                base = {label for _, label in places}
                every = base | {label for _, _, label, _ in spans}
                score = max([0.5 if places else 0.0, *(s[3] for s in spans)])
                rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(every)), score, [{"first": a, "end": b, "label": x, "covered": s} for a, b, x, s in spans]))
            columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            made = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **{c: [r[i] for r in rows] for i, c in enumerate(columns)}})
            yield made.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, _SCHEMA)
