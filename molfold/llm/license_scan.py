"""Licence texts in documents by a generalised suffix automaton.

The automaton holds every run of words of every template and phrase.  A
document is streamed through it word by word; the state and length at each
word are the matching statistics, the longest run ending there that occurs in
any template.  Runs that cannot be extended and are long enough are chained,
in the order of both document and template, into the spans a template covers.
Phrases are words of the automaton too: a phrase ends where the state's
suffixes include it.

Templates are fixed and small, documents are one row each: a narrow map
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, words_of
from .license_texts import NEEDED, PHRASES, TEMPLATES


class SuffixAutomaton:
    """All substrings of several sequences of word numbers."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        #: by state: the first end of its runs in each sequence they occur in
        self.ends: list[dict[int, int]] = [{}]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state of p's runs plus symbol, parted from longer ones in q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for position, symbol in enumerate(sequence):
            if symbol in self.next[last]:
                last = self._split(last, self.next[last][symbol], symbol)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][symbol], symbol)
                last = new
            self.ends[last].setdefault(number, position)

    def finish(self) -> None:
        """Give every state the ends of the longer runs it is a suffix of."""
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[state]] if self.link[state] > 0 else None
            if up is not None:
                for number, end in self.ends[state].items():
                    up[number] = min(end, up.get(number, end))

    def find(self, sequence: list[int]) -> int:
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state


@dataclass(frozen=True)
class Span:
    template: str
    label: str
    first_word: int
    last_word: int
    covered: int
    coverage: float


class LicenseIndex:
    """Automaton, vocabulary and phrases, ready to scan documents."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 5, most_gap: int = 12, least_coverage: float = 0.6):
        self.templates, self.phrases = templates, phrases
        self.min_match, self.most_gap, self.least_coverage = min_match, most_gap, least_coverage
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        self.sequences = [number(text) for _, _, text in templates]
        spoken = [number(text) for text, _ in phrases]
        for k, sequence in enumerate([*self.sequences, *spoken]):
            self.automaton.add(k, sequence)
        self.automaton.finish()
        own = {self.automaton.find(s): (k, len(s)) for k, s in enumerate(spoken)}
        self.spoken: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.length)):
            ending, up = [], state
            while up > 0:
                if up in own:
                    ending.append(own[up])
                up = self.automaton.link[up]
            self.spoken.append(ending)
        #: by state: the longest run of each template that ends with the state's own, and its end there
        self.reach: list[dict[int, tuple[int, int]]] = []
        for state in range(len(self.automaton.length)):
            near, up = {}, state
            while self.automaton.length[up] >= self.min_match:
                for k, end in self.automaton.ends[up].items():
                    if k < len(templates):
                        near.setdefault(k, (self.automaton.length[up], end))
                up = self.automaton.link[up]
            self.reach.append(near)
        #: a run of known words without any of these holds no phrase
        self.closing = np.zeros(len(self.vocabulary) + 1, bool)
        self.closing[[s[-1] for s in spoken]] = True
        self.shortest = min([self.min_match, *map(len, spoken)])

    def runs(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """[start, end) of the runs of known words that may hold a match or a phrase."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        closing = np.concatenate([[0], np.cumsum(self.closing[numbers])])
        wanted = (ends - starts >= self.min_match) | (closing[ends] > closing[starts])
        return zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Number of words; (start, phrase) of every phrase; spans of every template."""
        words = words_of(text)
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        a, places, matches = self.automaton, [], {}
        for start, end in self.runs(numbers) if words else ():
            state = length = 0
            open_: dict[int, tuple[int, int]] = {}  # by template: length and end of the run so far
            for i, symbol in enumerate(numbers[start:end].tolist(), start):
                while state > 0 and symbol not in a.next[state]:
                    state = a.link[state]
                    length = a.length[state]
                state = a.next[state].get(symbol, 0)
                length = length + 1 if state else 0
                places += [(i - size + 1, k) for k, size in self.spoken[state] if size <= length]
                if not open_ and length < self.min_match:
                    continue
                now = {k: (min(length, most), last) for k, (most, last) in self.reach[state].items()}
                for k, (size, last) in open_.items():
                    if k not in now or now[k][0] <= size:  # no longer run goes on
                        matches.setdefault(k, []).append((i - size, i, last + 1 - size))
                open_ = {k: run for k, run in now.items() if run[0] >= self.min_match}
            for k, (size, last) in open_.items():
                matches.setdefault(k, []).append((end - size, end, last + 1 - size))
        return len(words), places, [s for k, found in matches.items() for s in self._chain(k, found)]

    def _chain(self, k: int, found: list[tuple[int, int, int]]) -> Iterator[Span]:
        """Matches in the order of document and template, a few words apart, as one span."""
        name, label, _ = self.templates[k]
        first = last = done = covered = None
        for start, end, at in found:  # by end in the document
            skip = 0 if last is None else max(0, last - start, done - at)
            if last is None or start - last > self.most_gap or at + (end - start) <= done or end - start <= skip:
                if last is not None:
                    yield Span(name, label, first, last - 1, covered, min(1.0, covered / len(self.sequences[k])))
                first, covered, skip = start, 0, 0
            covered += end - start - skip
            last, done = end, at + (end - start)
        if last is not None:
            yield Span(name, label, first, last - 1, covered, min(1.0, covered / len(self.sequences[k])))

    def _deciding(self, text: bytes, spans: list[Span]) -> list[Span]:
        """Spans that give their label: covered enough, with the words that tell their
        licence from its siblings, and not inside one of another label that covers more."""
        spans = [s for s in spans if s.coverage >= self.least_coverage]
        if any(s.label in NEEDED for s in spans):
            words = words_of(text)
            spans = [s for s in spans if self._told(words[s.first_word : s.last_word + 1], s.label)]
        rank = lambda s: (s.covered, s.coverage)
        wins = lambda t, s: t.label != s.label and t.first_word <= s.first_word and t.last_word >= s.last_word and rank(t) > rank(s)
        return [s for s in spans if not any(wins(t, s) for t in spans)] if len({s.label for s in spans}) > 1 else spans

    @staticmethod
    def _told(words: list[bytes], label: str) -> bool:
        return all(any(w.encode() in words for w in group) for group in NEEDED.get(label, ()))

    def row(self, text: bytes) -> dict:
        n_words, places, spans = self.scan(text)
        base = sorted({self.phrases[k][1] for _, k in places})
        own = {s.label for s in self._deciding(text, spans)}
        return {
            "n_words": n_words,
            "n_base": len(places),
            "first_word": min((p for p, _ in places), default=None),
            "last_word": max((p for p, _ in places), default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted(own | set(base))),
            "score": max((s.coverage for s in spans), default=0.0),
            "spans": [s.__dict__ for s in sorted(spans, key=lambda s: (s.first_word, s.template))],
        }


SPANS = "array<struct<template:string,label:string,first_word:int,last_word:int,covered:int,coverage:double>>"
ROW = f"struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:{SPANS}>"
ARROW_ROW = pa.struct(
    [
        *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())]))),
    ]
)


def licenses(text: Column, **options) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = LicenseIndex(**options)
        for batch in batches:
            yield pa.array([index.row(t.as_py()) for t in batch], ARROW_ROW)

    return F.arrow_udf(run, ROW).asNondeterministic()(utf8(text))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document, repeated rows included: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score and the template spans.

    A null text counts as empty: no words, no labels, score 0.  ``score`` is
    the largest share of a template that one span covers.
    """
    return docs.select(F.col(id_col).alias("doc_id"), licenses(F.col(text_col), **options).alias("__found__")).select("doc_id", "__found__.*")
