"""Evaluation texts leaking into training text.

A generalised suffix automaton over the words of the evaluation items is built once; every training text is streamed through it
word by word, which gives at each word the longest match that ends there.  Matches of ``min_words`` words or more are leaks, of all
items that hold the matched words.  Cleaning takes the spans they cover out of the text as it is stored, and the whole text where the
spans cover more than a limit of its words.

The automaton is broadcast.  Its size is checked: items are streamed to the driver in order of their keys, and whenever ``MAX_WORDS`` words
have come they make an automaton of that bounded size and are let go; the corpus is streamed once for each.  The corpus is neither
shuffled nor sampled, and texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import received, share

MIN_WORDS = 13
MAX_WORDS = 1_000_000  # words of evaluation items in one automaton

# fixed values: characters that are not visible (format characters, default-ignorable code points, controls that are no white space)
_INVISIBLE = re.compile(
    r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f­͏؀-؅؜۝܏࣢ᅟᅠ឴឵᠋-᠏​-‏"
    r"‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻\U000110bd\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return _INVISIBLE.sub("", text).casefold()


def origins(text: str) -> list[int] | None:
    """The position in ``text`` of every character of its normal form; None where they are the same."""
    if not _INVISIBLE.search(text) and len(text.casefold()) == len(text):
        return None
    return [i for i, c in enumerate(text) if not _INVISIBLE.match(c) for _ in c.casefold()]


def words(text: str) -> list[str]:
    """Runs of letters and digits without letter case, once invisible characters have been dropped."""
    return _WORD.findall(normal(text))


class Automaton:
    """Suffix automaton of several word sequences; ``holders[state]``: items that hold the state's words."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for key, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.widest = list(range(len(order)))  # the state of the shortest suffix that still has min_words
        for v in order[1:]:
            up = self.link[v]
            if self.length[up] >= min_words:
                self.widest[v] = self.widest[up]
        self.holders: dict[int, set[int]] = {}
        for key, ws in coded:
            v = 0
            for w in ws:
                v = self.next[v][w]
                u = v
                while u > 0 and self.length[u] >= min_words and key not in self.holders.setdefault(u, set()):
                    self.holders[u].add(key)
                    u = self.link[u]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def hits(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(word, length, state) of the longest match that ends at each word, where it has min_words or more."""
        code, nxt, link, length, least = self.vocabulary.get, self.next, self.link, self.length, self.min_words
        v = n = 0
        for i, word in enumerate(ws):
            w = code(word)
            if w is None:
                v = n = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                continue
            v = to
            n += 1
            if n >= least:
                yield i, n, v


def _stream(automaton_of, clean: bool, max_coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: Automaton = received(automaton_of)
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"], strict=True):
                if not text:
                    continue
                norm = normal(text)
                spots = list(_WORD.finditer(norm))
                if len(spots) < a.min_words:
                    continue
                found: set[int] = set()
                spans: list[list[int]] = []
                for i, n, v in a.hits([m.group() for m in spots]):
                    found |= a.holders[a.widest[v]]  # every item with these min_words words
                    if spans and i + 1 - n <= spans[-1][1]:
                        spans[-1] = [min(spans[-1][0], i + 1 - n), i + 1]
                    else:
                        spans.append([i + 1 - n, i + 1])
                if found:
                    covered = sum(e - s for s, e in spans)
                    coverage, rest = covered / len(spots), None
                    if clean and coverage <= max_coverage:
                        place, kept, at = origins(text), [], 0
                        for s, e in spans:
                            first, last = spots[s].start(), spots[e - 1].end() - 1
                            kept.append(text[at : place[first] if place else first])
                            at = (place[last] if place else last) + 1
                        rest = "".join([*kept, text[at:]])
                    rows.append((key, sorted(found), [{"first_word": s, "last_word": e - 1} for s, e in spans], covered, len(spots), coverage, rest))
            yield pd.DataFrame(rows, columns=["key", "items", "spans", "covered_words", "n_words", "coverage", "rest"])

    return run


def leaks(
    texts: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, min_words: int = MIN_WORDS, clean: bool = False, max_coverage: float = 1.0, max_words: int = MAX_WORDS
) -> DataFrame:
    """The texts that share ``min_words`` successive words with an item: (key, items, spans, covered_words, n_words, coverage, rest).

    spans are maximal runs of matched words, coverage the share of the words they cover; ``clean`` gives in rest the text as stored without
    them, null where coverage is above ``max_coverage``.  With items in several shares a text has one row per share in which it leaks.
    Nulls and empty texts or items match nothing; texts and items of fewer words neither.  Repeated texts come out each; items with equal
    text are all reported.  Empty tables give no rows.  Other columns are ignored.
    """
    spark = texts.sparkSession
    kt, it = texts.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {kt}, items array<{it}>, spans array<struct<first_word: int, last_word: int>>, covered_words int, n_words int, coverage double, rest string"
    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    present = items.select(item_key, item_text).filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).orderBy(item_key, item_text)
    parts, held, size = [], [], 0

    def make() -> None:
        parts.append(source.mapInPandas(_stream(share(spark, Automaton(held, min_words)), clean, max_coverage), schema))

    for k, t in present.toLocalIterator():
        ws = words(t)
        if size and size + len(ws) > max_words:
            make()
            held, size = [], 0
        held.append((k, ws))
        size += len(ws)
    make()
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)
