"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block (any window of as many words as the template has, over line ends too) meets a template
when it holds at least ``threshold`` of the template's distinct words; all of them are found. It
gets the template's label if it also holds the words that name the license and its version, which
tell a license from another one whose notice differs in these words alone. Words are ordered by how many documents hold them, rarest first. A text
that misses all of a template's first ``size - needed + 1`` words can't have such a block (prefix
filter), nor can one with fewer words than needed (length filter), nor one whose first shared word
stands so late in both orders that too few words follow (positional filter). In the texts that are
left, each window's distinct words are counted as it moves on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_bytes

#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public license notices: their labels, words and, where they name a license, the words that tell it from others.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache 2 0"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", "creative commons sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license", "mit"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2 0"),
)

#: Lower-cases A-Z; what isn't a letter, a digit or beyond ASCII separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Templates:
    """Templates with their words in a global order, and an index of their prefixes."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float):
        self.labels = [t[0] for t in templates]
        words = [words_of(t[1].encode()) for t in templates]
        vocabulary = sorted({w for ws in words for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.lengths = [len(ws) for ws in words]
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in words]
        self.names = [frozenset(self.rank[w] for w in words_of("".join(t[2:]).encode())) for t in templates]
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (ranks, needed) in enumerate(zip(self.sets, self.needed)):
            for place, r in enumerate(ranks[: len(ranks) - needed + 1]):
                self.prefix.setdefault(r, []).append((k, place))
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def meets(self, words: list[bytes]) -> dict[int, tuple[float, float]]:
        """For each template that a window of ``words`` meets the largest containment, and that of the windows with the template's names (0: none meets it)."""
        ranks = [self.rank.get(w, -1) for w in words]
        held = frozenset(ranks)
        own = sorted(held - {-1})
        found: dict[int, tuple[float, float]] = {}
        seen: set[int] = set()
        for j, r in enumerate(own):
            for k, place in self.prefix.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                size, needed = len(self.sets[k]), self.needed[k]
                if len(own) < needed or 1 + min(size - place - 1, len(own) - j - 1) < needed:
                    continue
                if len(held.intersection(self.sets[k])) >= needed:
                    most, named = self._most(ranks, k)
                    if most >= needed:
                        found[k] = most / size, named / size if named >= needed else 0.0
        return found

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """The largest containment in a window with the names of each template that such a window meets."""
        return {k: named for k, (_, named) in self.meets(words).items() if named}

    def _most(self, ranks: list[int], k: int) -> tuple[int, int]:
        """Most distinct words of template ``k`` in one window, and in one that has its names (0: there is none)."""
        template, names, length = frozenset(self.sets[k]), self.names[k], self.lengths[k]
        places = [(at, r) for at, r in enumerate(ranks) if r in template]
        inside: dict[int, int] = {}
        best = named = first = 0
        for at, r in places:
            inside[r] = inside.get(r, 0) + 1
            while places[first][0] <= at - length:
                gone = places[first][1]
                first += 1
                if inside[gone] == 1:
                    del inside[gone]
                else:
                    inside[gone] -= 1
            best = max(best, len(inside))
            if len(inside) > named and names <= inside.keys():
                named = len(inside)
        return best, named


def template_rows(templates, most: int = 10_000) -> list[tuple]:
    """Templates as rows of label, text and names: given so, or as a table (label, text, names, which may be null) of ``most`` rows at most, as all tasks get them."""
    if not isinstance(templates, DataFrame):
        return list(templates)
    rows = templates.select("label", "text", F.coalesce("names", F.lit("")).alias("names")).filter("label is not null and text is not null").distinct().orderBy("label", "text", "names").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} templates")
    return [tuple(r) for r in rows if words_of(r["text"].encode())]


def _count_rows(vocabulary: frozenset[bytes]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                for w in vocabulary.intersection(words_of(text)):
                    total[w] = total.get(w, 0) + 1
        if total:
            yield pa.record_batch([pa.array([w.decode() for w in total], pa.string()), np.array(list(total.values()), np.int64)], names=["word", "n"])

    return rows


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at = [], 0
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at : at + len(phrase)] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


def _scan_rows(templates: Templates, phrases):
    split = [(words_of(p.encode()), label) for p, label in phrases]
    # For a quick look: a phrase's rarest word by length, and the words of templates' prefixes.
    marks = frozenset(max(p, key=len) for p, _ in split) | templates.rare

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text in text_bytes(batch.column("text")):
                words = words_of(text)
                if marks.isdisjoint(words):
                    out.append((len(words), 0, None, None, "", "", 0.0, ""))
                    continue
                places = [(at, label) for p, label in split for at in _places(words, p)]
                base = {label for _, label in places}
                met = {} if templates.rare.isdisjoint(words) else templates.meets(words)
                labels = base | {templates.labels[k] for k, (_, named) in met.items() if named}
                near = {templates.labels[k] for k in met}
                starts = [at for at, _ in places]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((most for most, _ in met.values()), default=0.0), ",".join(sorted(near))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "near_labels"]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", *names])

    return rows


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License labels of each text.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and last_word (smallest
    and largest of them, null if none), base_labels, labels (of phrases and of templates that a
    window meets and names; sorted, comma-joined), score (the largest containment of a template
    that a window meets, else 0) and near_labels (of all templates that a window meets).
    ``templates``: label, words and, optionally, the words among them that name the license, as
    rows or as a table (see :func:`template_rows`).
    The number of documents that hold each template word is counted over all documents first;
    that table is as large as the templates' vocabulary. Null texts count as empty; null ids
    and repeated rows come back as they are; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    templates = template_rows(templates)
    vocabulary = frozenset(w for t in templates for w in words_of(t[1].encode()))
    counted = rows.select("text").mapInArrow(_count_rows(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"].encode(): r["n"] for r in counted.collect()}  # a row for each template word
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, near_labels string"
    return rows.mapInArrow(_scan_rows(Templates(templates, counts, threshold), phrases), schema)
