"""Find license notices in texts: MinHash bands retrieve templates, containment verifies.

Words are runs of bytes other than ASCII white space, lower-cased, without marks at their
ends; runs without a letter or digit (comment marks, rules) are none.  A shingle is five words (a template of fewer words is one shingle of its own length).
Templates are grouped by size class: the smallest power of two of shingles that holds them.
For a class of size s, windows of 2s shingles start every s / 2 shingles, so a template of
at most s shingles lies whole in some window, of which it is at least a quarter if it has
more than s / 2 shingles (for s = 1, windows are single shingles).

A window and a template share each of ``bands`` bands of one MinHash row with probability
J, their Jaccard similarity.  With a containment of ``containment`` J is at least
containment * |T| / (2s + |T|), so some band agrees with probability 1 - (1 - J) ** bands;
``bands_for`` picks the bands for ``recall`` (0.999) at that J.  Retrieved pairs are then
verified exactly, on the words: the share of the template's distinct shingles that the window
holds (hashes only say where to compare).
Before, a text with fewer shingles that may be of a class's templates than any of them needs
is passed over (exact: a table of hash prefixes finds too many, never too few).

Templates are a parameter, at most ``MAX_TEMPLATES``; their bands are what is broadcast.

Defined results: NULL, empty and short texts match nothing; overlapping windows that match
one template are one match (first to last word); repeated rows are scanned each; templates
without a word are an error; an empty table gives no rows; very long texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comarca.llm.common import map_slices

WORDS = 5
MARKS = b"\"'()[]{}.,;:!?"
NO_WORD = re.compile(rb"[^a-z0-9\x80-\xff]*")
MAX_TEMPLATES = 1000
#: So many hashes are permuted at a time; longer texts take band after band (the result does not change).
BLOCK = 4_000_000
MATCHES = ("matches array<struct<template:string,first_word:int,last_word:int,"
           "found_shingles:int,template_shingles:int,containment:double>>")

#: Wording of common public notices, by the name of the license.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "all rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                  "in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                  "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                  "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of "
                        "the GNU General Public License as published by the Free Software Foundation, either version "
                        "3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: 1. Redistributions of source code must retain "
                    "the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def all_templates() -> dict[str, str]:
    """The notices above, and the whole license texts and headers of license_templates.json."""
    return TEMPLATES | json.loads(Path(__file__).with_name("license_templates.json").read_text("utf-8"))["templates"]


def words_of(text: str) -> list[bytes]:
    return [w.strip(MARKS) for w in text.encode("utf-8", "surrogatepass").lower().split() if not NO_WORD.fullmatch(w)]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from hashes of the words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def bands_for(jaccard: float, recall: float = 0.999) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - jaccard))) if jaccard < 1 else 1


class Scanner:
    """The templates of one shingle width and size class, and their bands."""

    def __init__(self, width: int, size: int, templates: list[tuple[str, dict[int, set[tuple[bytes, ...]]]]], containment: float):
        self.width, self.size, self.containment = width, size, containment
        #: name, shingles by their hash, number of shingles
        self.templates = [(name, own, sum(map(len, own.values()))) for name, own in templates]
        self.window = 1 if size == 1 else 2 * size
        self.step = max(1, size // 2)
        self.least = min(math.ceil(containment * len(s) - 1e-9) for _, s in templates)
        self.prefixes = np.zeros(1 << 20, bool)
        self.prefixes[[x >> 44 for _, s in templates for x in s]] = True
        # the worst case of a whole class: the fewest shingles in a window of others
        self.jaccard = 1.0 if size == 1 else min(
            containment * len(s) / (self.window + (1 - containment) * len(s)) for _, s in templates)
        self.bands = bands_for(self.jaccard)
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys = []
        for b in range(self.bands):
            lows = [self._permuted(np.array(sorted(s), np.uint64), b).min() for _, s in templates]
            order = np.argsort(np.array(lows))
            self.keys.append((np.array(lows)[order], order))
        self.lows = np.array([low[np.argsort(order)] for low, order in self.keys])

    def _permuted(self, hashes: np.ndarray, band) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = hashes * (self.factors[band] if isinstance(band, int) else self.factors[:, None])
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            return out

    def _window_lows(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The smallest value of each window, by row."""
        if self.window == 1:
            return values
        blocks, many = np.minimum.reduceat(values, starts, axis=1), self.window // self.step  # of step shingles each
        low = blocks.copy()
        for j in range(1, min(many, blocks.shape[1])):
            np.minimum(low[:, :-j], blocks[:, j:], out=low[:, :-j])
        return low

    def __call__(self, hashes: np.ndarray, words: Callable[[int], tuple[bytes, ...]]) -> Iterator[tuple[str, int, int, int, int]]:
        """Matches among a text's shingles of this width; ``words`` gives those of the shingle at a place."""
        if np.count_nonzero(self.prefixes[hashes >> np.uint64(44)]) < self.least:
            return
        starts = np.arange(0, len(hashes), self.step)
        ends = np.minimum(starts + self.window, len(hashes))
        candidates: set[tuple[int, int]] = set()
        together = len(self.templates) <= 16 and len(hashes) * self.bands <= BLOCK
        if together:  # all bands in one array
            window_low = self._window_lows(self._permuted(hashes[None, :], slice(None)), starts)
            for t in range(len(self.templates)):
                candidates.update((int(w), t) for w in np.flatnonzero((window_low == self.lows[:, t, None]).any(axis=0)))
        for b, (lows, order) in enumerate(() if together else self.keys):
            window_low = self._window_lows(self._permuted(hashes, b)[None, :], starts)[0]
            left, right = np.searchsorted(lows, window_low), np.searchsorted(lows, window_low, "right")
            for w in np.flatnonzero(left < right):
                candidates.update((int(w), int(t)) for t in order[left[w]:right[w]])
        for w, t in sorted(candidates):
            name, shingles, many = self.templates[t]
            held = {i: own for i in range(starts[w], ends[w]) if (same := shingles.get(int(hashes[i]))) and (own := words(i)) in same}
            found = len(set(held.values()))
            if found >= self.containment * many:
                yield name, min(held), max(held) + self.width - 1, found, many


def hashed_words(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of words, given with or without their marks; zero for what is no word."""
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 400_000:
            known.clear()
        for w in words:
            if w not in known:
                bare = w.strip(MARKS)
                known[w] = 0 if NO_WORD.fullmatch(w) else (crc32(bare) << 32 | crc32(bare[::-1], 0x5BD1E995)) & (1 << 64) - 1 or 1
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def scanners(templates: dict[str, str], containment: float = 0.8) -> list[Scanner]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES}")
    classes: dict[tuple[int, int], list] = {}
    for name, text in templates.items():
        words = words_of(text)
        if not words:
            raise ValueError(f"template {name!r} has no word")
        width = min(WORDS, len(words))
        shingles: dict[int, set[tuple[bytes, ...]]] = {}
        for i, x in enumerate(shingle_hashes(hashed_words(words, {}), width)):
            shingles.setdefault(int(x), set()).add(tuple(words[i:i + width]))
        classes.setdefault((width, 1 << (len(words) - width).bit_length()), []).append((name, shingles))
    return [Scanner(width, size, own, containment) for (width, size), own in sorted(classes.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, text: str = "text") -> DataFrame:
    """``matches`` instead of ``text``: where each template's notice stands in every whole text."""
    ready = docs.sparkSession.sparkContext.broadcast(scanners(all_templates() if templates is None else templates, containment))

    def start():
        known: dict[bytes, int] = {}

        def matches(t: str | None) -> list[dict]:
            words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            if not words:
                return []
            hashes, out = hashed_words(words, known), []
            places = np.flatnonzero(hashes)  # of words among all runs
            shingles = {width: shingle_hashes(hashes[places], width) for width in {s.width for s in ready.value}}
            for scanner in ready.value:
                merged: dict[str, list] = {}
                own_words = lambda i, n=scanner.width: tuple(words[p].strip(MARKS) for p in places[i:i + n])
                for name, lo, hi, found, of in scanner(shingles[scanner.width], own_words):
                    own = merged.setdefault(name, [])
                    if own and lo <= own[-1][1]:
                        own[-1][1], own[-1][2] = max(own[-1][1], hi), max(own[-1][2], found)
                    else:
                        own.append([lo, hi, found, of])
                out += [{"template": name, "first_word": int(places[lo]), "last_word": int(places[hi]), "found_shingles": found, "template_shingles": of,
                         "containment": found / of} for name, own in merged.items() for lo, hi, found, of in own]
            return sorted(out, key=lambda m: (m["first_word"], m["template"], m["last_word"]))

        def make(texts: pa.Array) -> list[pa.Array]:
            kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()),
                                       ("found_shingles", pa.int32()), ("template_shingles", pa.int32()), ("containment", pa.float64())]))
            return [pa.array([matches(t) for t in texts.to_pylist()], kind)]
        return make

    return map_slices(docs, [text], MATCHES, start)
