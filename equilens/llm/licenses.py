"""License scans by conditional compression.

Blocks of text with a licensing word are compressed once on their own and once with each license template as a raw
Zstandard dictionary. Templates are ranked by how much smaller the block becomes and confirmed by the exact differences
of wording between a run of the text's words and the template: few words may differ, and none by which licences are
told apart. Of templates that are confirmed in one place, the one that explains most words counts. A confirmed notice is taken out and the rest of its
block is ranked again, so a block gives every notice that is in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import small_batches

# Public license notices by SPDX identifier, without list numbers.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.")
BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
    "software developed by the organization.")
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software "
    "Foundation, either version {} of the License, or (at your option) any later version.")
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", f"{BSD} {BSD_NAMES}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", f"{BSD} The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", f"{BSD} {BSD_ADVERTISING} {BSD_NAMES}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.0", GNU.format("GNU Library General Public License", "2")),
    ("LGPL-2.1", GNU.format("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", GNU.format("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", GNU.format("GNU Affero General Public License", "3")),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)

# Parts of words in which licences differ; so do numbers.
DISTINCT = frozenset((
    "affero lesser gnulibrary gpl lgpl agpl mit apache mozilla mpl bsd isc cc by sa nc nd attribution sharealike noncommercial "
    "noderivatives noderivs not").split())

CUE = r"(?i)licen[sc]|copyright|spdx|permission|redistribut|public domain|free software|all rights|warrant"
UNIT = re.compile(r"[^\n]*?[.!?;:](?=\s)|[^\n]+")
WORD = re.compile(r"\w+(?:[.\-+]\w+)*")
LISTED = re.compile(r"(?:^|\n|[.:;,]\s)[\s*#/]*\(?(\d{1,2})[.)](?=\s)")


@dataclass(frozen=True)
class Scan:
    """A unit (sentence or line) longer than ``unit_words`` is looked at in windows of that many words, half
    overlapping; neighbouring units with a licensing word, at most ``gap`` units apart, form a block until it has
    ``block_words`` words. A template is confirmed where the words that differ from a run of the text's words are at
    most ``differing`` of the template's words and don't tell licences apart; every template is tried that has enough of its words there. Where none
    is confirmed, the closest of the ``ranked`` best templates is named."""

    unit_words: int = 80
    block_words: int = 160
    gap: int = 1
    ranked: int = 4
    differing: float = 0.15
    level: int = 9


def units(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Spans of sentences and lines, long ones in half-overlapping windows."""
    for m in UNIT.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = m.start() + len(m[0].rstrip())
        if end <= start:
            continue
        words = [w.span() for w in re.finditer(r"\S+", text[start:end])] if end - start > size else []
        if len(words) <= size:
            yield start, end
            continue
        for k in range(0, len(words), size // 2):
            yield start + words[k][0], start + words[min(k + size, len(words)) - 1][1]
            if k + size >= len(words):
                break


def blocks(text: str, scan: Scan) -> Iterator[tuple[int, int]]:
    """Spans of blocks around licensing words."""
    cue = re.compile(CUE)
    start, end, last, size = -1, -1, -10, 0
    for k, (a, b) in enumerate(units(text, scan.unit_words)):
        if not cue.search(text, a, b):
            continue
        words = len(WORD.findall(text, a, b))
        if start >= 0 and k - last <= scan.gap + 1 and size + words <= scan.block_words:
            end, size = b, size + words
        else:
            if start >= 0:
                yield start, end
            start, end, size = a, b, words
        last = k
    if start >= 0:
        yield start, end


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their spans. Numbers of lists are left out, 'v2.0' and 'v. 2.0' are 'version 2', and the
    'library' of 'GNU Library' is a word of its own, as programs are libraries too."""
    listed, out = {m.start(1) for m in LISTED.finditer(text)}, []
    for m in WORD.finditer(text):
        word, last = m[0].lower(), out[-1][0] if out else ""
        if m.start() in listed and last not in ("version", "v"):
            continue
        number = re.fullmatch(r"(v?)(\d+(?:\.\d+)*?)(?:\.0)*", word)
        if number:
            if number[1]:
                out.append(("version", m.start(), m.start() + 1))
            elif last == "v":
                out[-1] = ("version", *out[-1][1:])
            word = number[2]
        elif word == "library" and last == "gnu":
            word = "gnulibrary"
        out.append((word, m.start() + len(number[1]) if number else m.start(), m.end()))
    return out


def distinct(apart: list[str]) -> bool:
    """Whether differing words tell licences apart: a number, or a part of a word in ``DISTINCT``, on one side only."""
    sides = {"-": Counter(), "+": Counter()}
    for w in apart:
        parts = re.findall(r"\d+(?:\.\d+)*|[^\W\d_]+", w[1:])
        sides[w[0]].update(re.sub(r"(\.0)+$", "", p) for p in parts if p in DISTINCT or p[0].isdigit())
    return sides["-"] != sides["+"]


def distances(template: list[str], own: list[str]) -> np.ndarray:
    """Fewest differing words between the first i words of the template and a run of ``own`` that ends at word j."""
    at, place = np.arange(len(own) + 1), {}
    codes = np.array([place.setdefault(w, len(place)) for w in own], int)
    cost = np.zeros((len(template) + 1, len(own) + 1), np.int32)
    for i, w in enumerate(template):
        row = cost[i] + 1
        row[1:] = np.where(codes == place.get(w, -1), np.minimum(row[1:], cost[i][:-1]), row[1:])
        cost[i + 1] = np.minimum.accumulate(row - at) + at
    return cost


def path(cost: np.ndarray, template: list[str], own: list[str], end: int) -> tuple[list[str], int]:
    """Words that only the template (-) or only the run of ``own`` up to ``end`` (+) has, and where the run begins."""
    i, j, out = len(template), end, []
    while i:
        if j and template[i - 1] == own[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(f"-{template[i]}")
        else:
            j -= 1
            out.append(f"+{own[j]}")
    return out[::-1], j


class Scanner:
    """Compressors for all templates, made once per task."""

    def __init__(self, templates: tuple[tuple[str, str], ...], scan: Scan):
        self.templates, self.scan = templates, scan
        self.alone = zstandard.ZstdCompressor(level=scan.level)
        self.given = []
        for _, text in templates:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=scan.level)
            self.given.append(zstandard.ZstdCompressor(level=scan.level, dict_data=raw))
        self.words = [[w[0] for w in tokens(t)] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]

    def ranking(self, block: str) -> list[tuple[float, int]]:
        """(share by which the template makes the block smaller, template), best first, ties by template."""
        raw = block.encode("utf-8", "replace")
        plain = len(self.alone.compress(raw))
        found = [(1 - len(c.compress(raw)) / plain, k) for k, c in enumerate(self.given)]
        return sorted(found, key=lambda r: (-r[0], r[1]))

    def closest(self, template: int, own: list[str], lo: int, hi: int) -> tuple[list[str], int, int] | None:
        """The confirmed run of ``own`` with the fewest differences that touches words lo to hi, the first of equal
        ones: words that only the template (-) or only the run (+) has, and the run's bounds."""
        words, most = self.words[template], self.scan.differing * len(self.words[template])
        cost = distances(words, own)
        for end in map(int, np.argsort(cost[-1], kind="stable")):
            if cost[-1][end] > most:
                return None
            if end > lo:
                apart, start = path(cost, words, own, end)
                if start < hi and not distinct(apart):
                    return apart, start, end
        return None

    def part(self, text: str, words: list[tuple[str, int, int]], lo: int, hi: int, low: int, high: int) -> Iterator[tuple[dict, int]]:
        """Rows of words lo to hi, each with the word after it: the best confirmed notice is taken out and what is left
        of it and right of it is looked at again. A notice may begin and end outside, between ``low`` and ``high``."""
        if lo >= hi:
            return
        a, b = words[lo][1], words[hi - 1][2]
        ranking = self.ranking(text[a:b])
        reach = lambda k: int(len(self.words[k]) * (1 + self.scan.differing)) + 1
        far = max(map(reach, range(len(self.words))))
        there = Counter(w[0] for w in words[max(low, lo - far):min(high, hi + far)])
        found = []
        for gain, k in ranking:
            if (self.counts[k] - there).total() > self.scan.differing * len(self.words[k]):
                continue
            first = max(low, lo - reach(k))
            run = self.closest(k, [w[0] for w in words[first:min(high, hi + reach(k))]], lo - first, hi - first)
            if run:
                found.append((len(run[0]) - len(self.words[k]), len(run[0]), -gain, k, run[0], first + run[1], first + run[2]))
        if found:
            _, _, gain, k, apart, i, j = min(found)
            yield from self.part(text, words, lo, i, low, i)
            yield self.row(words[i][1], words[j - 1][2], k, -gain, apart, True), j
            yield from self.part(text, words, j, hi, j, high)
        elif re.search(CUE, text[a:b]):
            own = [w[0] for w in words[lo:hi]]
            ranked = [(gain, k, self.differences(own, k)) for gain, k in ranking[: self.scan.ranked] if gain > 0]
            if ranked:
                gain, k, apart = min(ranked, key=lambda r: (len(r[2]) / len(self.words[r[1]]), -len(self.words[r[1]]), -r[0], r[1]))
                yield self.row(a, b, k, gain, apart, False), hi

    def differences(self, own: list[str], template: int) -> list[str]:
        cost = distances(self.words[template], own)
        return path(cost, self.words[template], own, int(cost[-1].argmin()))[0]

    def row(self, start: int, end: int, k: int, gain: float, apart: list[str], confirmed: bool) -> dict:
        return {
            "start": start, "end": end, "license": self.templates[k][0], "template": k, "reduction": gain,
            "n_differences": len(apart), "differences": apart, "confirmed": confirmed,
        }

    def scan_text(self, text: str) -> Iterator[dict]:
        words, done = None, 0
        for start, end in blocks(text, self.scan):
            words = words or tokens(text)
            lo, hi = (bisect_left(words, at, key=lambda w: w[1]) for at in (start, end))
            for row, after in self.part(text, words, max(lo, done), hi, done, len(words)):
                yield row
                if row["confirmed"]:
                    done = after


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, scan: Scan = Scan()) -> DataFrame:
    """One row per confirmed notice, and one per block (or what notices leave of it) with a licensing word that only
    some template makes smaller: doc_id, start and end (characters), license, template, reduction of the block,
    n_differences, differences and confirmed. Confirmed notices don't overlap.

    Whole texts are scanned. Null and empty texts and texts without a licensing word give no rows; a repeated row
    gives its rows again; a null doc_id stays null; ties go to the earlier template; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("template", pa.int32()),
        ("reduction", pa.float64()), ("n_differences", pa.int32()), ("differences", pa.list_(pa.string())), ("confirmed", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, scan)
        for batch in batches:
            rows = [{"doc_id": i} | r for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in scanner.scan_text(t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = docs.where(F.col("text").rlike(CUE)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, (
        "doc_id long, start int, end int, license string, template int, reduction double, n_differences int, "
        "differences array<string>, confirmed boolean"))
