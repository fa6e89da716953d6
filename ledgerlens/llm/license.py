"""License scans by conditional compression.

A block that a license template helps to compress is likely to be worded like it.  Candidate blocks (sentences, lines
and stretches of a template's length around license words; their words in lower case) are compressed with zstandard, alone and with
each template as raw dictionary; templates are ranked by how much they reduce the size.  Those that do are then
confirmed by comparing their words with the block's: a winner must have its words in order in the block with few
differences.  All wordings of a block are found in one pass: only stretches that hold enough of a template's words in any
order are compared, and these are short, so the work grows in proportion to the text, however often it repeats a wording.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from math import ceil

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wordings of public license texts and notices: (license, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the MPL 2.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)
HINT = r"(?i)licen[sc]|copyright|warrant|permission|redistribut|public domain|creative commons|\bCC[ -]?(BY|0)"
#: Share of a template's words that the block must have in order, and of differing words that it may have besides.
MIN_SHARE = 0.85
MAX_EXTRA = 0.25
#: Least reduction of the compressed size for a template to be looked at, as a share of the block's size or the template's own.
MIN_REDUCTION = 0.25
LEVEL = 3
_WORDS = regex.compile(r"[\p{L}\p{N}]+(?:[.\-/][\p{L}\p{N}]+)*")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+(?=\S)")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates = [(name, text, words(text)) for name, text in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given, self.own = [], []
        for _, _, w in self.templates:
            self.own.append(len(self.plain.compress(" ".join(w).encode())))
            raw = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False))
        self.hint = regex.compile(HINT)
        self.longest = max(len(w) for _, _, w in self.templates)
        self.known: dict[str, list[tuple[float, int]]] = {}

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(reduction, template), the largest reduction first, by compressed size with each template against none.

        A template is looked at if it saves a share of the block's size or, in a longer block, of its own.
        """
        got = self.known.get(block)
        if got is None:
            data = " ".join(words(block)).encode("utf-8", "replace")
            alone = len(self.plain.compress(data))
            got = sorted(((1 - len(c.compress(data)) / alone, -i) for i, c in enumerate(self.given)), reverse=True)
            got = [(r, -i) for r, i in got if r >= MIN_REDUCTION or r * alone >= MIN_REDUCTION * self.own[-i]]
            if len(self.known) > 10_000:
                self.known.clear()
            if len(block) < 1000:
                self.known[block] = got
        return got

    def blocks(self, text: str):
        """Candidate blocks (first and last character) of a text: sentences with a hint, and stretches with a template's
        length on both sides of each hint, inside its line and over the lines around, so that wordings over several
        sentences or lines stand whole.  None is longer than 4 * reach but for a sentence around one hint."""
        at, reach, every = 0, 8 * self.longest, []
        for line in text.split("\n"):
            if hints := [(at + m.start(), at + m.end()) for m in self.hint.finditer(line)]:
                every += hints
                cut = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
                for a, b in zip(cut, cut[1:], strict=False):
                    if self.hint.search(line, a, b):
                        yield from self._stretches([h for h in hints if at + a <= h[0] < at + b] if b - a > 4 * reach else [(at + a, at + b)],
                                                   at + a, at + b, reach)
                yield from self._stretches(hints, at, at + len(line), reach)
            at += len(line) + 1
        yield from self._stretches(every, 0, len(text), reach)

    @staticmethod
    def _stretches(hints: list[tuple[int, int]], low: int, high: int, reach: int):
        """What lies within ``reach`` of hints, from low to high; long runs are cut into stretches of 4 * reach that overlap by
        2 * reach, so that any wording of up to that length is whole in one."""
        run: list[list[int]] = []
        for start, end in hints:
            a, b = max(low, start - reach), min(high, end + reach)
            if run and a <= run[-1][1]:
                run[-1][1] = b
            else:
                run.append([a, b])
        for a, b in run:
            yield a, min(b, a + 4 * reach)
            while b - a > 4 * reach:
                a += 2 * reach
                yield a, min(b, a + 4 * reach)

    @staticmethod
    def _compare(have: list[str], want: list[str]) -> tuple[int, int, int] | None:
        """(words found, first, last) of the wording ``want`` in ``have``, if enough of it is there in order."""
        match = [m for m in difflib.SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if m.size]
        if not match:
            return None
        # words that stand alone, far before or after the others, are not part of the wording
        extra = lambda: match[-1].a + match[-1].size - match[0].a - sum(m.size for m in match)
        while len(match) > 1 and extra() > MAX_EXTRA * len(want):
            left, right = match[1].a - match[0].a - match[0].size, match[-1].a - match[-2].a - match[-2].size
            del match[0 if left - match[0].size >= right - match[-1].size else -1]
        found = sum(m.size for m in match)
        if found < MIN_SHARE * len(want) or extra() > MAX_EXTRA * len(want):
            return None
        return found, match[0].a, match[-1].a + match[-1].size - 1

    def confirm(self, have: list[str], template: int) -> list[tuple[int, int, int, int]]:
        """(first word, last word, words missing, words too many) of a template's wordings among a block's words.

        A wording lies in a window of its length and the words that may be too many.  Windows that hold enough of its words in
        any order are joined to regions, cut so that each wording is whole in one, and compared.
        """
        want = self.templates[template][2]
        need, width = ceil(MIN_SHARE * len(want)), len(want) + int(MAX_EXTRA * len(want))
        wanted, inside, count, regions = Counter(want), Counter(), 0, []
        counts = []
        for e, word in enumerate(have):
            inside[word] += 1
            count += inside[word] <= wanted[word]
            if e >= width:
                old = have[e - width]
                count -= inside[old] <= wanted[old]
                inside[old] -= 1
            counts.append(count)
            if count >= need:
                a = max(0, e + 1 - width)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = e + 1
                else:
                    regions.append([a, e + 1])
        todo = [(a, min(z, a + 3 * width)) for low, z in regions for a in range(low, max(low + 1, z - width), 2 * width)]
        out = []
        while todo:
            a, z = todo.pop()
            if z - a < need:
                continue
            got = self._compare(have[a:z], want)
            if got is None and z - a > width:  # parts of other wordings may be in the way: the best window alone
                e = max(range(a + width - 1, z), key=lambda e: counts[e])
                got = self._compare(have[e + 1 - width:e + 1], want)
                got = got and (got[0], got[1] + e + 1 - width - a, got[2] + e + 1 - width - a)
            if got:
                found, first, last = got
                out.append((a + first, a + last, len(want) - found, last + 1 - first - found))
                todo += [(a, a + first), (a + last + 1, z)]
        return out

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, template, reduction, missing, extra) of confirmed wordings without overlaps.

        Where wordings overlap, the one with most words that are its own stays.
        """
        best: dict[tuple, float] = {}
        for a, b in dict.fromkeys(self.blocks(text)):
            ranked = self.ranked(text[a:b])
            if not ranked:
                continue
            spans = [(m.group().lower(), a + m.start(), a + m.end()) for m in _WORDS.finditer(text[a:b])]
            have = [w for w, _, _ in spans]
            for reduction, i in ranked:
                for first, last, missing, extra in self.confirm(have, i):
                    key = (spans[first][1], spans[last][2], i, missing, extra)
                    best[key] = max(reduction, best.get(key, reduction))
        own = lambda f: len(self.templates[f[2]][2]) - 2 * f[3] - f[4]
        kept: list[tuple] = []
        for f in sorted(best, key=lambda f: (-own(f), f[3] + f[4], f[0], f[2])):
            at = bisect_left(kept, f)
            if (at == 0 or kept[at - 1][1] <= f[0]) and (at == len(kept) or kept[at][0] >= f[1]):
                kept.insert(at, f)
        return [(a, z, self.templates[i][0], i, best[a, z, i, m, x], m, x) for a, z, i, m, x in kept]


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, start, end, license, template, reduction, missing, extra, exact) of each license wording in ``docs`` (doc_id, text).

    start and end are characters of the text; missing and extra count differing words, exact means none.  Texts without
    a wording, null and empty texts have no row; repeated rows give repeated results.  A text may be of any length and hold
    any number of wordings.  Other columns are ignored.
    """
    schema = ("doc_id long, start long, end long, license string, template int, reduction double, missing int, extra int, "
              "exact boolean")
    names = ["doc_id", "start", "end", "license", "template", "reduction", "missing", "extra", "exact"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]

    def scan(batches):
        scanner = Scanner(templates)
        for b in batches:
            rows = [(doc, *f, f[5] + f[6] == 0) for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)
                    for f in scanner.scan(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    hinted = docs.where(F.col("text").rlike(HINT)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return hinted.mapInArrow(scan, schema)
