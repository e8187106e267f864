"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into word 3-grams; of every WINDOW neighbouring ones the least by hash goes into an inverted index
(winnowing), so that a copy of WINDOW + 2 words in a row always shares one. Documents that hold enough fingerprints
of a template on near diagonals are aligned with it in a band around them; the share of the template's words that are
matched in order and the span in the document are reported.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .grams import WORD, GramIndex, banded_matches, plain_words

WINDOW = 2

#: Notices and short texts of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-4.0-short": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-short": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-short": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nd-4.0-short": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-4.0-short": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-nd-4.0-short": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "cc0-1.0-short": "This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "agpl-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-2.1-short": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-short": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: Templates that differ in a few words or go on where another ends: of matches that overlap, the best alone is reported.
VARIANTS = tuple(re.compile(p) for p in (r"bsd-.*", r".*-(line|short)", r"(a|l)?gpl-.*-notice"))


def best_variants(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """found: (template, coverage, begin, end, words matched less words missed). Of overlapping variants the one with the most of these."""
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[4], m[2], m[0])):
        mine = next((v for v in VARIANTS if v.fullmatch(m[0])), None)
        if mine is None or not any(mine.fullmatch(k[0]) and k[2] < m[3] and m[2] < k[3] for k in kept):
            kept.append(m)
    return kept


class TemplateIndex:
    """The inverted index of winnowed fingerprints. Templates are a bounded, given set."""

    def __init__(self, templates: dict[str, str], window: int = WINDOW):
        self.names = sorted(n for n in templates if plain_words(templates[n]))
        words = [plain_words(templates[n]) for n in self.names]
        self.index = GramIndex(words, 3)
        at = defaultdict(list)
        self.least = []
        for k, (grams, text) in enumerate(zip(self.index.grams, words)):
            digest = [xxhash.xxh64_intdigest(" ".join(text[p : p + 3])) for p in range(len(grams))]
            chosen = {min(range(p, min(p + window, len(grams))), key=lambda q: (digest[q], -q)) for p in range(max(1, len(grams) - window + 1))}
            for p in chosen:
                at[int(grams[p])].append((k, p))
            self.least.append(min(2, len(chosen)))
        self.keys = np.array(sorted(at), np.int64)
        self.places = [at[int(k)] for k in self.keys]

    def matches(self, text: str | None, least_coverage: float) -> list[tuple[str, float, int, int]]:
        """(template, coverage, begin, end) in code points, by begin."""
        words = plain_words(text)
        ids = self.index.numbers(words)
        pos, place = self.index.find(ids, self.keys)
        if not len(pos):
            return []
        hits = defaultdict(list)
        for p, s in zip(pos.tolist(), place.tolist()):
            for k, at in self.places[s]:
                hits[k].append((p - at, at, p))
        spans = [m.span() for m in WORD.finditer(text)]
        out = []
        for k, mine in hits.items():
            n = len(self.index.ids[k])
            for matched, first, last in self.aligned(k, sorted(mine), ids, least_coverage):
                out.append((self.names[k], matched / n, spans[first][0], spans[last][1], 2 * matched - n))
        return sorted((m[:4] for m in best_variants(out)), key=lambda m: (m[2], -m[3], m[0]))

    def aligned(self, k: int, hits: list[tuple[int, int, int]], ids: np.ndarray, least_coverage: float) -> list[tuple[int, int, int]]:
        """(matched, first, last) of template k. hits: (diagonal, place in the template, place in the document), sorted.

        Windows of neighbouring diagonals are aligned from the one with the most different places down. A window's
        hits are then spent, and so are those in the span of its match, but for hits that are used no window is
        left out: whatever stands before or between, each full copy is aligned on its own diagonals.
        """
        template = self.index.ids[k]
        band = max(4, len(template) // 8)
        spent = [False] * len(hits)

        def window(i: int) -> list[int]:
            end = i
            while end < len(hits) and hits[end][0] <= hits[i][0] + band:
                end += 1
            return [j for j in range(i, end) if not spent[j]]

        def places(i: int) -> int:
            return len({hits[j][1] for j in window(i)})

        heap = [(-places(i), i) for i in range(len(hits))]
        heapq.heapify(heap)
        by_place = sorted(range(len(hits)), key=lambda j: hits[j][2])
        at_place = [hits[j][2] for j in by_place]
        out = []
        while heap:
            held, i = heapq.heappop(heap)
            if -held < self.least[k]:
                break
            if spent[i]:
                continue
            if (now := places(i)) != -held:
                heapq.heappush(heap, (-now, i))
                continue
            matched, first, last = banded_matches(template, ids, hits[i][0] - band // 2, hits[i][0] + band + band // 2)
            for j in window(i):
                spent[j] = True
            if matched and matched / len(template) >= least_coverage:
                out.append((matched, first, last))
                for j in by_place[bisect_left(at_place, first) : bisect_right(at_place, last)]:
                    spent[j] = True
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least_coverage: float = 0.7) -> DataFrame:
    """(doc_id, n_matches, licenses, coverage, spans), a row for each row of docs.

    licenses, coverage and spans are comma-joined, in the order of the matches' begins; spans are begin:end in code
    points, coverage the matched share of the template's words with three decimals. Null and empty texts have no match;
    rows that repeat are reported each; an empty table, and an empty set of templates, give what one expects. Other
    columns aren't read. A short notice that a longer one begins with is reported beside it; of overlapping variants
    (VARIANTS) only the nearest is.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [index.matches(t, least_coverage) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(m[0] for m in f) for f in found], pa.string()), pa.array([",".join(f"{m[1]:.3f}" for m in f) for f in found], pa.string()), pa.array([",".join(f"{m[2]}:{m[3]}" for m in f) for f in found], pa.string())],
                names=["doc_id", "n_matches", "licenses", "coverage", "spans"],
            )

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_matches bigint, licenses string, coverage string, spans string")
