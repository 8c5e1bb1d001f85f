"""License scans: winnowed template fingerprints pick candidates, banded alignment reports what matched."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontam import word_hashes, words_of

#: Notices, headers and opening passages of common licenses, by (license, kind).
TEMPLATES = {
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ("MIT", "notice"): "Released under the MIT License.",
    ("MIT", "licensed"): "Licensed under the MIT License.",
    ("MIT", "opening"): 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ("GPL-3.0", "notice"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "header"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ("GPL-2.0", "notice"): "This work is licensed under the GNU General Public License, version 2.",
    ("LGPL-3.0", "notice"): "This work is licensed under the GNU Lesser General Public License, version 3.",
    ("BSD-2-Clause OR BSD-3-Clause", "opening"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ("ISC", "opening"): "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ("MPL-2.0", "notice"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ("CC-BY-4.0", "notice"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "notice"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-ND-4.0", "notice"): "Licensed under CC BY-ND 4.0.",
    ("CC0-1.0", "notice"): "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
HEADER = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark2} either version {version} of the License, or (at your option) any later version."
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD = TEMPLATES["BSD-2-Clause OR BSD-3-Clause", "opening"] + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
TEMPLATES |= {
    ("GPL-2.0", "header"): HEADER.format(what="program", mark=";", mark2=";", name="General Public License", version=2),
    ("LGPL-2.1", "header"): HEADER.format(what="library", mark=";", mark2=";", name="Lesser General Public License", version=2.1),
    ("LGPL-3.0", "header"): HEADER.format(what="program", mark=":", mark2=",", name="Lesser General Public License", version=3),
    ("AGPL-3.0", "header"): HEADER.format(what="program", mark=":", mark2=",", name="Affero General Public License", version=3),
    ("AGPL-3.0", "notice"): "This work is licensed under the GNU Affero General Public License, version 3.",
    ("CC-BY-NC-SA-4.0", "notice"): "Licensed under CC BY-NC-SA 4.0.",
    ("CC-BY-NC-ND-4.0", "notice"): "Licensed under CC BY-NC-ND 4.0.",
    ("MPL-2.0", "header"): TEMPLATES["MPL-2.0", "notice"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ("MIT", "text"): TEMPLATES["MIT", "opening"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ("ISC", "text"): TEMPLATES["ISC", "opening"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ("BSD-2-Clause", "text"): BSD + AS_IS,
    ("BSD-3-Clause", "text"): BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + AS_IS,
}
#: Whole license texts, a file each.
TEMPLATES |= {(f.name.removesuffix(".txt"), "text"): f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
GNU = {"GPL": "gnu general public license", "LGPL": "lesser general public license", "AGPL": "affero general public license"}
#: Words that must stand, and that must not stand, in what is named so: its near siblings differ in them.
NEEDED = {f"{k}-{v}": (words, f"version {v.removesuffix('.0').replace('.', ' ')}") for k, words in GNU.items() for v in ("2.0", "2.1", "3.0")}
NEEDED |= {"LGPL-2.0": ("library general public license", "version 2"), "Apache-2.0": ("apache license",), "BSD-3-Clause": ("neither the name",)}
NEEDED |= {n: (f"cc {n[3:-4].replace('-', ' ').lower()} 4 0",) for n, _ in TEMPLATES if n.startswith("CC-BY")}
BARRED = {"GPL-3.0": ("remote network interaction",), "BSD-2-Clause": ("neither the name",)}
GRAM, WINDOW = 3, 2
#: Templates of more words are aligned at the diagonals of most hits first. A template is aligned only where as many of its fingerprints as this share of its words, each counted once, are found near a diagonal.
LONG, LEAST_HITS = 400, 0.05
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def grams(hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint64)
    if len(h) < GRAM:
        return h[:0]
    out = np.zeros(len(h) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + len(out)] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out ^ (out >> np.uint64(29))


def inverted_index(templates: dict) -> tuple[list, dict[int, list[tuple[int, int]]]]:
    """Templates as (license, kind, words), and for each winnowed fingerprint its (template, position)."""
    ready, index = [], defaultdict(list)
    for t, ((name, kind), text) in enumerate(sorted(templates.items())):
        words = words_of(text)
        ready.append((name, kind, words))
        g = grams(word_hashes(words))
        picked = {i + int(np.argmin(g[i : i + WINDOW])) for i in range(max(1, len(g) - WINDOW + 1))} if len(g) else set()
        for i in picked:
            index[int(g[i])].append((t, i))
    return ready, dict(index)


def align(template: list[bytes], words: list[bytes], at: int, band: int) -> tuple[int, int, int, int] | None:
    """Best alignment of the template with words near position `at`, within `band` of the diagonal: (matched, edits, first, last + 1).

    Matches count 1 and inserted, deleted or replaced words -0.5; what precedes and follows the template in the text is free.
    """
    m, width = len(template), 2 * band + 1
    known = {w: k for k, w in enumerate(dict.fromkeys(template))}
    wanted = [known[w] for w in template]
    # the text position j of cell d in row i is at + i - band + d, and stands for word j - 1
    near = np.full(m + width, -1)
    lo, hi = max(0, at - band), min(len(words), at - band + m + width)
    near[lo - (at - band) : max(hi, lo) - (at - band)] = [known.get(w, -1) for w in words[lo:hi]]
    best = np.zeros(width)
    trail = np.zeros((m + 1, width), np.int8)
    cells = np.arange(width)
    for i in range(1, m + 1):
        begin = at + i - band
        first, end = min(max(1 - begin, 0), width), min(max(len(words) + 1 - begin, 0), width)  # cells with a word: first <= d < end
        new, code = np.full(width, -1e9), np.zeros(width, np.int8)
        if first < end:
            new[first:end] = best[first:end] + np.where(near[i - 1 + first : i - 1 + end] == wanted[i - 1], 1.0, -0.5)
            code[first:end] = 1
        down = best[1:] - 0.5
        better = (down >= new[:-1]) | (code[:-1] == 0)
        new[:-1][better], code[:-1][better] = down[better], 2
        if first < end:
            k = max(first - 1, 0)
            reach = np.maximum.accumulate(new[k:end] + 0.5 * cells[k:end]) - 0.5 * cells[k:end]
            side = np.full(width, -np.inf)
            side[k + 1 : end] = reach[:-1] - 0.5
            better = side >= new
            new[better], code[better] = side[better], 3
        trail[i] = code
        best = new
    d = int(best.argmax())
    i, matched, edits, first, last = m, 0, 0, None, None
    while i > 0 and trail[i, d]:
        j = at + i - band + d
        if trail[i, d] == 1:
            if words[j - 1] == template[i - 1]:
                matched, first, last = matched + 1, j - 1, j if last is None else last
            else:
                edits += 1
            i -= 1
        elif trail[i, d] == 2:
            i, d, edits = i - 1, d + 1, edits + 1
        else:
            d, edits = d - 1, edits + 1
    return (matched, edits, first, last) if matched else None


def may_be(name: str, words: list[bytes]) -> bool:
    """Whether the words have those that tell the license from its near siblings."""
    text = b" " + b" ".join(words) + b" "
    has = lambda phrase: f" {phrase} ".encode() in text
    return all(map(has, NEEDED.get(name, ()))) and not any(map(has, BARRED.get(name, ())))


def fingerprints_near(pairs: list[tuple[int, int]], band: int) -> list[tuple[int, int]]:
    """For each diagonal in order, how many fingerprints of the template are found within the band, by one window over pairs of (diagonal, fingerprint)."""
    pairs.sort()
    held, low, high, out = Counter(), 0, 0, []
    for d in dict.fromkeys(d for d, _ in pairs):
        while high < len(pairs) and pairs[high][0] <= d + band:
            held[pairs[high][1]] += 1
            high += 1
        while pairs[low][0] < d - band:
            held[pairs[low][1]] -= 1
            if not held[pairs[low][1]]:
                del held[pairs[low][1]]
            low += 1
        out.append((d, len(held)))
    return out


def scan_text(text: str | None, ready: list, index: dict, keys: np.ndarray, least: float) -> list[dict]:
    """Matches in page order; where spans overlap, the one with most words matched less edits stays."""
    words = words_of(text)
    g = grams(word_hashes(words))
    if not len(g):
        return []
    place = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    hits = np.flatnonzero(keys[place] == g)
    if not len(hits):
        return []
    starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in hits.tolist():
        for t, at in index[int(g[i])]:
            starts[t].append((i - at, at))
    found = []
    for t, pairs in starts.items():
        name, kind, template = ready[t]
        if len(words) < least * len(template):
            continue
        band, done = max(3, len(template) // 8), []
        long = len(template) > LONG
        near, diagonals = fingerprints_near(pairs, band), Counter(d for d, _ in pairs)
        enough = [d for d, n in near if n >= LEAST_HITS * len(template)]
        for at in sorted(enough, key=lambda d: (-diagonals[d], d)) if long else enough:
            k = bisect_left(done, at - band)
            if k < len(done) and done[k] <= at + band:  # within the band of one before
                continue
            insort(done, at)
            if (a := align(template, words, at, band)) and a[0] / len(template) >= least and may_be(name, words[a[2] : a[3]]):
                found.append((a[0] - a[1], a[0] / len(template), a[2], a[3], name, kind))
    taken: list[tuple] = []
    spans: list[tuple[int, int]] = []  # in order, none over another
    for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4], x[5])):
        k = bisect_left(spans, (x[2], x[3]))
        if (k == 0 or spans[k - 1][1] <= x[2]) and (k == len(spans) or x[3] <= spans[k][0]):
            spans.insert(k, (x[2], x[3]))
            taken.append(x)
    where = [m.span() for m in WORD.finditer(text)] if taken else []
    return [{"license": n, "kind": k, "coverage": c, "start": where[a][0], "end": where[b - 1][1]} for _, c, a, b, n, k in sorted(taken, key=lambda x: x[2])]


MATCH = "array<struct<license: string, kind: string, coverage: double, start: long, end: long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, least: float = 0.8) -> DataFrame:
    """(id_col, matches): one row per row of docs; each match has the share of the template's words found, and its span in characters.

    Null, empty and wordless texts have no matches; repeated rows get equal ones. Whole texts are scanned; further columns are ignored.
    """
    ready, index = inverted_index(TEMPLATES if templates is None else templates)

    def run(batches):
        keys = np.array(sorted(index) or [0], np.uint64)
        for b in batches:
            found = [scan_text(t.as_py(), ready, index, keys, least) for t in b["t"]]
            kind = pa.list_(pa.struct([("license", pa.string()), ("kind", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(found, kind)], ["id", "matches"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, matches {MATCH}").withColumnRenamed("id", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.posexplode("matches").alias("match_no", "m")).select("doc_id", F.col("match_no").cast("long").alias("match_no"), "m.license", "m.kind", "m.coverage", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"))
