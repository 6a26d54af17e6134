"""License scan by patience alignment.

Words that stand once in the text and once in the template anchor the two; the longest increasing run of anchors is kept,
and the gaps between anchors are aligned in the same way (a gap without anchors keeps its common head and tail). Coverage
is the aligned share of the template's words.

A template that stands several times in a window has few anchors or none there, as all its words are repeated. So stretches
of twice a template's length are also aligned by themselves, by their longest common subsequence, half a length apart:
each notice with up to half as many strange words lies whole in one of them.

A template is aligned with a text only if the text holds enough of the template's words to reach `least` at all; that
test never drops a match. Licences that share most of their words are told apart by place: each place is named by the template
that covers it best, so a header of one GNU licence does not name the others. Templates are read whole and their size is bounded by `template_words`.

Defined cases: null and empty texts and empty templates match nothing; ties go to the longer template, then to the one whose
name comes first; repeated rows are each scanned; very long texts are scanned whole; extra columns, those with clashing names
too, are left aside; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table

_AS_IS = "THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with {0}. If not, see https://www.gnu.org/licenses/."

#: Public notices that are put into texts, and licences and their headers as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the “License”); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an “AS IS” BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-full": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause-full": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-full": "This software is provided ‘as-is’, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-full": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the “Software”) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-header": _GNU.format("This program", "", "2"),
    "GPL-3.0-header": _GNU.format("This program", "", "3"),
    "LGPL-3.0-header": _GNU.format("This library", "Lesser ", "3"),
    "AGPL-3.0-header": _GNU.format("This program", "Affero ", "3"),
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of aligned words, in order."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        wanted = Counter(template[b0:b1])
        here = Counter(w for w in text[a0:a1] if w in wanted)
        place = {template[b]: b for b in range(b0, b1)}
        both = [(a, place[text[a]]) for a in range(a0, a1) if here.get(text[a]) == 1 and wanted[text[a]] == 1]
        chain = [both[i] for i in longest_increasing([b for _, b in both])]
        out += chain
        if chain:
            ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(out)


def common_words(text: list[str], places: dict[str, int]) -> int:
    """Length of the longest common subsequence of a text and a template, whose places of each word are the bits of a number."""
    every = 0
    for bits in places.values():
        every |= bits
    open_ = every
    for w in text:
        met = open_ & places.get(w, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return (every ^ open_).bit_count()


def coverage(text: list[str], template: list[str]) -> float:
    """The best share over the places where the template may stand: in windows around its words, and in stretches of twice its length."""
    if not template:
        return 0.0
    size = len(template)
    places: dict[str, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    spots = [i for i, w in enumerate(text) if w in places]
    best, k = 0, 0
    # Windows of the text around runs of template words; a run ends where a template's length of other words follows.
    while k < len(spots):
        end = k
        while end + 1 < len(spots) and spots[end + 1] - spots[end] <= size:
            end += 1
        best = max(best, len(align(text[spots[k] : spots[end] + 1], template)))
        k = end + 1
    # Stretches that hold more template words than are aligned so far.
    step = max(1, size // 2)
    for bucket in sorted({i // step for i in spots}) if best < size else ():
        low, high = bisect_left(spots, bucket * step), bisect_left(spots, bucket * step + 2 * size)
        if high - low > best:
            best = max(best, common_words([text[i] for i in spots[low:high]], places))
    return best / size


def occurrences(text: list[str], template: list[str], least: float) -> list[tuple[float, list[int]]]:
    """(coverage, places in the text) wherever the template reaches `least`: the narrowest part of each stretch that holds as many
    of its words; if no stretch has one, the windows around its words."""
    size = len(template)
    places: dict[str, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    spots, step, out = [i for i, w in enumerate(text) if w in places], max(1, size // 2), {}
    for bucket in sorted({i // step for i in spots}):
        inside = spots[bisect_left(spots, bucket * step) : bisect_left(spots, bucket * step + 2 * size)]
        held = common_words([text[i] for i in inside], places) if len(inside) >= least * size else 0
        if held < least * size:
            continue
        # More words never hold less, so both ends are found by halving.
        end = bisect_left(range(len(inside)), held, key=lambda k: common_words([text[i] for i in inside[: k + 1]], places)) + 1
        start = bisect_left(range(end), True, key=lambda k: common_words([text[i] for i in inside[k:end]], places) < held) - 1
        out[inside[start], inside[end - 1]] = held
    if out:
        return [(held / size, list(range(a, b + 1))) for (a, b), held in out.items()]
    found, k = [], 0
    while k < len(spots):
        end = k
        while end + 1 < len(spots) and spots[end + 1] - spots[end] <= size:
            end += 1
        pairs = align(text[spots[k] : spots[end] + 1], template)
        if len(pairs) >= least * size:
            found.append((len(pairs) / size, [spots[k] + a for a, _ in pairs]))
        k = end + 1
    return found


def told_apart(text: list[str], sets: dict[str, list[str]], names: list[str], least: float) -> list[str]:
    """Of `names`, those that are the best somewhere: a place belongs to the template of highest coverage there, the longer of
    several, and what has over half of its words in places of others is not named for it."""
    if len(names) < 2:
        return names
    found = sorted(((c, len(sets[n]), n, at) for n in names for c, at in occurrences(text, sets[n], least)), key=lambda f: (-f[0], -f[1], f[2]))
    taken, kept = set(), set()
    for _, _, name, at in found:
        if 2 * sum(i in taken for i in at) <= len(at):
            kept.add(name)
            taken.update(at)
    return [n for n in names if n in kept]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, template_words: int = 100_000) -> DataFrame:
    """doc_id, license (the template with the highest coverage, the longest of several; null below `least`), coverage, licenses (all that reach `least`
    and are the best where they stand)."""
    sets = {name: words(t) for name, t in sorted((templates or TEMPLATES).items())}
    if sum(map(len, sets.values())) > template_words:
        raise ValueError(f"templates of more than {template_words} words; scan them in several calls")
    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = set().union(*sets.values())

    def run(batches):
        for batch in batches:
            best, share, found = [], [], []
            for text in batch.column("text"):
                text = words(text.as_py() or "")
                held = vocabulary.intersection(text)
                got = {n: coverage(text, t) if t and sum(w in held for w in t) >= least * len(t) else 0.0 for n, t in sets.items()}
                top = max(got, key=lambda n: (got[n], len(sets[n])), default=None)
                ok = top is not None and got[top] >= least
                best.append(top if ok else None)
                share.append(got[top] if ok else 0.0)
                apart = told_apart(text, sets, [n for n, c in got.items() if c >= least], least)
                found.append(sorted({*apart, top}) if ok else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "license", "coverage", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, licenses array<string>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "coverage", F.array_join("licenses", ",").alias("licenses"))
