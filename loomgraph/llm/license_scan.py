"""License scans by sentence rules.

A text is cut into sentences at line ends and at . ! ? ; : before white space. Sentences are normalised to lower-case
words of a-z and 0-9 and looked up among known licence sentences; a known sentence that runs over several lines is put
together again as long as what has been read is the beginning of one. A document becomes a sequence of known sentence
identifiers, and each licence rule is an ordered sequence of identifiers that must occur in that order, with at most
`gap` other sentences between two of them; cuts without a word are no sentences. A rule whose match lies inside a longer
rule's match yields to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X

#: Sentences of public licence notices, by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-comply": "you may not use this file except in compliance with the License.",
    "apache-2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-head": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-head": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl-3-work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-released": "Released under the BSD License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "lgpl-3-head": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-21-head": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3-head": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "apache-2-title": "Apache License Version 2.0, January 2004",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "boost-head": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "epl-2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc0": "Dedicated to the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
}
#: Rules, as licence and ordered sentence identifiers.
RULES = [
    ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-project"]), ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-no-liability"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-2-short"]), ("Apache-2.0", ["apache-2-head", "apache-2-comply"]), ("Apache-2.0", ["apache-2-head", "apache-2-comply", "apache-2-obtain", "apache-2-as-is", "apache-2-see"]), ("Apache-2.0", ["apache-2-obtain"]),
    ("GPL-3.0-only", ["gpl-3-work"]), ("GPL-2.0-only", ["gpl-2-work"]), ("GPL-3.0-or-later", ["gpl-3-head"]), ("GPL-3.0-or-later", ["gpl-3-head", "gpl-hope", "gpl-details"]), ("GPL-2.0-or-later", ["gpl-2-head"]), ("GPL-2.0-or-later", ["gpl-2-head", "gpl-hope", "gpl-details"]),
    ("LGPL-3.0-only", ["lgpl-3-work"]), ("AGPL-3.0-only", ["agpl-3-work"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]), ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]), ("BSD-unspecified", ["bsd-released"]),
    ("GPL-3.0-only", ["gpl-3-title"]), ("GPL-2.0-only", ["gpl-2-title"]), ("LGPL-3.0-only", ["lgpl-3-title"]), ("LGPL-2.1-only", ["lgpl-21-title"]), ("AGPL-3.0-only", ["agpl-3-title"]), ("Apache-2.0", ["apache-2-title"]),
    ("GPL-3.0-or-later", ["gpl-3-head", "gpl-hope", "gpl-details", "gpl-received"]), ("LGPL-3.0-or-later", ["lgpl-3-head"]), ("LGPL-3.0-or-later", ["lgpl-3-head", "gpl-hope", "lgpl-details"]), ("LGPL-2.1-or-later", ["lgpl-21-head"]), ("AGPL-3.0-or-later", ["agpl-3-head"]), ("AGPL-3.0-or-later", ["agpl-3-head", "gpl-hope", "agpl-details"]),
    ("ISC", ["isc-grant"]), ("ISC", ["isc-grant", "isc-as-is"]), ("Zlib", ["zlib-grant"]), ("Unlicense", ["unlicense-public"]), ("BSL-1.0", ["boost-head"]), ("BSL-1.0", ["bsl-title"]), ("EPL-2.0", ["epl-2-head"]),
    ("MPL-2.0", ["mpl-2-title"]), ("MPL-2.0", ["mpl-2-head", "mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-head"]), ("CC-BY-NC-4.0", ["cc-by-nc-4"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]), ("CC-BY-4.0", ["cc-by-4"]), ("CC0-1.0", ["cc0"]), ("proprietary", ["reserved"]),
]
#: Licences whose one-line tag in a source file is a rule of its own.
TAGGED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "Zlib", "Unlicense", "BSL-1.0", "EPL-2.0", "CC0-1.0"]
SENTENCES |= {f"tag-{x}": f"SPDX-License-Identifier: {x}" for x in TAGGED}
RULES += [(x, [f"tag-{x}"]) for x in TAGGED]
_WORD = re.compile(r"[A-Za-z0-9]+")
_BREAK = re.compile(r"[.!?;:]+(?=\s|$)|[\r\n]+")


def normalise(sentence: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORD.findall(sentence))


class Rules:
    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
        self.known = {normalise(s): k for k, s in sentences.items()}
        self.beginnings = {w[:i] for w in self.known for i in range(1, len(w))}
        self.first = {w[0] for w in self.known if w}
        self.longest = max(map(len, self.known), default=0)
        self.rules = [(name, tuple(ids)) for name, ids in rules if ids]

    def sentences(self, text: str) -> list[tuple[int, int, int, str]]:
        """(number, begin, end, identifier) of known sentences, in order; numbers count the text's sentences."""
        cuts, last = [], 0
        for m in _BREAK.finditer(text):
            cuts.append((last, m.end()))
            last = m.end()
        if last < len(text):
            cuts.append((last, len(text)))
        out, i, number = [], 0, 0
        while i < len(cuts):
            word = _WORD.search(text, *cuts[i])
            if word is None:
                i += 1
                continue
            best = None
            if word[0].lower() in self.first:
                read: tuple[str, ...] = ()
                for j in range(i, len(cuts)):  # ends soon: what has been read is no longer than the longest sentence
                    read += tuple(m[0].lower() for m in islice(_WORD.finditer(text, *cuts[j]), self.longest + 1))
                    if read in self.known:
                        best = (j, self.known[read])
                    if read not in self.beginnings:
                        break
            if best:
                out.append((number, word.start(), cuts[best[0]][1], best[1]))
                i = best[0]
            number += 1
            i += 1
        return out

    def licences(self, found: list[tuple[int, int, int, str]], gap: int) -> list[tuple[str, int, int]]:
        """(licence, first, last) over places in `found`, longest matches first, none inside another."""
        places: dict[str, list[int]] = {}
        for i, x in enumerate(found):
            places.setdefault(x[3], []).append(i)
        matches = []
        for name, ids in self.rules:
            for start in places.get(ids[0], ()):
                at = start
                for want in ids[1:]:
                    there = places.get(want, ())
                    nxt = bisect_right(there, at)
                    if nxt == len(there) or found[there[nxt]][0] - found[at][0] - 1 > gap:
                        break
                    at = there[nxt]
                else:
                    matches.append((start, at, len(ids), name))
        matches.sort(key=lambda m: (-m[2], m[0], m[3]))
        kept: dict[tuple[int, str], tuple[list[int], list[int]]] = {}  # of one licence and length: starts, and the furthest end so far
        out = []
        for start, at, length, name in matches:
            inside = False
            for (n, other), (starts, ends) in kept.items():
                if n > length or other == name:
                    k = bisect_right(starts, start) - 1
                    inside = inside or (k >= 0 and ends[k] >= at)
            if not inside:
                starts, ends = kept.setdefault((length, name), ([], []))
                starts.append(start)
                ends.append(max(at, ends[-1]) if ends else at)
                out.append((name, start, at))
        return sorted(out)


def _scan(rules: Rules, gap: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text in part.column("text").to_pylist():
                found = rules.sentences(text or "")
                named = rules.licences(found, gap) if found else []
                out[0].append(len(found))
                out[1].append(len({n for n, _, _ in named}))
                out[2].append(",".join(sorted({n for n, _, _ in named})))
                out[3].append([{"licence": n, "begin": found[a][1], "end": found[b][2], "sentences": [x[3] for x in found[a : b + 1]]} for n, a, b in named])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("licence", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 3 + keep]], names=["doc_id", "n_sentences", "n_licences", "licences", "matches"][: 4 + keep])

    return run


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = 3, matches: bool = True) -> DataFrame:
    """(doc_id, n_sentences, n_licences, licences[, matches]) for every row of docs (doc_id, text; more are ignored).

    n_sentences counts known licence sentences, licences lists the distinct licences found, sorted and joined by commas;
    matches has each one's character range and sentences. Null and empty texts have none. Repeated rows give repeated
    results; a null doc_id stays null.
    """
    table = Rules(SENTENCES if sentences is None else sentences, RULES if rules is None else rules)
    schema = "doc_id long, n_sentences long, n_licences long, licences string" + ", matches array<struct<licence: string, begin: long, end: long, sentences: array<string>>>" * matches
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(table, gap, matches), schema)
