"""Operator 10 - licence scans by sentence rules.

Sentences of a text are normalised and mapped to identifiers of known licence sentences; the
sequence of identifiers, with what stands between left out, is matched against licence rules, each
an ordered sequence of identifiers. Where rules share sentences, the longest match from the left
wins; sentences that no rule completes are reported as fragments.

Defined cases: null and empty texts have no sentences; rows map one for one (ties, repeats, null
ids stay); an empty table gives an empty one; extra columns pass through, those named as an added
column are replaced; whole texts are read, in time linear in their length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from bispace.llm.bpe import slices
from bispace.llm.common import ddl, worker_state

# Sentences of well-known licences and notices.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-short": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}
# Licences that are named by tag or by a short sentence.
TAGGED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {f"tag-{x}": f"SPDX-License-Identifier: {x}" for x in TAGGED}
# Ordered rules, licence and the sentences that state it.
RULES = [
    *((x, (f"tag-{x}",)) for x in TAGGED),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("EPL-2.0", ("epl2",)),
    ("MPL-2.0", ("mpl-short", "mpl-copy")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-short",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-short",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("all-rights",)),
]

_BREAK = re.compile(r"(?<=[.!?:])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    """Lower-cased words and numbers with one space between."""
    return " ".join(_WORD.findall(sentence.lower()))


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list = RULES):
        self.known: dict[str, str] = {}
        for name, sentence in sentences.items():
            self.known[normalise(sentence)] = name
        self.rules = sorted(((tuple(r[1]), r[0]) for r in rules), key=lambda r: -len(r[0]))
        # a known sentence holds one of these words, so a text without them needs no splitting;
        # a sentence may also be folded over lines, which is tried where a line starts one
        words = [set(s.split()) for s in self.known]
        anchors: list[str] = []
        while any(words):
            best = max(sorted(set().union(*words)), key=lambda w: (sum(w in s for s in words) * len(w), len(w)))
            anchors.append(best)
            words = [s for s in words if best not in s]
        self.anchor = re.compile("|".join(map(re.escape, sorted(anchors))))
        self.starts: dict[str, int] = {}
        for s in self.known:
            head = s.split(" ", 1)[0]
            self.starts[head] = max(self.starts.get(head, 0), len(s))

    def sentences(self, text: str) -> list[str]:
        """Identifiers of the known sentences, in order; lines that fold a sentence are joined."""
        if not self.anchor.search(text.lower()):
            return []
        parts = [p for p in (normalise(x) for x in _BREAK.split(text)) if p]
        out, at = [], 0
        while at < len(parts):
            joined, used, most = parts[at], 1, self.starts.get(parts[at].split(" ", 1)[0], 0)
            name, width = self.known.get(joined), 1
            while at + used < len(parts) and len(joined) < most:
                joined = f"{joined} {parts[at + used]}"
                used += 1
                if joined in self.known:
                    name, width = self.known[joined], used
            if name:
                out.append(name)
            at += width
        return out

    def licences(self, ids: list[str]) -> tuple[list[str], list[str]]:
        """Licences of the rules that match, in order of text, and sentences left over."""
        found, rest, at = [], [], 0
        while at < len(ids):
            for sequence, licence in self.rules:
                if tuple(ids[at : at + len(sequence)]) == sequence:
                    found.append(licence)
                    at += len(sequence)
                    break
            else:
                rest.append(ids[at])
                at += 1
        return found, rest


def scan_licenses(documents: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """``documents`` with ``sentence_ids``, ``licenses`` (in order of text) and ``fragments``."""
    added = ["sentence_ids", "licenses", "fragments"]
    keep = [c for c in documents.columns if c not in added]

    key = repr((sorted(sentences.items()), rules))

    def run(batches):
        own = worker_state(("licences", key), lambda: Scanner(sentences, rules))
        for whole in batches:
            for batch in slices(whole, text):
                ids = [own.sentences(t or "") for t in batch.column(text).to_pylist()]
                found = [own.licences(i) for i in ids]
                made = [pa.array(x, pa.list_(pa.string())) for x in (ids, [f for f, _ in found], [r for _, r in found])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *added])

    source = documents.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join(x for x in (ddl(documents, keep), *(f"{a} array<string>" for a in added)) if x)
    return source.mapInArrow(run, fields)
