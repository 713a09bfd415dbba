"""Licenses told by their words: headers and texts, by multinomial logistic regression on word n-grams.

The training rows are written from templates: sentences of the public license texts and headers, alone
and in runs, with the names and versions of the GNU family filled in. A background class holds texts
of other licenses. A block of text is rejected (open set) when too few of its word triples were seen in
training, or when its best probability is low.
"""

from __future__ import annotations

import re

import numpy as np

OTHER = "~other"
LEAST_WORDS, LEAST_SEEN, LEAST_PROBABILITY = 12, 0.5, 0.5

_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."

#: Sentences of public license texts and headers. Each tuple is one text in order.
TEXTS: list[tuple[str, list[str]]] = [
    ("MIT", _MIT),
    ("ISC", [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC_WARRANTY]),
    (OTHER, [_ISC_GRANT + ".", _ISC_WARRANTY]),
    ("BSD-2-Clause", [_BSD_HEAD, _BSD_TWO, _BSD_END]),
    ("BSD-3-Clause", [_BSD_HEAD, _BSD_TWO, _BSD_NAME, _BSD_END]),
    (OTHER, [_BSD_HEAD, _BSD_TWO, _BSD_ADVERT, _BSD_NAME, _BSD_END]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."]),
    ("Apache-2.0", ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", "Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."]),
    (OTHER, ["The Apache Software License, Version 1.1", _BSD_HEAD, _BSD_TWO, "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation."]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]),
    ("MPL-2.0", ["Mozilla Public License Version 2.0 Definitions Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", "Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form."]),
    (OTHER, ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", "Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied."]),
    ("Zlib", ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."]),
    (OTHER, ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."]),
    (OTHER, ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/."]),
    (OTHER, ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."]),
    (OTHER, ["Boost Software License Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software."]),
    (OTHER, ["This file is proprietary and confidential. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited without the express written permission of the owner."]),
]
#: Names in the headers of the GNU family.
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = ("1", "2", "2.1", "3")
_GNU_START = ["This program is free software: you can redistribute it and/or modify it under the terms of", "This library is free software; you can redistribute it and/or modify it under the terms of", "is free software; you can redistribute it and/or modify it under the terms of"]
_GNU_END = ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.", "You should have received a copy of the {name} along with this program. If not, see http://www.gnu.org/licenses/."]
_GNU_TERMS = [
    ("or-later", "the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."),
    ("or-later", "the {name} as published by the Free Software Foundation; either version {v} of the License, or any later version."),
    ("only", "the {name} as published by the Free Software Foundation, version {v}."),
    ("only", "the {name} version {v} as published by the Free Software Foundation."),
    ("only", "version {v} of the {name} as published by the Free Software Foundation."),
    ("only", "the {name} as published by the Free Software Foundation, version {v} of the License only."),
]
#: Every training row holds one of these, so a text without them can't be accepted.
HINT = r"licen[sc]e|permi(?:t|ssion)|redistribut|warrant|unencumbered|misrepresent"

_HINT = re.compile(HINT, re.I)
_WORDS = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def words(text: str) -> list[str]:
    """Lower-case words and version numbers, without '.0'."""
    out = []
    for w in _WORDS.findall(text.lower()):
        while w[0].isdigit() and w.endswith(".0"):
            w = w[:-2]
        out.append(w)
    return out


def features(ws: list[str]) -> list[str]:
    """Word n-grams, n = 1 to 3."""
    return ws + [" ".join(ws[i : i + n]) for n in (2, 3) for i in range(len(ws) - n + 1)]


def training_rows(known: set[str]) -> list[tuple[str, str]]:
    """(text, label) of all variants; labels are the known ids and the background class."""
    out: set[tuple[str, str]] = set()
    opened: dict[str, set[str]] = {}  # first sentences that several texts share tell nothing
    for label, sentences in TEXTS:
        for k in range(len(sentences)):
            opened.setdefault(" ".join(sentences[: k + 1]), set()).add(label)
    for label, sentences in TEXTS:
        runs = {" ".join(sentences[: k + 1]) for k in range(len(sentences))}
        runs = {r for r in runs if len(opened[r]) == 1 and len(words(r)) >= LEAST_WORDS}
        out |= {(r, label if label in known else OTHER) for r in runs}
    for short, name in GNU.items():
        for v in GNU_VERSIONS:
            for kind, terms in _GNU_TERMS:
                label = f"{short}-{v if '.' in v else v + '.0'}-{kind}"
                label = label if label in known else OTHER
                for start in _GNU_START:
                    head = f"{start} {terms.format(name=name, v=v)}"
                    ends = [e.format(name=name) for e in _GNU_END]
                    out |= {(head, label), (f"{head} {ends[0]}", label), (f"{head} {ends[0]} {ends[1]}", label)}
    return sorted(out)


class TextModel:
    """Multinomial logistic regression over blocks of text, with open-set rejection."""

    def __init__(self, known: list[str], rounds: int = 400, rate: float = 2.0, decay: float = 1e-5):
        rows = training_rows(set(known))
        self.labels = sorted({label for _, label in rows} | {OTHER})
        bags = [sorted(set(features(words(t)))) for t, _ in rows]
        self.at = {f: i for i, f in enumerate(sorted({f for b in bags for f in b}))}
        self.triples = {f for b in bags for f in b if f.count(" ") == 2}
        x = np.zeros((len(rows), len(self.at)), np.float32)
        for i, b in enumerate(bags):
            x[i, [self.at[f] for f in b]] = 1 / np.sqrt(len(b))
        y = np.zeros((len(rows), len(self.labels)), np.float32)
        y[np.arange(len(rows)), [self.labels.index(label) for _, label in rows]] = 1
        # regression on the inner products of the rows: far fewer rows than n-grams, the same weights
        gram = x @ x.T
        a, step = np.zeros_like(y), np.zeros_like(y)
        for _ in range(rounds):
            z = gram @ a
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = 0.9 * step - rate * (p - y + decay * a)
            a = a + step
        self.weights = x.T @ a

    def _seen(self, ws: list[str]) -> bool:
        triples = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)]
        return sum(t in self.triples for t in triples) >= LEAST_SEEN * len(triples)

    def familiar(self, paragraph: str) -> bool:
        """Whether a paragraph reads like one of a license."""
        ws = words(paragraph) if _HINT.search(paragraph) else []
        return len(ws) >= LEAST_WORDS // 2 and self._seen(ws)

    def predict(self, text: str) -> str | None:
        """A known id, OTHER for another license or an unsure one, None for a text that is no license."""
        ws = words(text)
        if len(ws) < LEAST_WORDS or not self._seen(ws):
            return None
        hit = [self.at[f] for f in set(features(ws)) if f in self.at]
        z = self.weights[hit].sum(0) / np.sqrt(len(hit))
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return OTHER if p[k] < LEAST_PROBABILITY else self.labels[k]

    def licenses(self, lines: list[str | None]) -> list[tuple[str, range]]:
        """(id or OTHER, lines) of the runs of license paragraphs; None breaks a run, as other text does."""
        out, run, para = [], [], []

        def end_run() -> None:
            if run:
                got = self.predict(" ".join(lines[i] for i in run))
                if got:
                    out.append((got, range(run[0], run[-1] + 1)))
                run.clear()

        def end_paragraph() -> None:
            if para:
                if self.familiar(" ".join(lines[i] for i in para)):
                    run.extend(para)
                else:
                    end_run()
                para.clear()

        for i, line in enumerate([*lines, None]):
            if line:
                para.append(i)
                continue
            end_paragraph()
            if line is None:
                end_run()
        return out
