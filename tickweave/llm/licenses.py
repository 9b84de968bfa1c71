"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are put into classes by their number of shingles, from a power of two up to the next. A class has windows of
four times its least size, which overlap by half, so that a notice lies whole in one of them and its Jaccard index with
that window is at least a quarter. The least values of a window under HASHES functions are compared with those of the
class's templates, a band for each function: a notice is met with a chance of 1 - (3/4) ** HASHES, which is above
1 - 1e-5 if it is unaltered. A window that meets a template in any band is verified: the exact share of the template's
shingles that it holds. Windows that hold too few shingles of any template to pass are not hashed, which loses nothing.

Templates are notices, file headers and whole licenses, 200 kilobytes that travel with the task. A license may have several.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE_WEIGHTS, hasher, mix64, stream64

#: Short notices by the license that they name, as projects write them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights-reserved": "All rights reserved",
}
_AS_IS = """ IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. """
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """


def _gnu(what: str, name: str, version: str) -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,
    either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received
    a copy of the GNU {name} along with this {what}"""


#: Whole short licenses, file headers and more short forms.
TEXTS = {
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "The MIT License (MIT)",
        "Licensed under the MIT License",
    ),
    "BSD-2-Clause": (_BSD + "THIS SOFTWARE" + _AS_IS,),
    "BSD-3-Clause": (_BSD + _THIRD + "THIS SOFTWARE" + _AS_IS, "Licensed under the BSD 3-Clause License"),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    "GPL-2.0-or-later": (_gnu("program", "General Public License", "2"),),
    "GPL-3.0": (_gnu("program", "General Public License", "3"),),
    "LGPL-2.1": (_gnu("library", "Lesser General Public License", "2.1"),),
    "LGPL-3.0": (_gnu("library", "Lesser General Public License", "3"),),
    "AGPL-3.0": (_gnu("program", "Affero General Public License", "3"),),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0",),
}
#: Whole long licenses, as files beside this one.
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic-1.0": "Artistic"}


def templates() -> dict[str, tuple[str, ...]]:
    """All texts by license: notices, headers, whole licenses and SPDX lines."""
    out = {name: (text,) for name, text in NOTICES.items()}
    for name, texts in TEXTS.items():
        out[name] = out.get(name, ()) + texts
    for name, file in FILES.items():
        out[name] = out.get(name, ()) + ((Path(__file__).parent / "license_texts" / f"{file}.txt").read_text("utf-8"),)
    for name in out:
        if name != "all-rights-reserved":
            out[name] += tuple(f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if "GPL-" in name and not name.endswith("-or-later") else ("",)))
    return out


#: Words of a shingle at most; shorter templates take as many words as they have.
SHINGLE = 5
HASHES = 48
#: Share of a template's shingles that a place must hold.
CONTAINMENT = 0.75
#: The hash functions: odd factors and summands over hashes that are well spread already.
_FACTORS, _SUMMANDS = (stream64(HASHES, 1234) | np.uint64(1))[:, None], stream64(HASHES, 77)[:, None]
#: Shingles that are hashed at a time.
PIECE = 1 << 14
#: Leading bits of a shingle by which most are told from all templates'.
LEADING = 22


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = words[:n] * SHINGLE_WEIGHTS[0]
    for i in range(1, k):
        total = total + words[i : n + i] * SHINGLE_WEIGHTS[i]
    return mix64(total + np.uint64(k))


def _bare(raw: bytes) -> bytes:
    """Punctuation at the ends of words is left out, so that a full stop does not hide a notice."""
    return raw.translate(_PUNCTUATION)


_PUNCTUATION = bytes(32 if chr(i) in ".,;:!?\"'()[]{}<>*#&%$|/\\" else i for i in range(256))


class Scanner:
    """Finds templates in texts."""

    def __init__(self, notices: dict[str, str | tuple[str, ...]], containment: float = CONTAINMENT) -> None:
        self.names = sorted(notices)
        self.containment = containment
        self.classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for i, name in enumerate(self.names):
            for text in [notices[name]] if isinstance(notices[name], str) else notices[name]:
                words = hasher().words(_bare(text.encode()))
                if len(words):
                    k = min(SHINGLE, len(words))
                    runs = _runs(words, k)
                    self.classes.setdefault((k, 1 << (len(runs).bit_length() - 1)), []).append((i, np.unique(runs)))
        self.bands = {c: np.stack([_least(m) for _, m in found], axis=1) for c, found in self.classes.items()}
        #: Per class all its shingles, and the fewest that a window must hold; per k a table of the shingles' leading bits.
        self.known = {c: (np.unique(np.concatenate([m for _, m in found])), containment * min(len(m) for _, m in found)) for c, found in self.classes.items()}
        self.all = {k: np.unique(np.concatenate([m for (j, _), (m, _) in self.known.items() if j == k])) for k, _ in self.known}
        self.leading: dict[int, np.ndarray] = {}
        for (k, _), (members, _) in self.known.items():
            self.leading.setdefault(k, np.zeros(1 << LEADING, bool))[members >> np.uint64(64 - LEADING)] = True

    def __call__(self, text: str | None) -> list[tuple[str, float, int]]:
        """(license, containment, first word) of each license's best place in the text; the first of equals."""
        raw = (text or "").encode("utf-8", "replace")
        words = hasher().words(_bare(raw))
        out: dict[int, tuple[float, int]] = {}
        runs_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (k, size), found in self.classes.items():
            if k not in runs_of:
                runs = _runs(words, k)
                likely = np.flatnonzero(self.leading[k][runs >> np.uint64(64 - LEADING)])
                runs_of[k] = runs, likely[_within(runs[likely], self.all[k])]
            runs, likely = runs_of[k]
            if not len(likely):
                continue
            members, fewest = self.known[k, size]
            hits = likely[_within(runs[likely], members)]
            for a in self._candidates(runs, hits, fewest, size, self.bands[k, size]):
                place = runs[a : a + 4 * size]
                for i, members in found:
                    share = float(np.isin(members, place).sum()) / len(members)
                    if share >= self.containment:
                        at = a + int(np.flatnonzero(np.isin(place, members))[0])
                        if i not in out or (-share, at) < (-out[i][0], out[i][1]):
                            out[i] = (share, at)
        if not out:
            return []
        own, bare = _word_starts(raw), _word_starts(_bare(raw))
        return [(self.names[i], share, int(np.searchsorted(own, bare[at], "right")) - 1) for i, (share, at) in sorted(out.items())]

    @staticmethod
    def _candidates(runs: np.ndarray, hits: np.ndarray, fewest: float, size: int, bands: np.ndarray) -> list[int]:
        """Starts of windows whose least value equals a template's, in any band. A window is two halves of 2 * size.

        ``hits`` are the places of shingles that any template of the class has; a window with fewer than ``fewest`` fails.
        """
        if len(hits) < fewest:
            return []
        half, found = 2 * size, []
        at, counts = np.unique(hits // half, return_counts=True)
        held = dict(zip(at.tolist(), counts.tolist(), strict=True))
        for w in sorted({h for x in held for h in (x - 1, x) if h >= 0}):
            if held.get(w, 0) + held.get(w + 1, 0) >= fewest:
                least = _least(runs[w * half : (w + 2) * half])
                if (least[:, None] == bands).any():
                    found.append(w * half)
        return found


def _word_starts(raw: bytes) -> np.ndarray:
    """Places of the first bytes of words."""
    a = np.frombuffer(raw, np.uint8)
    solid = (a != 32) & ((a < 9) | (a > 13))
    return np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)) == 1)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array that is not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _least(members: np.ndarray) -> np.ndarray:
    parts = [(members[None, at : at + PIECE] * _FACTORS + _SUMMANDS).min(axis=1) for at in range(0, len(members), PIECE)]
    return np.min(parts, axis=0)


def scan(spark, notices: dict[str, str | tuple[str, ...]] | None = None, containment: float = CONTAINMENT):
    """A column function text -> array of (license, containment, first_word)."""
    shared = spark.sparkContext.broadcast(notices or templates())
    made: list[Scanner] = []
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())]))

    @F.pandas_udf(kind)
    def find(text: pd.Series) -> pd.Series:
        if not made:
            made.append(Scanner(shared.value, containment))
        return pd.Series([[{"license": a, "containment": b, "first_word": c} for a, b, c in made[0](t)] for t in text])

    return find


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str | tuple[str, ...]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Licenses that texts hold as notice, header or whole: rows (id, license, containment, first_word), the best place of each.

    Licenses that share their words (GNU headers, BSD) are all returned; the highest containment names the closest.

    ``first_word`` counts the text's words (runs without ASCII white space) from 0. Null and wordless texts hold none. Repeated rows give repeated results, rows
    with a null id are scanned too; ties between places go to the first. An empty table gives no rows. Other columns
    are not read.
    """
    find = scan(docs.sparkSession, notices, containment)
    found = docs.select(F.col(id_col), find(F.col(text_col)).alias("found")).filter(F.size("found") > 0)
    return found.select(id_col, F.explode("found").alias("m")).select(id_col, F.col("m.license").alias("license"), F.col("m.containment").alias("containment"), F.col("m.first_word").alias("first_word"))
