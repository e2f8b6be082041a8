"""License scan: normalised text against license templates by the Dice coefficient over word bigrams.

A text's words are lower-cased and stripped of punctuation. For each template, all windows that begin and end with one
of its bigrams are compared whose number of bigrams is in the bounds that a Dice coefficient of ``LEAST`` allows
(between b * d / (2 - d) and b * (2 - d) / d for a template of b); other windows can't be the best.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

LEAST = 0.8
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_REDISTRIBUTE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_HOLDERS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# License texts and usual notices, normalised.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_GRANT} the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "this project is licensed under the mit license see the license file for details"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", f"{_REDISTRIBUTE} {_HOLDERS}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTE} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_HOLDERS}"),
    ("BSD", "licensed under the bsd license"),
    ("BSD", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "licensed under the gnu general public license v3.0"),
    ("GPL-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("GPL-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http://mozilla.org/mpl/2.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "licensed under cc by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BSL-1.0", "distributed under the boost software license version 1.0"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
)


def normalised(text: str | None) -> list[str]:
    return [w for w in (_EDGE.sub("", w) for w in (text or "").lower().split()) if w]


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def bounds(bigrams: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams a text may have for a Dice coefficient of ``least`` with a template of ``bigrams``."""
    return int(np.ceil(bigrams * least / (2 - least) - 1e-9)), int(np.floor(bigrams * (2 - least) / least + 1e-9))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        bare = _EDGE.sub("", word)
        self[word] = value = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) if bare else 0
        return value


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        self.names = [name for name, _ in templates]
        words = [normalised(text) for _, text in templates]
        self.bags = [Counter(zip(w, w[1:])) for w in words]
        self.sizes = [sum(b.values()) for b in self.bags]
        self.known = _Words()
        owners = defaultdict(set)
        for k, w in enumerate(words):
            ids = np.array([self.known[x] for x in w], dtype=np.uint64)
            for key in self._pairs(ids).tolist():
                owners[key].add(k)
        self.owners = dict(owners)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(np.array(list(owners), dtype=np.uint64) & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _pairs(ids: np.ndarray) -> np.ndarray:
        out = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ids[1:]
        return out ^ out >> np.uint64(31)

    def best_window(self, k: int, words: list[str], places: list[int]) -> tuple[float, int, int]:
        """Dice coefficient with template ``k``, number of words and negated first word of the best window over ``places``."""
        low, high = bounds(self.sizes[k], self.least)
        bag, size, stop = self.bags[k], self.sizes[k], 0
        pairs = [(words[p], words[p + 1]) for p in places]
        best = (0.0, 0, 0)
        for i, a in enumerate(places):
            while stop < len(places) and places[stop] - a < high:
                stop += 1
            # At least ``low`` bigrams must be shared, whatever the window's size.
            if stop - i < low:
                continue
            seen: dict[tuple[str, str], int] = {}
            both = 0
            for pair, p in zip(pairs[i:stop], places[i:stop], strict=True):
                n = seen[pair] = seen.get(pair, 0) + 1
                if n <= bag.get(pair, 0):
                    both += 1
                    if both >= low:
                        best = max(best, (2 * both / (size + p - a + 1), p - a + 2, -a))
        return best

    def scan(self, text: str | None) -> tuple[str | None, float, int, int]:
        """License, Dice coefficient, first word and number of words of the best span; the earliest and largest wins ties."""
        raw = (text or "").lower().split()
        if len(self.known) > 400_000:
            self.known.clear()
        ids = np.fromiter(map(self.known.__getitem__, raw), dtype=np.uint64, count=len(raw))
        if len(ids) and not ids.all():
            ids = ids[ids > 0]
        best: tuple[str | None, float, int, int] = (None, 0.0, 0, 0)
        if len(ids) < 2:
            return best
        keys = self._pairs(ids)
        places = np.flatnonzero(self.filter[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)]).tolist()
        by_template = defaultdict(list)
        for p in places:
            for k in self.owners.get(int(keys[p]), ()):
                by_template[k].append(p)
        words = None
        for k in sorted(by_template):
            low, _ = bounds(self.sizes[k], self.least)
            if len(by_template[k]) < low:
                continue
            words = words or normalised(text)
            value, size, first = self.best_window(k, words, by_template[k])
            if value >= self.least and (value, size, first) > (best[1], best[3], -best[2]):
                best = (self.names[k], value, -first, size)
        return best


def scan(docs: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, license (null: none found), dice, first_word, n_words of the span.

    Null and empty texts have none; repeated rows are scanned each; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for part in parts:
            found = [scanner.scan(t.as_py()) for t in part.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "license", "dice", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, license string, dice double, first_word long, n_words long")
