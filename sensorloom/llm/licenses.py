"""Licence scans: phrases, and an exact set-similarity join of text blocks with licence templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A template is a
licence text taken as the set of its tokens: its words, or its pairs of adjacent words if it has
fewer than ``SHORT`` words, as a few words alone may stand anywhere. A block is a stretch of a
document's words, twice as long as the templates of its length class and
half overlapping, so that each stretch as long as the template lies whole in a block. A
block matches where it holds at least ``threshold`` of the template's tokens.

1. One pass counts in how many documents each template token occurs; the counts,
   as many as the templates have tokens, order all tokens from rare to frequent.
2. By the prefix principle a match must hold one of the template's ``|t| - need + 1``
   rarest tokens. A second pass emits, beside the phrase counts, only blocks with such
   a token, as sorted token ranks.
3. Blocks join an inverted index of the template prefixes; length and positional
   filters drop pairs that can't reach ``need`` tokens, and the rest are
   verified on the whole sets. The index has a row for each prefix token of the
   given templates, which bounds what is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHasher, bound_batches, byte_classes, cut, list_array, mix, pieces, utf8, word_spans

#: Phrases that count as places, by label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence texts and the notices with which they are applied.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_KEEP_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_USEFUL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."

#: Licence texts, and notices as they are written into files and pages, by label.
TEMPLATES = {
    "mit-notice": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "mit-text": [f"{_GRANT} {_KEEP_NOTICE} {_AS_IS}", _GRANT, _KEEP_NOTICE],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", _FREE.format("General Public License"), _USEFUL.format("General Public License")],
    "lgpl-3.0": [_FREE.format("Lesser General Public License"), _USEFUL.format("Lesser General Public License")],
    "agpl-3.0": [_FREE.format("Affero General Public License"), _USEFUL.format("Affero General Public License")],
    "bsd": [f"{_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}", f"{_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_AS_IS}", _BSD_HEAD, _BSD_SOURCE],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "rights-reserved": ["All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher"],
}

#: Templates of fewer words are taken as pairs of adjacent words.
SHORT = 16
WORD_BYTES = byte_classes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Block lengths in words, from which each template takes the first that is at least twice its own.
BLOCK_WORDS = (24, 96, 384, 1536, 6144)


def words_of(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def _hash_words(words: Sequence[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return WordHasher()(data, end - [len(w) for w in words], end)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word and the next."""
    return mix(h[:-1] * np.uint64(3) + h[1:])


def tokens_of(text: str) -> list[tuple[bytes, ...]]:
    """The distinct tokens of a template: words, or pairs of adjacent words if it is short."""
    words = words_of(text)
    return sorted({(w,) for w in words} if len(words) >= SHORT else set(zip(words, words[1:], strict=False)) or {(w,) for w in words})


def _hash_tokens(tokens: Sequence[tuple[bytes, ...]]) -> np.ndarray:
    hashes = [_hash_words(t) for t in tokens]
    return np.array([h[0] if len(h) == 1 else _pairs(h)[0] for h in hashes], np.uint64)


class _Lookup:
    """Token hash to a small id, or -1."""

    def __init__(self, tokens: Sequence[tuple[bytes, ...]]):
        h = _hash_tokens(tokens)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def both(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and of the pairs that start with them and stay in their row."""
        pair = np.full(len(h), -1)
        if len(h) > 1:
            pair[:-1] = np.where(row[1:] == row[:-1], self(_pairs(h)), -1)
        return self(h), pair


def _word_rows(data: np.ndarray, off: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their rows, and the number of words by row."""
    low = LOWER[data]
    start, end, row = word_spans(low, off, WORD_BYTES)
    return hasher(low, start, end), row, np.bincount(row, minlength=len(off) - 1)


def _vocabulary_in(vocabulary: list[tuple[bytes, ...]]):
    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        lookup, hasher, out = _Lookup(vocabulary), WordHasher(), []
        data, off = utf8(texts)
        for i, j in pieces(off):
            h, row, _ = _word_rows(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher)
            token = np.concatenate(lookup.both(h, row))
            hit = token >= 0
            pair = np.unique(np.concatenate([row, row])[hit] * len(vocabulary) + token[hit])
            out.append(list_array(pair % len(vocabulary), np.bincount(pair // len(vocabulary), minlength=j - i), pa.int32()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return found


def _scan(phrases: Mapping[str, str], ranked: list[tuple[bytes, ...]], in_prefix: np.ndarray, classes: list[int]):
    """Text to its phrase counts and the blocks with a prefix token; ``in_prefix``: class x rank."""
    labels = sorted(set(phrases.values()))
    parts = [(_hash_words(words_of(p)), labels.index(label)) for p, label in phrases.items()]
    paired = np.array([len(t) > 1 for t in ranked])
    block = "struct<width:int,block:int,ranks:array<int>>"
    block_type = pa.struct([("width", pa.int32()), ("block", pa.int32()), ("ranks", pa.list_(pa.int32()))])

    def piece(h: np.ndarray, row: np.ndarray, n: np.ndarray, lookup: _Lookup) -> pa.Array:
        starts = np.cumsum(n) - n
        places: dict[int, list[int]] = {}
        named: dict[int, set[int]] = {}
        for phrase, label in parts:
            k = len(phrase)
            if len(h) < k:
                continue
            hit = row[k - 1 :] == row[: len(row) - k + 1]
            for m, part in enumerate(phrase):
                hit &= h[m : len(h) - k + 1 + m] == part
            for p in np.flatnonzero(hit).tolist():
                places.setdefault(int(row[p]), []).append(p - int(starts[row[p]]))
                named.setdefault(int(row[p]), set()).add(label)
        word, pair = lookup.both(h, row)
        blocks: dict[int, list[dict]] = {}
        for c, width in enumerate(classes):
            half, done = width // 2, (-1, -1)
            hits = (word >= 0) & in_prefix[c][word] & ~paired[word] | (pair >= 0) & in_prefix[c][pair] & paired[pair]
            for p in np.flatnonzero(hits).tolist():
                r = int(row[p])
                last = (p - int(starts[r])) // half
                for b in range(max(0, last - 1), last + 1):
                    if (r, b) <= done:
                        continue
                    done = (r, b)
                    lo = int(starts[r]) + b * half
                    hi = min(lo + width, int(starts[r] + n[r]))
                    own = np.concatenate([word[lo:hi], pair[lo:hi]])
                    blocks.setdefault(r, []).append({"width": width, "block": b, "ranks": np.unique(own[own >= 0]).tolist()})
        rows = len(n)
        n_base = np.zeros(rows, np.int64)
        first, last_, base, found = [None] * rows, [None] * rows, [[]] * rows, [[]] * rows
        for r, at in places.items():
            n_base[r], first[r], last_[r], base[r] = len(at), min(at), max(at), sorted(labels[x] for x in named[r])
        for r, own in blocks.items():
            found[r] = own
        columns = [pa.array(n.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last_, pa.int64()), pa.array(base, pa.list_(pa.string())), pa.array(found, pa.list_(block_type))]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    @F.arrow_udf(f"struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base:array<string>,blocks:array<{block}>>")
    def scan(texts: pa.Array) -> pa.Array:
        lookup, hasher, out = _Lookup(ranked), WordHasher(), []
        data, off = utf8(texts)
        for i, j in pieces(off):
            out.append(piece(*_word_rows(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher), lookup))
        return pa.concat_arrays(out) if out else piece(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), lookup)

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks`` of each row.

    ``n_base`` counts the places of all phrases, ``labels`` joins the phrases' labels and
    those of matching templates, ``score`` is 1 with a phrase, else the largest share of
    a matching template's tokens, else 0, and ``blocks`` lists the matches (template label, first word, words).

    Defined cases: a null text counts as empty: no words, no labels, score 0. Null and
    repeated ids come back row by row. Templates without words are ignored. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = [(label, tokens_of(t), len(words_of(t))) for label, texts in templates.items() for t in texts if words_of(t)]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    counted = src.select(F.explode(_vocabulary_in(vocabulary)("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    frequency = {r["w"]: r["n"] for r in counted}  # a row for each word of the templates
    order = sorted(range(len(vocabulary)), key=lambda i: (frequency.get(i, 0), i))
    rank = {vocabulary[i]: r for r, i in enumerate(order)}
    ranked = [vocabulary[i] for i in order]

    index, whole = [], []
    classes = sorted({next((b for b in BLOCK_WORDS if b >= 2 * n), 2 * n) for _, _, n in sets})
    in_prefix = np.zeros((len(classes), len(ranked)), bool)
    for k, (label, words, n) in enumerate(sets):
        own = sorted(rank[w] for w in words)
        need = math.ceil(threshold * len(own) - 1e-9)
        width = next((b for b in BLOCK_WORDS if b >= 2 * n), 2 * n)
        whole.append((k, label, own, need))
        for position, r in enumerate(own[: len(own) - need + 1]):
            index.append((width, r, k, position, len(own), need))
            in_prefix[classes.index(width), r] = True
    index = spark.createDataFrame(index, "width int, rank int, template int, at int, size int, need int")
    whole = spark.createDataFrame(whole, "template int, label string, own array<int>, need int")

    found = cut(src.select("id", _scan(phrases, ranked, in_prefix, classes)("text").alias("s")).select("id", "s.*").withColumn("rid", F.monotonically_increasing_id()))
    block = found.select("rid", F.explode("blocks").alias("b")).select("rid", "b.*")
    token = block.select("rid", "width", "block", "ranks", F.posexplode("ranks").alias("place", "rank"))
    reach = F.least(F.col("size") - F.col("at"), F.size("ranks") - F.col("place"))
    pair = token.join(F.broadcast(index), ["width", "rank"]).where((F.size("ranks") >= F.col("need")) & (reach >= F.col("need") - F.col("at")))
    pair = pair.dropDuplicates(["rid", "width", "block", "template"]).select("rid", "width", "block", "ranks", "template")
    common = F.size(F.array_intersect("ranks", "own"))
    match = pair.join(F.broadcast(whole), "template").where(common >= F.col("need"))
    match = match.select("rid", "label", (F.col("block") * (F.col("width") / 2).cast("int")).alias("first"), F.col("width").alias("words"), (common / F.size("own")).alias("share"))
    by_row = match.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("share").alias("best"), F.sort_array(F.collect_set(F.struct("label", "first", "words"))).alias("hits"))
    out = found.drop("blocks").join(by_row, "rid", "left")
    base = F.col("base")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("hits", F.array().cast("array<struct<label:string,first:int,words:int>>")).alias("blocks"),
    )
