"""Licence scans by a positional rare-token index over licence templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import chunks, table, word_hashes, word_spans

#: Bytes that stand outside words: ASCII without digits and letters.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """A licence: its label, one of its texts, and the phrases that a match must hold."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Public licence texts, without the lines that name a holder.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version
{} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_PUBLIC = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Base phrases (fixed values of the query's contract), the notices that projects put in their files, and licence texts.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "isc license permission to use copy modify", ("isc license",)),
    Template("mit-text", _GRANT, ("permission is hereby granted free of charge", "furnished to do so")),
    Template("bsd-2-text", f"{_REDISTRIBUTION} {_AS_IS}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd-3-text", f"{_REDISTRIBUTION} {_ENDORSE} {_AS_IS}", ("redistribution and use in source and binary forms", "endorse or promote products derived")),
    Template("isc-text", _ISC, ("with or without fee is hereby granted",)),
    Template("zlib-text", _ZLIB, ("alter it and redistribute it freely",)),
    Template("apache-2.0-text", _APACHE, ("licensed under the apache license version 2 0", "distributed on an as is basis")),
    Template("gpl-2-text", _GPL.format(2), ("gnu general public license", "either version 2")),
    Template("gpl-3-text", _GPL.format(3), ("gnu general public license", "either version 3")),
    Template("unlicense-text", _PUBLIC, ("unencumbered software released into the public domain",)),
)
#: Of each stretch of so many words of a file, so many distinct licence words, those of highest IDF, are looked up; a word
#: that more than half of all documents hold never is.
STRETCH, RARE = 32, 8
#: Words that a template's words may stand off their place, so that texts with a few words more or fewer still fit; and the
#: share of a template's IDF that looked-up words must vote for within such a band.
BAND, VOTES = 8, 0.1


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in words_of(t.text)})


def _hits(batch_text: pa.Array, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk: words per row, and for each word its place in the sorted vocabulary or -1."""
    for _, offsets, body in chunks(batch_text):
        starts, ends, n = word_spans(offsets, body, _OUTSIDE)
        h = word_hashes(body, starts, ends)
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        yield n, np.where(hashes[at] == h, at, -1) if len(h) else np.empty(0, np.int64)


def document_frequencies(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """(word, n_docs) of the vocabulary over all documents: one bit row per batch is summed in the task, then by Spark."""
    hashes, names = _keyed(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for n, w in _hits(batch.column("text"), hashes):
                doc = np.repeat(np.arange(len(n)), n)[w >= 0]
                total += np.bincount(np.unique(doc * len(names) + w[w >= 0]) % len(names), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total)], ["word", "n_docs"])

    return docs.select("text").mapInArrow(run, "word string, n_docs long").groupBy("word").agg(F.sum("n_docs").alias("n_docs"))


def _keyed(vocab: list[str]) -> tuple[np.ndarray, list[str]]:
    """Hashes of the words, ascending, and the words in that order."""
    body = "".join(vocab).encode()
    ends = np.cumsum([len(w.encode()) for w in vocab])
    starts = np.concatenate(([0], ends[:-1]))
    h = word_hashes(np.frombuffer(body, np.uint8), starts, ends)
    order = np.argsort(h)
    return h[order], [vocab[k] for k in order]


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, min_score: float = 0.6) -> DataFrame:
    """One row per document: n_words, base places, labels, and the best score.

    Method: a positional rare-token index. Document frequencies of all licence words are counted over all documents. Each
    word posts the templates and positions at which it stands. A file looks up the postings of its rarest licence words
    (RARE of each STRETCH), which vote with their IDF for a template and the band of relative positions where it would
    begin. Where a band gets enough votes (VOTES), all key phrases must stand in it, whole and in their order, and the
    IDF-weighted share of template words within BAND words of their place must reach min_score.

    Base phrases are exact: the rarest word of each is looked up wherever it stands, and the phrase must begin there, so
    none is lost.

    Null text counts as empty (n_words 0, no labels, score 0, null first_word and last_word); an empty table gives no
    rows; repeated rows each give a row; other columns are not read.
    """
    hashes, names = _keyed(vocabulary(templates))
    number = {w: k for k, w in enumerate(names)}
    n_docs = docs.count()
    found = {r["word"]: r["n_docs"] for r in document_frequencies(docs, names).collect()}  # at most the templates' words
    idf = np.array([np.log((n_docs + 1) / (found.get(w, 0) + 1)) + 1e-9 for w in names])

    most = max(len(words_of(t.text)) for t in templates)
    want = np.full((len(templates), most), -2)
    anchor_at = np.zeros(len(templates), np.int64)
    is_anchor = np.zeros(len(names), bool)
    for k, t in enumerate(templates):
        words = words_of(t.text)
        want[k, : len(words)] = [number[w] for w in words]
        if t.base:
            anchor_at[k] = max(range(len(words)), key=lambda j: (idf[want[k, j]], -j))
            is_anchor[want[k, anchor_at[k]]] = True
    # postings of word v: (template, position) at first_post[v]..first_post[v + 1]
    post_t, post_j = np.nonzero(want >= 0)
    by_word = np.argsort(want[post_t, post_j], kind="stable")
    post_t, post_j = post_t[by_word], post_j[by_word]
    first_post = np.searchsorted(want[post_t, post_j], np.arange(len(names) + 1))
    rarity = np.argsort(np.argsort(-idf, kind="stable"), kind="stable")
    usual = idf < np.log(2)
    weight = np.where(want >= 0, idf[np.maximum(want, 0)], 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    base = np.array([t.base for t in templates])
    labels = [t.label for t in templates]

    size = (want >= 0).sum(axis=1)
    keys_of = [[np.array([number[x] for x in key]) for key in map(words_of, t.keys)] for t in templates]
    long_post = ~base[post_t]  # postings of templates that votes find

    def looked_up(at: np.ndarray, doc: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which occurrences of licence words are among the RARE rarest of their stretch."""
        part = doc * (int(np.diff(first).max(initial=0)) // STRETCH + 1) + (at - first[doc]) // STRETCH
        pair = np.unique(part * len(names) + rarity[word])
        of = pair // len(names)
        few = pair[np.arange(len(pair)) - np.searchsorted(of, of) < RARE]
        return np.isin(part * len(names) + rarity[word], few) & ~usual[word]

    def postings(at: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, template, position in it, where it would begin) of all postings of these occurrences."""
        n = first_post[word + 1] - first_post[word]
        item = np.repeat(first_post[word] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.repeat(doc, n), post_t[item], post_j[item], np.repeat(at, n) - post_j[item], long_post[item]

    def base_places(w: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, template, first word) of all base phrases."""
        hit = is_anchor[w[at]]
        doc, tmpl, j, start, votes = postings(at[hit], doc[hit], w[at[hit]])
        ok = ~votes & (j == anchor_at[tmpl]) & (start >= first[doc]) & (start + size[tmpl] <= first[doc + 1])
        doc, tmpl, start = doc[ok], tmpl[ok], start[ok]
        for j in range(int(size[base].max(initial=0))):
            same = (j >= size[tmpl]) | (w[np.where(j < size[tmpl], start + j, 0)] == want[tmpl, j])
            doc, tmpl, start = doc[same], tmpl[same], start[same]
        return doc, tmpl, start

    def bands(w: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, template, middle of the band) where the looked-up words' votes suffice. A band is two steps of BAND
        wide, so that places at the edge of a step fall well within one; a template word votes once in it."""
        pick = looked_up(at, doc, w[at], first)
        doc, tmpl, j, start, votes = postings(at[pick], doc[pick], w[at[pick]])
        doc, tmpl, j, start = doc[votes], tmpl[votes], j[votes], start[votes]
        step = (start - first[doc]) // BAND
        step = np.concatenate([step - 1, step])
        doc, tmpl, j = np.tile(doc, 2), np.tile(tmpl, 2), np.tile(j, 2)
        if not len(doc):
            return doc, tmpl, step
        low = int(step.min())
        band = (doc * len(templates) + tmpl) * (int(step.max()) - low + 1) + step - low
        one = np.unique(band * most + j, return_index=True)[1]
        keys, back = np.unique(band[one], return_inverse=True)
        total = np.bincount(back, weight[tmpl[one], j[one]], len(keys))
        of = one[np.unique(back, return_index=True)[1]][total >= VOTES]
        return doc[of], tmpl[of], first[doc[of]] + (step[of] + 1) * BAND

    def in_order(text: np.ndarray, keys: list[np.ndarray]) -> bool:
        at = 0
        for key in keys:
            starts = np.flatnonzero(text[at : len(text) - len(key) + 1] == key[0])
            found = next((k for k in starts if np.array_equal(text[at + k : at + k + len(key)], key)), None)
            if found is None:
                return False
            at += int(found) + len(key)
        return True

    def match(n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Accepted (document, template, first word) with scores, of one chunk."""
        first = np.concatenate(([0], np.cumsum(n)))
        at = np.flatnonzero(w >= 0)
        of = np.searchsorted(first, at, "right") - 1
        b_doc, b_tmpl, b_start = base_places(w, first, at, of)
        doc, tmpl, middle = bands(w, first, at, of)
        score = np.zeros(len(doc))
        for j in range(int(size[tmpl].max(initial=0))):
            live = np.flatnonzero(j < size[tmpl])
            same = np.zeros(len(live), bool)
            for off in range(-BAND, BAND + 1):
                here = middle[live] + j + off
                inside = (here >= first[doc[live]]) & (here < first[doc[live] + 1])
                same |= inside & (w[np.where(inside, here, 0)] == want[tmpl[live], j])
            score[live] += np.where(same, weight[tmpl[live], j], 0)
        lo, hi = np.maximum(middle - BAND, first[doc]), np.minimum(middle + size[tmpl] + BAND, first[doc + 1])
        good = np.array([k for k in np.flatnonzero(score >= min_score) if in_order(w[lo[k] : hi[k]], keys_of[tmpl[k]])], np.int64)
        doc, tmpl, middle, score = doc[good], tmpl[good], middle[good], score[good]
        return np.concatenate([b_doc, doc]), np.concatenate([b_tmpl, tmpl]), np.concatenate([b_start - first[b_doc], middle - first[doc]]), np.concatenate([np.ones(len(b_doc)), np.minimum(score, 1.0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for n, w in _hits(batch.column("text"), hashes):
                doc, tmpl, start, score = match(n, w) if len(w) else (np.empty(0, int),) * 4
                rows: dict[int, list[int]] = {}
                for k, d in enumerate(doc.tolist()):
                    rows.setdefault(d, []).append(k)
                for d, size in enumerate(n.tolist()):
                    own = rows.get(d, [])
                    at = [int(start[k]) for k in own if base[tmpl[k]]]
                    plain = sorted({labels[tmpl[k]] for k in own if base[tmpl[k]]})
                    every = sorted({labels[tmpl[k]] for k in own})
                    for to, x in zip(out, (size, len(at), min(at, default=None), max(at, default=None), ",".join(plain), ",".join(every), max((float(score[k]) for k in own), default=0.0)), strict=True):
                        to.append(x)
            types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
