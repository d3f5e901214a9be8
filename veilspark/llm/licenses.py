"""License scans: a positional rare-token index.

A template is a notice, a name or a whole licence text. Its words have an inverse document frequency over the whole
corpus, counted in a pass of its own; the rarest of them are indexed with their offsets, and words that many documents
hold are not. A file's words are looked up, the rarest of each template vote for the start that the template would have
there, and starts where enough weight meets, within a small drift, are candidates. A candidate counts when the
template's mandatory key phrases stand word for word in its span and enough of the template's weight stands in its
place; that share is its score. So a licence that borrows another's opening sentence is not taken for it.

Beside the templates three base phrases are counted wherever their words stand consecutively.

Defined results: a null text is empty; an empty text or one without words has no places, no labels and score 0; very
long texts are read whole, in one pass; repeated rows are scanned alike; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import bound_batches, in_slices, strings

#: Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, words, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2 0",)),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("has waived all copyright and related or neighboring rights",)),
    ("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-3.0", "licensed under cc by 3 0", ("cc by 3 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa-3.0", "licensed under cc by sa 3 0", ("cc by sa 3 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    ("boost-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
]

#: Public licence texts whose body is short enough to stand in a file: whole, as their words.
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
TEMPLATES += [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge", "sublicense and or sell copies of the software", "permission notice shall be included in all copies")),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd-3-clause", f"{_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}", ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", ("in no event will the authors be held liable for any damages arising", "altered source versions must be plainly marked as such")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache org licenses license 2 0", "except in compliance with the license")),
    # Names alone, as titles and references have them.
    *((label, name, (name,)) for label, name in (("apache-2.0", "apache license version 2 0"), ("mit", "mit license"), ("gpl-2.0", "gnu general public license version 2"), ("gpl-3.0", "gnu general public license version 3"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"), ("mpl-2.0", "mozilla public license version 2 0"), ("epl-2.0", "eclipse public license v2 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("bsd-3-clause", "bsd 3 clause license"), ("bsd-2-clause", "bsd 2 clause license"), ("isc", "isc license"))),
]


#: Indexed words of a template, the rarest in the corpus first; words in a larger share of all documents are indexed only
#: where a template has fewer than ``FEW_WORDS`` rarer ones. ``PRIOR`` documents without any of them smooth the shares.
RARE_WORDS, FEW_WORDS, MAX_SHARE, PRIOR = 8, 2, 0.05, 1000
#: Votes within so many places of each other, or a tenth of the template's length, count together; the share of a
#: template's indexed weight that makes a candidate, and the share of all its weight that makes a label.
DRIFT, MIN_SHARE, MIN_COVERAGE = 3, 0.5, 0.6
#: The score of a file in which only base phrases were found.
BASE_SCORE = 0.5
#: What divides words, once A-Z are lower-cased.
DIVIDERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, dictionary encoded and joined, and where each text's begin (one more at the end)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), DIVIDERS)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    keep = pc.not_equal(flat, "")
    kept = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))]
    coded = flat.filter(keep).dictionary_encode()
    return coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded, kept[bounds]


class LicenseIndex:
    """Postings of rare template words: word to offsets in templates.

    ``frequency`` has the number of documents of the corpus, under "", and those that hold each word of the templates;
    without it all words are alike.
    """

    def __init__(self, frequency: dict[str, int] | None = None, templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> None:
        self.labels = [x[0] for x in templates]
        own = [x[1].split() for x in templates]
        phrases = [k.split() for x in templates for k in x[2]] + [k.split() for k in base]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in (*own, *phrases) for w in x}))}
        known = frequency or {}
        n = known.get("", 0) + PRIOR
        self.share = {w: known.get(w, 0) / n for w in self.vocabulary}
        self.idf = np.array([-math.log((known.get(w, 0) + 1) / (n + 1)) for w in self.vocabulary])
        self.words = [self._codes(x) for x in own]
        self.keys = [[self._codes(k.split()) for k in x[2]] for x in templates]
        self.base = [(self._codes(k.split()), label) for k, label in base.items()]
        self.total = [float(self.idf[x].sum()) for x in self.words]
        self.drift = [max(DRIFT, len(x) // 10) for x in self.words]
        names = list(self.vocabulary)
        self.rare: list[np.ndarray] = []
        for x in self.words:
            order = sorted(set(x.tolist()), key=lambda w: (-self.idf[w], names[w]))
            few = [w for w in order if self.share[names[w]] <= MAX_SHARE]
            self.rare.append(np.array((few if len(few) >= FEW_WORDS else order[:FEW_WORDS])[:RARE_WORDS]))
        #: Indexed weight of each word in each template.
        self.weight = np.zeros((len(names), len(templates)))
        for t, x in enumerate(self.rare):
            self.weight[x, t] = self.idf[x]
        self.need = MIN_SHARE * self.weight.sum(axis=0)

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary[w] for w in words])

    def codes(self, coded: pa.DictionaryArray) -> np.ndarray:
        """The vocabulary's number of every word, or -1."""
        known = np.array([self.vocabulary.get(w, -1) for w in strings(coded.dictionary, " ")] or [-1])
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)

    @staticmethod
    def places(codes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the words of a phrase stand consecutively."""
        at = np.flatnonzero(codes[: max(0, len(codes) - len(phrase) + 1)] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[codes[at + k] == phrase[k]]
        return at

    def scan(self, codes: np.ndarray) -> tuple[np.ndarray, set[str], set[str], float, list[tuple[str, int, int]]]:
        """Base places, base labels, all labels, score, and the templates' spans, of the words of one text."""
        found = [(self.places(codes, x), label) for x, label in self.base]
        base = {label for x, label in found if len(x)}
        places = np.sort(np.concatenate([x for x, _ in found]))
        labels, score, spans = set(base), BASE_SCORE if base else 0.0, []
        where = np.flatnonzero(codes >= 0)
        order = where[np.argsort(codes[where], kind="stable")]
        present, starts = np.unique(codes[order], return_index=True)
        stops = np.r_[starts[1:], len(order)]
        at = {int(w): order[a:b] for w, a, b in zip(present, starts, stops, strict=False)}
        for t in np.flatnonzero(self.weight[present].sum(axis=0) >= self.need) if len(present) else ():
            starts, coverage = self._candidates(codes, at, int(t))
            good = coverage >= MIN_COVERAGE
            if not good.any():
                continue
            labels.add(self.labels[t])
            score = max(score, float(coverage[good].max()))
            length, kept = len(self.words[t]), []
            for start, share in zip(starts[good].tolist(), coverage[good].tolist(), strict=True):
                if kept and start < kept[-1][0] + length:  # of overlapping places the one that covers most
                    if share > kept[-1][1]:
                        kept[-1] = (start, share)
                else:
                    kept.append((start, share))
            spans += [(self.labels[t], max(0, x), min(len(codes), x + length)) for x, _ in kept]
        return places, base, labels, min(1.0, score), sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    def _candidates(self, codes: np.ndarray, at: dict[int, np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of a template at which enough of the file's rarest words of it meet and its key phrases stand, and how
        much of the template stands there."""
        own, drift = self.words[t], self.drift[t]
        rare = [int(w) for w in self.rare[t] if int(w) in at]  # the file's words of the template, the rarest first
        votes = [np.unique(np.concatenate([at[w] - o for o in np.flatnonzero(own == w)])) for w in rare]
        starts = np.unique(np.concatenate(votes))
        met = np.zeros(len(starts))
        for w, x in zip(rare, votes, strict=True):
            met += self.idf[w] * (np.searchsorted(x, starts + drift, "right") > np.searchsorted(x, starts))
        starts = starts[met >= self.need[t]]
        for k in self.keys[t]:
            stand = self.places(codes, k)
            starts = starts[np.searchsorted(stand, starts + len(own) + drift - len(k), "right") > np.searchsorted(stand, starts - drift)]
        coverage = np.zeros(len(starts))
        for o, w in enumerate(own.tolist()):
            if len(starts) and w in at:
                coverage += self.idf[w] * (np.searchsorted(at[w], starts + o + drift, "right") > np.searchsorted(at[w], starts + o - drift))
        return starts, coverage / self.total[t]


def word_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Over all documents: their number, under "", and how many hold each word of the templates (a few hundred numbers)."""
    bound_batches(docs.sparkSession)
    vocabulary = LicenseIndex().vocabulary
    names = np.array(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, rows = LicenseIndex(), np.zeros(len(names), np.int64), 0
        for b in batches:
            coded, bounds = word_lists(b.column(0))
            codes = index.codes(coded)
            where = np.flatnonzero(codes >= 0)
            row = np.searchsorted(bounds, where, "right") - 1
            counts += np.bincount(np.unique(row * len(names) + codes[where]) % len(names), minlength=len(names))
            rows += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["", *names.tolist()]), pa.array([rows, *counts.tolist()], pa.int64())], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(in_slices(run, 0), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, words, base places, first and last of them, labels, score, and the spans of the templates found."""
    bound_batches(docs.sparkSession)
    frequency = word_frequencies(docs, text_col)
    src = docs.select(id_col, text_col)
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        src.schema[id_col], *(T.StructField(x, T.LongType()) for x in ("n_words", "n_base", "first_word", "last_word")),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(span)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(frequency)
        watched = np.zeros(len(index.vocabulary), bool)
        for x in (*index.rare, *(phrase[:1] for phrase, _ in index.base)):
            watched[x] = True
        arrow_span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            coded, bounds = word_lists(b.column(1))
            codes = index.codes(coded)
            sizes = np.diff(bounds)
            hits = np.r_[0, np.cumsum((codes >= 0) & watched[codes])] if len(codes) else np.zeros(1, np.int64)
            rows = [(0, None, None, "", "", 0.0, [])] * b.num_rows
            for i in np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]]).tolist():
                places, base, labels, score, spans = index.scan(codes[bounds[i] : bounds[i + 1]])
                first, last = (int(places[0]), int(places[-1])) if len(places) else (None, None)
                rows[i] = (len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": s[0], "first": s[1], "end": s[2]} for s in spans])
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), arrow_span]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    return src.mapInArrow(in_slices(run, 1), schema)
