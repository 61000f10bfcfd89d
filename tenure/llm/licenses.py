"""License scans (operator 10): a positional rare-token index over templates.

Templates are licence notices in the normal word form (A-Z lower-cased, words
of ``0-9a-z`` and non-ASCII characters), some as one opening sentence, some
whole.  Each word's document frequency over the whole corpus gives its IDF.
A file looks up its highest-IDF licence words: where a template of n words may differ
in m places (``MIN_SHARE``), the template's words that the file lacks use up some of the
m, and of those it has the m + ``VOTES`` of highest IDF (m being what is left) are looked up.
An occurrence at word ``w`` of a word that stands at ``p`` in a template votes for
that template starting at ``w - p``.  The remaining differences can spoil at most m of the
words, so a notice in place always gets ``VOTES`` votes (or one of each word but m, where the
template has fewer words): the index loses no match.  Where a start has them,
the template's words are compared in place, and its mandatory key phrases must
stand inside the matched stretch.  The share of template words found in place
must reach ``MIN_SHARE``.

Beside the templates' labels, the base phrases (fixed, given) are counted at
every place where their words stand consecutively.

Defined results: a null or wordless text has no words, places or labels, and
score 0; in an empty corpus every list is empty; an empty table gives no rows;
repeated rows are scanned each time; words of equal IDF are taken in byte
order, which changes no result; a very long text is scanned whole, in time about linear in
its words; input columns named like the results keep their names and values in ``scan``, and the
results get longer names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import append_columns, fold_words, fresh

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening words of public licence notices, and the shorter notices whole, with the phrases that
# must stand in a match.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("artistic-2.0", "released under the artistic license 2 0", ["artistic license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring"
                " rights to this work", ["waived all copyright"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software released into the public domain"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met 1 redistributions of source code must retain the above copyright"
            " notice this list of conditions and the following disclaimer 2 redistributions in binary form must"
            " reproduce the above copyright notice this list of conditions and the following disclaimer in the"
            " documentation and or other materials provided with the distribution this software is provided by the"
            " copyright holders and contributors as is and any express or implied warranties including but not"
            " limited to the implied warranties of merchantability and fitness for a particular purpose are"
            " disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect"
            " incidental special exemplary or consequential damages including but not limited to procurement of"
            " substitute goods or services loss of use data or profits or business interruption however caused and"
            " on any theory of liability whether in contract strict liability or tort including negligence or"
            " otherwise arising in any way out of the use of this software even if advised of the possibility of"
            " such damage", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted provided that the above copyright notice and this permission notice appear in all"
            " copies the software is provided as is and the author disclaims all warranties with regard to this"
            " software including all implied warranties of merchantability and fitness in no event shall the author"
            " be liable for any special direct indirect or consequential damages or any damages whatsoever resulting"
            " from loss of use data or profits whether in an action of contract negligence or other tortious action"
            " arising out of or in connection with the use or performance of this software",
     ["with or without fee is hereby granted"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files the software to deal in the software without restriction including"
            " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
            " copies of the software and to permit persons to whom the software is furnished to do so subject to"
            " the following conditions the above copyright notice and this permission notice shall be included in"
            " all copies or substantial portions of the software the software is provided as is without warranty of"
            " any kind express or implied including but not limited to the warranties of merchantability fitness for"
            " a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"
            " for any claim damages or other liability whether in an action of contract tort or otherwise arising"
            " from out of or in connection with the software or the use or other dealings in the software",
     ["free of charge"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be"
             " held liable for any damages arising from the use of this software permission is granted to anyone to"
             " use this software for any purpose including commercial applications and to alter it and redistribute"
             " it freely subject to the following restrictions 1 the origin of this software must not be"
             " misrepresented you must not claim that you wrote the original software if you use this software in a"
             " product an acknowledgment in the product documentation would be appreciated but is not required 2"
             " altered source versions must be plainly marked as such and must not be misrepresented as being the"
             " original software 3 this notice may not be removed or altered from any source distribution",
     ["permission is granted to anyone to use this software"]),
]

VOTES = 2
MIN_SHARE = 0.8


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each word of a (small, fixed) vocabulary occurs, and the number of documents."""
    wanted = {w.encode() for w in vocabulary}

    def count(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(wanted.intersection(fold_words(text or b"")))
        words = [w.decode() for w in seen] + [""]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*seen.values(), n], pa.int64())],
                                         names=["word", "n"])

    sent = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    rows = sent.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}      # at most the vocabulary's size
    return counts, counts.pop("", 0)


class Index:
    """Every template's words by falling IDF with their positions, and how many places of it may differ."""

    def __init__(self, templates, df: dict[str, int], n_docs: int):
        self.templates = []
        for label, text, phrases in templates:
            words = text.encode().split()
            positions: dict[bytes, list[int]] = defaultdict(list)
            for p, w in enumerate(words):
                positions[w].append(p)
            idf = {w: math.log((n_docs + 1) / (df.get(w.decode(), 0) + 1)) for w in positions}
            by_idf = [(w, positions[w]) for w in sorted(positions, key=lambda w: (-idf[w], w))]
            least = next(k for k in range(len(words) + 1) if k / len(words) >= MIN_SHARE)
            self.templates.append((label, words, [b" " + k.encode() + b" " for k in phrases], by_idf, len(words) - least))
        self.vocabulary = frozenset(w for t in self.templates for w in t[1])

    def probes(self, present: frozenset[bytes], by_idf, allowed: int) -> tuple[list[tuple[bytes, list[int]]], int]:
        """The words of one template to look up in a file that has ``present``, and the votes a start needs; no
        words if the file lacks too many."""
        had = []
        for w, positions in by_idf:
            if w in present:
                had.append((w, positions))
            else:
                allowed -= len(positions)
                if allowed < 0:
                    return [], 0
        had = had[:allowed + VOTES]
        return had, max(1, len(had) - allowed)

    def find(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, share of the template in place, first word, word after the last) of every match."""
        present = self.vocabulary.intersection(words)
        places: dict[bytes, list[int]] = defaultdict(list)
        found = []
        for label, template, keys, by_idf, allowed in self.templates:
            looked_up, needed = self.probes(present, by_idf, allowed)
            if not looked_up:
                continue
            if not places:
                for at, w in enumerate(words):
                    if w in present:
                        places[w].append(at)
            votes: Counter[int] = Counter()
            for w, positions in looked_up:
                votes.update({at - p for at in places[w] for p in positions})
            for start in sorted(s for s, n in votes.items() if n >= needed):
                lo = max(start, 0)
                stretch = words[lo:start + len(template)]
                share = sum(a == b for a, b in zip(stretch, template[lo - start:])) / len(template)
                joined = b" " + b" ".join(stretch) + b" "
                if share >= MIN_SHARE and all(k in joined for k in keys):
                    found.append((label, share, lo, lo + len(stretch)))
        return found


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase."""
    text, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE_PHRASES.items():
        needle, at, index, last = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := text.find(needle, at)) >= 0:
            index += text.count(b" ", last, at)
            out.append((index, label))
            last = at
            at += 1
    return sorted(out)


def scan(docs: DataFrame, text_col: str = "text", templates=None, keep_text: bool = True) -> tuple[DataFrame, dict]:
    """``docs`` with the scan's columns, and the names these got: ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score`` and ``matches`` (label:first word:word after the last)."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t[1].split()})
    index = Index(templates, *document_frequencies(docs, vocabulary, text_col))
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
             "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(),
             "matches": T.StringType()}
    names = dict(zip(kinds, fresh(docs, *kinds)))

    def row(text):
        words = fold_words(text or b"")
        base, found = base_places(words), index.find(words)
        labels = {label for _, label in base}
        score = max([share for _, share, _, _ in found], default=0.0)
        return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted(labels)), ",".join(sorted(labels | {f[0] for f in found})),
                1.0 if base else round(score, 6), ",".join(f"{a}:{b}:{c}" for a, _, b, c in sorted(found)))

    def make():
        return lambda texts: list(zip(*map(row, texts))) or [[]] * len(kinds)

    return append_columns(docs, text_col, [(names[k], t) for k, t in kinds.items()], make, keep_text), names


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document with the scan's columns beside its id."""
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("document_text"))
    made, c = scan(narrow, "document_text", keep_text=False, **options)
    return made.select(id_col, *[F.col(c[k]).alias(k) for k in c])
