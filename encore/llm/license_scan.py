"""Licence notices by a positional index of rare words.

The index holds every word of every template (a licence's notice, or a plain phrase) with its
places. Of a file only the licence words are looked at, rarest in the corpus first. A template may
miss some of its words (none, for a base phrase); places whose words the file lacks use up part of
that allowance, and of the places left, the ``allowance + 2`` rarest are looked up. At least two
of them stand right in each match, so their postings are intersected by relative position: only
starts that two places agree on are verified. No match is missed.

To verify is to find the mandatory key phrases and enough of the words, in order. In long notices
words may stand a little off their places, as a word put in or left out moves the rest.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import words_of

AGREEING = 2  # looked-up places that must agree on a start
LEAST_MATCH = 0.7  # share of a notice's words that must stand at their places
WORDS_PER_SHIFT, MOST_SHIFT = 20, 3  # a word may stand off by one for so many words of its notice


@dataclass(frozen=True)
class Template:
    """Text of a licence notice with the phrases it cannot lack; ``base`` ones match verbatim."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


# Phrases with their labels.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
# Notices of common licences, as their texts recommend them.
NOTICES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0",
             ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without "
             "modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0",
             ("boost software license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "creative commons attribution 4 0 international license",
             ("creative commons attribution 4",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0",
             ("eclipse public license",)),
    Template("gpl-2.0", "gnu general public license version 2", ("public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any "
             "purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy "
             "of this software and associated documentation files",
             ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    # Whole notices, as their licences give them.
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice shall be included in all copies or substantial portions
        of the software""", ("to deal in the software without restriction",)),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with
        or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies""", ("with or without fee",)),
    Template("bsd-2-clause", """redistribution and use in source and binary forms with or without
        modification are permitted provided that the following conditions are met 1 redistributions
        of source code must retain the above copyright notice this list of conditions and the
        following disclaimer 2 redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution""",
             ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("bsd-3-clause", """neither the name of the copyright holder nor the names of its contributors may
        be used to endorse or promote products derived from this software without specific prior
        written permission""", ("endorse or promote products derived from this software",)),
    Template("zlib", """this software is provided as is without any express or implied warranty in no event
        will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely""",
             ("to alter it and redistribute it freely",)),
    Template("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this
        file except in compliance with the license you may obtain a copy of the license at http
        www apache org licenses license 2 0 unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied""", ("the apache license",)),
    Template("gpl-2.0-or-later", """this program is free software you can redistribute it and or modify it
        under the terms of the gnu general public license as published by the free software
        foundation either version 2 of the license or at your option any later version""",
             ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3.0-or-later", """this program is free software you can redistribute it and or modify it
        under the terms of the gnu general public license as published by the free software
        foundation either version 3 of the license or at your option any later version""",
             ("gnu general public license", "either version 3 of the license")),
    Template("lgpl-2.1-or-later", """this library is free software you can redistribute it and or modify it
        under the terms of the gnu lesser general public license as published by the free software
        foundation either version 2 1 of the license or at your option any later version""",
             ("gnu lesser general public license", "either version 2 1 of the license")),
    Template("agpl-3.0-or-later", """this program is free software you can redistribute it and or modify it
        under the terms of the gnu affero general public license as published by the free software
        foundation either version 3 of the license or at your option any later version""",
             ("gnu affero general public license", "either version 3 of the license")),
    Template("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at http mozilla
        org mpl 2 0""", ("mozilla public license",)),
    Template("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a
        copy of the software and accompanying documentation covered by this license the software to
        use reproduce display distribute execute and transmit the software""",
             ("any person or organization obtaining a copy",)),
    Template("unlicense", """this is free and unencumbered software released into the public domain anyone is
        free to copy modify publish use compile sell or distribute this software either in source
        code form or as a compiled binary for any purpose commercial or non commercial and by any
        means""", ("free and unencumbered software",)),
    Template("cc-by-sa", """this work is licensed under the creative commons attribution sharealike 4 0
        international license""", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", """this work is licensed under the creative commons attribution noncommercial 4 0
        international license""", ("creative commons attribution noncommercial",)),
)
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def document_frequencies(docs: DataFrame, text_column: str, vocabulary: frozenset) -> dict:
    """In how many documents each template word occurs; ``b""`` counts all documents.

    Every task adds up its own documents, so a word costs a row per task.
    """

    def count(batches):
        seen = Counter()
        for batch in batches:
            seen[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "docs"],
        )

    counted = docs.select(text_column).mapInArrow(count, "word binary, docs long")
    total = counted.groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return {bytes(row.word): row.docs for row in total}  # at most the words of the templates


def inverse_frequencies(counts: dict, vocabulary: frozenset) -> dict[bytes, float]:
    total = counts.get(b"", 0)
    return {word: math.log((total + 1) / (counts.get(word, 0) + 1)) for word in vocabulary}


class Index:
    """Word -> (template, place), with what it takes to verify a template."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates, self.idf = templates, idf
        self.words = [words_of(t.text) for t in templates]
        self.keys = [
            [(key, places(key, words)) for key in map(words_of, t.keys)]
            for t, words in zip(templates, self.words, strict=True)
        ]
        self.allowances = [
            0 if t.base else len(words) - math.ceil(LEAST_MATCH * len(words) - 1e-9)
            for t, words in zip(templates, self.words, strict=True)
        ]
        self.shifts = [
            0 if t.base else min(MOST_SHIFT, len(words) // WORDS_PER_SHIFT)
            for t, words in zip(templates, self.words, strict=True)
        ]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(self.words):
            for place, word in enumerate(words):
                self.postings[word].append((number, place))
        self.vocabulary = frozenset(self.postings)

    def rarest(self, present: frozenset) -> dict[bytes, list[tuple[int, int]]]:
        """Postings to look up in a file that holds these licence words."""
        found = Counter(number for word in present for number, _ in self.postings[word])
        wanted = {}
        for number, n in found.items():
            left = self.allowances[number] - (len(self.words[number]) - n)
            if left >= 0:
                wanted[number] = left + AGREEING
        chosen = defaultdict(list)
        for word in sorted(present, key=lambda w: (-self.idf.get(w, 0.0), w)):
            for number, place in self.postings[word]:
                if wanted.get(number, 0) > 0:
                    wanted[number] -= 1
                    chosen[word].append((number, place))
        return chosen

    def starts(self, words: list[bytes]) -> dict[int, list[int]]:
        """Template -> starts that enough of the looked-up places agree on, rising."""
        present = self.vocabulary.intersection(words)
        chosen = self.rarest(present) if present else {}
        if not chosen:
            return {}
        agree: dict[int, Counter] = defaultdict(Counter)
        for at, word in enumerate(words):
            for number, place in chosen.get(word, ()):
                agree[number][at - place] += 1
        result = {}
        for number, counts in agree.items():
            shift = self.shifts[number]
            if shift:
                near = Counter()
                for start, n in counts.items():
                    for off in range(-shift, shift + 1):
                        near[start + off] += n
                counts = near
            need = min(AGREEING, len(self.words[number]))
            result[number] = sorted(start for start, n in counts.items() if n >= need)
        return result

    def share(self, number: int, start: int, words: list[bytes]) -> float:
        """Share of the template's words in place; 0 unless all mandatory phrases are."""
        template, shift = self.words[number], self.shifts[number]
        for key, at in self.keys[number]:
            if not any(
                words[max(start + p + off, 0):start + p + off + len(key)] == key
                for p in at for off in range(-shift, shift + 1)
            ):
                return 0.0
        return in_order(template, words, start, shift) / len(template)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        base_at, base, labels, score = [], set(), set(), 0.0
        for number, starts in self.starts(words).items():
            template = self.templates[number]
            if template.base:
                at = [start for start in starts if self.share(number, start, words) == 1.0]
                base_at += at
                base.update([template.label] if at else [])
                score = 1.0 if at else score
                continue
            best = 0.0
            for start in starts:
                best = max(best, self.share(number, start, words))
                if best == 1.0:
                    break
            if best >= LEAST_MATCH:
                labels.add(template.label)
                score = max(score, best)
        return (
            len(words), len(base_at), min(base_at, default=None), max(base_at, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
        )


def in_order(template: list[bytes], words: list[bytes], start: int, shift: int) -> int:
    """Most template words that stand in order in ``words``, each off its place by ``shift`` at most."""
    if not shift:
        return sum(
            0 <= start + i < len(words) and words[start + i] == word
            for i, word in enumerate(template))
    width = 2 * shift + 1
    best = [0] * width  # best[d]: with words up to start + i + d - shift
    for i, word in enumerate(template):
        row, last = [], 0
        for d in range(width):
            at = start + i + d - shift
            # One place on, the same word of the document is one step less off.
            value = max(best[d + 1] if d + 1 < width else best[-1], last)
            if 0 <= at < len(words) and words[at] == word:
                value = max(value, best[d] + 1)
            row.append(value)
            last = value
        best = row
    return best[-1]


def places(phrase: list[bytes], words: list[bytes]) -> list[int]:
    """Where a phrase stands in a list of words."""
    return [i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase]


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: words, places of base phrases, labels and a score from 0 to 1.

    ``score`` is the best share of a template's words found in place, 1 for a base phrase. A notice
    of 20 words or more may lack words or have some put in, as long as none moves by more than a
    place per 20 words of the notice, 3 at most, and LEAST_MATCH of them are there in order. Null
    and empty texts have no words, null first and last word, empty labels and score 0. Null ids
    stay null, repeated rows are scanned one by one, other columns are not read.
    """
    vocabulary = frozenset(word for t in templates for word in words_of(t.text))
    counts = document_frequencies(docs, text_column, vocabulary)
    idf = inverse_frequencies(counts, vocabulary)

    def scan(batches):
        index = Index(templates, idf)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            found = [index.scan(text) for text in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in kinds]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = [part.split()[0] for part in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_column, *names])

    read = docs.select(id_column, text_column)
    kind = read.schema[id_column].dataType.simpleString()
    return read.mapInArrow(scan, f"`{id_column}` {kind}, {RESULT}")
