"""License scan: an exact set-similarity join of text blocks with license templates, and fixed phrases.

A template's blocks are all runs of as many words as it has, anywhere in a text, across line ends (a text with fewer
words is one block).  A block matches if it holds CONTAINED of the template's distinct words or more.  Words are ordered
by how many documents of the whole corpus have them, rarest first.  A template's prefix is its first n - needed + 1
words: a matching block has one of them (prefix filter), ``needed`` template words at least (length filter), and after
the places of the shared word both sides have enough words left (positional filter).  A block holds no more than its
text, so the filters are asked of the text first; what passes is verified block by block: the block moves over the
places of the template's words, so a text costs no more than its own length.  No block is missed.  The templates are a
parameter of known size and travel with the tasks.

Null text: empty.  Empty table: no rows.  Rows with equal doc_id: a row each.  Very long texts: all of their blocks, in
one row.  Ties: of equally good blocks the first.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Phrase and label: fixed values of the base scan.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label and words of common license notices, their opening words and their full texts: fixed values.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
]
CONTAINED = 0.85

_SEPARATORS = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of letters, digits and non-ASCII characters."""
    return text.lower().translate(_SEPARATORS).split()


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents have each word of the templates' vocabulary; its size bounds what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for word in vocabulary.intersection(words(text)):
                    total[word] = total.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = map_batches(docs.select("text").filter("text is not null"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], contained: float):
        self.labels = [label for label, _ in templates]
        spelt = [words(text.encode()) for _, text in templates]
        self.lengths = [len(x) for x in spelt]
        self.sets = [frozenset(x) for x in spelt]
        order = sorted(frozenset().union(*self.sets), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.words = [sorted(s, key=self.rank.__getitem__) for s in self.sets]
        self.needed = [int(np.ceil(contained * len(s) - 1e-9)) for s in self.sets]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.words):
            for i, w in enumerate(own[: len(own) - self.needed[t] + 1]):
                self.prefixes.setdefault(w, []).append((t, i))

    def candidates(self, found: list[bytes]) -> list[int]:
        """The templates that a block of these words may match, by the three filters."""
        held = sorted(self.rank.keys() & set(found), key=self.rank.__getitem__)
        left: set[int] = set()
        for j, w in enumerate(held):
            for t, i in self.prefixes.get(w, ()):
                if len(held) >= self.needed[t] and 1 + min(len(self.words[t]) - i - 1, len(held) - j - 1) >= self.needed[t] - i:
                    left.add(t)
        return sorted(left)

    def matches(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """Template, first word and containment of the best block of every template that has one."""
        out = []
        for t in self.candidates(found):
            own = self.sets[t]
            places = [i for i, w in enumerate(found) if w in own]
            held: dict[bytes, int] = {}
            best, where, end = 0, -1, 0
            for i in places:  # a block that begins elsewhere holds no more than the one from its first template word on
                while end < len(places) and places[end] < i + self.lengths[t]:
                    w = found[places[end]]
                    held[w] = held.get(w, 0) + 1
                    end += 1
                if len(held) > best:
                    best, where = len(held), i
                w = found[i]
                held[w] -= 1
                if not held[w]:
                    del held[w]
            if best >= self.needed[t]:
                out.append((t, where, best / len(own)))
        return out


def phrase_places(found: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """The words at which each phrase starts."""
    line = b" " + b" ".join(found) + b" "
    out = []
    for phrase in phrases:
        text, at, seen, count, places = b" " + b" ".join(phrase) + b" ", -1, 0, 0, []
        while (at := line.find(text, at + 1)) >= 0:
            count += line.count(b" ", seen, at)  # words before the place, counted on from the last one
            seen = at
            places.append(count)
        out.append(places)
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and matches (word, label, template, containment): the best block of each template."""
    frequency = document_frequencies(docs, frozenset(w for _, text in templates for w in words(text.encode())))
    index, spelt = TemplateIndex(templates, frequency, contained), [words(p.encode()) for p, _ in phrases]
    match = pa.struct([("word", pa.int64()), ("label", pa.string()), ("template", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("matches", pa.list_(match))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = words(text or b"")
                places = phrase_places(found, spelt)
                every = [p for own in places for p in own]
                matches = []
                if index.prefixes.keys() & set(found):
                    matches = [{"word": i, "label": index.labels[t], "template": templates[t][1], "containment": c} for t, i, c in index.matches(found)]
                rows.append((doc_id, len(found), len(every), min(every, default=None), max(every, default=None), sorted({phrases[i][1] for i, own in enumerate(places) if own}), matches))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)

    returned = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<word: long, label: string, template: string, containment: double>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, returned)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.col("matches.label")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


_SQL_WORDS = r"list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SQL_ROWS = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
OP4_SQL = f"""
WITH phrase(phrase, label) AS (VALUES {_SQL_ROWS(PHRASES)}),
template(label, template) AS (VALUES {_SQL_ROWS(TEMPLATES)}),
tokens AS (SELECT label, string_split(template, ' ') AS t FROM template),
kinds AS (SELECT label, len(t) AS m, list_distinct(t) AS t FROM tokens),
doc AS (SELECT doc_id, text, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
place AS (
  SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) + 1)) AS i FROM doc, phrase)
  WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY 1),
likely AS (SELECT doc_id, w, label, m, t FROM doc, kinds WHERE len(list_intersect(t, w)) >= ceil({CONTAINED} * len(t) - 1e-9)),
block AS (
  SELECT doc_id, label, len(t) AS n, len(list_intersect(t, w[i : i + m - 1])) AS shared
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely)),
hit AS (SELECT doc_id, label, shared / n AS containment FROM block WHERE shared >= ceil({CONTAINED} * n - 1e-9)),
both_kinds AS (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM hit),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM both_kinds GROUP BY 1),
best AS (SELECT doc_id, max(containment) AS c FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""
