"""License scans: exact set-similarity join of text blocks with license templates.

A block is a line of a text, the words around a line's end, or a paragraph
(lines up to one without words); so wrapped notices and whole licenses are
found however long their lines are. A line of more than 2 * ``REACH`` words
counts as a paragraph, and the windows of so many words in it, ``REACH``
apart, are blocks too. A template is the set of words of a
notice, or of a paragraph of a license; it is found in a block that holds at
least ``threshold`` of them. Paragraphs are tried with templates of
``LONG`` distinct words or more: a long paragraph holds the few words of a
short notice by chance. Words are ordered by how many texts have them in the
whole corpus, rarest first:

* prefix filter: of a template of n words of which m must be there, one of its
  n - m + 1 rarest has to be in the block;
* length filter: a block with fewer than m of the templates' words is out;
* positional filter: if the p-th word of the template is the a-th of the block,
  then no more than what follows in both can be common from there on.

What passes is verified on the full sets. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lowered, written
from .pii import running

#: Phrases that are searched as such, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public notices, and paragraphs of public licenses, whose words make a template.
TEMPLATES = (
    ("agpl-name", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-name", "gnu lesser general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-warranty", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache-2.0-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense-text", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
)
#: Distinct words from which on a template is looked for in paragraphs.
LONG = 12
#: What stands between paragraphs: a line's end, no words, a line's end.
BREAK = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
#: So many words before and after a line's end make a block; so do twice as many within a longer line.
REACH = 32
THRESHOLD = 0.9


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def needed(n: int, threshold: float) -> int:
    """Words of a template of ``n`` that a block must have."""
    return max(1, next(m for m in range(n + 1) if m >= n * threshold - 1e-9))


def _starts(w: Column, phrase: str) -> Column:
    """Positions, from 0, where the phrase's words stand one after the other in the array ``w``."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(w, i) == first
        for k, word in enumerate(rest, 1):
            found = found & (F.get(w, i + k) == word)
        return found

    return F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(here(i), F.lit(False)))


def ranked(docs: DataFrame, templates) -> list[str]:
    """The templates' words, those of the fewest texts first."""
    vocab = sorted({w for _, t in templates for w in t.split()})
    lexicon = F.array(*[F.lit(w) for w in vocab])
    # As many rows as the templates have words.
    counts = {r["word"]: r["count"] for r in docs.select(F.explode(F.array_intersect(words(lowered("text")), lexicon)).alias("word")).groupBy("word").count().collect()}
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def prefixes(templates, threshold: float, order: list[str]) -> list[tuple]:
    """(word, place, label, n, m, template): a row for each word of which a block must have one; words are numbers in ``order``."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, text in templates:
        t = sorted({rank[w] for w in text.split()})
        m = needed(len(t), threshold)
        rows += [(t[p], p, label, len(t), m, t) for p in range(len(t) - m + 1)]
    return rows


def found_templates(blocks: DataFrame, keys: list[str], rows: list[tuple], order: list[str]) -> DataFrame:
    """keys, label, share of the templates contained in blocks; ``blocks`` has keys, paragraph (a flag) and tokens, a block's distinct words of ``order``."""
    table = blocks.sparkSession.createDataFrame(rows, "word int, place int, label string, n int, m int, template array<int>")
    numbers = F.array(*[F.lit(w) for w in order])
    tokens = F.array_sort(F.transform("tokens", lambda w: (F.array_position(numbers, w) - 1).cast("int")))
    probe = blocks.select(*keys, "paragraph", tokens.alias("tokens")).select(*keys, "paragraph", "tokens", F.posexplode("tokens").alias("at", "word"))
    # The table of prefixes comes from the templates, a parameter: some hundreds of rows.
    near = probe.join(F.broadcast(table), "word").where(
        (F.size("tokens") >= F.col("m"))
        & (~F.col("paragraph") | (F.col("n") >= LONG))
        & (F.least(F.col("place"), F.col("at")) + F.least(F.col("n") - F.col("place"), F.size("tokens") - F.col("at")) >= F.col("m"))
    )
    common = F.size(F.array_intersect("tokens", "template"))
    return near.where(common >= F.col("m")).groupBy(*keys, "label").agg(F.max(common / F.col("n")).alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    Null and empty texts have no words and no labels. score is 1 where a
    phrase stands, else the largest share of a template found in a block, else
    0. Repeated rows each give a row; further columns are ignored.
    """
    order = ranked(docs, templates)
    table = prefixes(templates, threshold, order)
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    lexicon, first_words = literal(order), literal(sorted({order[r[0]] for r in table}))
    rows = docs.select("doc_id", lowered("text").alias("low"))
    rows = rows.select("doc_id", "low", F.filter(F.transform(F.split("low", "\n"), words), lambda x: F.size(x) > 0).alias("lines"))
    # No word holds a line's end: the lines' words are the text's.
    rows = rows.select("doc_id", "low", "lines", F.flatten("lines").alias("w"))
    lic = F.array_contains("w", "license")
    starts = [F.when(lic, _starts(F.col("w"), p)).otherwise(F.array().cast("array<int>")) for p, _ in PHRASES]
    # A text without a word of any prefix has no block with one.
    rows = rows.withColumn("maybe", F.arrays_overlap("w", first_words))
    ends = F.when(F.col("maybe"), running(F.transform("lines", lambda x: F.size(x)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("ends", ends).withColumn("paragraphs", F.when(F.col("maybe"), F.transform(F.split("low", BREAK), words)).otherwise(F.array().cast("array<array<string>>")))
    # Lines and paragraphs that have no word of a prefix go first; of the others the templates' words are kept.
    held = lambda x: F.arrays_overlap(x, first_words)
    block = lambda x, paragraph: F.struct(paragraph.alias("paragraph"), F.array_intersect(x, lexicon).alias("tokens"))
    windows = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / REACH).cast("int") - 2, F.lit(0))), lambda k: F.slice(x, k * REACH + 1, 2 * REACH))
    long = lambda x: F.size(x) > 2 * REACH
    short, whole = F.lit(False), F.lit(True)
    around = lambda e: F.slice("w", F.greatest(e - REACH, F.lit(0)) + 1, F.least(e, F.lit(REACH)) + REACH)
    crossing = F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), around)
    blocks = F.concat(
        F.transform(F.filter("lines", held), lambda x: block(x, long(x))),
        F.transform(F.filter(F.flatten(F.transform(F.filter("lines", lambda x: long(x) & held(x)), windows)), held), lambda x: block(x, short)),
        F.transform(F.filter(crossing, held), lambda x: block(x, short)),
        F.transform(F.filter("paragraphs", held), lambda x: block(x, whole)),
    )
    least = min(r[4] for r in table)
    rows = rows.select(
        "doc_id",
        F.xxhash64("low").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.flatten(F.array(*starts)).alias("places"),
        F.array(*[F.size(s) > 0 for s in starts]).alias("has"),
        F.when(F.col("maybe"), F.filter(blocks, lambda t: F.size(t["tokens"]) >= least)).alias("blocks"),
    )
    rows, _ = written(rows)  # without the texts: a small share of the input
    keys = ["doc_id", "text_hash"]
    # Labels follow from the text: rows that repeat an id and a text share them.
    cut = rows.where(F.size("blocks") > 0).select(*keys, F.explode("blocks").alias("b")).select(*keys, "b.*")
    labels = found_templates(cut, keys, table, order).groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("found"), F.max("share").alias("share"))
    named = F.filter(F.array(*[F.when(F.col("has")[k], F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    joined = rows.alias("r").join(labels.alias("l"), F.expr("r.doc_id <=> l.doc_id AND r.text_hash = l.text_hash"), "left")
    n = F.size("places")
    return joined.select(
        "r.doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array(named), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(named, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
