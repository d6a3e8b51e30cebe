r"""Operator 2: license scans by a positional rare-token index, in DataFrame operations only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. One pass over the texts writes a narrow table: for
each row its number of words and the places of its licence words (the words of any template). Inverse document frequencies of all
licence words are counted from that table, over the whole corpus, and so is everything that follows:

* Each file's licence words are ranked by IDF. Its ``RAREST`` highest are looked up, and of each template that the file could hold (all
  words of the mandatory phrase occur in it) the rarest mandatory word as well, so that no template is missed.
* The postings of the looked-up words are intersected by relative position: a word at p that a template has at t stands for the
  template's start at p - t, and a start is a candidate if all looked-up words of its mandatory phrase stand for it.
* At a candidate the mandatory phrase is verified word by word. The score of a place is the share of the template's words that stand
  where they belong.

Templates are full license texts and notices of any length; base phrases are templates whose phrase is mandatory as a whole.

Null and empty texts have no words and no labels; first_word and last_word are null where no base phrase stands. Equal rows
are kept and get equal results. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.llm.shared import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words of a text in lower case, as a class that Java matches faster.
_LOWER_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The only letter beyond ASCII that becomes an ASCII letter in lower case, the Kelvin sign, and a letter that does not.
_KELVIN, _OTHER = "\u212a", "\u0138"
#: A file's highest-IDF licence words that are looked up whatever they belong to.
RAREST = 8

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Label, text, mandatory key phrase.
TEMPLATES = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "granted free of charge to any person obtaining a copy"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "with or without fee is hereby granted"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", "nor the names of its contributors may be used to endorse or promote products"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", "including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""", "to any person or organization obtaining a copy of the software"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered software released into the public domain"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache license version 2 0"),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at""", "except in compliance with the license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-notice", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "the gnu general public license as published by the free software foundation"),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
]


class Template:
    """A word sequence and the place of its mandatory phrase."""

    def __init__(self, number: int, label: str, text: str, key: str, base: bool) -> None:
        self.number, self.label, self.base = number, label, base
        self.words, self.key = (re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in (text, key))
        self.key_at = next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)

    def mandatory(self, at: int) -> bool:
        return self.key_at <= at < self.key_at + len(self.key)


def templates(texts: list[tuple[str, str, str]] | None = None) -> list[Template]:
    """The base phrases and the given (label, text, mandatory phrase)."""
    rows = [(label, phrase, phrase, True) for phrase, label in BASE.items()] + [(*t, False) for t in (TEMPLATES if texts is None else texts)]
    return [Template(k, *r) for k, r in enumerate(rows)]


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def licence_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(row, doc_id, n_words, hits) for each row of ``docs``; hits are the words of the vocabulary and their places.

    ``lower`` changes letters beyond A-Z too, but no word's bounds, and with the Kelvin sign out of the way no word becomes one of ASCII letters.
    """
    text = F.coalesce("text", F.lit(""))
    lower = F.lower(F.when(F.contains(text, F.lit(_KELVIN)), F.replace(text, F.lit(_KELVIN), F.lit(_OTHER))).otherwise(text))
    rows = docs.select("doc_id", F.regexp_extract_all(lower, F.lit(_LOWER_WORD), F.lit(0)).alias("words"))
    hits = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.cast("long").alias("pos"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(hits).alias("hits"))


def frequencies(hits: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each vocabulary word over all rows; as many rows come to the driver as the vocabulary has words."""
    met = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.word))).alias("word"))
    seen = {r.word: r.n for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = hits.count()
    return {w: log((1 + total) / (1 + seen.get(w, 0))) for w in vocabulary}


def candidates(hits: DataFrame, found: list[Template], idf: dict[str, float], postings: DataFrame) -> DataFrame:
    """(row, template, start): places where all looked-up words of a mandatory phrase stand."""
    ranked = F.split(F.lit(" ".join(sorted(idf, key=lambda w: (-idf[w], w)))), " ")
    keys = F.from_json(F.lit(json.dumps([{"template": t.number, "words": t.key} for t in found])), "array<struct<template:int,words:array<string>>>")
    own = F.array_intersect(ranked, F.transform("hits", lambda h: h.word))  # the file's licence words, the rarest first
    must = sorted({max(t.key, key=lambda w: (idf[w], w)) for t in found})  # a file with a template has its rarest mandatory word
    rows = hits.where(F.exists("hits", lambda h: h.word.isin(must))).select("row", "hits", own.alias("own"))
    rows = rows.withColumn("possible", F.filter(keys, lambda t: F.size(F.array_except(t.words, F.col("own"))) == 0)).where(F.size("possible") > 0)
    rarest = F.transform("possible", lambda t: F.array_intersect("own", t.words)[0])
    rows = rows.withColumn("asked", F.array_union(F.slice("own", 1, RAREST), rarest))
    each = rows.select("row", "hits", "asked", F.inline("possible"))
    asked = F.array_intersect("asked", "words")
    needed = F.size(F.filter("words", lambda w: F.array_contains("asked", w)))
    each = each.select("row", "template", needed.alias("needed"), F.filter("hits", lambda h: F.array_contains(asked, h.word)).alias("hits"))
    votes = each.select("row", "template", "needed", F.inline("hits")).join(F.broadcast(postings.where("mandatory")), ["template", "word"])
    starts = votes.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    return starts.where("n = needed").select("row", "template", "start")


def places(hits: DataFrame, found: list[Template], idf: dict[str, float]) -> DataFrame:
    """(row, template, start, matched, label, base, n): each verified place of a template."""
    spark = hits.sparkSession
    postings = _table(spark, [{"template": t.number, "at": i, "word": w, "mandatory": t.mandatory(i)} for t in found for i, w in enumerate(t.words)], "template:int,at:long,word:string,mandatory:boolean")
    facts = _table(spark, [{"template": t.number, "label": t.label, "base": t.base, "n": len(t.words), "n_key": len(t.key)} for t in found], "template:int,label:string,base:boolean,n:long,n_key:long")
    starts = written(candidates(hits, found, idf, postings), "license-candidates")
    wanted = starts.join(F.broadcast(postings), "template").select("row", "template", "start", "mandatory", (F.col("start") + F.col("at")).alias("pos"), "word")
    near = hits.join(starts.select("row").distinct(), "row", "left_semi").select("row", F.inline("hits"))
    met = wanted.join(near, ["row", "pos", "word"]).groupBy("row", "template", "start").agg(F.count("*").alias("matched"), F.count_if("mandatory").alias("keyed"))
    return met.join(F.broadcast(facts), "template").where("keyed = n_key").select("row", "template", "start", "matched", "label", "base", "n")


def scan(docs: DataFrame, texts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    score is the largest share of a template's words that stands at one place; 0 without labels. ``texts`` are templates
    (label, text, mandatory phrase) in place of ``TEMPLATES``.
    """
    found = templates(texts)
    vocabulary = sorted({w for t in found for w in t.words})
    hits = written(licence_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary), "license-words")
    base = F.col("base")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    by_row = places(hits, found, frequencies(hits, vocabulary)).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max(F.col("matched") / F.col("n")).alias("score"),
    )
    out = hits.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
