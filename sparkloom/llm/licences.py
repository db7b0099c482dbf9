"""Licence scans by a positional index of rare words, in DataFrame functions only.

Templates are licence notices and whole short licences with a label and mandatory
key phrases.  In how many texts each of their words stands is counted over the
whole table; the words of highest inverse document frequency of each template are
the index: word -> (template, position).  All index words that a file has
are looked up, so a file of many notices loses none; each place gives, per posting, a
relative position (place in the file less place in the template).  Postings of
one template that agree on it, give or take a few words, support one placement.
A placement with enough support is accepted if every key phrase of its template
stands in the file.  Counts and index have a row for each template word at most,
whatever the data; they go to the driver and are broadcast.

Base phrases (cc by, general public license, all rights reserved) are counted in
every text by pattern on the raw text; word numbers are looked for only in texts
that have one.  Case is ASCII case: only A-Z are folded.

Edge cases: a null or empty text has no words, no labels and score 0; equal
texts get equal results; nulls and repeats in the key do not matter, since
results are joined back by a digest of the text; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle

# What a word is, on raw text, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLDED, CAPITALS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices (label, text, key phrases), as licences and their usual headers word them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted", "without restriction"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "version 2"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", ["mozilla public license"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain. CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License", ["creative commons attribution noncommercial"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["permission is hereby granted", "substantial portions of the software"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["redistributions of source code must retain"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ["with or without fee is hereby granted", "author disclaims all warranties"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented", ["the origin of this software must not be misrepresented"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["specific language governing permissions"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["distributed in the hope that it will be useful", "gnu general public license"]),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", ["strictly prohibited"]),
]
#: Index words of each template, slack of a relative position in words, and least share of index words in agreement.
RARE, SLACK, SUPPORT = 6, 3, 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def postings() -> list[tuple[str, int, int]]:
    """(word, template, position of its first place) of all template words."""
    out = []
    for n, (_, text, _) in enumerate(TEMPLATES):
        ws = words_of(text)
        out += [(w, n, i) for w, i in {w: i for i, w in reversed(list(enumerate(ws)))}.items()]
    return sorted(out, key=lambda p: (p[1], p[2]))


def index_rows(holders: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(word, template, position, index words of the template): the RARE words in the fewest texts, ties by place."""
    rows = []
    for n in range(len(TEMPLATES)):
        mine = sorted((p for p in postings() if p[1] == n), key=lambda p: (holders.get(p[0], 0), p[2]))[:RARE]
        rows += [(*p, len(mine)) for p in mine]
    return rows


def phrase_pattern(phrase: str) -> str:
    """Matches the phrase's words, consecutive, any ASCII case, as whole words."""
    words = "{0}+".format(GAP).join(re.escape(w) for w in phrase.split())
    return f"(?i)(?<!{WORD[:-1]}){words}(?!{WORD[:-1]})"


def _starts(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase stands."""
    parts = phrase.split()
    here = lambda w, i: F.struct(i.cast("long").alias("at"), (F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts))).alias("ok"))
    first = F.transform(words, lambda w, i: F.when(w == parts[0], here(w, i)))
    return F.transform(F.filter(first, lambda x: x.isNotNull() & x["ok"]), lambda x: x["at"])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    phrases = list(BASE)
    # Nearly every text needs its words only to be counted: plain substring tests go before all patterns.
    low = F.lower(t)
    lookup = lambda marks: functools.reduce(operator.or_, [low.contains(m) for m in marks])
    has_base = lookup(["cc", "general", "reserved"]) & functools.reduce(operator.or_, [t.rlike(phrase_pattern(p)) for p in phrases])
    maybe = lookup(sorted({max((w for k in ks for w in k.split()), key=len) for *_, ks in TEMPLATES}))
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.translate(t, CAPITALS, CAPITALS.lower()), F.lit(FOLDED), F.lit(0))
    one = df.select(F.col(key).alias("doc_id"), has_base.alias("has_base"), maybe.alias("maybe"), t.alias("t"), words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    for n, p in enumerate(phrases):
        one = one.withColumn(f"at{n}", F.when(F.col("has_base"), _starts(F.col("words"), p)).otherwise(F.array().cast("array<bigint>")))
    keys = sorted({k for *_, ks in TEMPLATES for k in ks})
    inside = F.array_compact(F.array(*[F.when(F.col("t").rlike(phrase_pattern(k)), F.lit(i)) for i, k in enumerate(keys)]))
    vocabulary = F.array(*[F.lit(w) for w in sorted({p[0] for p in postings()})])
    one = one.withColumn("present", F.array_intersect(vocabulary, F.col("words"))).withColumn("keys", F.when(F.col("maybe"), inside).otherwise(F.array().cast("array<int>")))
    some = F.size("keys") > 0
    one = one.withColumn("digest", F.when(some, F.sha2("t", 256))).withColumn("words", F.when(some, F.col("words")).otherwise(none)).drop("t", "has_base", "maybe")
    one = settle(one, df.count(), wide=True)
    holders = {r[0]: r[1] for r in one.select(F.explode("present").alias("word")).groupBy("word").count().collect()}  # words of templates only
    best = _placements(spark, one, index_rows(holders), holders, keys)
    starts = F.concat(*[F.col(f"at{n}") for n in range(len(phrases))])
    based = F.array_compact(F.array(*[F.when(F.size(f"at{n}") > 0, F.lit(BASE[p])) for n, p in enumerate(phrases)]))
    # A row without a digest has no partner; its own key spreads such rows over the tasks.
    spread = one.drop("words", "present").withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.col("doc_id").cast("string"))))
    joined = spread.join(best, "digest", "left").withColumn("starts", starts).withColumn("based", based)
    labels = F.array_sort(F.array_distinct(F.concat("based", F.coalesce("found", none))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(F.array_sort("based"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.when(F.size("based") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def _placements(spark: SparkSession, one: DataFrame, rows: list, holders: dict[str, int], keys: list[str]) -> DataFrame:
    """(digest, found, score): accepted templates' labels and the best share of index words in agreement."""
    index = spark.createDataFrame(rows, "word string, template int, position int, of int")
    needs = [(n, label, [keys.index(k) for k in ks]) for n, (label, _, ks) in enumerate(TEMPLATES)]
    need = spark.createDataFrame(needs, "template int, label string, need array<int>")
    texts = one.where("digest is not null").select("digest", "words", "keys").dropDuplicates(["digest"])
    ranked = sorted({r[0] for r in rows}, key=lambda w: (holders.get(w, 0), w))  # highest inverse document frequency first
    # All of a file's index words are looked up: they are the rarest of each template, so as many as there are templates times RARE at most.
    texts = texts.withColumn("mine", F.array_intersect(F.array(*map(F.lit, ranked)), F.col("words")))
    seen = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("mine", x["word"]))
    hits = texts.select("digest", "keys", F.explode(seen).alias("s")).select("digest", "keys", "s.*").join(F.broadcast(index), "word")
    # A placement counts in its own band of relative positions and the next, so near ones meet in at least one.
    band = F.explode(F.array(F.floor((F.col("at") - F.col("position")) / SLACK), F.floor((F.col("at") - F.col("position")) / SLACK) + 1))
    support = hits.withColumn("band", band).groupBy("digest", "template", "band").agg((F.size(F.collect_set("word")) / F.first("of")).alias("share"), F.first("keys").alias("keys"))
    good = support.where(F.col("share") >= SUPPORT).join(F.broadcast(need), "template").where(F.size(F.array_except("need", "keys")) == 0)
    return good.groupBy("digest").agg(F.collect_set("label").alias("found"), F.round(F.max("share"), 6).alias("score"))
