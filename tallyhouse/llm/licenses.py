"""Licence scan: exact set-similarity join with containment, in DataFrame
functions only.

Words are runs of letters, digits and non-ASCII after lower-casing A-Z. Two
things are looked for in every whole text:

* base phrases, at every place where their words stand consecutively;
* text blocks that hold at least ``containment`` of a licence template's distinct
  words. A block is any run of ``SPREAD`` times as many consecutive words as the
  template has, wherever its lines break (a shorter text is one block).

The second is a set-similarity join. Template words are put in one global order,
rarest in the corpus first. With ``need`` words to share, a matching block must
hold one of the template's first ``size - need + 1`` words (prefix filter): only
texts with such a word are kept as words at all, and only the neighbourhoods of
such words are looked at. A neighbourhood must have ``need`` template words
(length filter), and enough of them must come after the word that brought it in
in the global order (positional filter); what passes is verified block by block
on the whole sets. The filters only drop blocks that cannot match. Of templates
that meet in one place those held best name it.

Each text is normalised twice: once to count template words, once for all the
rest; what the second pass keeps is written to the shared folder. Templates and
phrases are parameters; their number bounds what is broadcast.

Defined cases: null text has no word; a text without words matches nothing;
repeated rows and ids each get their own labels; a text without a licence has
empty labels, null word places and score 0.0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: label: phrase, fixed values of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, text): short notices of common public licences.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released into the public domain under cc0 1 0 universal"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "this document is confidential and proprietary and may not be reproduced without written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # whole texts
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
     files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
     distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
     following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
     FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
     LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
     IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
     above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
     REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
     DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
     NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
     met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
     in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
     materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
     WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
     may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
     distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
     License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
     the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
     will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
     Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
     arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
     to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not
     claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
     original software. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
     distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
CONTAINMENT = 0.8
#: Words of a text that are handled as one row.
STRETCH = 2048
#: Words of a block for each word of its template.
SPREAD = 1.5
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    """The words of a template, as those of a text."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(BREAKS, " ", text)).split()


def spaced(text: Column) -> Column:
    """The words of a text with one space between them, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BREAKS, " "))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any(words) -> str:
    """Pattern for whole words or phrases in a spaced text; ASCII case folds."""
    return "(?i)(?<![^ ])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")(?![^ ])"


def _count_words(spaced_text: Column) -> Column:
    blanks = F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))
    return F.when(spaced_text == "", 0).otherwise(blanks + 1).cast("long")


def phrase_places(docs: DataFrame, spaced_col: str, phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_base, first_word, last_word and base_list."""
    phrases = PHRASES if phrases is None else phrases
    s, every = F.col(spaced_col), _any(phrases)
    # words before a place: the blanks before it
    head = F.regexp_extract(s, f"(?s)^(.*?){every}", 1)
    tail = F.regexp_extract(s, f"(?s)^(.*){every}", 1)
    blanks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    found = s.rlike(every)
    # every place counts, those inside another one too
    places = lambda p: F.regexp_count(s, F.lit(f"(?i)(?<![^ ])(?={p}(?![^ ]))"))
    labels = [F.when(s.rlike(_any([p])), F.lit(label)) for p, label in phrases.items()]
    return docs.withColumns(
        {
            "n_base": F.when(found, sum((places(p) for p in phrases), F.lit(0))).otherwise(0).cast("long"),
            "first_word": F.when(found, blanks(head)),
            "last_word": F.when(found, blanks(tail)),
            "base_list": F.when(found, F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))).otherwise(F.array().cast("array<string>")),
        }
    )


def word_order(docs: DataFrame, spaced_col: str, vocabulary: set[str]) -> dict[str, int]:
    """Rank of each template word, rarest in the whole corpus first. One row
    for each template word reaches the driver."""
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "w string"))
    words = docs.select(F.explode(F.split(F.lower(F.col(spaced_col)), " ")).alias("w"))
    seen = {r[0]: r[1] for r in words.join(known, "w").groupBy("w").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}


class Templates:
    """Templates with their words in the global order, and their prefixes."""

    def __init__(self, templates, rank: dict[str, int], containment: float):
        self.rows, self.heads = [], []
        for n, (label, text) in enumerate(templates):
            words = template_words(text)
            own = sorted(set(words), key=rank.__getitem__)
            need = math.ceil(containment * len(own) - 1e-9)
            if own:
                self.rows.append((n, label, own, len(own), need, max(1, math.ceil(SPREAD * len(words)))))
                self.heads += [(w, n, i) for i, w in enumerate(own[: len(own) - need + 1])]

    def words(self) -> list[str]:
        return sorted({w for w, _, _ in self.heads})


def template_links(kept: DataFrame, key_cols: list[str], templates: Templates) -> DataFrame:
    """key columns, block (its first word), n_block, label, template, shared,
    containment: for every neighbourhood of a prefix word the best block at or
    above the threshold. ``kept`` has ``tokens``: the words of texts that hold a
    prefix word."""
    spark = kept.sparkSession
    # as large as the templates: rows for their prefixes, not for the corpus
    sets = F.broadcast(spark.createDataFrame(templates.rows, "template int, label string, own array<string>, size int, need int, width int"))
    heads = F.broadcast(spark.createDataFrame(templates.heads, "word string, template int, at int"))
    wanted = F.array(*[F.lit(w) for w in templates.words()])
    # stretches of a text, each with what a block can reach beyond it: a row of an anchor carries no more than that
    reach = max((r[5] for r in templates.rows), default=1)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(STRETCH)), lambda b: F.struct(b.alias("core"), F.greatest(b - reach, F.lit(0)).alias("base")))
    rows = kept.where("tokens is not null").select(*key_cols, F.explode(F.transform(cut, lambda c: F.struct(c["core"].alias("core"), c["base"].alias("base"), F.slice("tokens", c["base"] + 1, c["core"] - c["base"] + STRETCH + reach).alias("part")))).alias("s")).select(*key_cols, "s.*")
    places = F.transform(F.slice("part", F.col("core") - F.col("base") + 1, STRETCH), lambda w, i: F.struct(w.alias("word"), (F.col("core") + i).alias("pos")))
    rows = rows.select(*key_cols, "base", "part", F.explode(F.filter(places, lambda x: F.array_contains(wanted, x["word"]))).alias("a")).select(*key_cols, "base", "part", "a.word", "a.pos")
    rows = rows.join(heads, "word").join(sets, "template")
    begin = F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0))
    rows = rows.withColumn("begin", begin).withColumn("around", F.slice("part", F.col("begin") - F.col("base") + 1, F.col("pos") - F.col("begin") + F.col("width"))).drop("part")
    rows = rows.withColumn("present", F.array_intersect("own", "around")).where(F.size("present") >= F.col("need"))
    # the word that brought the block in is the rarest of those it holds
    rows = rows.where((F.col("word") == F.element_at("present", 1)) & (F.col("size") - F.col("at") >= F.col("need")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("around") - F.col("width"), F.lit(0)))
    tried = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect("own", F.slice("around", i + 1, F.col("width")))).alias("shared"), (-i).alias("back")))
    best = rows.withColumn("best", F.array_max(tried)).where("best.shared >= need")
    return best.select(
        *key_cols, (F.col("begin") - F.col("best.back")).alias("block"), F.least("width", F.size("around")).alias("n_block"), "label", "template", F.col("best.shared").alias("shared"),
        (F.col("best.shared") / F.col("size")).alias("containment"),
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row for each row of ``docs``: word count, base places and labels,
    all labels, and the best containment (1.0 with a base phrase)."""
    rows = docs.select(F.col(id_col).alias("_id"), spaced(F.col(text_col)).alias("_spaced"))
    vocabulary = {w for _, t in templates for w in template_words(t)}
    table = Templates(templates, word_order(rows, "_spaced", vocabulary), containment)
    heads = F.array(*[F.lit(w) for w in table.words()]).cast("array<string>")
    gate = F.arrays_overlap(F.split(F.lower(F.col("_spaced")), " "), heads)
    base = phrase_places(rows, "_spaced", phrases).withColumns({"n_words": _count_words(F.col("_spaced")), "tokens": F.when(gate, F.split(_lower(F.col("_spaced")), " "))})
    # a row's number keeps repeated rows apart; the written table fixes it
    base = stage(base.drop("_spaced").withColumn("_row", F.monotonically_increasing_id()), "licences")
    links = template_links(base.select("_row", "tokens"), ["_row"], table)
    place = lambda x: F.struct(x["containment"].alias("c"), x["block"].alias("b"), (x["block"] + x["n_block"]).alias("e"), x["label"].alias("l"))
    spots = links.groupBy("_row", "template", (F.col("block") / F.col("n_block")).cast("int").alias("_region")).agg(F.max_by(F.struct("containment", "block", "n_block", "label"), F.struct("containment", -F.col("block"))).alias("x"))
    spots = spots.groupBy("_row").agg(F.collect_list(place(F.col("x"))).alias("_all"))
    # where blocks of several templates meet, those held best name the place
    named = F.filter("_all", lambda x: ~F.exists("_all", lambda y: (y["c"] > x["c"]) & (y["b"] < x["e"]) & (x["b"] < y["e"])))
    best = spots.select(F.col("_row").alias("_r"), F.array_distinct(F.transform(named, lambda x: x["l"])).alias("_found"), F.array_max(F.transform("_all", lambda x: x["c"])).alias("_best"))
    joined = base.drop("tokens").join(best, F.col("_row") == F.col("_r"), "left")
    found = F.coalesce("_found", F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
