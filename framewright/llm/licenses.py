"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the places of the same k-grams in license
templates: pairs for phrases and notices, runs of ``LONG_GRAM`` words for whole license texts, whose
pairs would be too common to tell anything.  A match at text position i and template position j votes
for diagonal i - j.  A phrase stands where one diagonal has all its pairs.  For notices and license
texts, diagonals with a share of the k-grams are seeds; seeds within ``DRIFT`` of each other (words put
in or left out) merge, and the span they cover is verified: it must hold ``COVER`` of the template's
words in about its length.

The scan is one pass: a text's k-grams are thinned to those that may be in a template, and become rows
with a header row that carries the text's length; the join is to a table of as many rows as the
templates have words, and only matches and headers are shuffled, by row.  A diagonal holds a template
word once at most, so what a task gathers is bounded by the longest template.

Cases: null text has no words; texts without a match give a row with zero places and empty labels;
texts that are shorter than a template's k-gram can't hold it; repeated rows give a row each; null
doc_ids stay; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import letter_words, probe

DRIFT, SEED_SHARE, COVER = 3, 0.25, 0.8
#: Words of a k-gram of notices and phrases, and of texts of ``LONG`` words or more (see ``_with_grams``).
GRAM, LONG_GRAM, LONG = 2, 5, 40
#: Phrases that count wherever their words stand consecutively (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are matched as a whole, with small changes (fixed values).
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is dedicated to the public domain": "public-domain",
}
#: Whole license texts and headers (fixed values: the published texts, without their copyright lines).
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law.""",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """A template's words as the texts' words are made."""
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _zipped(a: Column, b: Column, shift: int) -> Column:
    """A hash of each number of ``a`` and the one ``shift`` places further on in ``b``, as far as ``b`` goes."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.slice(F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y)), F.lit(1), n)


def _with_grams(rows: DataFrame) -> DataFrame:
    """``two`` and ``five``: hashes of all pairs and runs of five of ``words``; each word is hashed once."""
    rows = rows.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two", _zipped(F.col("one"), F.col("one"), 1))
    rows = rows.withColumn("four", _zipped(F.col("two"), F.col("two"), 2))
    return rows.withColumn("five", _zipped(F.col("four"), F.col("one"), 4)).drop("one", "four")


def templates(spark, phrases: dict, notices: dict, texts: dict) -> DataFrame:
    """j, hash, template, k, grams, length, label and exact of every k-gram of the templates."""
    rows = []
    for exact, group in ((True, phrases), (False, notices), (False, {t: label for label, t in texts.items()})):
        for text, label in group.items():
            words = words_of(text)
            k = GRAM if exact or len(words) < LONG else LONG_GRAM
            if len(words) < k:
                raise ValueError(f"a template has {k} words at least: {text!r}")
            rows.append((words, len(rows), k, len(words) - k + 1, len(words), label, exact))
    known = spark.createDataFrame(rows, "words array<string>, template long, k int, grams int, length int, label string, exact boolean")
    grams = F.when(F.col("k") == GRAM, F.col("two")).otherwise(F.col("five"))
    return _with_grams(known).select(F.posexplode(grams).alias("j", "hash"), "template", "k", "grams", "length", "label", "exact")


def scan(docs: DataFrame, phrases: dict | None = None, notices: dict | None = None, texts: dict | None = None) -> DataFrame:
    """A row per text: doc_id, n_words and spans (label, exact, first and last word, cover, verified)."""
    table = templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, TEXTS if texts is None else texts)
    maybe = probe(table.select("hash").distinct(), "hash")
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", letter_words(F.col("text")).alias("words"))
    match = "struct<i:int,hash:bigint>"
    head = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("long").alias("hash")).cast(match)

    def grams(name: str) -> Column:
        """The k-grams of the text that may be in a template."""
        return F.array_compact(F.transform(name, lambda h, i: F.when(maybe(h), F.struct(i.alias("i"), h.alias("hash")).cast(match))))

    hashed = _with_grams(words.withColumn("n_words", F.size("words").cast("long")))
    each = hashed.select("row", "doc_id", "n_words", F.explode(F.concat(F.array(head), grams("two"), grams("five"))).alias("x")).select("row", "doc_id", "n_words", "x.*")
    known = F.broadcast(table)  # as many rows as the templates have words
    votes = each.join(known, "hash", "left").filter("i < 0 or template is not null")
    by = ("row", "doc_id", "n_words", "template", "label", "exact", "k", "grams", "length")
    place = F.when(F.col("template").isNotNull(), F.col("i") - F.col("j"))
    by_diagonal = votes.withColumn("diagonal", place).groupBy(*by, "diagonal").agg(F.collect_set("j").alias("hit"), F.min("i").alias("low"), F.max(F.col("i") + F.col("k")).alias("stop"))
    share = F.size("hit") / F.col("grams")
    seeds = by_diagonal.filter(F.col("template").isNull() | F.when(F.col("exact"), share == 1).otherwise(share >= SEED_SHARE))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = (F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT)).cast("int")
    parts = seeds.withColumn("part", F.sum(F.coalesce(fresh, F.lit(0))).over(order))
    merged = parts.groupBy(*by, "part").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min("low").alias("low"), F.max("stop").alias("stop"))
    held = F.size(F.array_distinct(F.flatten(F.transform("hit", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    cover = held / F.col("length")
    sound = (cover >= COVER) & (F.col("stop") - F.col("low") <= F.col("length") / F.lit(COVER) + DRIFT)
    span = F.when(F.col("template").isNotNull(), F.struct("label", "exact", F.col("low").cast("long").alias("first_word"), (F.col("stop") - 1).cast("long").alias("last_word"), cover.alias("cover"), sound.alias("verified")))
    return merged.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def license_summary(docs: DataFrame) -> DataFrame:
    """The scan as one row of places and labels per text."""
    found = scan(docs)
    base, good = F.filter("spans", lambda s: s["exact"]), F.filter("spans", lambda s: s["verified"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first_word"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(good).alias("labels"), score.alias("score"))
