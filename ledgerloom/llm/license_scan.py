"""License scans by diagonal voting.

Every rolling k-gram of words, as a 64-bit hash, is joined by Spark to the positions of that gram in the templates, each template
with its own number. A hit votes for the diagonal "document position minus template position"; votes are counted per document,
template and diagonal with partial aggregation before the shuffle; neighbouring diagonals (insertions and deletions) merge into one
candidate span. A span is verified against its template: of the template's grams, those that stand in the span count, each once
however often it stands there, and have to be COVER of all; the span may not be longer than STRETCH templates. For the base phrases a place
counts only if all its grams vote for one and the same diagonal, that is if the words stand consecutively.

A bitmap of the templates' gram hashes is tested where grams are made, as a runtime filter of the join; it lets false
hits through and never drops a true one.

Defined cases: a null or empty text has no words, no places, null first and last word, empty labels and score 0; a very long text is
scanned whole; repeated rows are scanned row by row; a template of fewer words than a gram is one gram, one without words is no template;
a null doc_id is carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM, Words, column, gram_starts, grams, groups, texts_of
from .store import prepare

#: Base phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words and texts of well-known licenses and notices, and the labels this scan adds for them.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit-release",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    # The texts as a whole.
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit-full",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc-full",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd-full",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache-2.0-header",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""": "gpl-3.0-header",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""": "mpl-2.0-header",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
    2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
    3. This notice may not be removed or altered from any source distribution.""": "zlib-full",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
    In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""": "unlicense-full",
}
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Diagonals at most so far apart belong to one span; share of a template's grams that a span must hold; longest span in template lengths.
SLACK, COVER, STRETCH = 3, 0.6, 1.5
#: Template grams that are broadcast; more are joined by shuffle.
MAX_BROADCAST_GRAMS = 1 << 18
_FILTER_BITS = 18


def template_grams(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[int, int, int, str, bool, int, int, int]]:
    """(gram, position, template, label, whether a base phrase, words of a gram, grams and words of the template) rows."""
    rows = []
    for texts, most, base in ((phrases, PHRASE_GRAM, True), (notices, NOTICE_GRAM, False)):
        for text, label in texts.items():
            words = Words([text], ALNUM)
            n = len(words.starts)
            k = min(most, n)
            if n:
                found = grams(words.hashes(), gram_starts(words.bounds, k), k).view(np.int64)
                template = len({r[2] for r in rows})
                rows += [(int(g), i, template, label, base, k, len(found), n) for i, g in enumerate(found)]
    return rows


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = template_grams(phrases, notices)
    templates = spark.createDataFrame(rows, "gram long, at int, template int, label string, base boolean, k int, n_grams int, n_template int")
    sizes = sorted({r[5] for r in rows})
    if len(rows) <= MAX_BROADCAST_GRAMS:
        templates = F.broadcast(templates)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[np.array([r[0] for r in rows], np.int64) & (len(seen) - 1)] = True

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in groups(batches, "text"):
            words = Words(texts_of(batch, "text"), ALNUM)
            hashes, text_of = words.hashes(), words.text_of()
            docs_at, places, found = [np.arange(batch.num_rows)], [np.full(batch.num_rows, -1)], [np.zeros(batch.num_rows, np.int64)]
            for k in sizes:
                starts = gram_starts(words.bounds, k)
                made = grams(hashes, starts, k).view(np.int64)
                hit = seen[made & (len(seen) - 1)]
                docs_at.append(text_of[starts[hit]])
                places.append(starts[hit] - words.bounds[text_of[starts[hit]]])
                found.append(made[hit])
            at = np.concatenate(docs_at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + at, pa.int64()), column(batch, "doc_id").take(pa.array(at)), pa.array(np.diff(words.bounds)[at], pa.int64()), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(found), pa.int64())],
                ["row", "doc_id", "n_words", "place", "gram"],
            )
            row += batch.num_rows

    rolled = own.mapInArrow(roll, T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", own.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "place", "gram"))]))
    # A document's first row has place -1 and joins to nothing, so documents without hits stay.
    hits = rolled.join(templates, (rolled.gram == templates.gram) & (rolled.place >= 0), "left").drop("gram")
    per = ["row", "doc_id", "n_words", "template", "label", "base", "k", "n_grams", "n_template"]
    diagonals = hits.groupBy(*per, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK)
    clusters = diagonals.withColumn("cluster", F.sum(F.when(far, 1).otherwise(0)).over(order)).groupBy(*per, "cluster")
    # The sets hold positions of one template each, so they are bounded by its length.
    spans = clusters.agg(F.array_distinct(F.flatten(F.collect_set("ats"))).alias("ats"), F.min("low").alias("low"), F.max("high").alias("high"))
    end = F.col("high") + F.col("k")
    cover = F.size("ats") / F.col("n_grams")
    holds = F.when(F.col("base"), F.size("ats") == F.col("n_grams")).otherwise((cover >= COVER) & (end - F.col("low") <= STRETCH * F.col("n_template")))
    place = F.when(holds, F.struct(F.col("label"), F.col("low").alias("start"), end.alias("end"), cover.alias("cover")))
    base = F.col("base") & holds
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"), F.min(F.when(base, F.col("low"))).alias("first_word"), F.max(F.when(base, F.col("low"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(holds, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(place)).alias("spans"), F.coalesce(F.max(F.when(holds, cover)), F.lit(0.0)).alias("score"),
    ).drop("row")
