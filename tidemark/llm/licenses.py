"""License scan by diagonal voting.

Templates are cut into word k-grams; each hash points to (template, position). All rolling k-gram hashes of a document are joined to
that table. A hit votes for the diagonal "document position minus template position": a copied template gives one strong diagonal,
words put in or left out move it by a few. Votes are counted by (document, template, diagonal), diagonals with next to no votes go,
neighbouring ones are merged to spans, and a span is verified by the share of the template's k-grams it has and by its length. Whole
licences and headers have grams of five words; short notices have grams of two, as they have few.

The template table is fixed text of this module (or the caller's), so its size is known and it is broadcast. A task first drops
k-grams that no template has; only hits become rows. Hits of one document and template are grouped, never those of a template alone,
so a licence in a third of all documents makes no large group.

Defined results: a null text is an empty one, with no words; ids may be null or repeat, each row has a result; other columns are not
read; a phrase in the base set counts at each of its places, overlapping ones too; texts of any length are read whole; spans of several
templates may overlap and each gives its label, and the score is the largest share of one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common, textkit

#: Phrases whose every place counts.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that works carry, by label.
NOTICES = {
    "mit": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "creative-commons": "this work is licensed under a creative commons attribution license",
    "public-domain": "this work has been released into the public domain by its author",
}

#: Texts and headers of public licences, by label; names of holders and years stand outside.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
}

#: Templates as (label, text); a label may have several.
TEMPLATES = (*NOTICES.items(), *TEXTS.items())
#: Words of a gram, and of one of a template of fewer than ``SHORT_WORDS`` words.
K, SHORT_K, SHORT_WORDS = 5, 2, 24
#: Diagonals that far apart, at most, are merged; one with fewer votes than a ``LEAST`` part of the template's grams is chance.
NEAR, LEAST = 3, 64
#: Votes of an island that is chained, and words between islands of a chain as a share of the template's.
CHAINED, GAP = 3, 0.5
#: A verified span has this share of its template's grams, and this many times its length at most. A changed word costs as many grams as they are long.
SHARE, SHORT_SHARE, STRETCH = 0.5, 0.75, 1.5


def _hashes(phrases: list[str], k: int) -> list[np.ndarray]:
    words = textkit.split_words(pa.array(phrases, pa.large_string()), textkit.NOT_ALNUM)
    h, at = textkit.windows(words, words.hashes(lower=True), k)
    of = words.text_of_word()[at]
    return [h[of == i] for i in range(len(phrases))]


def scan_hits(docs: DataFrame, grams: dict[int, np.ndarray]) -> DataFrame:
    """(row, doc_id, n_words, hits): for each k, the places of k-grams that a template has. The row number tells equal ids apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = textkit.split_words(common.texts(batch), textkit.NOT_ALNUM)
            hashes, of = words.hashes(lower=True), words.text_of_word()
            doc, pos, size, value = [], [], [], []
            for k, wanted in grams.items():
                h, at = textkit.windows(words, hashes, k)
                at, h = at[hit := np.isin(h, wanted)], h[hit]
                doc.append(of[at])
                pos.append(at - words.first[of[at]])
                size.append(np.full(len(at), k, np.int32))
                value.append(textkit.signed(h))
            doc, pos, size, value = map(np.concatenate, (doc, pos, size, value))
            order = np.argsort(doc, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(pos[order]), pa.array(size[order]), pa.array(value[order])], names=["pos", "k", "hash"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), hits)], names=["row", "doc_id", "n_words", "hits"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "row long, doc_id long, n_words long, hits array<struct<pos:long,k:int,hash:long>>")


def _chained(islands: DataFrame, key: list[str]) -> DataFrame:
    """Islands of one copy in one row: each begins within ``GAP`` of the template's length behind the one before, and goes on in the template where that one ended.

    So words that are put in, or left out, cost their own grams alone. Only long templates are chained, and islands of a few votes, which a phrase that a
    template repeats makes, are chains of their own.
    """
    known = islands.withColumns({"first_at": F.array_min("ats"), "last_at": F.array_max("ats"), "strong": (F.col("votes") >= CHAINED) & (F.col("n_words_of") >= SHORT_WORDS)})
    along = Window.partitionBy("row", "template", "strong").orderBy("start", "end", "first_at")
    follows = F.col("strong") & (F.col("start") - F.lag("end").over(along) <= F.floor(F.col("n_words_of") * GAP)) & (F.col("first_at") > F.lag("last_at").over(along) - NEAR)
    chain = F.sum(F.when(follows, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("chain", chain).groupBy(*key, "strong", "chain").agg(F.collect_list(F.struct("start", "end", "votes", "ats")).alias("islands"))


def _verified(chains: DataFrame) -> DataFrame:
    """The chains that hold enough of their template in few enough words; of a chain that doesn't, the islands that do."""
    part = F.struct(
        F.array_min(F.transform("islands", lambda x: x["start"])).alias("start"),
        F.array_max(F.transform("islands", lambda x: x["end"])).alias("end"),
        F.aggregate("islands", F.lit(0).cast("long"), lambda n, x: n + x["votes"]).alias("votes"),
        F.array_distinct(F.flatten(F.transform("islands", lambda x: x["ats"]))).alias("ats"),
    )
    least = F.when(F.col("n_words_of") >= SHORT_WORDS, F.lit(SHARE)).otherwise(F.lit(SHORT_SHARE))
    holds = lambda x: (F.size(x["ats"]) / F.col("n_grams") >= least) & (x["end"] - x["start"] <= F.ceil(F.col("n_words_of") * STRETCH))
    whole = chains.withColumn("whole", part)
    found = whole.withColumn("span", F.explode(F.when(holds(F.col("whole")), F.array("whole")).otherwise(F.filter("islands", holds))))
    return found.select("row", "label", F.col("span.start").alias("start"), F.col("span.end").alias("end"), (F.size("span.ats") / F.col("n_grams")).alias("share"), F.col("span.votes").alias("votes"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Mapping[str, str] = BASE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): the digest of each row, and the verified spans behind it."""
    spark = docs.sparkSession
    table, wanted = [], {}
    for phrase, label in base.items():
        n = len(phrase.split())
        whole = _hashes([phrase], n)[0]
        wanted.setdefault(n, []).append(whole)
        table.append((n, int(textkit.signed(whole)[0]), -1, label, 0, 1, n))
    for i, (label, text) in enumerate(templates):
        n = int(textkit.split_words(pa.array([text], pa.large_string()), textkit.NOT_ALNUM).count[0])
        k = K if n >= SHORT_WORDS else min(SHORT_K, n)
        grams = _hashes([text], k)[0]
        wanted.setdefault(k, []).append(grams)
        table += [(k, int(h), i, label, at, len(grams), n) for at, h in enumerate(textkit.signed(grams))]
    places = spark.createDataFrame(table, "k int, hash long, template int, label string, at int, n_grams int, n_words_of int")
    scanned = common.materialize(scan_hits(docs, {n: np.concatenate(x) for n, x in wanted.items()}), "hits")
    hits = scanned.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    voted = hits.join(F.broadcast(places), ["k", "hash"]).withColumn("diagonal", F.col("pos") - F.col("at"))  # bounded: a row a template word

    found = voted.filter("template < 0").groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_list"))
    key = ["row", "template", "label", "k", "n_grams", "n_words_of"]
    # a diagonal has one run of places of the template, so (template, diagonal) is a place in the document
    diagonals = voted.filter("template >= 0").groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("ats"), F.min("pos").alias("start"), (F.max("pos") + F.col("k")).alias("end"))
    diagonals = diagonals.filter(F.col("votes") * LEAST >= F.col("n_grams"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    island = F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    merged = diagonals.withColumn("island", island).groupBy(*key, "island").agg(F.sum("votes").alias("votes"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = _verified(_chained(merged, key))

    extra = spans.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("extra_list"), F.max("share").alias("best"))
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("base_list", none), F.coalesce("extra_list", none))))
    documents = scanned.select("row", "doc_id", "n_words").join(found, "row", "left").join(extra, "row", "left")
    digest = documents.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_list", none), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    return digest, spans


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))[0]
