"""License scans by diagonal voting.

Every word position of a text makes rolling k-gram hashes, which Spark joins to a table of template positions. A match
of document place p and template place t votes for the diagonal p - t. Votes are summed by diagonal; a phrase stands
where its diagonal has all its votes. Notices, which may have words put in or left out, take neighbouring diagonals
together; the span is verified by its length and by the share of the notice's k-grams found in it. The k-grams behind
every vote are compared word for word, so equal hashes alone never count.

The templates are a list in the driver (the public notices below, or the caller's), so their table is bounded by it and is
broadcast. Texts are never shuffled, only votes. A notice counts from COVERAGE of it on, so one license's words can earn
labels of licenses that share most of a notice (of the GNU family for instance).

Defined results: null texts count as empty: no words, no places, empty labels, score 0; repeated rows are rows of their
own; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_az, materialize, row_keyed, stable

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label and words of each phrase (all of it must stand) ...
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: ... and of each notice or body (most of it must stand), from the public texts of those licenses.
NOTICES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)
K_PHRASE, K_NOTICE = 2, 5
#: Diagonals at most this far apart belong together; least share of a notice's k-grams; longest span, times the notice.
GAP, COVERAGE, STRETCH = 3, 0.6, 1.5


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, list[str]]]:
    """(number, label, base, k, words) of each template."""
    listed = [(label, True, K_PHRASE, text) for label, text in phrases] + [(label, False, K_NOTICE, text) for label, text in notices]
    return [(i, label, base, k, text.split()) for i, (label, base, k, text) in enumerate(listed)]


def template_grams(spark: SparkSession, k: int, found: list[tuple[int, str, bool, int, list[str]]]) -> DataFrame:
    """One row per distinct k-gram: its hash h{k} and hits{k}, the template places where it stands."""
    rows = [(i, label, base, len(w) - k + 1, len(w), t, w[t : t + k]) for i, label, base, k_, w in found if k_ == k for t in range(len(w) - k + 1)]
    table = spark.createDataFrame(rows, "tpl int, label string, base boolean, grams int, size int, at int, words array<string>")
    hit = F.struct("tpl", "label", "base", "grams", "size", "at", F.concat_ws(" ", "words").alias("gram"), F.lit(k).alias("k"))
    return table.withColumn(f"h{k}", F.xxhash64(*(F.col("words")[j] for j in range(k)))).groupBy(f"h{k}").agg(F.collect_list(hit).alias(f"hits{k}"))


def votes(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """row, doc_id, tpl, label, base, grams, size, diagonal, n, lo, hi; and a row with tpl -1 and hi = n_words for each document."""
    spark, found = docs.sparkSession, templates(phrases, notices)
    words = F.regexp_extract_all(lower_az(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    keyed = row_keyed(stable(docs.select("doc_id", "text")), "row").select("row", "doc_id", F.concat(words, F.array(F.lit(""))).alias("words"))
    gram = lambda k: F.xxhash64("w", *(F.get("words", F.col("p") + j) for j in range(1, k)))
    rolling = keyed.select("row", "doc_id", "words", F.posexplode_outer("words").alias("p", "w")).withColumns({f"h{K_PHRASE}": gram(K_PHRASE), f"h{K_NOTICE}": gram(K_NOTICE)})
    for k in (K_PHRASE, K_NOTICE):
        rolling = rolling.join(F.broadcast(template_grams(spark, k, found)), f"h{k}", "left")
    whole = F.struct(F.lit(-1).alias("tpl"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("grams"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit("").alias("gram"), F.lit(1).alias("k"))
    none = F.array().cast(rolling.schema[f"hits{K_PHRASE}"].dataType)
    hits = F.when(F.col("w") == "", F.array(whole)).otherwise(F.concat(F.coalesce(f"hits{K_PHRASE}", none), F.coalesce(f"hits{K_NOTICE}", none)))
    matched = rolling.where((F.col("w") == "") | F.col(f"hits{K_PHRASE}").isNotNull() | F.col(f"hits{K_NOTICE}").isNotNull()).select("row", "doc_id", "words", "p", F.explode(hits).alias("hit"))
    proven = matched.where(F.concat_ws(" ", F.slice("words", F.col("p") + 1, F.col("hit.k"))) == F.col("hit.gram"))
    diagonal = F.when(F.col("hit.tpl") >= 0, F.col("p") - F.col("hit.at")).otherwise(0)
    return (
        proven.select("row", "doc_id", "hit.tpl", "hit.label", "hit.base", "hit.grams", "hit.size", diagonal.alias("diagonal"), "p")
        .groupBy("row", "doc_id", "tpl", "label", "base", "grams", "size", "diagonal")
        .agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    )


def spans(found: DataFrame) -> DataFrame:
    """Verified places: row, doc_id, label, base, first (word), coverage. The whole-document rows stay, with label ''."""
    full = found.where("base and n = grams").select("row", "doc_id", "label", "base", F.col("diagonal").alias("first"), F.lit(1.0).alias("coverage"), F.lit(0).alias("n_words"))
    whole = found.where("tpl < 0").select("row", "doc_id", "label", "base", F.lit(0).alias("first"), F.lit(0.0).alias("coverage"), F.col("hi").alias("n_words"))
    order = Window.partitionBy("row", "tpl").orderBy("diagonal")
    apart = (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(GAP + 1)) > GAP).cast("int")
    run = F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        found.where("not base and tpl >= 0").withColumn("apart", apart).withColumn("run", run)
        .groupBy("row", "doc_id", "tpl", "label", "base", "grams", "size", "run")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("coverage", F.least(F.lit(1.0), F.col("n") / F.col("grams")))
        .where((F.col("coverage") >= COVERAGE) & (F.col("hi") + K_NOTICE - F.col("lo") <= F.col("size") * STRETCH))
    )
    notices = merged.select("row", "doc_id", "label", "base", F.col("lo").alias("first"), "coverage", F.lit(0).alias("n_words"))
    return full.unionByName(whole).unionByName(notices)


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(materialize(votes(docs, phrases, notices)))
    base, label = F.col("base"), F.when(F.col("label") != "", F.col("label"))
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            joined_labels(F.collect_set(F.when(base, label))).alias("base_labels"),
            joined_labels(F.collect_set(label)).alias("labels"),
            F.max("coverage").alias("score"),
        )
        .drop("row")
    )
