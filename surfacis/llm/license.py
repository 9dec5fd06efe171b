"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let

#: Words are runs of letters and digits, and of anything beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of well-known license texts and of the notices that name one, by label, as words in lower case.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
]
#: Words to a gram for phrases and for passages; diagonals this near are one place; share of a passage's grams that makes a hit, and the number of grams up to which all of them have to be there.
SHORT, LONG, NEAR, ENOUGH, FEW = 2, 4, 3, 0.5, 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def grams(words: Column, k: int, only: list[int] | None = None) -> Column:
    """Hash of every rolling k-gram and its words, by position; the words of those grams only whose hash is in only, if that is given."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        own = F.slice(words, i, k)
        h = F.xxhash64(*[F.element_at(words, i + j) for j in range(k)])
        return F.struct(h.alias("h"), own.alias("own")) if only is None else let(h, lambda x: F.struct(x.alias("h"), F.when(x.isin(only), own).alias("own")))

    return F.transform(at, gram)


def templates(spark: SparkSession) -> DataFrame:
    """tpl, label, kind, n_grams and every gram's position, hash and words: a fixed table of a few hundred rows."""
    rows = [(label, "phrase", text) for text, label in PHRASES.items()] + [(label, "passage", text) for label, text in PASSAGES]
    values = ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(rows))
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(tpl, label, kind, body)").withColumn("w", words_of(F.col("body")))
    t = t.withColumn("g", F.when(F.col("kind") == "phrase", grams(F.col("w"), SHORT)).otherwise(grams(F.col("w"), LONG)))
    t = t.select("tpl", "label", "kind", F.size("g").alias("n_grams"), F.posexplode("g").alias("tpos", "gram"))
    return t.select("tpl", "label", "kind", "n_grams", "tpos", F.col("gram.h").alias("hash"), F.col("gram.own").alias("words"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All grams of a text are joined by hash to the template positions (a fixed small table), and the words of those that meet are
    compared. A match votes for its diagonal, the offset of text against template; a phrase stands where a diagonal has all its votes;
    neighbouring diagonals of a passage are merged, so that words put in or left out don't break it. A merged span is verified: its
    template positions have to follow each other in the text in their order, each counted once, and count as a hit if they are
    ENOUGH of the passage's grams (all, if it has FEW or less). score is the best share found (1 for phrases, 0 without a hit).
    Null or empty text has no words and empty label strings. Rows that repeat or share an id each give a row;
    other columns are dropped. An empty table gives an empty table. Rows are numbered by their place in the input, which has to be
    the same whenever a lost task runs again, as it is for files and staged tables.
    """
    t = templates(docs.sparkSession).withColumn("long", F.col("kind") == "passage")
    hashes = [r["hash"] for r in t.select("hash").distinct().collect()]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w")).withColumn("n_short", F.greatest(F.size("w") - (SHORT - 1), F.lit(0)))
    end = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("array<string>").alias("own")))  # a last element without a hash: every row passes on, with hits or without
    rows = rows.select("row", "id", "n_words", "n_short", F.posexplode(F.concat(grams(F.col("w"), SHORT, hashes), grams(F.col("w"), LONG, hashes), end)).alias("at", "g"))
    rows = rows.select("row", "id", "n_words", "n_short", "at", F.col("g.h").alias("h"), F.col("g.own").alias("own"))
    meets = (F.col("h") == F.col("hash")) & (F.col("long") == (F.col("at") >= F.col("n_short"))) & (F.col("own") == F.col("words"))
    hit = rows.join(F.broadcast(t), meets, "left").where("tpl IS NOT NULL OR h IS NULL")
    pos = F.when(F.col("long"), F.col("at") - F.col("n_short")).otherwise(F.col("at"))
    hit = hit.withColumn("pos", pos).withColumn("diagonal", pos - F.col("tpos"))
    votes = hit.groupBy("row", "id", "n_words", "tpl", "label", "long", "n_grams", "diagonal").agg(F.collect_set(F.struct("tpos", "pos")).alias("seen"))
    order = Window.partitionBy("row", "tpl").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("long"), NEAR).otherwise(0)
    votes = votes.withColumn("new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("place", F.sum("new").over(order))
    merged = votes.groupBy("row", "id", "n_words", "tpl", "label", "long", "n_grams", "place").agg(F.min("diagonal").alias("start"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("tpos"), F.lit(-1).alias("pos"))
    onward = lambda a, x: F.when((x["tpos"] > a["tpos"]) & (x["pos"] > a["pos"]), F.struct((a["n"] + 1).alias("n"), x["tpos"].alias("tpos"), x["pos"].alias("pos"))).otherwise(a)
    merged = merged.withColumn("n_seen", F.aggregate("seen", nothing, onward, lambda a: a["n"]))
    share = F.col("n_seen") / F.col("n_grams")
    base, more = ~F.col("long") & (share == 1), F.col("long") & (share >= F.when(F.col("n_grams") <= FEW, 1.0).otherwise(ENOUGH))
    out = merged.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | more, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | more, share)), F.lit(0.0)).alias("score"),
    )
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
