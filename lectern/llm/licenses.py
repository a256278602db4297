"""License scans by diagonal voting.

The hashes of all rolling word k-grams of every text are joined to the k-gram positions of the templates; each match votes
for its diagonal (text position - template position).  Votes are aggregated by document, template and diagonal, diagonals at
most GAP apart that follow each other are merged into one span, and a span is verified by the words that agree.  Templates
are a fixed table of a few hundred rows, so the join broadcasts it.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_hash, word_array

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening passages of public licence texts, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: Rolling grams: short templates use two words, all others four.
GRAMS, GAP, LEAST = (2, 4), 3, 0.7


def template_rows() -> list[tuple]:
    """tid, label, base (a phrase), size (words), t (position), gram: a fixed table of under a thousand rows."""
    rows = [(f"phrase:{p}", label, True, p.split()) for p, label in PHRASES.items()] + [(f"text:{label}", label, False, t.split()) for label, t in TEMPLATES.items()]
    values = []
    for tid, label, base, words in rows:
        k = max(g for g in GRAMS if g <= len(words))
        values += [(tid, label, base, len(words), i, words[i : i + k]) for i in range(len(words) - k + 1)]
    return values


def template_grams(spark: SparkSession) -> DataFrame:
    """The templates' grams with h, their hash."""
    values = template_rows()
    table = spark.createDataFrame(values, "tid string, label string, base boolean, size int, t int, gram array<string>")
    return table.withColumn("h", F.when(F.size("gram") == 2, F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1)))).otherwise(F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(4)))))


def _seeds(base: DataFrame) -> DataFrame:
    """doc_id, tx, p, x (words of the gram), h of all rolling grams.  Words are zipped with their followers and unfolded, so that
    hashes are computed inside generated code rather than in array lambdas."""
    after = [F.slice("w", k, F.col("n_words")).alias(f"x{k - 1}") for k in range(2, 5)]
    each = base.where("n_words > 0").select("doc_id", "tx", F.posexplode(F.arrays_zip(F.col("w").alias("x0"), *after)).alias("p", "x")).select("doc_id", "tx", "p", "x.*")
    two, four = F.xxhash64("x0", "x1"), F.xxhash64("x0", "x1", "x2", "x3")
    both = F.array(F.when(F.col("x1").isNotNull(), two), F.when(F.col("x3").isNotNull(), four))
    return each.select("doc_id", "tx", "p", "x0", "x1", "x2", "x3", F.explode(both).alias("h"))


def license_spans(docs: DataFrame) -> DataFrame:
    """One row for each (doc_id, tx): copies, n_words and spans array<struct<s, e, label, base, score>>.

    s and e are word positions, e exclusive; score is the share of the template's words in the span's matched grams.  Spans of
    templates are kept from a share of LEAST on.
    """
    base = docs.select("doc_id", text_hash().alias("tx"), word_array(F.col("text")).alias("w"))
    base = base.select("doc_id", "tx", "w", F.size("w").alias("n_words"))
    met = _seeds(base).join(F.broadcast(template_grams(docs.sparkSession)), "h")
    same = F.when(F.size("gram") == 2, F.col("gram") == F.array("x0", "x1")).otherwise(F.col("gram") == F.array("x0", "x1", "x2", "x3"))
    met = met.where(same)
    votes = met.select("doc_id", "tx", "tid", "label", "base", "size", (F.col("p") - F.col("t")).alias("d"), F.col("p").alias("s"), (F.col("p") + F.size("gram")).alias("e"))
    # equal rows of one key vote alike: their votes are one set
    diagonal = votes.groupBy("doc_id", "tx", "tid", "label", "base", "size", "d").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("at"))
    by_doc = Window.partitionBy("doc_id", "tx", "tid").orderBy("d")
    apart = F.coalesce((F.col("d") - F.lag("d").over(by_doc) > F.lit(GAP)) | F.col("base"), F.lit(True))
    merged = diagonal.withColumn("run", F.sum(apart.cast("int")).over(by_doc))
    spans = merged.groupBy("doc_id", "tx", "tid", "label", "base", "size", "run").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    grow = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    covered = F.aggregate("at", zero, grow, lambda a: a["n"])
    scored = spans.select("doc_id", "tx", F.struct(F.array_min("at.s").alias("s"), F.array_max("at.e").alias("e"), "label", "base", F.least(F.lit(1.0), covered / F.col("size")).alias("score")).alias("span"))
    good = scored.where(F.col("span.base") | (F.col("span.score") >= LEAST))
    none = base.select("doc_id", "tx", F.lit(None).cast(good.schema["span"].dataType).alias("span"), "n_words")
    rows = none.unionByName(good.withColumn("n_words", F.lit(None).cast("int")))
    return rows.groupBy("doc_id", "tx").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_list("span")).alias("spans"))


def license_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs (doc_id, text).

    Null and empty texts have no words; repeated rows each give their row; an empty table gives none; other columns are not
    read.  score is the best span's share of its template (0 without spans).
    """
    per = license_spans(docs)
    base = F.filter("spans", lambda x: x["base"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    per = per.select("doc_id", "copies", F.col("n_words").cast("long").alias("n_words"), base.alias("b"), "spans")
    out = per.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min("b.s").cast("long").alias("first_word"), F.array_max("b.s").cast("long").alias("last_word"),
        join(F.col("b.label")).alias("base_labels"), join(F.col("spans.label")).alias("labels"), F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"), "spans", "copies",
    )
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")
