"""Licences in files by a positional index of the rare words of licence texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epochlens.llm.common import WORD, row_key, texts
from epochlens.llm.native import literal_table
from epochlens.session import cut

# One by one, as a class of single characters is one look-up, while each of its ranges is compared by itself.
_SINGLES = "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum())
_SEPARATOR, _WORD_CHAR = f"[{_SINGLES}]", f"[^{_SINGLES}]"

#: The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A passage by which a licence is recognised, and phrases of it that must stand in the file."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Passages of public licences.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("licensed under cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("licensed under cc by sa 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("licensed under cc by nc 4 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
)
#: Common words of English that the index leaves out.
STOP_WORDS = frozenset("a an and any are as at by can for form forms in is it may not of or that the this to use with you".split())


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def index(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(word, template, place): postings of the templates' words but the stop words."""
    rows = [
        {"word": w, "template": t, "place": i} for t, x in enumerate(templates) for i, w in enumerate(_words(x.text)) if w not in STOP_WORDS
    ]
    return literal_table(spark, rows, "word: string, template: int, place: int")


def phrase_pattern(phrase: str) -> str:
    """Pattern of a phrase whose words stand one after another, A-Z in either case, whatever separates them."""
    return rf"(?<!{_WORD_CHAR})(?i:" + rf"{_SEPARATOR}++".join(_words(phrase)) + rf")(?!{_WORD_CHAR})"


def _count_words(text: Column) -> Column:
    """Words of a text, each replaced by one character together with what separates it from others."""
    marks = F.regexp_replace(text, f"{_SEPARATOR}*+{_WORD_CHAR}++{_SEPARATOR}*+", "x")
    return F.when(text.rlike(_WORD_CHAR), F.length(marks)).otherwise(0).cast("bigint")


def telling_words(phrases: Iterable[str]) -> list[str]:
    """A word of every phrase: a text without any of these holds none of the phrases. Long and shared words come first."""
    words = [set(_words(p)) for p in phrases]
    shared = Counter(w for ws in words for w in ws)
    return sorted({min(ws, key=lambda w: (-len(w), -shared[w], w), default="") for ws in words})


def phrase_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """_row, doc_id, n_words, n_base, first_word, last_word, base_labels, and `phrases`, the mandatory phrases that stand in the text.

    A text is split at a phrase; the words before the first piece's end and after the last piece's begin give the
    phrase's smallest and largest place.
    """
    mandatory = sorted({p for t in templates for p in t.phrases})
    df = docs.withColumn("n_words", _count_words(F.col("text")))
    # The only guard is a necessary one: each phrase has one of these words. They are sought as plain bytes.
    telling = telling_words([*mandatory, *(p for p, _ in BASE_PHRASES)])
    df = df.withColumn("_lower", F.lower("text"))
    df = df.withColumn("_text", F.when(reduce(or_, [F.contains("_lower", F.lit(w)) for w in telling]), F.col("text"))).drop("_lower")
    df = df.withColumns({f"_{label}": F.split("_text", phrase_pattern(phrase), -1) for phrase, label in BASE_PHRASES})
    base = [
        F.when(F.size(f"_{label}") > 1, F.struct(
            F.lit(label).alias("label"),
            (F.size(f"_{label}") - 1).cast("bigint").alias("n"),
            _count_words(F.get(f"_{label}", F.lit(0))).alias("first"),
            (F.col("n_words") - _count_words(F.element_at(f"_{label}", -1)) - len(_words(phrase))).alias("last"),
        ))
        for phrase, label in BASE_PHRASES
    ]
    df = df.withColumn("_base", F.array_compact(F.array(*base)))
    found = F.array_compact(F.array(*[F.when(F.col("_text").rlike(phrase_pattern(p)), F.lit(p)) for p in mandatory]))
    total = F.aggregate("_base", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    return df.select(
        "_row", "doc_id", "n_words", total.alias("n_base"), F.array_min("_base.first").alias("first_word"), F.array_max("_base.last").alias("last_word"),
        F.array_sort("_base.label").alias("base_labels"), F.coalesce(found, F.array().cast("array<string>")).alias("phrases"),
    )


def licence_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(_row, word, pos): where words of the index (column word; one row each) stand in each text; words count from 0."""
    pieces = F.split(F.lower("text"), f"{_SEPARATOR}+", -1)
    each = docs.withColumn("_pieces", pieces).select(
        "_row", F.when(F.get("_pieces", F.lit(0)) == "", 1).otherwise(0).alias("_lead"), F.posexplode("_pieces").alias("_pos", "word")
    )
    # As many rows as the templates have distinct words.
    return each.join(F.broadcast(words), "word").select("_row", "word", (F.col("_pos") - F.col("_lead")).alias("pos"))


def weights(postings: DataFrame, df: DataFrame, n_texts: int) -> DataFrame:
    """Postings with `idf`, and `full`, the weight of all words of their template.

    The inverse document frequency is smoothed, so that a word which every text holds still weighs 1.
    """
    counted = postings.join(df, "word", "left")
    idf = F.log((F.lit(n_texts) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    return counted.select("word", "template", "place", idf.alias("idf")).withColumn("full", F.sum("idf").over(Window.partitionBy("template")))


def rarest(weighed: DataFrame, least: float) -> DataFrame:
    """The rarest postings of each template that weigh more than 1 - `least` of it.

    A place where `least` of a template's weight is found lacks too little to lack all of these, so looking them up
    alone finds every such place.
    """
    before = Window.partitionBy("template").orderBy(F.desc("idf"), "place").rowsBetween(Window.unboundedPreceding, -1)
    lighter = F.coalesce(F.sum("idf").over(before), F.lit(0.0))
    return weighed.withColumn("_before", lighter).where(F.col("_before") <= (1.0 - least) * F.col("full") + 1e-6).drop("_before")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Licence words are those of the templates without stop words; their inverse document frequency counts the distinct
    texts of all documents. A posting (template, place) and a place in the file give a relative position. Each file
    looks up the rarest words of every template, which is enough to find every relative position at which words
    of at least `least` of the template's weight can stand; there all words of the template are weighed. A template
    so found counts if its mandatory phrases stand in the file. The score is the largest such share, or 0.5 where
    only base phrases stand.

    Null and empty texts have no words; repeated rows get a row each; ids may be null; an empty table gives no
    rows. Very long texts are read whole, and any number of licences may stand in one. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    source = texts(docs)
    source = source.withColumn("_row", row_key(source))
    found = cut(phrase_places(source, templates))
    postings = index(spark, templates)
    hits = cut(licence_words(source, postings.select("word").distinct()))
    df = hits.select("_row.text", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # As many rows as the templates have words.
    weighed = cut(weights(postings, df, found.select("_row.text").distinct().count()))
    at = F.col("pos") - F.col("place")
    candidates = hits.join(F.broadcast(rarest(weighed, least)), "word").select("_row", "template", at.alias("offset")).distinct()
    aligned = (
        hits.join(F.broadcast(weighed), "word").select("_row", "template", at.alias("offset"), "place", "idf", "full")
        .join(candidates, ["_row", "template", "offset"], "left_semi").distinct()
        .groupBy("_row", "template", "offset").agg(F.sum("idf").alias("weight"), F.first("full").alias("full"))
        .withColumn("share", F.least(F.lit(1.0), F.round(F.col("weight") / F.col("full"), 9)))
        .where(F.col("share") >= least)
    )
    demands = [{"template": i, "label": t.label, "needs": list(t.phrases)} for i, t in enumerate(templates)]
    needs = literal_table(spark, demands, "template: int, label: string, needs: array<string>")
    verified = (
        aligned.groupBy("_row", "template").agg(F.max("share").alias("share"))
        .join(F.broadcast(needs), "template").join(found.select("_row", "phrases").distinct(), "_row")
        .where(F.size(F.array_except("needs", "phrases")) == 0)
        .groupBy("_row").agg(F.collect_set("label").alias("matched"), F.max("share").alias("share"))
    )
    return found.join(verified, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("matched", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("share", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
