"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices

K = 3
#: Diagonals of one template that lie this close are one occurrence with words put in or left out.
BAND = 3
#: Share of a template's k-grams that an occurrence must hold.
COVER = 0.6
#: Phrases: an occurrence has every word, in one run.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Well-known licence wording; an occurrence may differ in some words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher"),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class WordNumbers(dict):
    """Numbers of the templates' words, from 1; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _words(text: str) -> list[bytes]:
    """Runs of digits, letters a-z and non-ASCII characters, after A-Z are lower-cased."""
    return WORD.findall(text.encode().lower())


def _codes(numbers: WordNumbers, words: list[bytes]) -> np.ndarray:
    """Rolling k-gram hashes. They are exact: a word's number is a digit, so equal hashes are equal words."""
    n = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    size = len(numbers) + 1
    return (n[:-2] * size + n[1:-1]) * size + n[2:] if len(n) >= K else np.zeros(0, np.int64)


def _numbers(templates: list[tuple[str, str, bool]]) -> WordNumbers:
    return WordNumbers((w, i + 1) for i, w in enumerate(sorted({w for _, text, _ in templates for w in _words(text)})))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    Every rolling word 3-gram of every text is joined to the positions of the same 3-gram in the
    templates, whose number is fixed, so that side is broadcast. Matches vote for the diagonal ``text position -
    template position``. A phrase occurs where its diagonal has all its 3-grams. For longer wording, diagonals within BAND are merged and
    the span is verified: it must hold COVER of the template's 3-grams and be at most half as long
    again. The hashes have no collisions, so a voted 3-gram is an equal one.

    n_base counts the phrases' places, first_word and last_word are their smallest and largest start (null without any),
    base_labels and labels are distinct, sorted and comma-joined (empty without any). score is 1 for a
    phrase, else the best verified cover, else 0. Null and empty texts have no words; repeated rows are told apart
    and each give a row; other columns play no part; an empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    both = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    if any(len(_words(text)) < K for _, text, _ in both):
        raise ValueError(f"a template needs {K} words or more")
    numbers = _numbers(both)
    grams = [(t, label, base, len(_words(text)) - K + 1, i, int(c)) for t, (label, text, base) in enumerate(both) for i, c in enumerate(_codes(numbers, _words(text)))]
    positions = spark.createDataFrame(grams, "template int, label string, base boolean, grams int, at int, code long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                words = [_words(t) for t in texts]
                codes = [_codes(numbers, w) for w in words]
                offsets = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(texts))), batch.column("id").slice(start, len(texts)), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes)))],
                    names=["row", "id", "n_words", "codes"],
                )
                row += len(texts)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(hashed, f"row long, id {kind}, n_words long, codes array<long>")
    voted = (
        rows.select("row", "id", "n_words", F.posexplode_outer("codes").alias("pos", "code"))
        .join(F.broadcast(positions), "code", "left")
        .where("template is not null or coalesce(pos, 0) = 0")  # one row at least of each text
        .groupBy("row", "id", "n_words", "template", "label", "base", "grams", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count("template").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > BAND), 1).otherwise(0)
    merged = (
        voted.withColumn("new", near)
        .withColumn("run", F.sum("new").over(by_diagonal))
        .groupBy("row", "id", "n_words", "template", "label", "base", "grams", "run")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    phrase = F.col("base") & (F.col("votes") == F.col("grams"))
    wording = ~F.col("base") & (cover >= COVER) & (F.col("last") - F.col("first") + K <= 1.5 * (F.col("grams") + K - 1))
    found = merged.withColumn("phrase", phrase).withColumn("kept", phrase | wording)
    start = F.when(F.col("phrase"), F.col("first").cast("long"))
    return (
        found.groupBy("row", "id", "n_words")
        .agg(
            F.count_if("phrase").alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("kept"), cover)), F.lit(0.0)).alias("score"),
        )
        .select(F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
