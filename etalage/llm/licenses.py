"""License scans in DataFrame operations: MinHash bands over text windows, then exact containment."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage.llm.common import written

SHINGLE = 5
CONTAINMENT = 0.8
#: Bands of one row each: windows as like a template as LIKENESS meet it in one of
#: BANDS with the probability that collision_probability() gives.
BANDS = 10
LIKENESS = 0.5
#: Window lengths in shingles; a template uses the one nearest to its own length.
SCALES = (1, 2, 4, 8, 16, 32, 64)

#: Notices that texts carry, by licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def collision_probability(likeness: float, bands: int = BANDS) -> float:
    """That two windows of this Jaccard similarity share at least one band."""
    return 1 - (1 - likeness) ** bands


def _words(text: Column) -> Column:
    """Letter and digit runs, A-Z lowered."""
    parts = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(hashes: Column, words: int) -> Column:
    """One 64-bit hash for each run of ``words`` words, in text order."""
    count = F.size(hashes) - words + 1
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(words))))


def _hashed(df: DataFrame, text: str, words: int) -> DataFrame:
    """``df`` with shingles, each step behind the one before so that none is computed twice."""
    df = df.withColumn("_hashes", F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))
    return df.withColumn("shingles", F.explode(F.array(_shingles(F.col("_hashes"), words)))).drop("_hashes")


def _nearest_scale(size: Column) -> Column:
    """The scale with the least ratio to a length."""
    scale = F.lit(SCALES[-1])
    for low, high in reversed(list(zip(SCALES, SCALES[1:], strict=False))):
        scale = F.when(size * size <= low * high, low).otherwise(scale)
    return scale


def _listed(spark: SparkSession, notices, words: int) -> DataFrame:
    """(template, license, notice) of the notices that have a shingle."""
    rows = [(k, name, text) for k, (name, text) in enumerate(notices) if len(re.findall(r"[^\W_]+", text)) >= words]
    values = [F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("notice")) for k, name, text in rows]
    listed = F.array(*values).cast("array<struct<template:int,license:string,notice:string>>")  # the type of an empty list, too
    return spark.range(1).select(F.explode(listed).alias("t")).select("t.*")


def _telling_words(notices: DataFrame, words: int, shingles: list[int]) -> list[str]:
    """Words of which every text with one of the notices' given shingles holds one.

    For each shingle its longest word of plain letters and digits; a word that holds
    another one is not needed.  None at all when a shingle has no such word.
    """
    placed = _hashed(notices, "notice", words).select(_words(F.col("notice")).alias("w"), F.posexplode("shingles").alias("at", "shingle"))
    plain = F.filter(F.slice("w", F.col("at") + 1, words), lambda w: w.rlike("^[a-z0-9]+$"))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    found = {r.word for r in placed.where(F.col("shingle").isin(shingles)).select(longest.alias("word")).distinct().collect()}
    if None in found:
        return []
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def templates(spark: SparkSession, notices=NOTICES, words: int = SHINGLE) -> DataFrame:
    """(template, license, shingles, scale): one row per notice, a list fixed by its caller."""
    hashed = _hashed(_listed(spark, notices, words), "notice", words).withColumn("shingles", F.array_distinct("shingles"))
    return hashed.select("template", "license", "shingles", _nearest_scale(F.size("shingles")).alias("scale"))


def _starts(scale: int) -> Column:
    """(scale, start) of windows of ``scale`` shingles, three quarters of each shared with the next."""
    last = F.greatest(F.lit(0), F.size("shingles") - scale)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(max(1, scale // 4))), F.array(last)))
    return F.transform(starts, lambda x: F.struct(F.lit(scale).alias("scale"), x.alias("start")))


def _band(window: Column, band: int) -> Column:
    return F.array_min(F.transform(window, lambda s: F.xxhash64(s, F.lit(band))))


def license_scan(docs: DataFrame, notices=NOTICES, words: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """One row per document and notice found: doc_id, template, license, n_shared, n_shingles, containment, first_word.

    A notice is found when at least ``containment`` of its distinct shingles are in
    the document; ``first_word`` is the first word of the first window that met it.
    Whole texts are read.  A text without notices, a null, an empty one or one of
    fewer words than a shingle gives no row; null ids are kept; a repeated row gives
    its own rows again; other columns are ignored; an empty table gives no rows.

    A window meets a template in a band when the least shingle hash of both is the
    same, which is then the hash of one of the template's own least shingles: texts
    with none of those can meet no template, and are left out before windows are cut.
    Texts without even a word of those shingles are left out before they are hashed.
    """
    spark = docs.sparkSession
    keys = written(templates(spark, notices, words), "notices")
    parts = keys.select("template", "scale", "shingles", F.explode(_template_windows(bands)).alias("w"))
    parts = written(parts.select("template", "scale", "w.band", "w.value", "w.source"), "bands")
    # the notices are a list fixed by the caller, so their hashes may be written into the plan
    own = parts.select("scale", "source").distinct().collect()
    if not own:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_found_columns()).limit(0)
    least = sorted({r.source for r in own})
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if telling := _telling_words(_listed(spark, notices, words), words, least):
        lowered = base.withColumn("lowered", F.explode(F.array(F.lower("text"))))  # lowered once, searched often
        base = lowered.where(reduce(or_, [F.contains(F.col("lowered"), F.lit(w)) for w in telling])).drop("lowered")
    base = base.withColumn("row", F.monotonically_increasing_id())
    hit = F.arrays_overlap("shingles", F.array(*(F.lit(x) for x in least)))
    held = _hashed(base, "text", words).drop("text").where(hit)
    cut = held.withColumn("at", F.explode(F.concat(*(_starts(scale) for scale in sorted({r.scale for r in own})))))
    cut = cut.withColumn("window", F.slice("shingles", F.col("at.start") + 1, F.col("at.scale")))
    each = F.array(*(F.struct(F.lit(b).alias("band"), _band(F.col("window"), b).alias("value")) for b in range(bands)))
    rows = cut.select("doc_id", "row", F.col("at.scale").alias("scale"), F.col("at.start").alias("start"), "shingles", F.explode(each).alias("b"))
    rows = rows.select("doc_id", "row", "scale", "start", "shingles", F.col("b.band").alias("band"), F.col("b.value").alias("value"))
    fixed = parts.select("template", "scale", "band", "value").distinct()
    found = rows.join(F.broadcast(fixed), ["scale", "band", "value"])
    whole = keys.select("template", "license", F.col("shingles").alias("own"))
    met = found.groupBy("row", "template").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("first_word"), F.first("shingles").alias("shingles"))
    shared = F.size(F.array_intersect("own", "shingles"))
    checked = met.join(F.broadcast(whole), "template").withColumn("n_shared", shared.cast("long")).withColumn("n_shingles", F.size("own").cast("long"))
    checked = checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)
    return checked.select("doc_id", "template", "license", "n_shared", "n_shingles", "containment", F.col("first_word").cast("long").alias("first_word"))


def _least(window: Column, band: int) -> Column:
    """The least hash of a window in a band, with the shingle it comes from."""
    return F.array_min(F.transform(window, lambda s: F.struct(F.xxhash64(s, F.lit(band)).alias("value"), s.alias("source"))))


def _found_columns() -> list[Column]:
    kinds = {"template": "int", "license": "string", "n_shared": "long", "n_shingles": "long", "containment": "double", "first_word": "long"}
    return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]


def _template_windows(bands: int) -> Column:
    """(band, value, source) of every window of a template's own length scale."""
    size, scale = F.size("shingles"), F.col("scale")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), size - scale))

    def at(start: Column) -> Column:
        window = F.slice("shingles", start + 1, scale)
        lows = [(band, _least(window, band)) for band in range(bands)]
        return F.array(*(F.struct(F.lit(band).alias("band"), low["value"].alias("value"), low["source"].alias("source")) for band, low in lows))

    return F.flatten(F.transform(starts, at))
