"""Licence scans by diagonal voting of word k-grams against templates."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowmend.llm import tables
from rowmend.llm.text import ALPHANUMERIC, LOWER, flat, hashes, mix, per_text, pieces, spans

# The longest k-grams that may vote, and the least agreement of a span with its template.
K = 3
LEAST_LIKENESS = 0.8
# Grams in a list of one text, and the most template grams that are broadcast (some 40 MB).
LIST_GRAMS, BROADCAST_GRAMS = 1 << 16, 1 << 20

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of well-known licences, (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
]


def _located(texts: pa.Array):
    data, offsets = flat(texts)
    low = LOWER[data]
    starts, ends, doc = spans(low, offsets, ALPHANUMERIC)
    return low, starts, ends, doc, hashes(low, starts, ends)


def words_of(text: str | None) -> list[str]:
    low, starts, ends, _, _ = _located(pa.array([text], pa.string()))
    raw = low.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def grams(word_hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every run of ``k`` words, rolled over the sequence; shorter sequences have none."""
    if len(word_hashes) < k:
        return np.empty(0, np.int64)
    out = np.zeros(len(word_hashes) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + word_hashes[j : len(word_hashes) - k + 1 + j]
    return mix(out).view(np.int64)


def hashes_of(words: list[str]) -> np.ndarray:
    return _located(pa.array([" ".join(words)]))[4]


@dataclass(frozen=True)
class Sought:
    """A template and what the least likeness leaves of it.

    A span that is like enough has at most ``extra`` words of its own and holds at least
    ``least`` of the template's ``k``-grams, on diagonals at most ``extra`` apart.
    """

    label: str
    words: list[str]
    k: int
    least: int
    extra: int


def sought(label: str, text: str, likeness: float = LEAST_LIKENESS) -> Sought:
    """The longest grams of which one at least is left by any edits that ``likeness`` allows.

    With d of n words dropped and e words added the agreement is 2(n - d) / (2n - d + e). A
    dropped word takes at most k grams with it, an added one parts at most k - 1; single
    words are always left. A template without words is refused.
    """
    words = words_of(text)
    n, least_ratio = len(words), Fraction(str(likeness))
    if not n:
        raise ValueError(f"template of {label} has no words")
    room = 2 * n * (1 - least_ratio)
    dropped = range(int(room / (2 - least_ratio)) + 1)
    edits = [(d, int((room - d * (2 - least_ratio)) / least_ratio)) for d in dropped]
    for k in range(min(K, n), 0, -1):
        least = n - k + 1 - max(k * d + (k - 1) * e for d, e in edits)
        if least > 0:
            break
    return Sought(label, words, k, least, edits[0][1])


def postings(listed: list[Sought]) -> list[tuple[int, int, int, int]]:
    """``(k, gram, template, at)`` for the grams of every template, of the length it uses."""
    return [
        (t.k, g, number, at) for number, t in enumerate(listed) for at, g in enumerate(grams(hashes_of(t.words), t.k).tolist())
    ]


def phrase_places(
    hashed: np.ndarray, doc: np.ndarray, bounds: np.ndarray, phrases: list[tuple[np.ndarray, str]],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """How often phrases stand in each text, at which word first and last, and their labels."""
    n = len(bounds) - 1
    at, owner, labels = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [set() for _ in range(n)]
    for wanted, label in phrases:
        m = len(wanted)
        if len(hashed) < m:
            continue
        hit = doc[: len(doc) - m + 1] == doc[m - 1 :]
        for j, h in enumerate(wanted):
            hit &= hashed[j : len(hashed) - m + 1 + j] == h
        found = np.flatnonzero(hit)
        at.append(found - bounds[doc[found]])
        owner.append(doc[found])
        for d in set(doc[found].tolist()):
            labels[d].add(label)
    at, owner = np.concatenate(at), np.concatenate(owner)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, owner, at)
    np.maximum.at(last, owner, at)
    return np.bincount(owner, minlength=n), first, last, labels


def gram_lists(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``(row, k, first, grams)``: all rolling k-grams of every text, in lists of at most
    ``LIST_GRAMS``; ``first`` is the word at which a list begins."""

    def work(batches):
        for batch in pieces(batches, "text"):
            _, _, _, doc, hashed = _located(batch.column("text"))
            words = np.diff(per_text(doc, batch.num_rows))
            for k in lengths:
                rolled = grams(hashed, k)[doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]]
                count = np.maximum(words - k + 1, 0)
                lists = -(-count // LIST_GRAMS)
                owner = np.repeat(np.arange(batch.num_rows), lists)
                first = (np.arange(len(owner)) - np.repeat(np.cumsum(lists) - lists, lists)) * LIST_GRAMS
                size = np.minimum(LIST_GRAMS, count[owner] - first)
                ends = np.concatenate(([0], np.cumsum(size)))
                yield pa.record_batch(
                    [batch.column("row").take(pa.array(owner)), pa.array(np.full(len(owner), k)), pa.array(first),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rolled))],
                    ["row", "k", "first", "grams"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(work, f"row {kind}, k bigint, first bigint, grams array<bigint>")


def candidate_spans(rows: DataFrame, listed: list[Sought]) -> DataFrame:
    """``(row, spans)``: runs of words, ``(template, begin, stop)``, that may hold a span like enough.

    Every k-gram is joined with the places of templates it stands at and votes for its place in
    the text less the one in the template, its diagonal. Diagonals as far apart as added words
    can move them are one; it is kept if it has the votes that the likeness guarantees, and
    reaches as far as the words of such a span can.
    """
    spark = rows.sparkSession
    places = postings(listed)
    posted = spark.createDataFrame(places, "k bigint, gram bigint, template int, at bigint")
    if len(places) <= BROADCAST_GRAMS:
        posted = F.broadcast(posted)
    limits = spark.createDataFrame(
        [(n, t.least, t.extra, len(t.words)) for n, t in enumerate(listed)], "template int, least int, extra int, size int"
    )
    each = gram_lists(rows, sorted({t.k for t in listed})).select("row", "k", "first", F.posexplode("grams").alias("place", "gram"))
    votes = each.join(posted, ["k", "gram"]).groupBy(
        "row", "template", (F.col("first") + F.col("place") - F.col("at")).alias("diagonal")
    ).agg(F.collect_set("at").alias("at"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("extra")
    merged = (
        votes.join(F.broadcast(limits), "template").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(along))
        .groupBy("row", "template", "run", "least", "extra", "size")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.flatten(F.collect_list("at")).alias("at"))
        .filter(F.size(F.array_distinct("at")) >= F.col("least"))
    )
    span = F.struct(
        "template", F.greatest(F.col("low") - F.col("extra"), F.lit(0)).alias("begin"),
        (F.col("high") + F.col("size") + F.col("extra")).alias("stop"),
    )
    return merged.groupBy("row").agg(F.collect_list(span).alias("spans"))


def best_agreement(words: list[bytes], places: dict[bytes, int], size: int, extra: int) -> float:
    """The best agreement of a span of ``words`` with a template of ``size`` words.

    Agreement is twice the matching words in order over the words of both. ``places`` has
    the template's places of each word as bits. A zero bit of ``open_`` is one more matching word
    (longest common subsequence by bits); a best span begins and ends with a match.
    """
    bits, full = [places.get(w, 0) for w in words], (1 << size) - 1
    inner = [i for i, b in enumerate(bits) if b]
    most, of = 0, 1
    for n, i in enumerate(inner):
        # What is left matches at most word by word.
        if 2 * min(size, len(inner) - n) * of <= most * (size + 1):
            break
        open_ = full
        for j in inner[n:]:
            if j - i >= size + extra:
                break
            both = open_ & bits[j]
            open_ = (open_ + both | open_ - both) & full
            match, words_of_both = 2 * (size - open_.bit_count()), j - i + 1 + size
            if match * of > most * words_of_both:
                most, of = match, words_of_both
    return most / of


def verified(rows: DataFrame, listed: list[Sought]) -> DataFrame:
    """``(row, found, best)`` from rows with ``text`` and ``spans``: labels of templates with a span
    that agrees enough, and the best agreement; rows without one are left out."""
    wanted = []
    for t in listed:
        places: dict[bytes, int] = {}
        for at, word in enumerate(t.words):
            places[word.encode()] = places.get(word.encode(), 0) | 1 << at
        wanted.append((t, places))

    def work(batches):
        for batch in pieces(batches, "text"):
            low, starts, ends, doc, _ = _located(batch.column("text"))
            bounds, raw = per_text(doc, batch.num_rows), low.tobytes()
            labels, best = [set() for _ in range(batch.num_rows)], np.zeros(batch.num_rows)
            for d, spans_of in enumerate(batch.column("spans").to_pylist()):
                for s in spans_of:
                    template, places = wanted[s["template"]]
                    a, b = bounds[d] + s["begin"], min(bounds[d] + s["stop"], bounds[d + 1])
                    words = [raw[i:j] for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    ratio = best_agreement(words, places, len(template.words), template.extra)
                    if ratio >= LEAST_LIKENESS:
                        labels[d].add(template.label)
                        best[d] = max(best[d], ratio)
            some = pa.array([bool(found) for found in labels])
            found = pa.array([sorted(found) for found in labels], pa.list_(pa.string()))
            yield pa.record_batch([batch.column("row"), found, pa.array(best)], ["row", "found", "best"]).filter(some)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(work, f"row {kind}, found array<string>, best double")


def phrases_in(rows: DataFrame) -> DataFrame:
    """``(row, id, n_words, n_base, first_word, last_word, base)`` of every row."""
    phrases = [(hashes_of(words_of(p)), label) for p, label in PHRASES.items()]

    def work(batches):
        for batch in pieces(batches, "text"):
            _, _, _, doc, hashed = _located(batch.column("text"))
            bounds = per_text(doc, batch.num_rows)
            count, first, last, base = phrase_places(hashed, doc, bounds, phrases)
            none = count == 0
            yield pa.record_batch(
                [batch.column("row"), batch.column("id"), pa.array(np.diff(bounds)), pa.array(count), pa.array(first, mask=none),
                 pa.array(last, mask=none), pa.array([sorted(b) for b in base], pa.list_(pa.string()))],
                ["row", "id", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("row", "id")]
    return rows.select("row", "id", "text").mapInArrow(
        work, f"row {kinds[0]}, id {kinds[1]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base array<string>"
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per input row.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Base
    labels come from phrases anywhere in the text, the others from spans whose words agree
    with a template's: every span that agrees enough counts. The score is the best
    agreement, 1 where a phrase stands. Only texts with a candidate span are shuffled. Null
    texts have no words, ids may be null or repeat, an empty table gives an empty result,
    other columns are not read.
    """
    spark = tables.ready(docs)
    rows = tables.numbered(docs, "scanned").select(
        "row", F.col(f"whole.`{id_col}`").alias("id"), F.coalesce(F.col(f"whole.`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    result = phrases_in(rows)
    added = spark.createDataFrame([], f"row {rows.schema['row'].dataType.simpleString()}, found array<string>, best double")
    if templates:
        listed = [sought(label, text) for label, text in templates]
        spans, path = tables.temporary(candidate_spans(rows, listed), "spans")
        key = F.xxhash64("row")
        likely = tables.only_possible(rows.select("row", "text"), key, spans, key, "__perhaps").filter("__perhaps")
        added = tables.written(verified(likely.join(spans, "row").select("row", "text", "spans"), listed), "licences")
        tables.release(spark, path)
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return result.join(added, "row", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
