"""License scan with DataFrame functions only: known phrases, and an exact set-similarity join with templates.

The blocks of a text are its lines and, for what line ends cross, all windows of as many consecutive
words as a template has. A template is a set of words. A block matches a template when it
holds at least ``threshold`` of the template's distinct words. Candidates come from the prefix
filter: order the templates' words by how many documents hold them, rarest first; a block that holds
``need = ceil(threshold * size)`` of ``size`` words must hold one of the first ``size - need + 1``.
A block with fewer than ``need`` distinct words is out by length; a block whose first prefix word is
at place ``p`` can hold ``size - p`` words at most, which the positional filter compares with
``need``. Only what is left is intersected in full, so the result is exact.

The templates are a table, carried as one array that every row meets: one expression over it, however
many there are. ``matches`` are the lines over the threshold, ``passages`` the windows.

Defined results: a null text is empty; ids and repeated rows are scanned row by row; an empty table
gives an empty result and every word the count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Templates = tuple[tuple[str, str], ...]
#: Phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Opening statements of public licenses and notices, with the labels they give.
TEMPLATES: Templates = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
)
THRESHOLD = 0.9
_SPLIT = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words) -> str:
    return "array(" + ", ".join(map(_quoted, words)) + ")" if words else "cast(array() as array<string>)"


def _lowered(docs: DataFrame, text: str) -> DataFrame:
    # lower() also maps the Kelvin sign to an ASCII k; another letter takes its place first, so that only A-Z give a-z.
    d = docs.withColumn("_low", F.expr(f"lower(replace(coalesce({text}, ''), 'K', 'ĸ'))"))
    return d.withColumn("_words", F.expr(f"array_remove(split(_low, '{_SPLIT}'), '')"))


def word_frequencies(docs: DataFrame, *, text: str = "text", templates: Templates = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates stands: counted over all documents, at most one row a template word."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    d = _lowered(docs.select(F.col(text).alias("_text")), "_text")
    found = d.select(F.explode(F.expr(f"array_intersect(_words, {_array(vocabulary)})")).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r[0]: r[1] for r in found}


def template_table(templates: Templates, frequencies: dict[str, int], threshold: float) -> str:
    """The templates as an array of structs: label, words (rarest first), need, prefix, n (words with repeats)."""
    rows = []
    for t, label in templates:
        words = sorted(set(t.split()), key=lambda w: (frequencies.get(w, 0), w))
        need = -int(-(threshold * len(words)) // 1)
        rows.append(f"struct({_quoted(label)} as label, {_array(words)} as words, {need} as need, {_array(words[: len(words) - need + 1])} as prefix, {len(t.split())} as n)")
    return "array(" + ", ".join(rows) + ")"


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, frequencies: dict[str, int] | None = None, templates: Templates = TEMPLATES) -> DataFrame:
    """``keep``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``matches`` and ``passages``.

    ``matches``: (label, line, overlap, size) for every line and template over the threshold.
    ``passages``: (label, word, overlap, size) for every window and template over it, whatever lines the window crosses.
    A projection: no row leaves its partition.
    """
    freq = frequencies if frequencies is not None else word_frequencies(docs, text=text, templates=templates)
    d = _lowered(docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text")), "_text")
    # Each word between two spaces of its own: phrases then never share a space and a split finds every place.
    d = d.withColumn("_n", F.expr("cast(size(_words) as bigint)")).withColumn("_line", F.expr("if(_n = 0, '', concat(' ', array_join(_words, '  '), ' '))"))
    parts, spaces = [], lambda x: f"cast((length({x}) - length(replace({x}, ' ', ''))) div 2 as bigint)"
    for k, (phrase, _) in enumerate(PHRASES):
        p = " " + "  ".join(phrase.split()) + " "
        d = d.withColumn(f"_p{k}", F.expr(f"if(contains(_line, '{p}'), split(_line, '{p}'), cast(null as array<string>))"))
        parts.append((f"_p{k}", len(phrase.split())))
    d = d.withColumn("n_base", F.expr(" + ".join(f"coalesce(cast(size({c}) - 1 as bigint), 0L)" for c, _ in parts)))
    d = d.withColumn("first_word", F.expr("least(" + ", ".join(spaces(f"{c}[0]") for c, _ in parts) + ")"))
    d = d.withColumn("last_word", F.expr("greatest(" + ", ".join(f"_n - {n} - " + spaces(f"element_at({c}, -1)") for c, n in parts) + ")"))
    base = ", ".join(f"if({c} is null, null, '{label}')" for (c, _), (_, label) in zip(parts, PHRASES, strict=True))
    d = d.withColumn("_base", F.expr(f"array_sort(array_distinct(array_compact(array({base}))))"))
    # The join with the templates: those of which the whole text holds enough words, then block by block.
    prefixes = sorted({w for t, _ in templates for w in t.split()})
    d = d.withColumn("_templates", F.expr(f"if(arrays_overlap(_words, {_array(prefixes)}), filter({template_table(templates, freq, threshold)}, t -> arrays_overlap(_words, t.prefix) and size(array_intersect(t.words, _words)) >= t.need), null)"))
    some = "_templates is not null and size(_templates) > 0"
    d = d.withColumn("_blocks", F.expr(f"if({some}, transform(split(_low, '\\n'), (l, i) -> struct(i as line, array_distinct(array_remove(split(l, '{_SPLIT}'), '')) as words)), null)"))
    # By length; by the place of the first prefix word that the block holds, from which on need words must be left; in full.
    left = "size(t.words) - array_position(t.words, array_intersect(t.prefix, b.words)[0]) + 1 >= t.need"
    fits = f"size(b.words) >= t.need and arrays_overlap(b.words, t.prefix) and {left} and size(array_intersect(b.words, t.words)) >= t.need"
    of = "t.label as label, {} as {}, {} as overlap, size(t.words) as size"
    lines = f"transform(filter(_blocks, b -> {fits}), b -> struct({of.format('b.line', 'line', 'size(array_intersect(b.words, t.words))')}))"
    # A window holds a prefix word, so it starts at most n - 1 words before one.
    starts = "array_distinct(flatten(transform(filter(transform(_words, (w, i) -> if(array_contains(t.prefix, w), i, -1)), i -> i >= 0), i -> sequence(greatest(i - t.n + 1, 0), i))))"
    windows = f"filter(transform({starts}, i -> struct({of.format('i', 'word', 'size(array_intersect(slice(_words, i + 1, t.n), t.words))')})), m -> m.overlap >= t.need)"
    for name, each, at in (("matches", lines, "line"), ("passages", windows, "word")):
        d = d.withColumn(name, F.expr(f"if({some}, flatten(transform(_templates, t -> {each})), cast(array() as array<struct<label: string, {at}: int, overlap: int, size: int>>))"))
    found = "concat(transform(matches, m -> m.label), transform(passages, m -> m.label))"
    d = d.withColumn("_labels", F.expr(f"if(spark_partition_id() >= 0, array_sort(array_distinct(concat(_base, {found}))), null)"))  # so that no filter moves below the scan
    shares = "concat(transform(matches, m -> cast(m.overlap as double) / m.size), transform(passages, m -> cast(m.overlap as double) / m.size))"
    return d.select(
        *keep,
        F.col("_n").alias("n_words"),
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join("_labels", ",").alias("labels"),
        F.expr(f"if(n_base > 0, 1D, coalesce(array_max({shares}), 0D))").alias("score"),
        "matches",
        "passages",
    )
