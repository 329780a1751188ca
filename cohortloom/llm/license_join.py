"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license notice. A block is a window of twice the template's words, at multiples of its
words, so every passage as long as the template lies in one. A block meets a template where it contains at least a given share
of the template's words. The join is the usual one for sets: words are ordered by their frequency in the corpus, rarest first;
a block that meets a template shares one of the rarest words of it (prefix filter), has enough words itself (length filter), and
may still share enough by the place in the order where its words of a longer prefix end: those seen and all that are left in the
template are enough (positional filter). Of what is left, only the words of the candidate blocks are counted. Words that are in no template
are rarer than all others in that order, as they never match.

The templates are a parameter and small: their words and prefixes are the only things broadcast or made literal. Texts are
read once and reduced to the places of template words; only documents with a prefix word are looked at again.

Defined results: a null text counts as empty, has no words and no label; repeated rows are rows of their own; a phrase that
overlaps itself counts at every place; very long texts are scanned whole; without templates only phrases label; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import text_or_empty, written

THRESHOLD = 0.8
#: Words by which prefixes are longer than they must be for one shared word; so many more must be shared in them.
MORE = 3
#: What separates words, the phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Notices that licenses ask to be put into works, in lower case and without punctuation.
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license version"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
    ),
    Template(
        "apache-2",
        "licensed under the apache license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    ),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial international license"),
    Template("cc-by", "licensed under a creative commons attribution international license"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation",
    ),
    Template(
        "agpl",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    Template(
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for "
        "any damages arising from the use of this software",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template(
        "cc0",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide",
    ),
)


def words_of(text: Column) -> Column:
    """Words of a text, with only A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the places where the words of the phrase stand consecutively."""
    last = F.size(words) - len(phrase)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _stands(words, phrase, i) & (i <= last))
    rare = max(phrase, key=len)
    return F.when(F.array_contains(words, rare), starts).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _stands(words: Column, phrase: list[str], at: Column) -> Column:
    fits = F.lit(True)
    for k, word in enumerate(phrase):
        fits = fits & F.get(words, at + k).eqNullSafe(F.lit(word))
    return fits


def scanned(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """One slim row per document: words, places of phrases, and places of the words of templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select("doc_id", words_of(text_or_empty()).alias("words"))
    found = F.concat(*[_labelled(_places(F.col("words"), phrase.split()), label) for phrase, label in PHRASES.items()])
    hits = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))),
        lambda h: h.isNotNull(),
    )
    rows = words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), found.alias("base"), hits.alias("hits"))
    return written(rows.withColumn("row_no", F.monotonically_increasing_id()), "license-scan")


def word_ranks(rows: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Each template word's place in the order by document frequency, rarest first; as many rows as templates have words."""
    seen = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in seen.collect()}
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    return {w: k for k, w in enumerate(order)}


def least_shared(words: int, threshold: float) -> int:
    """The least number of so many words whose share reaches the threshold."""
    return next(n for n in range(words + 1) if n / words >= threshold)


def matches(rows: DataFrame, templates: tuple[Template, ...], threshold: float) -> DataFrame:
    """``row_no, template, block, containment`` of the blocks that contain the wanted share of a template's words."""
    ranks = word_ranks(rows, templates)
    spark = rows.sparkSession
    shapes, prefixes = [], []
    for number, template in enumerate(templates):
        ordered = sorted({ranks[w] for w in template.words})
        least = least_shared(len(ordered), threshold)
        more = max(min(MORE, least - 1), 0)
        shapes.append((number, len(template.words), least, 1 + more, ordered))
        prefixes += [(rank, number) for rank in ordered[: len(ordered) - least + 1 + more]]
    shape = F.broadcast(spark.createDataFrame(shapes, "template int, stride int, least int, early int, ranks array<int>"))
    prefix = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int").join(shape.drop("ranks"), "template"))
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])

    rare = sorted({w for w, k in ranks.items() if k in {p[0] for p in prefixes}})
    hit = rows.select("row_no", "n_words", F.explode(F.filter("hits", lambda h: h["word"].isin(rare))).alias("h"))
    hit = hit.select("row_no", "n_words", F.col("h.at").alias("at"), rank[F.col("h.word")].alias("rank"))

    def in_blocks(places: DataFrame) -> DataFrame:
        k = F.floor(F.col("at") / F.col("stride")).cast("int")
        return places.withColumn("block", F.explode(F.when(k > 0, F.array(k - 1, k)).otherwise(F.array(k))))

    candidates = in_blocks(hit.join(prefix, "rank")).groupBy("row_no", "template", "block").agg(
        F.size(F.collect_set("rank")).alias("seen"),
        *[F.any_value(c).alias(c) for c in ("n_words", "stride", "least", "early")],
    )
    long_enough = F.least(2 * F.col("stride"), F.col("n_words") - F.col("block") * F.col("stride")) >= F.col("least")
    candidates = candidates.filter((F.col("seen") >= F.col("early")) & long_enough)
    candidates = written(candidates.select("row_no", "template", "block", "stride"), "license-candidates")

    # of a candidate document, those words of its candidate blocks that are in the block's template
    wanted = candidates.select("row_no", "template", "stride").distinct()
    places = rows.join(candidates.select("row_no").distinct(), "row_no", "left_semi")
    places = places.select("row_no", F.explode("hits").alias("h"))
    places = places.select("row_no", F.col("h.at").alias("at"), rank[F.col("h.word")].alias("rank"))
    own = F.broadcast(spark.createDataFrame([(n, r) for n, *_, ordered in shapes for r in ordered], "template int, rank int"))
    inside = in_blocks(places.join(wanted, "row_no").join(own, ["template", "rank"])).join(
        candidates.drop("stride"), ["row_no", "template", "block"], "left_semi"
    )
    shared = inside.groupBy("row_no", "template", "block").agg(F.size(F.collect_set("rank")).alias("shared"))
    return shared.join(shape, "template").filter(F.col("shared") >= F.col("least")).select(
        "row_no", "template", "block", (F.col("shared") / F.size("ranks")).alias("containment")
    )


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks`` of each document.

    ``score`` is 1 with a phrase, else the highest containment of a template that is met, else 0; ``n_blocks`` counts the
    blocks that meet a template.
    """
    rows = scanned(docs, templates)
    label = F.create_map(*[F.lit(x) for k, t in enumerate(templates) for x in (k, t.label)]) if templates else None
    if templates:
        met = matches(rows, templates, threshold)
        by_row = met.groupBy("row_no").agg(
            F.max("containment").alias("best"),
            F.count(F.lit(1)).alias("n_blocks"),
            F.collect_set(label[F.col("template")]).alias("more"),
        )
        rows = rows.join(by_row, "row_no", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("double").alias("best"), F.lit(0).cast("bigint").alias("n_blocks"), F.array().cast("array<string>").alias("more"))
    base = F.array_sort(F.array_distinct("base.label"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.at").cast("bigint").alias("first_word"),
        F.array_max("base.at").cast("bigint").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, more)))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
    )


def brute_force_sql(templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, every block held against every template."""
    listed = ", ".join(
        f"({k}, '{t.label}', {len(t.words)}, [{', '.join(repr(w) for w in sorted(set(t.words)))}])" for k, t in enumerate(templates)
    )
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in PHRASES.items())
    return f"""
WITH templates AS (SELECT * FROM (VALUES {listed}) AS t(template, label, stride, words)
), phrases AS (SELECT * FROM (VALUES {phrases}) AS p(label, words)
), docs AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda w: w <> '') AS words
  FROM documents
), base AS (
  SELECT row_no, label, unnest(list_filter(range(0, len(d.words) - len(p.words) + 1),
    lambda i: d.words[i + 1:i + len(p.words)] = p.words)) AS place
  FROM docs d, phrases p
), bases AS (
  SELECT row_no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found FROM base GROUP BY row_no
), blocks AS (
  SELECT row_no, t.label, t.words AS wanted,
    unnest(list_transform(range(0, (len(d.words) - 1) // stride + 1), lambda k: d.words[k * stride + 1:k * stride + 2 * stride])) AS words
  FROM docs d, templates t WHERE list_has_any(d.words, t.words)
), met AS (
  SELECT row_no, label, len(list_intersect(wanted, words)) / len(wanted) AS containment FROM blocks
), mets AS (
  SELECT row_no, max(containment) AS best, count(*) AS n_blocks, list(DISTINCT label) AS found FROM met
  WHERE containment >= {threshold} GROUP BY row_no
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.found, m.found))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM docs d LEFT JOIN bases b USING (row_no) LEFT JOIN mets m USING (row_no)
"""
