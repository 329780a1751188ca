r"""Quality rules: counts over words and lines, and the divergence of a document from its language.

A language's reference is what its documents look like on average: the shares of the classes of characters in words, and of its
most common words with one bin for all others. Every document has the same weight in it, whatever its length, in whole numbers, so the
sums don't depend on their order. The common words come from counts of all words of all documents, summed up in parts before the
shuffle; the best of a language are picked in parts too. A document is held against the reference of its language by the
Jensen-Shannon divergence (0 to 1, in bits), where it is long enough for its own shares to mean something.

Repeated windows are found by sorting: hash and place of each window are packed into one number, neighbours with the same hash
are compared word by word. Nothing leaves the row, and nothing but numbers is sorted for windows that don't repeat.

All steps are column expressions. Defined results: a null text counts as empty, has no words and fails the least number of words;
documents without a language share a reference of their own; a language without words has no word reference, so its documents aren't
held against one; repeated rows are rows of their own; very long texts are measured whole; an empty table gives an empty result;
columns other than doc_id, text and the language are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import text_or_empty, written
from cohortloom.session import BROADCAST_BYTES, BROADCAST_ROWS

#: White space between words, and the characters counted as symbols.
BLANKS, SYMBOLS = " \t\n\u000b\f\r", "#*$%&|<>"
#: Least words of a document, most words in repeated windows of three (in percent).
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Classes of characters in words, one taken out after the other; what is left is the last class.
CLASSES = ("[a-z]", r"[^\x00-\x7F]", "[A-Z]", r"[.,;:!?'\x22()\x2D]", "[0-9]")
#: Common words of a language, the weight of a document in whole numbers.
COMMON, UNIT = 25, 1_000_000
#: Values of the short hash that tells most other words from the common ones, a power of two.
SLOTS = 1024
#: Characters and words from which shares are held against the reference, and the divergence above which a document goes.
LEAST_CHARS, LEAST_COMPARED = 200, 100
MOST_CLASS_DIVERGENCE, MOST_WORD_DIVERGENCE = 0.11, 0.11


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value, which is computed once; a column named inside a lambda may be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: Column) -> Column:
    """Words between white space; one empty word, if there are none."""
    return F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")


def blank_words(text: Column) -> Column:
    """Words between white space."""
    return _let(_split(text), lambda w: F.when(F.get(w, F.lit(0)) != "", w).otherwise(F.array().cast("array<string>")))


def packed_windows(words: Column) -> Column:
    """Hash and start of each window of words in one number, sorted: the low bits, as many as the count of words has, are the start."""

    def pack(own: Column, bits: Column) -> Column:
        def one(word: Column, at: Column) -> Column:
            hashed = F.xxhash64(word, *[F.get(own, at + k) for k in range(1, WINDOW)])
            return F.call_function("shiftleft", hashed, bits).bitwiseOR(at.cast("bigint"))

        return F.sort_array(F.transform(F.slice(own, 1, F.size(own) - WINDOW + 1), one))

    packed = _let(words, lambda own: _let(_bits(own), lambda bits: pack(own, bits)))
    return F.when(F.size(words) >= WINDOW, packed).otherwise(F.array().cast("array<bigint>"))


def _bits(words: Column) -> Column:
    return F.length(F.bin(F.size(words).cast("bigint")))


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows found twice or more."""
    words, empty = F.col("words"), F.array().cast("array<bigint>")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bits(words)) - 1
    rows = rows.withColumn("packed", packed_windows(words)).withColumn("mask", mask)

    def second(packed: Column, high: Column) -> Column:
        """Places in the sorted numbers whose hash is that of the one before."""
        same = lambda i: F.get(packed, i).bitwiseXOR(F.get(packed, i - 1)).bitwiseAND(high) == 0
        return F.filter(F.sequence(F.lit(1), F.size(packed) - 1), same)

    found = _let(F.col("packed"), lambda packed: _let(F.bitwise_not("mask"), lambda high: second(packed, high)))
    rows = rows.withColumn("second", F.when(F.size("packed") > 1, found).otherwise(F.array().cast("array<int>")))

    def spelled(own: Column, packed: Column, mask: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.get(packed, i).bitwiseAND(mask).cast("int")
            return F.struct(F.concat_ws(" ", *[F.get(own, at + k) for k in range(WINDOW)]).alias("window"), at.cast("bigint").alias("at"))

        places = F.array_distinct(F.flatten(F.transform("second", lambda i: F.array(i - 1, i))))
        return F.sort_array(F.transform(places, one))

    candidates = _let(
        words, lambda own: _let(F.col("packed"), lambda packed: _let(F.col("mask"), lambda mask: spelled(own, packed, mask)))
    )
    rows = rows.withColumn("spelled", F.when(F.size("second") > 0, candidates))

    def covered(spelled: Column) -> Column:
        def twice(s: Column, k: Column) -> Column:
            same = [s["window"] == F.get(spelled, k + step)["window"] for step in (-1, 1)]
            return same[0] | same[1]

        starts = F.sort_array(F.transform(F.filter(spelled, twice), lambda s: s["at"]))
        fresh = lambda found: F.transform(
            found, lambda at, k: F.least(F.coalesce(F.get(found, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(_let(starts, fresh), F.lit(0).cast("bigint"), lambda a, x: a + x)

    total = F.coalesce(_let(F.col("spelled"), covered), F.lit(0))
    return rows.withColumn("n_repeat_words", total).drop("packed", "mask", "second", "spelled")


def with_class_counts(rows: DataFrame) -> DataFrame:
    """Adds ``classes``, the characters of each class, and ``n_symbols``, of which all are in the last class. Each class is cut out of
    what the ones before have left, column by column, so that nothing is computed twice."""
    left = ["text"]
    for k, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"left{k}", F.regexp_replace(left[-1], pattern + "+", ""))
        left.append(f"left{k}")
    sizes = [F.char_length(c).cast("bigint") for c in left]
    counts = F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1])
    symbols = F.char_length(F.regexp_replace(left[-1], f"[^{SYMBOLS}]+", "")).cast("bigint")
    return rows.withColumns({"classes": counts, "n_symbols": symbols}).drop(*left[1:])


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def measured(docs: DataFrame, language: str) -> DataFrame:
    """Each document's counts of words, symbols, lines, repeats and classes of characters, and its words."""
    rows = docs.select("doc_id", F.col(language).cast("string").alias("lang"), text_or_empty().alias("whole"))
    lines = F.filter(F.split("whole", "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    equal = _let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))
    # the text goes as soon as it is words, and the words' characters as soon as they are counted: each step copies its rows
    rows = rows.select("doc_id", "lang", blank_words(F.col("whole")).alias("words"), equal.cast("bigint").alias("n_dup_lines"))
    rows = with_class_counts(rows.withColumn("text", F.array_join("words", "")))
    rows = _repeated(rows.withColumn("word_chars", F.char_length("text").cast("bigint")).drop("text"))
    return rows.withColumn("n_words", F.size("words").cast("bigint"))


def _word_weights(rows: DataFrame) -> DataFrame:
    """``lang, word, weight``: each document deals its weight out to its words."""
    words = rows.select("lang", _split(F.col("text")).alias("words")).filter(F.get("words", F.lit(0)) != "")
    words = words.select("lang", F.expr(f"{UNIT} div size(words)").alias("part"), F.explode("words").alias("word"))
    return words.groupBy("lang", "word").agg(F.sum("part").alias("weight"))


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _slots(words: Column) -> Column:
    """For each value of a short hash, whether one of the words has it."""
    return _let(F.transform(words, _slot), lambda taken: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.array_contains(taken, k)))


def language_references(docs: DataFrame, language: str = "lang", common: int = COMMON) -> DataFrame:
    """``lang, class_shares, common_words, slots, common_shares``; the first of the common shares is that of all other words."""
    rows = docs.select(F.col(language).cast("string").alias("lang"), text_or_empty().alias("text"))
    weighed = written(_word_weights(rows), "word-weights")
    width = len(CLASSES) + 1
    # characters are counted in the different words, of which there are far fewer than places
    shapes = with_class_counts(weighed.select("lang", "weight", F.col("word").alias("text")))
    sums = [F.sum(F.col("weight") * F.get("classes", F.lit(k))).alias(f"s{k}") for k in range(width)]
    whole = F.aggregate(F.array(*[f"s{k}" for k in range(width)]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    by_class = shapes.groupBy("lang").agg(*sums).select(
        "lang", F.array(*[F.col(f"s{k}") / whole for k in range(width)]).alias("class_shares")
    )
    totals = weighed.groupBy("lang").agg(F.sum("weight").alias("total"))
    best = Window.partitionBy("lang").orderBy(F.desc("weight"), "word")
    top = weighed.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "weight"))).alias("top"), F.sum("weight").alias("known"))
    by_word = top.withColumnRenamed("lang", "_lang").join(totals, F.col("_lang").eqNullSafe(F.col("lang"))).select(
        "_lang",
        F.col("top.word").alias("common_words"),
        _slots(F.col("top.word")).alias("slots"),
        F.concat(
            F.array((F.col("total") - F.col("known")) / F.col("total")),
            _let(F.col("total"), lambda t: F.transform("top", lambda x: x["weight"] / t)),
        ).alias("common_shares"),
    )
    return by_class.join(by_word, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


def _part(p: Column, q: Column) -> Column:
    """A bin's part of the divergence."""
    middle = (p + q) / 2
    own = F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0)
    other = F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)
    return (own + other) / 2


def class_divergence(counts: Column, shares: Column) -> Column:
    parts = _let(_total(counts), lambda n: F.zip_with(counts, shares, lambda c, q: _part(c / n, q)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _with_word_divergence(rows: DataFrame) -> DataFrame:
    """Adds ``word_divergence``. The places of a text's common words are sorted, so a bin is a run; bins without a word add half
    their share."""

    def place(known: Column, slots: Column) -> Callable[[Column], Column]:
        # most words aren't common, and most of those fall into an empty slot
        return lambda w: F.when(F.get(slots, _slot(w)), F.array_position(known, w)).otherwise(F.lit(0).cast("bigint"))

    met = _let(F.col("common_words"), lambda known: _let(F.col("slots"), lambda slots: F.transform("words", place(known, slots))))
    rows = rows.withColumn("met", F.sort_array(F.filter(met, lambda k: k > 0)))

    def run_ends(places: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(places) - 1), lambda i: ~F.get(places, i).eqNullSafe(F.get(places, i + 1))
        )

    rows = rows.withColumn("ends", F.when(F.size("met") > 0, _let(F.col("met"), run_ends)).otherwise(F.array().cast("array<int>")))

    def run(end: Column, k: Column) -> Column:
        n = end - F.coalesce(F.get("ends", k - 1), F.lit(-1))
        return F.struct((n / F.size("words")).alias("p"), F.get("common_shares", F.get("met", end).cast("int")).alias("q"))

    other = F.struct(
        ((F.size("words") - F.size("met")) / F.size("words")).alias("p"), F.get("common_shares", F.lit(0)).alias("q")
    )
    rows = rows.withColumn("runs", F.when(F.size("words") > 0, F.concat(F.array(other), F.transform("ends", run))))
    parts = F.aggregate("runs", F.lit(0.0), lambda a, r: a + _part(r["p"], r["q"]))
    shown = F.aggregate("runs", F.lit(0.0), lambda a, r: a + r["q"])
    return rows.withColumn("word_divergence", parts + (1 - shown) / 2).drop("met", "ends", "runs")


def _small(references: DataFrame) -> DataFrame:
    """The references, for a broadcast where their counted rows and measured bytes are few."""
    width = F.coalesce(F.octet_length(F.array_join("common_words", "")), F.lit(0)) + 16 * COMMON + SLOTS + 200
    rows, size = references.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return F.broadcast(references) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else references


def judge(docs: DataFrame, language: str = "lang") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept`` and both divergences (null where the document is too short for one)."""
    references = _small(written(language_references(docs, language), "language-references").withColumnRenamed("lang", "_lang"))
    rows = measured(docs, language).join(references, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rows = _with_word_divergence(rows)
    classes = F.when(_total(F.col("classes")) >= LEAST_CHARS, class_divergence(F.col("classes"), F.col("class_shares")))
    words = F.when((F.size("words") >= LEAST_COMPARED) & F.col("common_words").isNotNull(), F.col("word_divergence"))
    rows = rows.withColumns({"class_divergence": F.round(classes, 6), "word_divergence": F.round(words, 6)})
    few = F.col("n_words") < LEAST_WORDS
    base = few | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    far = F.coalesce(F.col("class_divergence") > MOST_CLASS_DIVERGENCE, F.lit(False)) | F.coalesce(
        F.col("word_divergence") > MOST_WORD_DIVERGENCE, F.lit(False)
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~far).alias("kept"), "class_divergence", "word_divergence",
    )


def judge_sql() -> str:
    """DuckDB SQL for the rows of ``judge`` on the table documents."""

    def classes(text: str) -> str:
        rest, cuts = text, []
        for pattern in CLASSES:
            after = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}+', '', 'g')"
            cuts.append((rest, after))
            rest = after
        sizes = [f"length({left}) - length({after})" for left, after in cuts] + [f"length({rest})"]
        return ",\n    ".join(f"{size} AS c{k}" for k, size in enumerate(sizes))

    n = len(CLASSES) + 1
    shares = ", ".join(f"sum(weight * c{k}) AS s{k}" for k in range(n))
    whole = " + ".join(f"s{k}" for k in range(n))
    refs = ", ".join(f"s{k} / ({whole}) AS q{k}" for k in range(n))

    def part(p: str, q: str) -> str:
        middle = f"(({p} + {q}) / 2)"
        return (
            f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {middle}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {middle}) ELSE 0 END) / 2"
        )

    by_class = " + ".join(part(f"(c{k} / total)", f"q{k}") for k in range(n))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM docs)
), twice AS (
  SELECT r, pos FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT pos + d) AS n_repeat_words FROM twice, range({WINDOW}) AS t(d) GROUP BY r
), shapes AS (
  SELECT r, lang, length(joined) AS total,
    {classes("joined")}
  FROM (SELECT r, lang, coalesce(array_to_string(words, ''), '') AS joined FROM docs)
), weights AS (
  SELECT lang, word, sum(part) AS weight FROM (
    SELECT lang, {UNIT} // len(words) AS part, unnest(words) AS word FROM docs WHERE len(words) > 0) GROUP BY ALL
), class_refs AS (
  SELECT lang, {refs} FROM (SELECT lang, {shares} FROM (SELECT lang, weight, {classes("word")} FROM weights) GROUP BY lang)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS place, sum(weight) OVER (PARTITION BY lang) AS total
  FROM weights
), bins AS (
  SELECT lang, word, place, weight / total AS q FROM ranked WHERE place <= {COMMON}
  UNION ALL SELECT lang, NULL, 0, (max(total) - sum(weight)) / max(total) FROM ranked WHERE place <= {COMMON} GROUP BY lang
), counts AS (
  SELECT t.r, coalesce(b.place, 0) AS place, count(*) AS n, t.lang
  FROM (SELECT r, lang, unnest(words) AS word FROM docs) t LEFT JOIN bins b ON b.word = t.word AND b.lang IS NOT DISTINCT FROM t.lang
  GROUP BY t.r, t.lang, coalesce(b.place, 0)
), word_far AS (
  SELECT r, sum({part("p", "q")}) + (1 - sum(q)) / 2 AS far, sum(n) AS n_compared
  FROM (SELECT c.r, c.n, c.n / sum(c.n) OVER (PARTITION BY c.r) AS p, b.q
    FROM counts c JOIN bins b ON c.place = b.place AND c.lang IS NOT DISTINCT FROM b.lang) GROUP BY r
), class_far AS (
  SELECT r, total, {by_class} AS far
  FROM shapes s JOIN class_refs c ON s.lang IS NOT DISTINCT FROM c.lang WHERE total > 0
), judged AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN c.total >= {LEAST_CHARS} THEN round(c.far, 6) END AS class_divergence,
    CASE WHEN w.n_compared >= {LEAST_COMPARED} THEN round(w.far, 6) END AS word_divergence
  FROM docs d LEFT JOIN repeats p USING (r) LEFT JOIN class_far c USING (r) LEFT JOIN word_far w USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_divergence > {MOST_CLASS_DIVERGENCE}, false)
    AND NOT coalesce(word_divergence > {MOST_WORD_DIVERGENCE}, false) AS kept, class_divergence, word_divergence
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM judged)
"""
