"""Token counts by a word-end BPE file, with a two-tier table of pre-token lengths.

The first tier is a table of the most frequent pre-tokens and their numbers of tokens, taken from a bounded sample and
broadcast; the second is a bounded cache in each worker for the rest, filled by the library. Pre-tokens of the corpus are
never shuffled: a document's count is a sum of lookups in the task that reads it. The tables only save work. Texts with a
special string, or with characters outside a checked range, go to the library whole.

Defined results: a null text counts as empty (0 tokens); very long texts are counted whole; rows are independent of each
other; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import map_texts, slices, text_or_empty

#: Documents of the sample (about), pre-tokens kept by each of its tasks, rows of the broadcast table, and how often a
#: pre-token of the table is in the sample at least.
SAMPLE_DOCS, TASK_ROWS, TABLE_ROWS, LEAST = 4_000, 20_000, 50_000, 4
#: Lengths that a worker remembers besides the table, and the longest pre-token among them.
CACHED, CACHED_LENGTH = 400_000, 64

#: The pattern of the tokenizer file, spelt for characters of ``_CHECKED``, where NFC changes nothing.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_CHECKED = re.compile("[\t-\r -~\x85\xa0-ɏ‐-‧‰-⁞€]*")


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Lengths(dict):
    """Pre-token to number of tokens; what is missing is encoded and remembered, within bounds."""

    LETTERS = _byte_letters()

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.model, self.frequent = _library(path).model, frequent

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(self.LETTERS)))
        if len(pre_token) <= CACHED_LENGTH:
            if len(self) > CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n


class TokenCounter:
    """Numbers of tokens, as the library gives them for the whole text."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None) -> None:
        self.library = _library(path)
        self.lengths = Lengths(path, frequent or {})
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None

    def pre_tokens(self, text: str) -> list[str] | None:
        """None where only the library may tell."""
        if not _CHECKED.fullmatch(text) or self.special and self.special.search(text):
            return None
        return _PRE_TOKENS.findall(text.lower())

    def __call__(self, text: str) -> int:
        found = self.pre_tokens(text)
        if found is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, found))


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """At most ``TABLE_ROWS`` frequent pre-tokens of a hash sample of about ``SAMPLE_DOCS`` documents, with their lengths.

    Each task of the sample sends its most frequent ones only; the merged list is cut where it is collected.
    """
    step = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(path), Counter()
        for piece in slices(batches):
            for text in piece.column("text").to_pylist():
                seen.update(p for p in counter.pre_tokens(text) or () if len(p) <= CACHED_LENGTH)
            if len(seen) > 20 * TASK_ROWS:
                seen = Counter(dict(seen.most_common(10 * TASK_ROWS)))
        top = seen.most_common(TASK_ROWS)
        lengths = [counter.lengths[p] for p, _ in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(lengths, pa.int32())],
            ["pre_token", "n", "length"],
        )

    found = sample.mapInArrow(count, "pre_token string, n bigint, length int")
    merged = found.groupBy("pre_token", "length").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    rows = merged.orderBy(F.desc("n"), "pre_token").limit(TABLE_ROWS).collect()
    return {r["pre_token"]: r["length"] for r in rows}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: UTF-8 bytes and tokens of each whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def per_task() -> Callable[[list[str]], list[pa.Array]]:
        counter = TokenCounter(path, table.value)

        def work(texts: list[str]) -> list[pa.Array]:
            counts = [counter(t) for t in texts]
            return [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ]

        return work

    return map_texts(docs, per_task, "n_bytes bigint, n_tokens bigint, over_limit boolean")
