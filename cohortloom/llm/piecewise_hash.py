"""Fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes of the text ends a chunk where it leaves a block size's last remainder; each chunk gives
one character of a signature, by the top bits of its polynomial hash. A fingerprint holds the block size, the signature at it
and the one at twice it. Block sizes are powers of two times three: the smallest for which 64 chunks are expected to hold the
text, halved while the signature has under 32 characters. Two fingerprints are compared by edit distance where their block
sizes are equal or one is twice the other.

Defined results: a null text counts as empty and has the fingerprint ``3::``; equal fingerprints have likeness 1, incompatible
block sizes 0; very long texts are hashed whole, part by part; repeated rows are rows of their own, next to each other in the order (ties
are ordered by text); of one row the next is itself; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import slices, text_or_empty, written

WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: Bytes of a text that are hashed at a time.
_PART = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the chunk hash, and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [_power(_BASE, max(2 * n, 1 << 16)), _power(_INVERSE, max(2 * n, 1 << 16))]
    return _powers[0], _powers[1]


def rolling(codes: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: a sum, a weighted sum and a shifted sum of the last bytes."""
    wide = codes.astype(np.uint32)
    total = wide * np.uint32(WINDOW + 1)
    shifted = wide.copy()
    for back in range(1, min(WINDOW, len(codes))):
        before = wide[:-back]
        total[back:] += before * np.uint32(WINDOW - back + 1)
        shifted[back:] ^= before << np.uint32(5 * back)
    return total + shifted


def _ends_by_parts(codes: np.ndarray, sizes: list[int]) -> dict[int, tuple[list[int], int]]:
    """For each block size, the first ``LENGTH`` ends of chunks and the count of all; sizes are doubles of each other, smallest first.

    The rolling hash of a part starts from the last bytes of the part before. An end at a size is one at half of it.
    """
    found = {s: ([], 0) for s in sizes}
    for at in range(0, len(codes), _PART):
        before = min(at, WINDOW - 1)
        marks = rolling(codes[at - before : at + _PART])[before:]
        ends = np.arange(len(marks))
        for s in sizes:
            ends = ends[marks[ends] % np.uint32(s) == s - 1]
            first, count = found[s]
            first.extend((ends[: LENGTH - len(first)] + at + 1).tolist())
            found[s] = first, count + len(ends)
    return found


def _hash_by_parts(codes: np.ndarray) -> int:
    """The polynomial hash of a chunk: its byte k counts with the k-th power of the base."""
    powers, total = _powers_up_to(_PART)[0][:_PART], 0
    for at in range(0, len(codes), _PART):
        part = codes[at : at + _PART].astype(np.uint64) + np.uint64(1)
        total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return total & ((1 << 64) - 1)


def _by_parts(codes: np.ndarray, block: int) -> str:
    """The fingerprint of a very long text, with memory for one part of it at a time."""
    n = len(codes)

    def signature(ends: list[int], length: int) -> str:
        ends = ends[: length - 1]
        if not ends or ends[-1] != n:
            ends = [*ends, n]
        hashes = [_hash_by_parts(codes[a:b]) for a, b in zip([0, *ends], ends)]
        return "".join(chr(LETTERS[(h * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 58]) for h in hashes)

    while True:
        sizes = [s for s in (block // 4, block // 2, block, 2 * block) if s >= LEAST_BLOCK]
        found = _ends_by_parts(codes, sizes)
        for size in reversed(sizes[:-1]):
            if size == LEAST_BLOCK or found[size][1] >= LENGTH // 2:
                return f"{size}:{signature(found[size][0], LENGTH)}:{signature(found[2 * size][0], LENGTH)}"
        block = sizes[0]


def fingerprint(text: str) -> str:
    codes = np.frombuffer(text.encode(), np.uint8)
    n = len(codes)
    if not n:
        return f"{LEAST_BLOCK}::"
    if n > _PART:
        block = LEAST_BLOCK
        while block * LENGTH < n:
            block *= 2
        return _by_parts(codes, block)
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    marks = rolling(codes)
    powers, inverses = _powers_up_to(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=upto[1:])

    def ends_at(size: int) -> np.ndarray:
        return np.flatnonzero(marks % np.uint32(size) == size - 1) + 1

    def signature(ends: np.ndarray, length: int) -> str:
        ends = ends[: length - 1]
        if not len(ends) or ends[-1] != n:
            ends = np.append(ends, n)  # the rest is the last chunk
        starts = np.concatenate([[0], ends[:-1]])
        chunk = (upto[ends] - upto[starts]) * inverses[starts]
        return LETTERS[chunk * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)].tobytes().decode()

    ends = ends_at(block)
    while block > LEAST_BLOCK and len(ends) < LENGTH // 2:
        block //= 2
        ends = ends_at(block)
    return f"{block}:{signature(ends, LENGTH)}:{signature(ends_at(2 * block), LENGTH)}"


def likeness(a: str, b: str) -> Column:
    """1 minus the edit distance over the longer length, at the block sizes that both fingerprints have; the higher of two."""
    left, right = F.split(F.col(a), ":"), F.split(F.col(b), ":")
    size_a, size_b = left[0].cast("bigint"), right[0].cast("bigint")

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when(size_a == size_b, F.greatest(alike(left[1], right[1]), alike(left[2], right[2])))
        .when(size_a == 2 * size_b, alike(left[1], right[2]))
        .when(size_b == 2 * size_a, alike(left[2], right[1]))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of another text, or all that it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_DONE = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_ENDS = "first_text string, last_text string, first_fingerprint string"


def _closed(text: str, mark: str, following: str, next_mark: str) -> tuple:
    other = edited(text, following)
    return len(text), hashlib.sha256(other.encode()).hexdigest(), mark, fingerprint(other), next_mark


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: each row with the one after it; then one row with its first and last texts, as the last row's
    next one is in another partition."""
    done = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["doc_id", *(c.split()[0] for c in (_DONE + ", " + _ENDS).split(", "))]
    first = held = kind_of_id = None

    def out(ids: list, rows: list[tuple], ends: tuple = (None, None, None)) -> pa.RecordBatch:
        arrays = [pa.array(ids, kind_of_id), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(done))]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([e] * len(ids), pa.string()) for e in ends)], names)

    for piece in slices(batches):
        ids, rows, kind_of_id = [], [], piece.schema.field("doc_id").type
        for row_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            mark = fingerprint(text)
            if held is None:
                first = text, mark
            else:
                ids.append(held[0])
                rows.append(_closed(held[1], held[2], text, mark))
            held = row_id, text, mark
        if ids:
            yield out(ids, rows)
    if held is not None:
        open_row = len(held[1]), None, held[2], None, None
        yield out([held[0]], [open_row], (first[0], held[1], first[1]))


def _over_the_border(partitions: DataFrame) -> DataFrame:
    """The last row of each partition with the first text of the next one (after the last partition: the first).

    There is one row for each partition of the walk.
    """
    order = Window.orderBy("part")
    following = partitions.select("part").select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("next_part")
    )
    heads = partitions.select(
        F.col("part").alias("next_part"), F.col("first_text").alias("_text"), F.col("first_fingerprint").alias("_mark")
    )
    rows = partitions.join(following, "part").join(heads, "next_part")
    rows = rows.select("doc_id", "last_text", "fingerprint", "_text", "_mark")
    doc_id = dict(rows.dtypes)["doc_id"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 16):
            closed = [_closed(*row) for row in zip(*(piece.column(k).to_pylist() for k in range(1, 5)))]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array([r[k] for r in closed], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], ["doc_id", *(c.split()[0] for c in _DONE.split(", "))])

    return rows.mapInArrow(close, f"doc_id {doc_id}, {_DONE}")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document.

    "Next" is by descending doc_id. Rows are dealt out by ranges of doc_id, sorted and walked partition by partition: texts
    are shuffled once, and only the two ends of a partition cross its border.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    doc_id = dict(rows.dtypes)["doc_id"]
    sorted_rows = rows.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    walked = sorted_rows.mapInArrow(_walk, f"doc_id {doc_id}, {_DONE}, {_ENDS}")
    walked = written(walked.withColumn("part", F.spark_partition_id()), "piecewise-walk")
    border = _over_the_border(walked.filter("first_text IS NOT NULL"))
    whole = walked.filter("first_text IS NULL").select(*border.columns).unionByName(border)
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
