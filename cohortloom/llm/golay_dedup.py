"""SimHash near-duplicates through fuzzy keys of the binary Golay code.

A fingerprint has 64 bits in three segments of 22, 21 and 21, each a word of the perfect (23, 12) Golay code's space (padded
with zeros). Two fingerprints that differ in at most four bits have, by the pigeonhole principle, either a segment without a
difference or two segments that differ in one bit each. The first share the segment's value; for the second, a segment of odd
parity is decoded to the index of its codeword and, where that is three bits away, to the five codewords at four bits too,
a segment of even parity to its codeword only: one bit apart, the one's codeword is among the other's. Keys are
the values, and pairs of indices. Fingerprints that share a key are compared, so no link is missed and none is wrong.

No key's fingerprints are paired with each other at large. Each is first compared with two pivots of its key, components are
formed, and then only the components of a key are compared, by the bits that their fingerprints have in common, and where those
are near, their fingerprints: any two linked fingerprints are by then in one component, or are compared.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; repeated
rows and equal texts share a fingerprint and so a component; a null doc_id is never a component's name unless all are null;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.names import free_name
from cohortloom.llm.common import map_texts, written
from cohortloom.llm.components import components

#: Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Width and first bit of the segments, generator polynomial of the code.
SEGMENTS = ((22, 0), (21, 22), (21, 43))
GENERATOR = 0b110001110101
#: Shingles whose bits are counted at a time; bytes of a text that are words at a time.
_PART, _BLOCK = 1 << 14, 1 << 19
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``_BLOCK`` bytes, cut at white space."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, min(at + _BLOCK, len(raw)))
        stop = cut.start() if cut else len(raw)
        yield raw[at:stop].lower().split()
        at = stop


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    begins = (stops - sizes)[: len(words) - width + 1].tolist()
    ends = stops[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends)), np.uint64, len(begins))


def simhash(text: str) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles.

    A long text is hashed block by block; the last words of a block go before the first of the next.
    """
    counts, total, words = np.zeros(64, np.int64), 0, []
    for block in _word_blocks(text.encode()):
        words = words[1 - SHINGLE :] + block if total else words + block
        if len(words) < SHINGLE:
            continue
        hashes = _hashes(words, SHINGLE)
        total += len(hashes)
        counts += _bit_counts(hashes)
    if not total:
        if not words:
            return 0
        hashes = _hashes(words, len(words))
        total, counts = 1, _bit_counts(hashes)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        octets = hashes[at : at + _PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed 64-bit number."""

    def per_task() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([simhash(t) for t in texts], np.uint64).view(np.int64), pa.int64())]

    return map_texts(docs, per_task, "fp bigint")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each 12-bit word shifted by 11; nearest error of each remainder; the errors of weight four of each
    remainder whose nearest error has weight three (zeros for the others)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    high = np.array([remainder(d << 11) for d in range(4096)], np.int64)
    single = [remainder(1 << bit) for bit in range(23)]
    nearest, fours = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= single[bit]
            error = sum(1 << bit for bit in bits)
            if weight < 4:
                nearest[syndrome] = error
            else:
                fours[syndrome].append(error)
    return high, nearest, np.array([f or [0] * 5 for f in fours], np.int64)


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of up to 23 bits: six codeword indices, which of them count, and the parity.

    The first is the nearest codeword's; the others count for odd words that are three bits away from it.
    """
    high, nearest, fours = golay_tables()
    syndrome = high[words >> 11] ^ (words & 0x7FF)
    error = nearest[syndrome]
    odd = np.bitwise_count(words) & 1
    indices = np.concatenate([(words ^ error)[:, None], words[:, None] ^ fours[syndrome]], axis=1) >> 11
    counts = np.zeros(indices.shape, bool)
    counts[:, 0] = True
    counts[:, 1:] = ((np.bitwise_count(error) == 3) & (odd == 1))[:, None]
    return indices, counts, odd.astype(np.int64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the fingerprint, key, and side: keys of side 0 meet those of side 1, keys of side 2 meet each other."""
    unsigned = fps.view(np.uint64)
    words = [(unsigned >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for n, at in SEGMENTS]
    place = np.arange(len(fps))
    places, keys, sides = [], [], []
    for k, word in enumerate(words):
        places.append(place)
        keys.append(word | k << 32)
        sides.append(np.full(len(fps), 2, np.int8))
    decoded = [codeword_indices(w) for w in words]
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        (left, use_left, odd_left), (right, use_right, odd_right) = decoded[i], decoded[j]
        used = use_left[:, :, None] & use_right[:, None, :]
        kind = 3 + 2 * k + (odd_left ^ odd_right)
        key = (kind[:, None, None] << 32) | (left[:, :, None] << 12) | right[:, None, :]
        places.append(np.nonzero(used)[0])
        keys.append(key[used])
        sides.append(odd_left[places[-1]].astype(np.int8))
    return np.concatenate(places), np.concatenate(keys), np.concatenate(sides)


def key_table(distinct: DataFrame) -> DataFrame:
    """``key, side, fp`` for each fuzzy key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(at, 4096).to_numpy()
                places, keys, sides = fuzzy_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), pa.array(fps[places])], ["key", "side", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, side tinyint, fp bigint")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def fingerprint_classes(distinct: DataFrame) -> DataFrame:
    """The distinct fingerprints with their columns and ``root``: the smallest fingerprint that links reach."""
    keys = written(key_table(distinct), "golay-keys")
    pivots = keys.groupBy(F.col("key").alias("met")).agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    pivots = written(pivots, "golay-pivots")  # for a shuffle on both sides of the join, which can then split a hot key
    ends = [(F.col("fp") != F.col(pivot)) & _near("fp", pivot) for pivot in ("low", "high")]
    near = keys.select("key", "fp").join(pivots, (F.col("key") == F.col("met")) & (ends[0] | ends[1]))
    near = near.select("fp", F.explode(F.array("low", "high")).alias("pivot")).filter(_near("fp", "pivot"))
    stars = components(near)
    labelled = keys.join(stars, F.col("fp") == F.col("node"), "left")
    labelled = written(labelled.select("key", "side", "fp", F.coalesce("root", "fp").alias("label")), "golay-labels")
    joined = components(_links_across(labelled))
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left")
    rooted = rooted.select(*distinct.columns, F.coalesce("root", "fp").alias("label"))
    rooted = rooted.join(joined, F.col("label") == F.col("node"), "left")
    return rooted.select(*distinct.columns, F.coalesce("root", "label").alias("root"))


def _links_across(labelled: DataFrame) -> DataFrame:
    """``a, b``: labels of which some fingerprints that share a key are linked, once for each such pair of them.

    A label's fingerprints in a key are first reduced to their common bits. Two labels are looked at where those differ in few
    enough bits, by the fingerprints of the smaller one against those of the other.
    """
    groups = labelled.groupBy("key", "label").agg(
        F.bit_and("fp").alias("all"),
        F.bit_or("fp").alias("any"),
        F.bit_or(F.when(F.col("side") == 2, 4).otherwise(F.col("side") + 1)).alias("sides"),
        F.count(F.lit(1)).alias("n"),
    )
    groups = written(groups, "golay-groups")
    other = groups.select(*[F.col(c).alias(f"{c}_b") for c in groups.columns])
    apart = F.bit_count(F.col("all").bitwiseAND(F.bitwise_not("any_b"))) + F.bit_count(F.col("all_b").bitwiseAND(F.bitwise_not("any")))
    # side 0 meets side 1, and side 2 itself: of the bits 1, 2 and 4, one of the first two on either side, or 4
    meet = F.col("sides").bitwiseOR(F.col("sides_b")).bitwiseAND(F.lit(3)) == 3
    meet = meet | (F.col("sides").bitwiseAND(F.lit(4)) == 4)
    pairs = groups.join(
        other, (F.col("key") == F.col("key_b")) & (F.col("label") < F.col("label_b")) & meet & (apart <= MOST_BITS)
    )
    smaller = F.col("n") <= F.col("n_b")
    pairs = written(
        pairs.select(
            F.col("key").alias("met"),
            F.when(smaller, F.col("label")).otherwise(F.col("label_b")).alias("small"),
            F.when(smaller, F.col("label_b")).otherwise(F.col("label")).alias("large"),
        ),
        "golay-pairs",
    )
    few = labelled.join(pairs, (F.col("key") == F.col("met")) & (F.col("label") == F.col("small")))
    few = few.select("met", F.col("fp").alias("fp_small"), "small", "large")
    linked = few.join(
        labelled, (F.col("key") == F.col("met")) & (F.col("label") == F.col("large")) & _near("fp", "fp_small")
    )
    return linked.select(F.col("small").alias("a"), F.col("large").alias("b"))


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each document: the smallest doc_id that links reach."""
    marked = written(fingerprints(docs), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    classes = written(fingerprint_classes(distinct), "fingerprint-classes")
    # written, so that the join has a shuffle on both sides and can split a root with very many fingerprints
    named = written(classes.groupBy("root").agg(F.min("first").alias("component_id")), "component-names")
    return marked.join(classes.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with all their columns; rows with the same doc_id stay or go together."""
    kept = near_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    of = free_name(docs.columns, "kept_id")
    kept = written(kept.select(F.col("doc_id").alias(of)).distinct(), "kept-ids")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
