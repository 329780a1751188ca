import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import golay_dedup
from cohortloom.llm.common import written
from cohortloom.llm.components import _large_star, components
from cohortloom.llm.golay_dedup import (
    codeword_indices,
    drop_near_copies,
    fuzzy_keys,
    golay_tables,
    near_components,
    simhash,
)


def brute_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")]
    words = [w for part in words for w in __import__("re").split("[\t-\r]", part) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    """Smallest member of each component, by union-find."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_code_is_perfect():
    high, nearest, fours = golay_tables()
    assert (np.bitwise_count(nearest) <= 3).all() and len(np.unique(nearest)) == 2048
    weight = np.bitwise_count(nearest)
    assert [(weight == w).sum() for w in range(4)] == [1, 23, 253, 1771]
    assert (np.bitwise_count(fours[weight == 3]) == 4).all()


def test_words_one_bit_apart_share_an_index():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 4000)
    other = words ^ (1 << draw.integers(0, 23, 4000))
    (a, use_a, odd_a), (b, use_b, odd_b) = codeword_indices(words), codeword_indices(other)
    assert (odd_a != odd_b).all()
    for k in range(len(words)):
        assert {*a[k][use_a[k]].tolist()} & {*b[k][use_b[k]].tolist()}


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_near_fingerprints_meet(bits):
    draw = random.Random(bits)
    base = [draw.getrandbits(64) for _ in range(1500)]
    near = [x ^ sum(1 << b for b in draw.sample(range(64), bits)) for x in base]

    def by_fingerprint(fps):
        found = defaultdict(set)
        for place, key, side in zip(*(x.tolist() for x in fuzzy_keys(np.array(fps, np.uint64).view(np.int64)))):
            found[place].add((key, side))
        return found

    a, b = by_fingerprint(base), by_fingerprint(near)
    for k in range(len(base)):
        assert any((key, 2 if side == 2 else 1 - side) in b[k] for key, side in a[k])


def test_simhash_by_hand():
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["Ab", "cÉ", "d,", "日", "e f", "\x1c"], k=draw.randint(0, 12))) for _ in range(200)]
    for text in [*texts, "", " \t\n\x0b\x0c\r", "one", "A B\tC\nD  E"]:
        assert simhash(text) == brute_simhash(text), repr(text)


def test_components_of_links(spark):
    draw = random.Random(5)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(n, n + 1) for n in range(1000, 1040)] + [(7, 7)]
    expected = roots({n for pair in links for n in pair}, links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: r for n, r in expected.items() if n != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SHAPES = {
    "a star": [(n, 0) for n in range(1, 60)] * 2,
    "stars turned round": [(-n, n % 7) for n in range(1, 60)],
    "a path": [(n, n + 1) for n in range(64)],
    "a path out of order": [(n * 29 % 64, (n + 1) * 29 % 64) for n in range(63)],
    "two ends in many": [(n, m) for n in (-5, 3) for m in range(10, 40)],
    "repeats and loops": [(1, 2), (2, 1), (2, 2), (1, 2), (9, 9), (3, 2)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_of_shapes(spark, shape):
    links = SHAPES[shape]
    expected = {n: r for n, r in roots({n for pair in links for n in pair}, links).items() if n != r}
    found = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted(expected.items())


@pytest.mark.parametrize("links, most", [([(n, n % 5) for n in range(5, 300)], 2), ([(n, n // 2) for n in range(1, 300)], 17)])
def test_few_tables_are_written_for_components(spark, monkeypatch, links, most):
    """Stars are done once they have been looked at, and no round is run only to see that it changes nothing."""
    from cohortloom.llm import components as module

    names = []
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or written(df, name))
    found = module.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert found.count() == len(links) and len(names) <= most, names


def test_documents_against_all_pairs(spark):
    """Chains, a dense group and two that touch: the texts are such that fingerprints lie close together."""
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(30, 200))) for _ in range(60)]
    for _ in range(240):
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", None, "x", "x"]
    docs = spark.createDataFrame([(900 - k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    fps = {900 - k: brute_simhash(t or "") for k, t in enumerate(texts)}
    ids = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    expected = roots(ids, linked)
    found = near_components(docs).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in found} == fps
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert len(set(expected.values())) < len(ids) - 50
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(expected.values())


def test_awkward_rows(spark, awkward, nothing):
    found = near_components(awkward).collect()
    named = defaultdict(set)
    for r in found:
        named[r["doc_id"]].add(r["component_id"])
    assert named[1] == named[2] == {1} and named[3] == named[4] == named[5] == {3} and len(found) == 9
    assert drop_near_copies(awkward).columns == awkward.columns
    assert near_components(nothing).count() == 0 and drop_near_copies(nothing).count() == 0


def test_a_hot_node_is_split(spark):
    hot = spark.range(1, 200_001).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = _large_star(written(hot, "links"))
        assert len(star.toArrow()) == 200_000
        assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_blocks_as_the_whole(monkeypatch):
    """A long text, hashed block by block, has the fingerprint that it has in one piece."""
    draw = random.Random(12)
    texts = [" ".join("w" * draw.randint(1, 9) + str(draw.randint(0, 50)) for _ in range(draw.choice([1, 2, 3, 4, 5, 40, 400]))) for _ in range(80)]
    texts += ["  \n", "", "x" * 500, "a " * 300, "\t".join("AbCdE") + " " * 200]
    whole = [golay_dedup.simhash(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(golay_dedup, "_BLOCK", size)
        assert [golay_dedup.simhash(t) for t in texts] == whole


def test_memory_of_a_very_long_text():
    import tracemalloc

    text = " ".join(str(k) for k in range(3_000_000))
    tracemalloc.start()
    golay_dedup.simhash(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) + (200 << 20)
