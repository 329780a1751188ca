r"""The trie of conversation prefixes, built by van Emde Boas recursion.

A sequence of turns is cut at half its depth, the halves are cut again, and so on, all cuts of a level in one job. First the blocks of
1, 2, 4, ... turns get digests, each from its two halves. Then, from the longest blocks down, the prefix that ends at a cut is named: its name
is the digest of the name of the prefix that the upper block starts from and the digest of the upper block. With prefixes of lengths that
are multiples of a block known, all cuts in the middle of such blocks are named in the same job: upper tries and lower forests,
which begin where the cut prefix ends, are worked on side by side. After a logarithmic number of jobs, every prefix has a name, though none was
read turn by turn.

Totals of subtrees are grafted upward in the reverse order: from the shortest blocks on, what the lower forests under a cut prefix add up
to is added to each prefix of the upper block on the way to it. So a node's total is moved once for each level, not once for each
ancestor, and sums are formed in parts before they are shuffled.

A turn is known by the digest of its role and text, so texts are read once and no text is shuffled. Names and blocks are rows of their own, by
conversation and place: a very long conversation is spread out like any other, and so are equal ones, which share names only.

Defined results: turns are ordered by turn (null first), ties by digest; null roles and texts are empty; rows without a conv_id belong to
no conversation; repeated rows are turns of their own; without conversations there are no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import written
from cohortloom.operators.ranking import numbered

#: Conversations of a family, of which the first lends its opening turns to the others; the count of turns lent is under that.
FAMILY, LENT = 20, 4
#: Bytes of a name: a digest, cut.
NAME = 16
#: Members whose ids are joined to one text before the texts of a node are hashed.
CHUNK = 4096
_ROOT = bytes(NAME)


def _named(kind: int, *parts: Column) -> Column:
    """The digest of the parts, of which there are three kinds: turns, blocks of a level, and prefixes that end with one."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(bytes([kind])), *parts), 256)), 1, NAME)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv, pos, e, w``: turns numbered from 1 in their conversation, with the digest of role and text and the words of the text.

    The numbering is one order over all turns, dealt out by ranges, so that a very long conversation isn't gathered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        "turn",
        _named(0, F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("e"),
        words.cast("bigint").alias("w"),
    )
    placed = written(numbered(written(slim, "turns"), "conv", F.asc_nulls_first("turn"), "e", name="place"), "placed-turns")
    first = written(placed.groupBy("conv").agg(F.min("place").alias("first")), "first-turns")
    return placed.join(first, "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("pos"), "e", "w")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and ``conv, len`` of all of them (0 for one without turns)."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    lent = (F.crc32(F.col("conv").cast("string")) % LENT).cast("bigint")
    own = written(own.withColumns({"head": F.col("conv") - F.col("conv") % FAMILY, "lent": lent}), "conversations")
    heads = own.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    convs = own.join(heads, "head", "left").select(
        "conv", "head", "lent", "n", F.least(F.coalesce("head_n", F.lit(0)), "lent").alias("taken")
    )
    convs = written(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))), "rebuilt")
    openings = turns.filter(F.col("pos") < LENT).select(F.col("conv").alias("head"), "pos", "e", "w")
    lead = convs.filter("taken > 0").select("conv", "head", "taken", "len").join(openings, "head").filter("pos <= taken")
    rest = turns.join(convs.select("conv", "lent", "taken", "len"), "conv").filter("pos > lent")
    rest = rest.withColumn("pos", F.col("pos") - F.col("lent") + F.col("taken"))
    columns = ["conv", "pos", "len", "e", "w"]
    return lead.select(columns).unionByName(rest.select(columns)), convs.select("conv", "len")


def block_levels(turns: DataFrame, depth: int) -> list[DataFrame]:
    """By level k, ``conv, block, e, w, len``: digests of the whole blocks of 2**k turns; w is of the block's last turn."""
    level = turns.select("conv", (F.col("pos") - 1).alias("block"), "e", "w", "len")
    levels = [written(level, "blocks-0")]
    while depth >> len(levels):
        halves = levels[-1]
        right = F.col("block") % 2 == 1
        level = halves.groupBy("conv", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(~right, F.col("e"))).alias("a"),
            F.max(F.when(right, F.col("e"))).alias("b"),
            F.max(F.when(right, F.col("w"))).alias("w"),
            F.max("len").alias("len"),
        )
        level = level.filter("b IS NOT NULL").select("conv", "block", _named(2 * len(levels), F.col("a"), F.col("b")).alias("e"), "w", "len")
        levels.append(written(level, f"blocks-{len(levels)}"))
    return levels


def prefix_names(levels: list[DataFrame]) -> DataFrame:
    """``conv, pos, name, w, len`` of every prefix: cuts of the longest blocks first, then those in the middle of what they cut."""
    known = None
    for k in range(len(levels) - 1, -1, -1):
        upper = levels[k].filter("block % 2 = 0").withColumn("start", F.shiftleft("block", k))
        pos = (F.col("start") + (1 << k)).alias("pos")
        at_root = upper.filter("start = 0").withColumn("from", F.lit(_ROOT))
        if known is not None:
            starts = known.select("conv", F.col("pos").alias("start"), F.col("name").alias("from"))
            at_root = at_root.unionByName(upper.filter("start > 0").join(starts, ["conv", "start"]).select(at_root.columns))
        cut = written(at_root.select("conv", pos, _named(2 * k + 1, F.col("from"), F.col("e")).alias("name"), "w", "len"), f"cuts-{k}")
        known = cut if known is None else known.unionByName(cut)
    return known


def _low_bit(depth: Column) -> Column:
    return depth.bitwiseAND(-depth)


def grafted(nodes: DataFrame, paths: DataFrame, n_levels: int) -> DataFrame:
    """``name, n_leaves, saved_tokens`` over the subtree of each node but the root.

    ``nodes`` has ``name, parent, depth, conv, leaf, saved``, ``paths`` has ``conv, pos, name, parent`` of the prefixes on the
    way to each node's smallest member.
    """
    totals = nodes.select("name", "parent", "depth", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    for k in range(n_levels):
        # roots of the lower forests stand one below a cut; what their cut's upper block gets is their total so far
        forests = totals.filter((F.col("depth") > 1) & (_low_bit(F.col("depth") - 1) == 1 << k)).groupBy("parent").agg(*sums)
        cuts = nodes.filter(_low_bit(F.col("depth")) == 1 << k).select("name", "depth", "conv")
        cuts = cuts.join(forests.withColumnRenamed("parent", "name"), "name")
        way = F.sequence(F.col("depth") - (1 << k) + 1, F.col("depth"))
        steps = cuts.select("conv", F.explode(way).alias("pos"), "n_leaves", "saved_tokens").join(paths, ["conv", "pos"])
        gained = steps.groupBy("name", "parent", F.col("pos").alias("depth")).agg(*sums)
        totals = totals.unionByName(written(gained.select(totals.columns), f"grafts-{k}"))
    return totals.groupBy("name").agg(*sums)


def end_digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256``: digest of the ids (``name, conv``) of each name, ascending, joined by commas.

    Ids are joined to texts by chunks of the order over all ids, and a name's few texts are hashed one after the other as they come in
    order: a name with very many ids holds no more than one chunk's text at a time.
    """
    placed = numbered(ends, "conv", name="place").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    texts = written(placed.groupBy("name", "chunk").agg(ids.alias("ids")), "end-chunks")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if own != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if len(done) >= 1024:
                yield _table(done)
                done = []
        if digest is not None:
            done.append((name, digest.hexdigest()))
        if done:
            yield _table(done)

    ordered = texts.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids")
    return ordered.mapInArrow(hashed, "name binary, ends_sha256 string")


def _table(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    names, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, the root (depth 0) included.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    turns, convs = rebuilt(turns_in_order(conversations))
    turns, convs = written(turns, "rebuilt-turns"), written(convs, "rebuilt-lengths")
    n_convs, first, depth = convs.agg(F.count(F.lit(1)), F.min("conv"), F.coalesce(F.max("len"), F.lit(0))).first()
    levels = block_levels(turns, depth)
    names = prefix_names(levels)
    members = names.groupBy("name").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("pos").alias("depth"), F.max("w").alias("w")
    )
    above = names.select("conv", (F.col("pos") + 1).alias("pos"), F.col("name").alias("parent"))
    paths = names.select("conv", "pos", "name").join(above, ["conv", "pos"], "left")
    paths = written(paths.withColumn("parent", F.coalesce("parent", F.lit(_ROOT))), "paths")
    members = members.join(paths.select("conv", F.col("pos").alias("depth"), "name", "parent"), ["conv", "depth", "name"])
    members = written(members, "members")
    children = members.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = members.join(written(children, "children"), "name", "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns(
        {"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("w")}
    )
    nodes = written(nodes, "nodes")
    totals = written(grafted(nodes, paths, len(levels)), "totals")
    ends = names.filter("pos = len").select("name", "conv").unionByName(
        convs.filter("len = 0").select(F.lit(_ROOT).alias("name"), "conv")
    )
    digests = written(end_digests(written(ends, "ends")), "end-digests")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    parents = parents.unionByName(convs.sparkSession.createDataFrame([(_ROOT, first)], "parent binary, parent_conv_id bigint"))
    rows = nodes.join(totals, "name").join(parents, "parent").select(
        "name", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    )
    tops = nodes.filter("depth = 1").join(totals, "name")
    root = tops.agg(
        F.lit(_ROOT).alias("name"),
        F.lit(first).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(n_convs).cast("bigint").alias("n_convs"),
        F.count(F.lit(1)).alias("n_children"),
        F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    ).filter(F.col("n_convs") > 0)
    none = hashlib.sha256().hexdigest()
    return rows.unionByName(root).join(digests, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def prefix_trie_sql() -> str:
    """DuckDB SQL for the rows of ``prefix_trie`` on conversations: whole prefixes spelled out, each node added to all its ancestors."""
    from cohortloom.llm.target_resampling import crc32_sql

    return rf"""
WITH RECURSIVE spelled AS (
  SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS e,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id AS conv, sha256(e) AS e, w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(e)) AS pos FROM spelled
), own AS (
  SELECT conv, count(*) AS n, conv - conv % {FAMILY} AS head FROM turns GROUP BY conv
), {crc32_sql("SELECT DISTINCT conv_id::VARCHAR AS word FROM spelled")}, convs AS (
  SELECT o.conv, o.head, o.n, crc % {LENT} AS h, least(coalesce(p.n, 0), crc % {LENT}) AS taken
  FROM own o JOIN crcs ON word = o.conv::VARCHAR LEFT JOIN own p ON p.conv = o.head
), rebuilt AS (
  SELECT c.conv, t.pos, t.e, t.w FROM convs c JOIN turns t ON t.conv = c.head AND t.pos <= c.taken
  UNION ALL SELECT c.conv, t.pos - c.h + c.taken, t.e, t.w FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos > c.h
), prefixes AS (
  SELECT conv, 0 AS pos, '' AS name, 0 AS w FROM convs
  UNION ALL
  SELECT conv, pos, sha256(array_to_string(list(e) OVER (PARTITION BY conv ORDER BY pos), ',')), w FROM rebuilt
), trail AS (
  SELECT *, lag(name) OVER (PARTITION BY conv ORDER BY pos) AS parent,
    pos = max(pos) OVER (PARTITION BY conv) AS ends FROM prefixes
), nodes AS (
  SELECT name, min(conv) AS conv, any_value(pos) AS depth, count(*) AS n_convs, any_value(w) AS w, any_value(parent) AS parent,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256
  FROM trail GROUP BY name
), children AS (
  SELECT parent AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), totals AS (
  SELECT a.name, sum((c.n IS NULL)::INT) AS n_leaves, sum((d.n_convs - 1) * d.w) AS saved
  FROM nodes d LEFT JOIN children c USING (name) JOIN trail a ON a.conv = d.conv AND a.pos <= d.depth GROUP BY a.name
)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, p.conv AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t USING (name) LEFT JOIN children c USING (name) LEFT JOIN nodes p ON p.name = n.parent AND n.depth > 0
"""
