"""Operator 11, conversation prefix trie: the trie of all prefixes of turn sequences, by van Emde Boas recursion.

A trie of depth 2h is cut at depth h: an upper trie of the first halves, and below each cut prefix a lower one of what
follows it. Both are cut again, until they are one turn deep. All tries of one size are worked on in the same jobs, so
the recursion takes as many rounds as the depth has binary digits, and a conversation's turns are rows throughout: no
conversation and no group of conversations has to fit into a task.

*Naming.* Upwards, two neighbouring blocks of 2^j turns make a block of 2^(j+1), named by the SHA-256 of their names; a
turn is named by that of its role and text. Downwards, from the largest size, the cut prefix at depth a + h is named by the
name of the prefix at depth a, which an earlier round has given, and the name of the block of h turns after it. A depth
d is the cut of just one size, the largest power of two that divides it, so a prefix is named once. Names are digests;
two prefixes are one node where they agree.

*Totals.* Upwards again, from the smallest size: the totals of a lower trie are held by its top, which is a bottom of the upper
trie, and are grafted onto that trie's nodes, the top's ancestors down from the upper trie's own top.

Nodes with a third of all conversations are met in counts with map-side combining; the ids that end at one node are
hashed as a sorted stream, a task holds one batch of them.

Defined results: a null role or text is empty; turns are ordered by turn (null first), role, text, repeated rows stay;
rows without a conversation id belong to none; a conversation without turns is a member of the root alone; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.operators.positions import with_position
from taskweave.staging import stage

ROOT = bytes(32)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, role, text``: turns numbered from 1; a conversation may span any number of tasks."""
    require_columns(turns, conv, turn, role, text)
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    placed = with_position(rows, ["turn", "role", "text"], group=["conv_id"])
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "role", "text")


def _named_blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per size 2^j the full blocks that a depth can be cut after: ``conv_id, start, block``."""
    own = _digest(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"))
    blocks = stage(turns.select("conv_id", (F.col("pos") - 1).alias("at"), F.col("turns"), own.alias("block")), "trie-blocks-0")
    out = []
    for j in range(levels):
        # the left one of two neighbours starts where a trie of the next size starts
        out.append(blocks.where(F.col("at") % 2 == 0).select("conv_id", F.shiftleft("at", j).alias("start"), "turns", "block"))
        if j + 1 < levels:
            pair = blocks.where(F.shiftright("turns", j + 1) > F.shiftright("at", 1)).groupBy(
                "conv_id", F.shiftright("at", 1).alias("at"), "turns"
            )
            left, right = (F.max(F.when(F.col("at") % 2 == side, F.col("block"))) for side in (0, 1))
            blocks = stage(pair.agg(_digest(left, right).alias("block")), f"trie-blocks-{j + 1}")
    return out


def _named_prefixes(turns: DataFrame, levels: int) -> DataFrame:
    """``conv_id, depth, name, turns`` of every prefix of at least a turn."""
    blocks = _named_blocks(turns, levels)
    named: list[DataFrame] = []
    for j in range(levels - 1, -1, -1):
        cut = blocks[j]
        tops = [n.where(F.col("turns") >= F.col("depth") + (1 << j)).select("conv_id", F.col("depth").alias("start"), "name") for n in named]
        first = cut.where(F.col("start") == 0).withColumn("name", F.lit(ROOT))
        later = cut.where(F.col("start") > 0)
        both = first
        if tops:
            known = tops[0]
            for more in tops[1:]:
                known = known.unionByName(more)
            both = first.unionByName(later.join(known, ["conv_id", "start"]).select(*first.columns))
        depth = (F.col("start") + (1 << j)).alias("depth")
        named.append(stage(both.select("conv_id", depth, _digest("name", "block").alias("name"), "turns"), f"trie-names-{j}"))
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each name, from rows sorted by name and id."""
    name, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(names):
            stop = start
            while stop < len(names) and names[stop] == names[start]:
                stop += 1
            joined = ",".join(map(str, ids[start:stop])).encode()
            if names[start] == name:
                digest.update(b"," + joined)
            else:
                if digest is not None:
                    yield row()
                name, digest = names[start], hashlib.sha256(joined)
            start = stop
    if digest is not None:
        yield row()


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per node of the trie of ``turns`` (conv_id, pos from 1 without gaps, role, text).

    ``members``: (conv_id, turns), all conversations and their numbers of turns, turnless ones included.
    """
    turns = turns.join(members, "conv_id")
    deepest = members.agg(F.coalesce(F.max("turns"), F.lit(0))).first()[0]
    levels = int(deepest).bit_length()
    if levels:
        paths = _named_prefixes(turns, levels)
    else:
        paths = members.select("conv_id", F.lit(1).cast("long").alias("depth"), F.lit(ROOT).alias("name"), "turns").limit(0)
    whole = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), "turns")
    paths = stage(paths.unionByName(whole), "trie-paths")

    # a node's smallest member leads to its last turn and its parent
    counted = paths.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv_id", F.col("pos").alias("depth"), F.octet_length("text").cast("long").alias("bytes"))
    nodes = stage(
        counted.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"), "trie-nodes"
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, "name", "left").fillna(0, ["n_children"]), "trie-children")

    totals = nodes.select(
        "name", "depth", "conv_id",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved_tokens"),
    )
    for j in range(levels):
        totals = stage(_grafted(totals, paths, 1 << j), f"trie-totals-{j}")

    ends = paths.where(F.col("depth") == F.col("turns")).select("name", "conv_id")
    hashed = ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_hash_streams, "name binary, ends_sha256 string")
    up = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals.select("name", "n_leaves", "saved_tokens"), "name")
        .join(hashed, "name", "left")
        .join(up, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )


def _grafted(totals: DataFrame, paths: DataFrame, half: int) -> DataFrame:
    """``totals`` of the tries of depth ``2 * half``, from those of both halves.

    The tops of the lower halves lie at odd multiples of ``half``; what they hold is added to their ``half`` ancestors.
    """
    tops = totals.where((F.col("depth") > 0) & (F.col("depth") % (2 * half) == half)).select(
        "conv_id", F.col("depth").alias("cut"), "n_leaves", "saved_tokens"
    )
    reached = tops.withColumn("depth", F.explode(F.sequence(F.col("cut") - half, F.col("cut") - 1)))
    upper = paths.where((F.col("turns") >= half) & (F.floor(F.col("depth") / half) % 2 == 0)).select("conv_id", "depth", "name")
    added = reached.join(upper, ["conv_id", "depth"]).groupBy("name").agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
    )
    zero = F.lit(0)
    return totals.join(added, "name", "left").select(
        "name", "depth", "conv_id",
        (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
    )


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of a table of turns."""
    rows = stage(ordered_turns(turns, conv, turn, role, text), "turns")
    return prefix_trie(rows, rows.groupBy("conv_id").agg(F.count("*").alias("turns")))


def shared_starts(rows: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that neighbours share their first turns: turns and (conv_id, turns).

    Conversation c takes its first h turns from conversation c - c mod ``every`` (all if there are fewer, none if there is none), h being
    crc32 of c in decimal modulo ``most``, and goes on with its own turns after its first h.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    plan = sizes.withColumn("h", h).withColumn("origin", F.col("conv_id") - F.pmod("conv_id", F.lit(every)))
    given = sizes.select(F.col("conv_id").alias("origin"), F.col("own").alias("given"))
    plan = stage(
        plan.join(given, "origin", "left").withColumn("head", F.least("h", F.coalesce("given", F.lit(0)))), "trie-plan"
    )
    heads = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("origin"), "pos", "role", "text")
    taken = plan.join(heads, "origin").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "role", "text")
    own = (
        rows.join(plan.select("conv_id", "h", "head"), "conv_id").where(F.col("pos") > F.col("h"))
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "role", "text")
    )
    members = plan.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("turns"))
    return stage(taken.unionByName(own), "trie-turns"), members


OP11_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
plan AS (
  SELECT c, c - ((c % 5) + 5) % 5 AS origin,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 9 AS h
  FROM ids, crc_table),
original AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT p.c, 0 AS part, o.i, role, text FROM plan p JOIN original o ON o.c = p.origin AND o.i <= h
  UNION ALL SELECT p.c, 1, o.i, role, text FROM plan p JOIN original o ON o.c = p.c AND o.i > h),
paths AS (
  SELECT c, row_number() OVER w AS depth, list([role, text]) OVER (w ROWS UNBOUNDED PRECEDING) AS path, text
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, i)
  UNION ALL SELECT c, 0, [], '' FROM ids),
lengths AS (SELECT c, max(depth) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS bytes,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n) AS ends
  FROM paths JOIN lengths USING (c) GROUP BY path, depth),
linked AS (
  SELECT a.*, b.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = a.depth + 1 AND k.path[1:a.depth] = a.path) AS n_children
  FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND a.path[1:a.depth - 1] = b.path),
sums AS (
  SELECT a.path, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM linked a JOIN linked b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM linked JOIN sums USING (path, depth)
"""


@query(OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*shared_starts(rows))
