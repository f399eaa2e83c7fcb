"""The trie of turn sequences against building it turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import __spark_entry__ as entry
from taskweave.llm import prefixtrie


def trie_by_hand(sequences):
    """``sequences``: {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = own + sum(saved[k] for k in children[path])
    rows = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(path))
        rows.append(
            (min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path], saved[path],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def sequences_of(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in by.items()}


def rebuilt(original):
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = original.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(seed, n=60):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "", None], ["a", "b", "é", "", None]
    start = [(i, rng.choice(roles), rng.choice(texts)) for i in range(6)]
    rows = []
    for c in range(-4, n):
        if c % 7 == 3:
            continue
        k = rng.choice([1, 2, 3, 5, 8, 9, 16, 21])
        turns = start[: rng.randint(0, 6)]
        turns = [*turns, *((i, rng.choice(roles[:2]), rng.choice(texts)) for i in range(len(turns), k))]
        rows += [(c, *t) for t in turns]
        if c % 11 == 0:
            rows += [(c, None, "user", "first"), (c, 2, "user", "tie"), (c, 2, "user", "tie"), (c, 2, None, None)]
    return rows + [(None, 0, "user", "nobody's"), (None, None, None, None), (900, 0, "user", "long" * 9000), (901, 0, "user", "long" * 9000)]


def table_of(spark, rows):
    rows = [(*r, "x", 7) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string, depth int").repartition(5)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_against_turn_by_turn(spark):
    rows = rows_of(1)
    assert found(prefixtrie.conversation_trie(table_of(spark, rows))) == trie_by_hand(sequences_of(rows))


def test_rebuilt_conversations_with_turnless_ones(spark):
    rows = rows_of(2, 45)
    want = rebuilt(sequences_of(rows))
    assert any(not turns for turns in want.values())
    turns = prefixtrie.ordered_turns(table_of(spark, rows))
    assert found(prefixtrie.prefix_trie(*prefixtrie.shared_starts(turns))) == trie_by_hand(want)


def test_only_turnless_single_and_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, pos long, role string, text string")
    members = spark.createDataFrame([(10, 0), (9, 0)], "conv_id long, turns long")
    ends = hashlib.sha256(b"9,10").hexdigest()
    assert found(prefixtrie.prefix_trie(turns, members)) == [(9, 0, None, 2, 0, 1, 0, ends)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(prefixtrie.conversation_trie(empty)) == []
    one = [(5, 0, "user", "hi")]
    assert found(prefixtrie.conversation_trie(table_of(spark, one))) == trie_by_hand(sequences_of(one))


def test_many_members_of_one_node(spark):
    rows = [(c, t, "user", "same") for c in range(400) for t in range(1 + c % 2)]
    assert found(prefixtrie.conversation_trie(table_of(spark, rows))) == trie_by_hand(sequences_of(rows))


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(entry.queries()["op11_prefix_trie"](spark, sf_dir)) == trie_by_hand(rebuilt(sequences_of(rows)))
