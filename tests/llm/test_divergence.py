"""Source divergence against plain counting, with runs, shards, stretches and tiles small enough to be met."""

import random
import re
from collections import Counter, defaultdict

import pytest

from taskweave.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def by_hand(rows, least, most):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(lower(text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    out = []
    smoothed = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang in {g[0] for g in groups}:
        terms, v = kept[lang], len(kept[lang])
        own = {s: {t: c[t] for t in terms} for (g, s), c in groups.items() if g == lang}
        p = {s: {t: smoothed(n, sum(c.values()), v) for t, n in c.items()} for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in terms}
        q = {t: smoothed(n, sum(whole.values()), v) for t, n in whole.items()}
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in own if o != s]
            above = [(t, p[s][t] - q[t]) for t in terms if own[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", above, most)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:limit], 1)]
    return sorted(out)


def documents(seed, n, sources):
    rng = random.Random(seed)
    words = [a + b for a in ["The", "é", "zu", "ÉA", "x1y", "ß", "-"] for b in ["", "ka", "Lo", "n"]]
    langs = ["a", "b", None, ""]
    text = lambda: rng.choice([None, "", "!! 12"] + [" ".join(rng.choices(words, k=rng.randint(1, 60)))] * 9)
    rows = [(rng.choice(langs), rng.choice([None, "", "hot", "hot"] + [f"s{i}" for i in range(sources)]), text()) for _ in range(n)]
    return rows + rows[: n // 5] + [("lonely", "one", "few words"), ("lonely", "two", None), ("bare", "only", None)]


def audit(spark, rows, partitions=3, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, term string")
    got = divergence.audit_sources(df.repartition(partitions), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_against_counting(spark):
    rows = documents(1, 300, 4)
    assert audit(spark, rows, least_docs=8, most_terms=6) == by_hand(rows, 8, 6)


def test_many_runs_and_few_shards(spark):
    rows = documents(2, 400, 9)
    assert audit(spark, rows, partitions=5, least_docs=2, most_terms=50, block=20, shards=3) == by_hand(rows, 2, 50)


def merged(rows, least, block, shards, stretch, slice_, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "STRETCH", stretch)
    monkeypatch.setattr(divergence, "SLICE", slice_)
    batch = pa.RecordBatch.from_pydict({"l": [r[0] for r in rows], "s": [r[1] for r in rows], "t": [r[2].encode() for r in rows]})
    runs = [r for b in divergence.index_blocks(iter([batch]), shards, block) for r in b.to_pylist()]
    runs.sort(key=lambda r: (r["shard"], r["lang"], r["first"]))
    schema = next(divergence.index_blocks(iter([batch]), shards, block)).schema
    fed = (pa.RecordBatch.from_pylist([r], schema=schema) for r in runs)
    return {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"])) for b in divergence.merge_runs(fed, least) for r in b.to_pylist()}


@pytest.mark.parametrize("block, stretch, slice_", [(3, 1, 5), (10, 2, 30), (100_000, 7, 1 << 20)])
def test_index_is_the_same_for_every_memory(block, stretch, slice_, monkeypatch):
    rows = [(a or "", b or "", c or "") for a, b, c in documents(3, 120, 3)]
    got = merged(rows, 4, block, 3, stretch, slice_, monkeypatch)
    counts, docs = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        for t in found:
            counts[lang, t.encode()][source] += 1
        docs.update({(lang, t.encode()) for t in found})
    want = {k: dict(c) for k, c in counts.items() if docs[k] >= 4}
    assert {k: v for k, v in got.items() if k[1]} == want
    assert {(k[0], s) for k, v in got.items() if not k[1] for s in v} == {r[:2] for r in rows}


def test_tiles_are_passed_on(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "TILES", 2)
    rng = np.random.default_rng(1)
    b = rng.integers(1, 50, 11)
    rows, want = [], Counter()
    for _ in range(40):
        places = rng.permutation(11)[: rng.integers(1, 11)]
        p = b[places] + rng.integers(0, 99, len(places))
        rows.append({"lang": "x", "places": places.tolist(), "p": p.tolist(), "b": b[places].tolist()})
        value = dict(zip(places.tolist(), p.tolist()))
        for i in value:
            for j in value:
                if i < j:
                    alone = abs(value[i] - b[j]) + abs(value[j] - b[i]) - abs(b[i] - b[j])
                    want[i, j] += int(abs(value[i] - value[j]) - alone)
    got = Counter()
    for batch in divergence.stream_corrections(iter([pa.RecordBatch.from_pylist(rows)])):
        for r in batch.to_pylist():
            got[r["i"], r["j"]] += r["both"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_table_and_no_kept_terms(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit_sources(empty).count() == 0
    rows = [("a", "x", "one two"), ("a", "y", None), ("a", None, "one")]
    assert audit(spark, rows) == sorted(
        [("a", s, "pair", o, 0, r) for s, others in {"": "xy", "x": ["", "y"], "y": ["", "x"]}.items() for r, o in enumerate(others, 1)]
    )


def test_counts_beyond_long_arithmetic(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(800_000_000_000, 9_000_000_000_000, 70_000_000)], "c long, n long, v long")
    got = big.select(divergence._smoothed(F.col("c"), F.col("n"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (800_000_000_000 + 5) // (9_000_000_000_000 + 5 * 70_000_000)
