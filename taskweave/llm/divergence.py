"""Operator 13, source divergence audit: how far the word use of a language's sources is apart, and by which words.

**Index.** Every task reads its documents once and counts, in memory, the terms of each (lang, source): occurrences
and documents. When ``block`` entries are held, the block is spilled as a run: sorted by (shard, lang, term) and cut into
short sorted stretches, one row each. The shard is a hash of the term, so all that runs know of a term meets in one
shard, already summed per run. There the stretches come in the order of their first terms and a heap merges them: a
stretch is opened when its first term is reached and closed when it is used up, so a task holds the open stretches
only. A term that too few documents of its language have ends there; the others are written with their postings, a source and a
count each.

**Arithmetic.** p = 1 + floor(10^9 (count + 5) / (N + 5 V)) in whole numbers (decimals of 38 digits).

**Pairs.** A source that lacks a term still has the smoothed value b there, the same for all terms it lacks. So
the distance of two sources is V |b_s - b_t|, plus for each term one of them has a correction of its own that needs
b of the other alone, plus for each term both have a correction of the pair. The first kind comes from running sums over each
source's distinct values; the second is streamed: postings go by once, and a task adds their corrections into tiles of a
matrix of sources, which it passes on and forgets when it holds too many. Work is the sum of squared posting
lengths, not terms times sources squared, and no list is longer than the number of sources.

Terms are runs of ASCII letters and characters beyond ASCII, ASCII letters in lower case. Defined results: null text,
lang and source are empty strings; rows count as documents one by one, repeated ones too; a group without terms has its
pairs; a language without kept terms has distances of 0; ties go by the item's UTF-8 bytes; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.operators.positions import head_per_group
from taskweave.staging import stage

BLOCK = 500_000  # entries a task holds before it spills a run
STRETCH = 2_048  # entries of a row of a run
SLICE = 1 << 20  # bytes of a text that are split at once
TILE, TILES = 128, 256  # sources on a side of a tile, tiles held by a task
SCALE, SMOOTH = 1_000_000_000, 5
# fixed values: bytes that end a term, and the lower case of ASCII letters
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
_RUN = (
    "shard int, lang string, first binary, names array<string>, terms array<binary>, docs array<bigint>, "
    "ends array<int>, sources array<int>, counts array<bigint>"
)
_POSTINGS = "lang string, term binary, sources array<string>, counts array<bigint>"
_GROUP = b""  # stands for the group itself, so that groups without terms are known


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    mapped, start = text.translate(_BYTES), 0
    while len(mapped) - start > SLICE:
        stop = mapped.find(b" ", start + SLICE)
        if stop < 0:
            break
        yield mapped[start:stop].split()
        start = stop
    yield (mapped[start:] if start else mapped).split()


class Block:
    """Counts of terms and of documents with them, per (lang, source)."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, terms: list[bytes], new: set[bytes]) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        held = len(counts)
        counts.update(terms)
        docs.update(new)
        self.entries += len(counts) - held

    def run(self, shards: int) -> pa.RecordBatch:
        """Everything held as sorted stretches of one shard and language each: terms, then for each its sources and counts."""
        langs, names = (sorted({g[i] for g in self.groups}) for i in (0, 1))
        terms, docs, sizes = [], [], []
        codes = np.empty((len(self.groups), 2), np.int64)
        counts: list[int] = []
        for i, ((lang, source), (count, doc)) in enumerate(self.groups.items()):
            codes[i] = langs.index(lang), names.index(source)
            own = [*doc, *(t for t in count if t not in doc)]  # a document that goes on after a spill brings the latter
            terms += own
            docs += map(doc.__getitem__, own)
            counts += map(count.__getitem__, own)
            sizes.append(len(own))
        lang, source = np.repeat(codes, sizes, axis=0).T
        coded = pa.array(terms, pa.binary()).dictionary_encode()
        distinct = coded.dictionary
        place = np.empty(len(distinct), np.int64)  # of each distinct term, by shard and then by term
        shard = np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.int64, len(distinct)) % shards
        order = pc.sort_indices(distinct).to_numpy()
        order = order[np.argsort(shard[order], kind="stable")]
        place[order] = np.arange(len(distinct))
        code = coded.indices.to_numpy()
        rows = np.lexsort((source, place[code], lang, shard[code]))
        lang, source, code, shard = lang[rows], source[rows], code[rows], shard[code][rows]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])])
        at = np.flatnonzero(new)  # first entry of each (language, term)
        new_part = np.concatenate([[True], (shard[at][1:] != shard[at][:-1]) | (lang[at][1:] != lang[at][:-1])])
        parts = np.append(np.flatnonzero(new_part), len(at))
        cuts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(parts, parts[1:])])
        per_term = pa.array(np.append(cuts, len(at)).astype(np.int32))
        firsts = at[cuts]
        per_entry = pa.array(np.append(firsts, len(code)).astype(np.int32))
        sizes = np.diff(np.append(at, len(code)))
        sizes = np.cumsum(sizes) - np.repeat(firsts, np.diff(per_term))  # ends of the terms' entries inside their stretch
        listed = pa.ListArray.from_arrays
        columns = {
            "shard": pa.array(shard[firsts].astype(np.int32)),
            "lang": pa.array(langs, pa.string()).take(pa.array(lang[firsts])),
            "first": distinct.take(pa.array(code[firsts])),
            "names": pa.array([names] * len(firsts), pa.list_(pa.string())),
            "terms": listed(per_term, distinct.take(pa.array(code[at]))),
            "docs": listed(per_term, pa.array(np.add.reduceat(np.asarray(docs, np.int64)[rows], at))),
            "ends": listed(per_term, pa.array(sizes.astype(np.int32))),
            "sources": listed(per_entry, pa.array(source.astype(np.int32))),
            "counts": listed(per_entry, pa.array(np.asarray(counts, np.int64)[rows])),
        }
        return pa.RecordBatch.from_pydict(columns)


def index_blocks(batches: Iterator[pa.RecordBatch], shards: int, block: int) -> Iterator[pa.RecordBatch]:
    """The runs of one task: rows of (lang, source, text) counted until the block is full."""
    held = Block()
    for batch in batches:
        for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            lang, source = lang.as_py(), source.as_py()
            held.add(lang, source, [], {_GROUP})  # no occurrence, one document
            seen: set[bytes] = set()  # a document counts once for a term, over all its slices and runs
            for terms in term_lists(text.as_py()):
                new = set(terms) - seen
                held.add(lang, source, terms, new)
                seen |= new
                if held.entries >= block:
                    yield from _sliced(held.run(shards))
                    held = Block()
    if held.groups:
        yield from _sliced(held.run(shards))


def _sliced(run: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, run.num_rows, rows):
        yield run.slice(at, rows)


def merge_runs(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Postings of the terms that enough documents have, from stretches sorted by (shard, lang, first term)."""
    heap: list[tuple[bytes, int, int, tuple[list, ...]]] = []  # next term, number of the stretch, place, stretch
    out: list[tuple[str, bytes, list[str], list[int]]] = []
    where: tuple[int, str] | None = None
    term: bytes | None = None
    counts: dict[str, int] = {}
    docs = opened = 0

    def close() -> None:
        nonlocal term
        if term is not None and (docs >= least_docs or term == _GROUP):
            named = sorted(counts)
            out.append((where[1], term, named, [counts[s] for s in named]))
        term = None

    def advance(limit: bytes | None) -> None:
        """Use up what is below ``limit``, or everything."""
        nonlocal term, counts, docs
        while heap and (limit is None or heap[0][0] < limit):
            found, number, at, stretch = heap[0]
            names, terms, term_docs, ends, sources, numbers = stretch
            if found != term:
                close()
                term, counts, docs = found, {}, 0
            docs += term_docs[at]
            for i in range(ends[at - 1] if at else 0, ends[at]):
                source = names[sources[i]]
                counts[source] = counts.get(source, 0) + numbers[i]
            if at + 1 < len(terms):
                heapreplace(heap, (terms[at + 1], number, at + 1, stretch))
            else:
                heappop(heap)

    for batch in batches:
        for row in range(batch.num_rows):
            shard, lang, first, names, terms = (column[row].as_py() for column in batch.columns[:5])
            lists = (names, terms, *(column[row].values.to_numpy().tolist() for column in batch.columns[5:]))
            if (shard, lang) != where:
                advance(None)
                close()
                where = (shard, lang)
            else:
                advance(first)
            heappush(heap, (first, opened, 0, lists))
            opened += 1
            if len(out) >= 4_096:
                yield _postings(out)
                out.clear()
    advance(None)
    close()
    if out:
        yield _postings(out)


def _postings(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "term", "sources", "counts"])


def stream_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, places, p, b), a term each, into sums of what pairs of sources that both have it must add."""
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), tile in tiles.items():
            i, j = np.nonzero(tile)
            left, right = i + a * TILE, j + b * TILE
            once = left < right
            names = pa.array([lang] * int(once.sum()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(left[once].astype(np.int32)), pa.array(right[once].astype(np.int32)), pa.array(tile[i, j][once])],
                names=["lang", "i", "j", "both"],
            )
        tiles.clear()

    for batch in batches:
        for lang, places, p, b in zip(*batch.columns):
            lang = lang.as_py()
            places, p, b = (c.values.to_numpy(zero_copy_only=False) for c in (places, p, b))
            order = np.argsort(places)
            places, p, b = places[order], p[order], b[order]
            cuts = np.flatnonzero(np.diff(places // TILE)) + 1
            parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]))
            for x, (lo, hi) in enumerate(parts):
                for low, high in parts[x:]:
                    key = (lang, int(places[lo]) // TILE, int(places[low]) // TILE)
                    tile = tiles.get(key)
                    if tile is None:
                        if len(tiles) >= TILES:
                            yield from passed_on()
                        tile = tiles[key] = np.zeros((TILE, TILE), np.int64)
                    ps, bs, pt, bt = p[lo:hi, None], b[lo:hi, None], p[None, low:high], b[None, low:high]
                    tile[np.ix_(places[lo:hi] % TILE, places[low:high] % TILE)] += (
                        np.abs(ps - pt) - np.abs(ps - bt) - np.abs(pt - bs) + np.abs(bs - bt)
                    )
    yield from passed_on()


def _smoothed(count: Column, total: Column, terms: Column) -> Column:
    """p, exactly; null without terms."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    down = (total + SMOOTH * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", up, F.when(down > 0, down))


def source_index(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    least_docs: int = 30, block: int = BLOCK, shards: int | None = None,
) -> DataFrame:
    """Postings ``lang, term, sources, counts`` of the terms that enough documents have; the empty term lists the groups."""
    require_columns(docs, lang, source, text)
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text).cast("string"), empty).cast("binary").alias("text"),
    )
    runs = rows.mapInArrow(partial(index_blocks, shards=shards, block=block), _RUN)
    sorted_runs = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    merged = sorted_runs.mapInArrow(partial(merge_runs, least_docs=least_docs), _POSTINGS)
    return stage(merged.withColumn("term", F.col("term").cast("string")), "postings")


def audit_sources(docs: DataFrame, most_terms: int = 50, **index) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to other sources (``pair``), words used most above the language (``term``)."""
    posts = source_index(docs, **index)
    kept = posts.where(F.col("term") != "").withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    entries = kept.select("lang", "term", "total", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count"))))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sums = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    places = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stage(
        posts.where(F.col("term") == "").select("lang", F.explode("sources").alias("source"))
        .join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["terms", "lang_n", "n"])
        .withColumn("place", places).withColumn("b", _smoothed(F.lit(0), F.col("n"), F.col("terms"))),
        "groups",
    )
    facts = stage(
        entries.join(groups, ["lang", "source"]).select(
            "lang", "source", "place", "term", "b",
            _smoothed(F.col("count"), F.col("n"), F.col("terms")).alias("p"),
            _smoothed(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"),
        ),
        "facts",
    )
    above = facts.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = head_per_group(above, ["lang", "source"], [F.desc("value"), F.asc("item")], most_terms, rank="rank")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = distances(groups, facts).withColumn("rank", ranked)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(*out)
        .unionByName(top.withColumn("part", F.lit("term")).select(*out))
        .withColumn("rank", F.col("rank").cast("int"))
    )


def distances(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways; the result is as long as that."""
    left = groups.select("lang", F.col("place").alias("i"), "source", F.col("b").alias("bi"), "terms")
    right = groups.select("lang", F.col("place").alias("j"), F.col("source").alias("item"), F.col("b").alias("bj"))
    pairs = left.join(right, "lang").where(F.col("i") != F.col("j"))

    # what the terms of i add against the smoothed value of j: running sums over i's distinct values
    values = facts.groupBy("lang", F.col("place").alias("i"), F.col("p").alias("x")).agg(F.count("*").alias("n"))
    known = values.groupBy("lang", "i").agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("x")).alias("all_p"))
    asked = pairs.select("lang", "i", F.col("bj").alias("x"), F.lit(0).cast("long").alias("n"), "j", "bi")
    line = values.select("*", F.lit(None).cast("int").alias("j"), F.lit(None).cast("long").alias("bi")).unionByName(asked)
    up_to = Window.partitionBy("lang", "i").orderBy("x", "j").rowsBetween(Window.unboundedPreceding, 0)
    run = line.select(
        "*", F.sum("n").over(up_to).alias("low_n"), F.sum(F.col("n") * F.col("x")).over(up_to).alias("low_p")
    ).where(F.col("j").isNotNull())
    x, low_n, low_p, all_n, all_p = map(F.col, ("x", "low_n", "low_p", "all_n", "all_p"))
    far = (all_p - low_p) - x * (all_n - low_n) + x * low_n - low_p
    alone = run.join(known, ["lang", "i"]).select("lang", "i", "j", (far - all_n * F.abs(F.col("bi") - x)).alias("own"))

    lists = facts.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "b")).alias("l")).where(F.size("l") > 1)
    both = (
        lists.select("lang", F.col("l.place").alias("places"), F.col("l.p").alias("p"), F.col("l.b").alias("b"))
        .mapInArrow(stream_corrections, "lang string, i int, j int, both bigint")
    )
    zero = F.lit(0).cast("long")
    each_way = alone.unionByName(alone.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "own"))
    shared = both.select("lang", "i", "j", F.col("both").alias("own")).unionByName(
        both.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("both").alias("own"))
    )
    added = each_way.unionByName(shared).groupBy("lang", "i", "j").agg(F.sum("own").alias("own"))
    apart = F.coalesce(F.col("terms") * F.abs(F.col("bi") - F.col("bj")), zero)
    return pairs.join(added, ["lang", "i", "j"], "left").select(
        "lang", "source", "item", (apart + F.coalesce("own", zero)).cast("long").alias("value")
    )


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q FROM kept JOIN sizes USING (lang)),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT lang, source, term, coalesce(found.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN found USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM every GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (totals.total + 5 * v) AS p
      FROM every JOIN totals USING (lang, source) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query(OP13_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))
