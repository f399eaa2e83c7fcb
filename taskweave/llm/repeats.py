"""Places where a fixed number of units (words, bytes) in a row may occur in another document too.

Substring operators only need the parts of a corpus that can repeat. They are found exactly, without shuffling a row
per position:

1. Units are hashed, and of every window the smallest hash of ``gram`` units in a row is its *anchor*. Equal windows
   have equal anchors, and neighbouring windows mostly share theirs.
2. Documents (but for copies of whole texts) are dealt into chunks of a few megabytes. A chunk sends the distinct anchors it holds, mixed and packed in one
   binary row for each bucket of values, so an anchor that every document holds is sent once a chunk.
   They are sorted, so that only the differences of their first 44 bits are sent, compressed.
3. A bucket answers every chunk with one bit for each anchor: does it occur in another chunk, or in two documents of
   this one?
4. A chunk keeps the windows whose anchor has that bit, and gives them out as *pieces*: a run of windows with
   the same anchor, with the units they cover.

A window that occurs in two documents is in a piece of both, under the same anchor; what else the pieces hold is sorted
out by the operator. Copies of a piece inside a chunk carry their content once. Texts cross a shuffle compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.staging import stage

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@dataclass(frozen=True)
class Units:
    """What a text is made of, and how its parts are written in a piece."""

    #: texts -> hash of every unit (uint64), first unit of each text (one more than texts), content of units [a, b) of text t
    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, Callable[[int, int, int], bytes]]]
    #: content -> hash of every unit
    again: Callable[[bytes], np.ndarray]
    #: content, first unit, end unit -> content
    part: Callable[[bytes, int, int], bytes]
    window: int
    gram: int
    chunk_bytes: int = 6 << 20


def mix(h: np.ndarray, turn: int = 0) -> np.ndarray:
    """A hash of hashes; each ``turn`` orders them anew."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[turn % 5]) + np.uint64(turn)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[(turn + 1) % 5])
    return h ^ (h >> np.uint64(32))


def grams(units: np.ndarray, n: int, turn: int = 0) -> np.ndarray:
    """Hash of the ``n`` units from each place on, put together from those of 1, 2, 4, ... units."""
    count = len(units) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power, size, piece = np.uint64(_ODD[4]), 1, units
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                part = piece[done : done + count]
                out = part.copy() if out is None else out * power + part
                done += size
            if size * 2 > n:
                break
            piece = piece[:-size] * power + piece[size:]
            power, size = power * power, size * 2
    return np.minimum(mix(out, turn), _TOP - np.uint64(1))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` values in a row, from those of 1, 2, 4, ... values."""
    if len(values) < size:
        return np.empty(0, values.dtype)
    low, reach = values, 1
    while reach * 2 <= size:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    rest = size - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchored(
    units: np.ndarray, starts: np.ndarray, window: int, gram: int, at_once: int = 1 << 16, turn: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchors, the first windows and the ends; no run leaves its text.

    Texts are taken ``at_once`` units at a time, so that what is in hand stays small; a longer text is taken by itself.
    """
    found = []
    at = 0
    while at + 1 < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + at_once, side="right")) - 1)
        base = starts[at]
        low = sliding_min(grams(units[base : starts[stop]], gram, turn), window - gram + 1)
        # the windows of each text that start in its last units would run into the next text
        ends = np.repeat(starts[at + 1 : stop + 1] - base, np.diff(starts[at : stop + 1]))[: len(low)]
        first, end = runs(np.arange(len(low)) + window <= ends, low)
        found.append((low[first], first + base, end + base))
        at = stop
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([e, *parts]) for e, parts in zip((empty.astype(np.uint64), empty, empty), zip(*found) if found else ((), (), ())))


def runs(keep: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of kept places with one value."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (value[at[1:]] != value[at[:-1]])) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 1


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with each ``text`` compressed, and its ``n_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary())
            small = pa.array([codec.compress(t.as_buffer(), asbytes=True) for t in texts], pa.binary())
            yield batch.set_column(at, "text", small).append_column("n_bytes", pc.binary_length(texts))

    fields = [f"`{c}` {'binary' if c == 'text' else t}" for c, t in docs.dtypes]
    return docs.mapInArrow(run, ", ".join([*fields, "n_bytes int"]))


def unpacked(texts: pa.Array | pa.ChunkedArray, sizes: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts that ``packed`` compressed."""
    codec = pa.Codec("zstd", 1)
    whole = [codec.decompress(t.as_buffer(), n, asbytes=True) for t, n in zip(texts, sizes.to_pylist())]
    return pa.array(whole, pa.binary()).view(pa.string())


def _unpacked(table: pa.Table) -> pa.Table:
    texts = unpacked(table.column("text"), table.column("n_bytes"))
    return table.set_column(table.schema.get_field_index("text"), "text", texts).drop_columns(["n_bytes"])


def _name(content: bytes) -> int:
    name = xxhash.xxh3_64_intdigest(content)
    return name - (1 << 64) if name >> 63 else name


def _anchors_of(table: pa.Table, copies: pa.Table, units: Units):
    """The texts of a chunk but for copies, in the order of their documents, and their runs."""
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
    if copies.num_rows:
        known = set(zip(copies.column("doc_id").to_pylist(), copies.column("text_hash").to_pylist()))
        pairs = zip(table.column("doc_id").to_pylist(), table.column("text_hash").to_pylist())
        table = table.filter(pa.array([pair not in known for pair in pairs], pa.bool_()))
    texts = table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    hashes, starts, content = units.read(texts)
    return table, starts, content, anchored(hashes, starts, units.window, units.gram)


def _value_rows(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each bucket among the sorted values; a bucket is a range of values.

    Anchors are smallest hashes and crowd at the low end: they are mixed before, one to one, and spread evenly.
    """
    bounds = (np.arange(buckets + 1, dtype=np.float64) / buckets * 2.0**64).clip(max=2.0**64 - 2049)
    at = np.searchsorted(distinct, bounds.astype(np.uint64)).astype(np.int64)
    at[0], at[-1] = 0, len(distinct)
    return at[:-1], at[1:]


_SPARE = np.uint64(20)


def _squeezed(values: np.ndarray) -> bytes:
    """Ascending values but for their last bits, as compressed differences, byte by byte."""
    steps = np.diff(values >> _SPARE, prepend=np.uint64(0))
    return pa.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _stretched(data: bytes, count: int) -> np.ndarray:
    """The values of ``_squeezed``, their last bits zero; different ones may have become equal."""
    planes = np.frombuffer(pa.decompress(data, count * 8, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64) << _SPARE


def _send(table: pa.Table, copies: pa.Table, units: Units, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _SENT.empty_table()
    chunk = table.column("chunk")[0].as_py()
    table, starts, _, (anchors, first, _) = _anchors_of(table, copies, units)
    ids = table.column("doc_id").to_numpy()
    mixed = mix(anchors)
    order = np.argsort(mixed, kind="stable")  # documents stay in ascending order
    value = mixed[order]
    doc = ids[np.searchsorted(starts, first[order], side="right") - 1] if len(order) else order
    at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
    last = np.concatenate([at[1:], [len(value)]])[: len(at)] - 1
    distinct, many = value[at], doc[at] != doc[last]
    lo, hi = _value_rows(distinct, buckets)
    rows = [
        (chunk, b, int(j - i), _squeezed(distinct[i:j]), np.packbits(many[i:j]).tobytes())
        for b, (i, j) in enumerate(zip(lo, hi))
        if i < j
    ]
    return pa.Table.from_pylist([dict(zip(_SENT.names, r)) for r in rows], schema=_SENT)


_SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("anchors", pa.binary()), ("many", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("repeated", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    parts = [_stretched(a, n) for a, n in zip(table.column("anchors").to_pylist(), table.column("n").to_pylist())]
    many = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(p)] for m, p in zip(table.column("many").to_pylist(), parts)]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    value = every[order]
    same = value[1:] == value[:-1]
    hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    repeated = np.zeros(len(every), bool)
    repeated[order] = hit
    repeated |= np.concatenate(many).astype(bool)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    bits = [np.packbits(repeated[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])]
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_ANSWER)


#: content is given where it first stands in a chunk; ``place`` is the first window of the piece in its text
PIECES = pa.schema(
    [
        ("anchor", pa.int64()),
        ("content_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("place", pa.int32()),
        ("windows", pa.int32()),
        ("content", pa.binary()),
    ]
)
PIECES_SQL = "anchor long, content_id long, doc_id long, text_hash long, place int, windows int, content binary"


def _cut(table: pa.Table, answers: pa.Table, units: Units, buckets: int) -> pa.Table:
    if not table.num_rows or not answers.num_rows:
        return PIECES.empty_table()
    is_copy = pc.is_valid(answers.column("doc_id"))
    table, starts, content, (low, first, end) = _anchors_of(table, answers.filter(is_copy), units)
    answers = answers.filter(pc.invert(is_copy))
    mixed = mix(low)
    values = np.unique(mixed)
    repeated = np.zeros(len(values), bool)
    lo, hi = _value_rows(values, buckets)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("repeated").to_pylist()):
        n = hi[b] - lo[b]
        repeated[lo[b] : hi[b]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
    kept = repeated[np.searchsorted(values, mixed)] if len(low) else np.empty(0, bool)
    low, first, end = low[kept], first[kept], end[kept]
    owner = np.searchsorted(starts, first, side="right") - 1
    base = starts[owner]
    names, contents = [], []
    seen: set[tuple[int, int]] = set()
    places = zip(low.tolist(), (first - base).tolist(), (end - base + units.window - 1).tolist(), owner.tolist())
    for anchor, a, b, t in places:
        body = content(t, a, b)
        name = _name(body)
        names.append(name)
        contents.append(None if (anchor, name) in seen else body)
        seen.add((anchor, name))
    who = pa.array(owner)
    return pa.Table.from_arrays(
        [
            pa.array(low.view(np.int64)),
            pa.array(names, pa.int64()),
            table.column("doc_id").take(who),
            table.column("text_hash").take(who),
            pa.array((first - base).astype(np.int32)),
            pa.array((end - first).astype(np.int32)),
            pa.array(contents, pa.binary()),
        ],
        schema=PIECES,
    )


def _chunk(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("chunk")), F.lit(n)).alias("chunk")


def copied(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of the documents whose whole text a document with a smaller id has."""
    named = docs.select("doc_id", "text_hash", F.xxhash64("text", F.lit(1)).alias("h2"), F.length("text").alias("n"))
    first = named.groupBy("text_hash", "h2", "n").agg(F.min("doc_id").alias("first"))
    return named.join(first, ["text_hash", "h2", "n"]).where("doc_id > first").select("doc_id", "text_hash").distinct()


def pieces(docs: DataFrame, copies: DataFrame, units: Units, total_bytes: int, total_units: int) -> DataFrame:
    """The pieces of ``docs`` (``doc_id``, ``text_hash``, ``text``, none of them null) but for ``copies``."""
    n = max(1, total_bytes // units.chunk_bytes)
    dealt = packed(docs.select("doc_id", "text_hash", "text", _chunk(n)))
    noted = copies.select(_chunk(n), "doc_id", "text_hash")
    density = 2 / (units.window - units.gram + 2)
    buckets = max(1, int(total_units * density / 2_000_000))
    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.cogroup(noted.groupBy("chunk")).applyInArrow(
        lambda a, b: _send(_unpacked(a), b, units, buckets), "chunk long, bucket long, n int, anchors binary, many binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, repeated binary")
    both = answers.unionByName(noted, allowMissingColumns=True)
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(lambda a, b: _cut(_unpacked(a), b, units, buckets), PIECES_SQL)


def refined(rows: DataFrame, units: Units, turn: int) -> DataFrame:
    """Pieces cut again by the smallest gram in another order of hashes; in the last turn, each window by itself.

    A row of the last turn stands for equal windows in a row, and its content is one of them.

    ``rows``: ``party, anchor, content_id, shift, windows, doc_id, content``: ``shift`` is the first window's place in the
    piece that ``anchor`` and ``content_id`` name, ``party`` the key under which rows meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bodies = batch.column("content").to_pylist()
            hashes = [units.again(body) for body in bodies]
            starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
            gram = units.window if turn >= LAST_TURN else units.gram
            low, first, end = anchored(np.concatenate(hashes), starts, units.window, gram, turn=turn)
            owner = np.searchsorted(starts, first, side="right") - 1
            at, n = first - starts[owner], end - first
            party = batch.column("party").to_numpy().view(np.uint64)[owner]
            length = (1 if turn >= LAST_TURN else n) + units.window - 1
            parts = [units.part(bodies[o], a, b) for o, a, b in zip(owner.tolist(), at.tolist(), (at + length).tolist())]
            new = {
                "party": pa.array(mix(party ^ low, turn).view(np.int64)),
                "shift": pa.array((batch.column("shift").to_numpy()[owner] + at).astype(np.int32)),
                "windows": pa.array(n.astype(np.int32)),
                "content": pa.array(parts, pa.binary()),
            }
            who = pa.array(owner)
            columns = [new[f.name] if f.name in new else batch.column(f.name).take(who) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def least_holders(rows: DataFrame, parts: int = 64) -> DataFrame:
    """``FOUND`` rows of the last turn's ``rows``: the smallest document of each window, combined before any shuffle.

    A window that very many contents hold is summed and told again in ``parts`` parts.
    """
    named = rows.select(
        "party",
        F.unhex(F.sha2("content", 256)).alias("window"),
        F.pmod(F.xxhash64("anchor", "content_id", "shift"), F.lit(parts)).alias("part"),
        "anchor",
        "content_id",
        F.col("shift").alias("low"),
        (F.col("shift") + F.col("windows")).alias("high"),
        "doc_id",
    )
    parted = named.groupBy("party", "window", "part").agg(F.min("doc_id").alias("least"))
    least = parted.groupBy("party", "window").agg(F.min("least").alias("first_doc"))
    told = parted.select("party", "window", "part").join(least, ["party", "window"])
    return named.join(told, ["party", "window", "part"]).select("anchor", "content_id", "low", "high", "first_doc")


Engine = Callable[[pa.Table], pa.Table]
FOUND = pa.schema([("anchor", pa.int64()), ("content_id", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("first_doc", pa.int64())])
COVERED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
COVERED_SQL = "doc_id long, text_hash long, start int, end int"
FOUND_SQL = "anchor long, content_id long, low int, high int, first_doc long"
LAST_TURN = 4
WHOLE = 2**31 - 1


def _spans_of(copies: pa.Table, holders: pa.Table, window: int) -> pa.Table:
    """``COVERED`` rows: windows of the copies of contents that a smaller document holds."""
    copies = copies.select(["anchor", "content_id", "doc_id", "text_hash", "place"])
    both = copies.join(holders, ["anchor", "content_id"], join_type="inner", use_threads=False)
    both = both.filter(pc.less(both.column("first_doc"), both.column("doc_id")))
    place = both.column("place")
    start, end = pc.add(place, both.column("low")), pc.add(pc.add(place, both.column("high")), window - 1)
    columns = [both.column("doc_id"), both.column("text_hash"), start, end.cast(pa.int32())]
    return pa.Table.from_arrays(columns, schema=COVERED)


def first_holders(
    found: DataFrame, units: Units, engine: Engine, shard_units: int, most_contents: int | None = None
) -> DataFrame:
    """``doc_id, text_hash, start, end``: units of the windows of ``found`` that a document with a smaller id holds.

    A shard has all copies of the pieces of its anchors, and the engine's answer is told to them there. An anchor with
    over ``most_contents`` contents (by default, as many as fill a shard: they have up to two windows' units each), or
    very many copies of them, is left out: Spark joins its copies with their contents' holders. Each part is written
    before the next begins, so that shuffles behind it can be let go.
    """
    if most_contents is None:
        most_contents = max(1, shard_units // (2 * units.window))
    counts = found.groupBy("anchor").agg(F.count("content").alias("contents"), F.count("*").alias("copies"))
    many = (F.col("contents") > most_contents) | (F.col("copies") > 20 * most_contents)
    crowded = stage(counts.where(many).select("anchor"), "crowded-anchors")
    few = found.join(crowded, "anchor", "left_anti")
    size = few.agg(F.sum(F.when(F.col("content").isNotNull(), F.col("windows") + units.window))).first()[0] or 0
    sharded = few.select(
        F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-size // shard_units)))).alias("shard"),
        "anchor", "content_id", F.lit(0).alias("shift"), "doc_id", "text_hash", "place", "content",
    )

    def told(shard: pa.Table) -> pa.Table:
        holders = engine(shard.filter(pc.is_valid(shard.column("content"))).drop_columns(["text_hash", "place"]))
        return _spans_of(shard, holders, units.window)

    covered = stage(sharded.groupBy("shard").applyInArrow(told, COVERED_SQL), "covered", compression="zstd")
    if crowded.isEmpty():
        return covered
    rest = found.join(crowded, "anchor", "left_semi")
    joined = (
        rest.select("anchor", "content_id", "doc_id", "text_hash", "place")
        .join(_crowded_holders(rest, units, engine, shard_units, most_contents), ["anchor", "content_id"])
        .where(F.col("first_doc") < F.col("doc_id"))
        .select(
            "doc_id",
            "text_hash",
            (F.col("place") + F.col("low")).alias("start"),
            (F.col("place") + F.col("high") - 1 + units.window).alias("end"),
        )
    )
    return covered.unionByName(joined)


def _crowded_holders(
    found: DataFrame, units: Units, engine: Engine, shard_units: int, most_contents: int
) -> DataFrame:
    """``anchor, content_id, low, high, first_doc``: the smallest document that holds the windows ``[low, high)`` of a content.

    An anchor with many different contents (a common line in ever new surroundings) is cut finer before the engine sees
    it, so no party in a shard has more than ``most_contents`` rows. The last turn leaves single windows, which Spark
    aggregates: the engine is not given them.
    """
    rows = found.where(F.col("content").isNotNull()).select(
        F.col("anchor").alias("party"), "anchor", "content_id", F.lit(0).alias("shift"), "windows", "doc_id", "content"
    )
    cool: list[DataFrame] = []
    single = None
    for turn in range(1, LAST_TURN + 1):
        counts = rows.groupBy("party").agg(F.count("*").alias("n"))
        hot = stage(counts.where(F.col("n") > most_contents).select("party"), "hot-anchors")
        if hot.isEmpty():
            break
        cool.append(rows.join(hot, "party", "left_anti"))
        crowded = rows.join(hot, "party", "left_semi")
        # chunks each give a content once: one of them goes on, for the smallest document
        once = crowded.groupBy("party", "anchor", "content_id", "shift", "windows").agg(
            F.min("doc_id").alias("doc_id"), F.first("content").alias("content")
        )
        rows = stage(refined(once, units, turn), "refined", compression="zstd")
    else:
        single = rows
    if single is None:
        cool.append(rows)
    every = cool[0]
    for more in cool[1:]:
        every = every.unionByName(more)
    sizes = [c.agg(F.sum(F.col("windows") + units.window)).first()[0] or 0 for c in cool]
    shards = max(1, -(-sum(sizes) // shard_units))
    sharded = every.select(
        F.pmod(F.xxhash64("party"), F.lit(shards)).alias("shard"), "anchor", "content_id", "shift", "doc_id", "content"
    )
    holders = sharded.groupBy("shard").applyInArrow(engine, FOUND_SQL)
    return holders if single is None else holders.unionByName(least_holders(single))


def spans_of_repeats(
    docs: DataFrame, units: Units, engine: Engine, units_per_byte: float, shard_units: int
) -> DataFrame:
    """``doc_id, text_hash, spans``: units covered by windows that a document with a smaller id holds too.

    ``docs`` needs ``doc_id, text_hash, text``; spans are sorted (start, end) pairs that may overlap. A copy of a whole
    text is told by one span that ends at ``WHOLE``, and takes no part in the search.
    """
    whole = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    copies = stage(copied(whole), "copies")
    found = stage(pieces(whole, copies, units, total, int(total * units_per_byte)), "pieces", compression="zstd")
    covered = first_holders(found, units, engine, shard_units)
    every = covered.unionByName(
        copies.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(WHOLE).alias("end"))
    )
    spans = every.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return stage(spans, "spans", compression="zstd")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document, ``packed``, with its spans; null where there are none."""
    return packed(docs).join(spans.hint("merge"), ["doc_id", "text_hash"], "left")


def covered_masks(starts: np.ndarray, spans: pa.Array, window: int, at_once: int = 1 << 20) -> np.ndarray:
    """Which units of a batch's texts their spans cover; ``starts``: first unit of each text, one more than texts."""
    owner, flat = pc.list_parent_indices(spans).to_numpy(zero_copy_only=False), spans.flatten()
    low, high = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))
    size = np.diff(starts)[owner]
    told = (high != WHOLE) | (size >= window)
    high = np.where(high == WHOLE, size, high)[told]
    owner, low = owner[told], low[told]
    gone = np.empty(starts[-1], bool)
    at = 0
    while at + 1 < len(starts):  # some texts at a time, so that what is counted stays small
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + at_once, side="right")) - 1)
        a, b = np.searchsorted(owner, [at, stop])
        base, n = starts[owner[a:b]] - starts[at], starts[stop] - starts[at]
        steps = np.bincount(base + low[a:b], minlength=n + 1) - np.bincount(base + high[a:b], minlength=n + 1)
        gone[starts[at] : starts[stop]] = np.cumsum(steps[:n]) > 0
        at = stop
    return gone


def text_key() -> Column:
    return F.xxhash64("text").alias("text_hash")
