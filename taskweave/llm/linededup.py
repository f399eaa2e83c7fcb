"""Operator 1, line dedup: a segment-partition edit join finds lines that differ in few characters.

How many edits link two lines depends on the length of the shorter one (``BANDS``): none under 10 characters, where an edit
makes another word or number, one from 10 on, two from 24, three from 128, four from 256. Lines that no band reaches are compared for
equality only; lines without a word are not compared at all: they always stay. Equal lines are one line throughout.

A line of length n is cut into threshold + 1 segments; of two lines within the threshold, one holds a segment of the
other unchanged, shifted by no more than the edits before it allow. Every line therefore gives out its own segments and,
for each shorter length within that length's threshold, only those substrings that could be that length's segments
(chosen by the position and the difference of the lengths); equal ones meet in a bucket. The hashes of all these
substrings are differences of one running sum per block of lines. Candidates are verified by a bit-parallel edit distance over the
band of that many diagonals.

Groups are the connected components of the links, found without all pairs of a bucket (see ``linkage``). Of each group the first
line stays, by document id and place, and a line of the group goes if it is within its band of that first one; what only a
chain of links joins to it stays.

Keys and hashes only choose candidates, two 64-bit hashes together name a line.

Defined results: a null text stays null, an empty one empty; rows with a null id are returned as they are and do not
count for others; rows that share id and text are one document, and keep the same lines; among rows that share an id, the text
hash orders; ties cannot arise, as places are unique; other columns are carried along, whatever their names, but a column
``__removed`` is replaced; an empty table gives no rows. A text that loses all its lines is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import require_columns
from taskweave.llm.linkage import linked_groups_and_texts
from taskweave.llm.quality import blocks
from taskweave.llm.registry import query, table
from taskweave.staging import stage

Bands = tuple[tuple[int, int], ...]
#: shortest length of a band, and the edits that link a line of that length with one at least as long
BANDS: Bands = ((10, 1), (24, 2), (128, 3), (256, 4))
SHORTEST = BANDS[0][0]
_BLOCK = 1 << 20  # bytes of lines whose keys are made at once
_HELD = 1 << 20  # keys a task holds before it passes them on
_IN_RANGE = 1 << 20  # keys that are sorted at once
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_WORD = r"[^\x20\x09-\x0D]"


def allowed(length: int, bands: Bands) -> int:
    """Edits that link a line of this length with one at least as long; 0 below the bands."""
    most = 0
    for shortest, edits in bands:
        if length >= shortest:
            most = edits
    return most


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Start and size of the threshold + 1 even parts of a line."""
    parts = threshold + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(maxsize=1 << 14)
def probes(length: int, bands: Bands) -> tuple[tuple[int, int, int, int], ...]:
    """``(indexed length, segment, start, size)`` of the substrings that may be a segment of a line no longer than this."""
    out = []
    for shorter in range(min(allowed(length, bands), length - 1) + 1):
        threshold = allowed(length - shorter, bands)
        if not threshold or shorter > threshold:
            continue
        for i, (at, size) in enumerate(segments(length - shorter, threshold)):
            before, after = i, threshold - i
            low = max(at - before, at + shorter - after, 0)
            high = min(at + before, at + shorter + after, length - size)
            out += [(length - shorter, i, start, size) for start in range(low, high + 1)]
    return tuple(out)


def _same_start(x: str, y: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(x: str, y: str, most: int) -> int:
    """Levenshtein distance if it is at most ``most``, else ``most + 1``; bit k stands for the diagonal k - most.

    What both lines start and end with is left out. The band's matches are read as the columns come, so lines that differ from
    the start cost a few columns.
    """
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > most:
        return most + 1
    head = _same_start(x, y)
    x, y = x[head:], y[head:]
    tail = _same_start(x[::-1], y[::-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    width = 2 * most + 1
    mask = (1 << width) - 1
    up, down = mask ^ ((1 << most) - 1), 0
    goal, score = 1 << (len(x) - len(y) + most), len(x) - len(y)
    padded = "\0" * most + x
    for j, c in enumerate(y):
        same, at = 0, padded.find(c, max(j, most), j + width)
        while at >= 0:
            same |= 1 << (at - j)
            at = padded.find(c, at + 1, j + width)
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        slid = diagonal >> 1
        up, down = (left | ~(slid | right)) & mask, slid & right
        score += not diagonal & goal
        if score > most:
            break
    return min(score, most + 1)


def linked(x: str, y: str, bands: Bands) -> bool:
    most = allowed(min(len(x), len(y)), bands)
    return most > 0 and edit_distance(x, y, most) <= most


def near_enough(lines: pa.Array, bands: Bands) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of lines may be within their edits: by length, and by counts of characters, of which an edit changes two.

    A character is counted by the first byte of its UTF-8 form.
    """
    n = len(lines)
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    place = np.repeat(np.arange(0, 32 * n, 32), np.diff(ends))
    place += data & 31
    if (data & 0x80).any():
        place = place[(data & 0xC0) != 0x80]
    counts = np.bincount(place, minlength=32 * n).reshape(-1, 32).astype(np.int32)
    lengths = counts.sum(axis=1)
    edits = np.concatenate([[0], [e for _, e in bands]])[np.searchsorted([at for at, _ in bands], lengths, side="right")]

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = edits[np.where(lengths[i] < lengths[j], i, j)]
        close = (np.abs(lengths[i] - lengths[j]) <= most) & (most > 0)
        close[close] = np.abs(counts[i[close]] - counts[j[close]]).sum(axis=1) <= 2 * most[close]
        return close

    return may


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from any (Steele, Lea and Flood)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _of_codes() -> np.ndarray:
    return _mixed(np.arange(1 << 16, dtype=np.uint64))


@lru_cache(maxsize=1 << 14)
def _probe_columns(length: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the substrings of ``probes``, and a number for the segment each may be."""
    found = np.array(probes(length, bands), np.int64).reshape(-1, 4)
    return found[:, 2], found[:, 2] + found[:, 3], _mixed((found[:, 0] * 64 + found[:, 1]).astype(np.uint64))


def keys_of(lines: list[str], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the buckets of all lines, and for each the place of its line."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    values = _of_codes()[codes & np.uint32(0xFFFF)] + (codes >> np.uint32(16)) * np.uint64(_BASE)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(lengths) - lengths
    # sums[b] - sums[a], shifted back by a powers, is a hash of the characters from a to b
    size = 1 << max(20, int(len(codes)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, size)[: len(codes)], dtype=np.uint64)])
    back = _powers(pow(_BASE, -1, 1 << 64), size)
    order = np.argsort(lengths, kind="stable")
    found, which = np.unique(lengths[order], return_inverse=True)
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the substrings of all lengths stand one after another; a line takes those of its length
    columns = [_probe_columns(n, bands) for n in found.tolist()]
    at, end, segment = (np.concatenate(c) for c in zip(*columns))
    sizes = np.array([len(c[0]) for c in columns], np.int64)
    count = sizes[which]
    places = np.repeat(order, count)
    column = np.arange(len(places)) + np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(count) - count), count)
    begin = starts[places]
    a = begin + at[column]
    value = sums[begin + end[column]]
    value -= sums[a]
    value *= back[a]
    value ^= segment[column]
    return _mixed(value).view(np.int64), places


def _keys(line: str, bands: Bands | int) -> list[int]:
    """Keys of the buckets of a line; a number stands for that many edits at every length above it."""
    return keys_of([line], ((bands + 1, bands),) if isinstance(bands, int) else bands)[0].tolist()


def keys_of_length(length: int, bands: Bands) -> int:
    """About how many keys a line has."""
    most = allowed(length, bands)
    return sum((most * most - d * d) // 2 + most + 1 for d in range(most + 1)) if most else 0


def _buckets(lines: DataFrame, bands: Bands, ranges: int) -> DataFrame:
    """``range, data``: the keys of the lines, packed with the lines' names, by ``ranges`` even ranges of keys.

    A block of lines gives a line once; a task passes its keys on when it holds ``_HELD``.
    """

    def packs(keys: list[np.ndarray], names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.stack([np.concatenate(keys), np.concatenate(names)], axis=1)
        at = _range_of(rows[:, 0], ranges)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        offsets = pa.py_buffer((np.append(starts, len(at)) * 16).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(at[starts].astype(np.int64)), data], names=["range", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for whole in batches:
            for i, j in blocks(whole.column(1), _BLOCK):
                names, first = np.unique(whole.column(0).slice(i, j - i).to_numpy(), return_index=True)
                part = whole.column(1).slice(i, j - i).take(pa.array(first)).to_pylist()
                keys, places = keys_of(part, bands)
                held[0].append(keys)
                held[1].append(names[places])
                if sum(map(len, held[0])) >= _HELD:
                    yield from packs(*held)
                    held = ([], [])
        if sum(map(len, held[0])):
            yield from packs(*held)

    return lines.select("h1", "line").mapInArrow(run, "range long, data binary")


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    high = keys.view(np.uint64) >> np.uint64(32)
    at = (high * np.uint64(ranges)) >> np.uint64(32)
    return at.astype(np.uint16 if ranges <= 1 << 16 else np.int64)


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which of sorted values are equal to a neighbour."""
    alike = np.zeros(len(values) + 1, bool)
    alike[1:-1] = values[1:] == values[:-1]
    return alike[1:] | alike[:-1]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Rows of two numbers in order, each once; several times faster than ``np.unique`` by rows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    return rows[fresh]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed keys sorted by range, each (bucket, line) once, where a bucket has different lines."""
    held: list[np.ndarray] = []
    at = None

    def told() -> pa.RecordBatch:
        rows = np.concatenate(held)
        order = np.argsort(rows[:, 0])
        several = order[_repeated(rows[order, 0])]
        rows = _distinct(rows[several])  # each line of a bucket once
        rows = rows[_repeated(rows[:, 0])]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["bucket", "h1"])

    for batch in batches:
        for range_, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if range_ != at and held:
                yield told()
                held = []
            at = range_
            held.append(np.frombuffer(data.as_py(), np.int64).reshape(-1, 2))
    if held:
        yield told()


def _links(pairs: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("line_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = pa.array([linked(x, y, bands) for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    held = pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b")
    return held.mapInArrow(run, "a long, b long")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, h1, h2, line`` of the lines with a word."""
    cut = docs.where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    worded = cut.where(F.col("line").rlike(_WORD))
    return worded.select(
        "doc_id", "text_hash", "place", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "line"
    )


def repeated_lines(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """``doc_id, text_hash, gone`` (places of the lines to drop) from ``doc_id, text_hash, text``."""
    lines = _lines(docs)
    spot = F.struct("doc_id", "text_hash", "place")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(spot).alias("first"), F.count("*").alias("copies"), F.max(F.length("line")).alias("length")
    )
    known = stage(distinct.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "copies", "length"), "lines")

    expected = F.lit(0)
    for shortest, _ in bands:
        expected = F.when(F.col("length") >= shortest, F.lit(keys_of_length(shortest, bands))).otherwise(expected)
    n_keys = known.agg(F.sum(F.col("copies") * expected)).first()[0] or 0
    dealt = _buckets(lines, bands, max(1, -(-n_keys // _IN_RANGE))).repartition("range").sortWithinPartitions("range")
    crowded = stage(dealt.mapInArrow(_shared, "bucket long, h1 long"), "crowded")
    members = crowded.join(known.select("h1", "id"), "h1").select("bucket", "id").distinct()

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = ids.join(known.select("id", "first"), "id").select("id", "first.*")
        per_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "id")).alias("wanted"))
        named = docs.join(per_doc.hint("merge"), ["doc_id", "text_hash"]).select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
        return named.select("w.id", F.col("all")[F.col("w.place")].alias("text")).dropDuplicates(["id"])

    def compare(found: list[str]):
        return lambda i, j: linked(found[i], found[j], bands)

    def sieve(found: pa.Array):
        return near_enough(found, bands)

    groups, texts = linked_groups_and_texts(members, texts_of, lambda pairs, texts: _links(pairs, texts, bands), compare, sieve=sieve)
    grouped = stage(known.join(groups, "id"), "grouped-lines")
    heads = grouped.groupBy("component").agg(F.min_by("id", "first").alias("head_id"), F.min("first").alias("head"))
    followers = grouped.join(heads, "component").where(F.col("id") != F.col("head_id"))
    near = _links(followers.select(F.col("head_id").alias("a"), F.col("id").alias("b")), texts, bands).select(F.col("b").alias("id"))
    replaced = followers.join(near, "id").select("id", "head")
    owned = known.join(replaced, "id", "left").where((F.col("copies") > 1) | F.col("head").isNotNull())
    late = owned.select("h1", "h2", F.coalesce("head", "first").alias("kept"))
    gone = lines.select("h1", "h2", "doc_id", "text_hash", "place").join(late, ["h1", "h2"]).where(spot != F.col("kept"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The same rows and columns, repeated lines taken out of ``text``, and ``__removed``, how many they were."""
    require_columns(docs, key, text)
    docs = docs.drop("__removed")
    own = uuid.uuid4().hex[:8]  # names that no column has
    doc, digest, places = f"__id_{own}", f"__hash_{own}", f"__gone_{own}"
    marked = docs.withColumns({doc: F.col(key).cast("long"), digest: F.xxhash64(F.col(text))})
    plain = marked.select(F.col(doc).alias("doc_id"), F.col(digest).alias("text_hash"), F.col(text).alias("text"))
    gone = repeated_lines(plain, **limits).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), F.col("gone").alias(places))
    held = marked.join(gone.hint("merge"), [doc, digest], "left").select(*docs.columns, places)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in blocks(whole.column(at)):
                batch = whole.slice(start, stop - start)
                texts, removed = [], []
                for value, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    if places:
                        drop = set(places)
                        value = "\n".join(line for i, line in enumerate(value.split("\n")) if i not in drop)
                    texts.append(value)
                    removed.append(len(places or ()))
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], "__removed"])

    schema = T.StructType([*held.schema.fields[:-1], T.StructField("__removed", T.LongType())])
    return held.mapInArrow(run, schema)


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
