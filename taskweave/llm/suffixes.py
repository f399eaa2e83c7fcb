"""Operator 5, suffix-array dedup over bytes: Burrows-Wheeler transforms of shards, merged by refining their interleave.

A window is 50 bytes of a text's UTF-8. Bytes covered by a window that also starts in a document with a smaller id are
removed; windows are judged on the input and overlap.

``repeats`` finds the pieces of documents whose windows can occur elsewhere, and deals their distinct contents by anchor
into groups of a bounded number of bytes. In the task of a group

1. contents are split into shards, and the rotations of each shard are sorted by their first 50 bytes: its transform is
   the block of bytes before each rotation, in that order;
2. the shards are merged without sorting their rotations again. The interleave says, slot by slot, which shard the next
   rotation comes from. It starts as shard after shard; each round reads every slot's block from its shard's transform
   and sorts the slots stably by block, which makes the order right for one block more;
3. a slot starts an interval when its block differs from that of the slot before it, or the slots that they came from
   were in different intervals: after 50 bytes, the intervals are the runs of rotations with a common prefix of 50, and
   the smallest document in an interval is the first holder of its window.

A content that is the only one of its anchor shares no window with any other and is not merged with anything. Several
bytes make a block as long as there are no more than 65,536 different ones, so that slots are sorted by two bytes
whatever the text is. Every copy of a content gets its verdict by a join.

Defined results: a null text counts as empty; texts under 50 bytes stay whole; rows with a null id are kept whole and are
no one's reference; rows of one id do not count against each other; repeated rows get the same result each; a removed
span may cut a character, so what is kept is bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.llm.repeats import FOUND, Units, covered_masks, mix, spans_of_repeats, text_key, unpacked, with_spans

WINDOW, GRAM = 50, 20
SHARDS = 8
_CODES = 1 << 16
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return held, ends - ends[0]


def _read(texts: pa.Array):
    held, starts = _bytes_of(texts)
    view, at = memoryview(held), starts.tolist()
    return _BYTE_HASH[held], starts, lambda text, a, b: bytes(view[at[text] + a : at[text] + b])


BYTES = Units(
    _read, lambda c: _BYTE_HASH[np.frombuffer(c, np.uint8)], lambda c, a, b: c[a:b], WINDOW, GRAM
)


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, which have ``bits`` bits, and the dense rank of each; places are sorted with their keys if they fit."""
    place_bits = len(key).bit_length()
    if bits + place_bits <= 64:
        packed = key << np.uint64(place_bits)
        packed |= np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << place_bits) - 1)).view(np.int64)
        ordered = packed >> np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
    return order, rank


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` in the order of their first ``depth`` bytes, by ranks of prefixes of doubled length."""
    present = np.bincount(text, minlength=256) > 0
    bits = max(1, int(np.count_nonzero(present) - 1).bit_length())
    code = (np.cumsum(present) - 1).astype(np.uint64)[text]
    key = np.zeros(len(text), np.uint64)
    known = min(max(1, (64 - len(text).bit_length()) // bits), depth)
    for i in range(known):
        key = (key << np.uint64(bits)) | np.roll(code, -i)
    order, rank = _ranked(key, known * bits)
    while known < depth:
        step = min(known, depth - known)  # an overlap of equal bytes does not change the order
        bits = int(rank.max()).bit_length()
        order, rank = _ranked((rank << np.uint64(bits)) | np.roll(rank, -step), 2 * bits)
        known += step
    return order


def blocks_before(text: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes before each place, going round, as a number."""
    key = np.zeros(len(text), np.uint64)
    for i in range(size, 0, -1):
        key = (key << np.uint64(8)) | np.roll(text, i).astype(np.uint64)
    return key


def coded_blocks(shards: list[np.ndarray], size: int) -> np.ndarray | None:
    """The blocks of all shards as codes of two bytes in their order, if there are few enough."""
    blocks = np.concatenate([blocks_before(s, size) for s in shards])
    if size > 2:
        ordered = np.sort(blocks)
        distinct = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
        if len(distinct) > _CODES:
            return None
        blocks = np.searchsorted(distinct, blocks)
    return blocks.astype(np.uint16)


def merged(shards: list[np.ndarray], orders: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' rotations in the order of their first ``depth`` bytes, and where intervals start."""
    total = sum(map(len, shards))
    before = np.cumsum([0, *map(len, shards)])
    ordered = np.concatenate([o + a for o, a in zip(orders, before)])
    transforms: dict[int, np.ndarray] = {}
    for size in (4, 3, 2):
        codes = coded_blocks(shards, size)
        if codes is not None:
            transforms[size] = codes[ordered]
            break
    if depth % size:  # fewer bytes than a block that has codes, so these have codes too
        transforms[depth % size] = coded_blocks(shards, depth % size)[ordered]
    sizes = ([depth % size] if depth % size else []) + [size] * (depth // size)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    interval = np.zeros(total, np.int32)
    for m in sizes:
        block = np.empty(total, np.uint16)
        block[np.argsort(source, kind="stable")] = transforms[m]
        moved = np.argsort(block, kind="stable")
        block, came_from, source = block[moved], interval[moved], source[moved]
        starts = np.concatenate([[True], (block[1:] != block[:-1]) | (came_from[1:] != came_from[:-1])])
        interval = np.cumsum(starts, dtype=np.int32)
    return source, starts


def first_docs(contents: list[bytes], docs: np.ndarray, window: int = WINDOW, shards: int = SHARDS) -> list[np.ndarray]:
    """For each content (``window`` bytes or longer), the smallest document that holds each of its windows."""
    lengths = np.array([len(c) for c in contents])
    whole = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    bounds = np.searchsorted(starts, np.linspace(0, len(whole), min(shards, len(contents)) + 1).astype(np.int64))
    bounds[0], bounds[-1] = 0, len(contents)
    cuts = starts[np.unique(bounds)]
    parts = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    orders = [sorted_rotations(p, window) for p in parts]
    source, begins = merged(parts, orders, window)
    place = np.empty(len(whole), np.int64)  # of the rotation in each slot
    place[np.argsort(source, kind="stable")] = np.concatenate([o + a for o, a in zip(orders, cuts)])
    content = np.repeat(np.arange(len(contents)), lengths)[place]
    # rotations that run over the end of their content are no windows
    held = np.where(place + window <= starts[content + 1], docs[content], np.iinfo(np.int64).max)
    at = np.flatnonzero(begins)
    least = np.repeat(np.minimum.reduceat(held, at), np.diff(np.concatenate([at, [len(held)]])))
    first = np.empty(len(whole), np.int64)
    first[place] = least
    return [first[a : b - window + 1] for a, b in zip(starts[:-1], starts[1:])]


def merge_group(group: pa.Table) -> pa.Table:
    """``FOUND`` rows of the contents of one group."""
    anchor, name, shift, doc = (group.column(c).to_numpy() for c in ("anchor", "content_id", "shift", "doc_id"))
    order = np.lexsort((doc, shift, name, anchor))
    steps = [v[order][1:] != v[order][:-1] for v in (anchor, name, shift)]
    one = order[np.concatenate([[True], steps[0] | steps[1] | steps[2]])[: len(order)]]  # of a content's rows
    anchor, name, shift, doc = anchor[one], name[one], shift[one].astype(np.int64), doc[one]
    contents = group.column("content").take(pa.array(one))
    windows = pc.binary_length(contents).to_numpy().astype(np.int64) - WINDOW + 1
    # equal windows have equal anchors: the only content of an anchor is a merged transform as it is
    _, of, several = np.unique(anchor, return_inverse=True, return_counts=True)
    alone, shared = np.flatnonzero(several[of] == 1), np.flatnonzero(several[of] > 1)
    who, low, high, first = alone, np.zeros(len(alone), np.int64), windows[alone], doc[alone]
    if len(shared):
        firsts = first_docs(contents.take(pa.array(shared)).to_pylist(), doc[shared])
        every, owner = np.concatenate(firsts), np.repeat(np.arange(len(shared)), windows[shared])
        begin = np.cumsum(windows[shared]) - windows[shared]
        at = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])]))
        end = np.concatenate([at[1:], [len(every)]])
        owner = owner[at]
        who, first = np.concatenate([who, shared[owner]]), np.concatenate([first, every[at]])
        low, high = np.concatenate([low, at - begin[owner]]), np.concatenate([high, end - begin[owner]])
    columns = [anchor[who], name[who], (shift[who] + low).astype(np.int32), (shift[who] + high).astype(np.int32), first]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=FOUND)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = 1_500_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes that are left of each document."""
    require_columns(docs, key, text)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", text_key(), "text")
    spans = spans_of_repeats(own, BYTES, merge_group, units_per_byte=1, shard_units=group_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, starts = _bytes_of(unpacked(batch.column("text"), batch.column("n_bytes")))
            gone = covered_masks(starts, batch.column("spans"), WINDOW)
            first = starts[:-1][np.diff(starts) > 0]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[first] = gone[first]
            removed, runs = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            if len(first):
                for counted, mask in ((removed, gone), (runs, begins)):
                    counted[np.diff(starts) > 0] = np.add.reduceat(mask, first, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(np.diff(starts) - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(held[~gone])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(removed), pa.array(runs), kept],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return with_spans(own, spans).select("doc_id", "text", "n_bytes", "spans").mapInArrow(run, _RESULT)


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT r, doc_id, i, hash(substr(x, 2 * i + 1, {2 * WINDOW})) AS h
  FROM (SELECT *, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS i FROM d WHERE len(x) >= {2 * WINDOW})),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
late AS (SELECT DISTINCT r, i FROM win JOIN firsts USING (h) WHERE first < doc_id),
opened AS (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) < i - {WINDOW}, true) AS new FROM late),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM opened),
spans AS (SELECT r, k, min(i) AS a, max(i) + {WINDOW} AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
left_over AS (
  SELECT g.r, string_agg(substr(x, 2 * a + 1, coalesce(2 * (b - a), len(x))), '' ORDER BY a) AS kept
  FROM gaps g JOIN d USING (r) GROUP BY g.r),
summed AS (SELECT r, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE kept END)) AS kept_sha256
FROM d LEFT JOIN summed USING (r) LEFT JOIN left_over USING (r)
"""


@query(OP5_SQL)
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
