"""Operator 10, near-duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles, each labelled with how often it stood before. A sketch takes the two
labelled shingles with the smallest hashes under one of sixty orders, and keeps them in the order of the text, so equal
sketches speak for the same shingles in the same order: for edit similarity and not only for shared content. Three
sketches make a band, a band's key a bucket.

Two documents are linked when the longest common subsequence of their shingle sequences has at least 0.8 of the
shingles of both (common / (both - common)). The test is exact: an alignment that reaches 0.8 leaves out at most a ninth of
both lengths, so it stays within that band, and a bit-parallel recurrence over the band finds it. Candidates at a similarity
of exactly 0.8 share a band with probability 0.997, closer ones with more.

Documents with the same words are one class and are sketched and compared once. Buckets are not written
out as pairs (see ``linkage``); groups are the connected components of the links.

Defined results: documents without words, and rows with a null id, stand alone and are kept; documents of one to four
words are linked to those with the same words only; the kept document of a group is that with the smallest id; rows that
share an id are one document: they are kept or dropped together; repeated rows likewise; other columns are carried along by ``keep_one``
and ignored by ``near_duplicates``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.linkage import linked_groups
from taskweave.llm.quality import blocks
from taskweave.llm.registry import query, table
from taskweave.llm.repeats import grams, mix
from taskweave.llm.substrings import words_of
from taskweave.staging import stage

SHINGLE, BANDS, ROWS, KEPT = 5, 20, 3, 2
# similarity 0.8: at most one of so many of both sequences' shingles is outside the alignment
NINTH = 9
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 1)
_AT_ONCE = 1 << 20  # hashes of one step


def labelled(shingles: np.ndarray) -> np.ndarray:
    """The shingles made distinct by counting each one's earlier occurrences."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(len(ordered))
    earlier = np.empty(len(ordered), np.uint64)
    earlier[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(shingles + mix(earlier, 2), 3)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One number for each order: its smallest labelled shingles, as they follow in the text."""
    marks = labelled(shingles)
    out = np.empty(len(_SEEDS), np.uint64)
    step = max(1, _AT_ONCE // len(marks))
    with np.errstate(over="ignore"):
        for at in range(0, len(_SEEDS), step):
            seeds = _SEEDS[at : at + step, None]
            h = (marks[None, :] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            rows = np.arange(len(h))
            places = []
            for _ in range(min(KEPT, len(marks))):
                places.append(h.argmin(axis=1))
                h[rows, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            chosen = np.sort(np.stack(places), axis=0)
            key = np.zeros(len(h), np.uint64)
            for place in chosen:
                key = key * np.uint64(0xC2B2AE3D27D4EB4F) + shingles[place]
            out[at : at + step] = key
    return mix(out, 4)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    rows = sketches(shingles).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(0x165667B19E3779F9) + rows[:, r], r)
    return key.view(np.int64)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    starts, words = words_of(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return starts, hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else hashes, words


_SKETCH = "doc_id long, words_id binary, bands array<long>"


def sketch_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, words_id`` (null: no words), ``bands`` (none under five words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in blocks(whole.column(1)):
                batch = whole.slice(i, j - i)
                starts, hashes, words = _word_hashes(batch.column(1))
                sizes = np.diff(starts)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)
                joined = pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()
                names = [hashlib.blake2b(w, digest_size=16).digest() if n else None for w, n in zip(joined, sizes.tolist())]
                bands = [
                    band_keys(grams(hashes[a:b], SHINGLE)).tolist() if b - a >= SHINGLE else []
                    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(names, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "words_id", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Elements outside the longest common subsequence; ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    # bits of the band: bit k stands for place j - most + k of a; a cleared bit is a step of the common subsequence
    width = 2 * most + 1
    mask = (1 << width) - 1
    band, common = mask, 0
    for j, y in enumerate(b.tolist()):
        low = j - most
        match = 0
        for i in places.get(y, ()):
            if low <= i <= j + most:
                match |= 1 << (i - low)
        if match:
            hit = band & match
            band = ((band + hit) | (band & ~match)) & mask
        common += not band & 1
        band = (band >> 1) | (1 << (width - 1))
    common += width - band.bit_count()
    return min(len(a) + len(b) - 2 * common, most + 1)


def _sequences(texts: pa.Array) -> list[np.ndarray]:
    starts, hashes, _ = _word_hashes(texts)
    return [grams(hashes[i:j], SHINGLE) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    most = (len(x) + len(y)) // NINTH
    return distance(x, y, most) <= most


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of ids that are links."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(_sequences(batch.column(2)), _sequences(batch.column(3)))
            keep = pa.array([_linked(x, y) for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    held = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return held.mapInArrow(run, "a long, b long").distinct()


def _compare(texts: list[str]):
    """Alignments only where the shingles in common are enough for a link, in whatever order."""
    sequences = _sequences(pa.array(texts, pa.string()))
    marks = [frozenset(labelled(s).tolist()) if len(s) else frozenset() for s in sequences]

    def linked(i: int, j: int) -> bool:
        total = len(sequences[i]) + len(sequences[j])
        enough = total - 2 * len(marks[i] & marks[j]) <= total // NINTH
        return enough and _linked(sequences[i], sequences[j])

    return linked


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component, kept`` of every row."""
    require_columns(docs, key, text)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketched = stage(sketch_documents(own), "sketches")
    known = sketched.where(F.col("doc_id").isNotNull() & F.col("words_id").isNotNull())
    classes = known.groupBy("words_id").agg(F.min("doc_id").alias("id"))
    heads = known.join(classes, "words_id").where("doc_id = id").select("id", F.explode("bands").alias("bucket"))
    members = heads.distinct()

    def texts_of(ids: DataFrame) -> DataFrame:
        # the same plan at every size: the ids may be many
        return own.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").distinct()

    groups = linked_groups(members, texts_of, _links, _compare)
    # rows that share an id belong to one group, whatever their words
    joined = known.join(classes, "words_id").select("doc_id", "id").distinct()
    labelled_ = joined.join(groups, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    final = labelled_.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketched.select("doc_id").join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", component.alias("component"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those of documents that a group has another document for."""
    dropped = near_duplicates(docs, key, text).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(key).cast("long") == F.col("__dropped"), "left_anti")


@query()
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
