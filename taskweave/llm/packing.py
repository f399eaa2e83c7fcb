"""Operator 7, best-fit packing: documents into as few sequences of a fixed number of tokens as a tree of rounds finds.

Each task packs its own items best fit, largest first. Bins that are nearly full are done. The others go on as items,
with all they hold, into a round of fewer and differently mixed tasks, until one task has seen what is left or a round
saves nothing. A bin is a row that lists its pieces; a piece has a token at least, so a row is bounded by the length of
a sequence, and no task is given more than ``items_per_task`` rows. Every piece is placed, whatever the sizes are.

Documents longer than a sequence are cut into full pieces, the first of which takes the remainder; full pieces are
sequences of their own and do not enter the rounds.

Token ids are staged once as lengths and checksums, so a lost executor costs the tasks it ran. Tasks are dealt by a
hash of what the item holds, which a task that is run again repeats.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they stand; ties in
length are taken in the order of the rows' keys; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.staging import stage

PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"
_BIN = f"length long, members array<{PIECE}>"
Encode = Callable[[str], Sequence[int]]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Encode:
    """Ids of the vocabulary file at ``path``, as the ``tokenizers`` library gives them without added tokens.

    Where the file's ranks lie next to it, the same ids are made by ``tiktoken``, which is five times as fast; texts
    that hold the text of a special token are left to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
    ranks = f"{os.path.splitext(path)[0]}.tiktoken"
    if not os.path.exists(ranks):
        return lambda text: whole().encode(text, add_special_tokens=False).ids
    import public_tokenizers

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in whole().get_added_tokens_decoder().values()]

    def encode(text: str) -> Sequence[int]:
        if any(s in text for s in special):
            return whole().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(total: int, most: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``total`` ids."""
    first = total % most or min(total, most)
    yield 0, first
    for start in range(first, total, most):
        yield start, most


def token_pieces(
    docs: DataFrame, encoder: Callable[[str], Encode], path: str, end_id: int, most: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    require_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.empty(0, "<u4")
                given = value.as_py()
                if given:
                    ids = np.asarray(encode(given), "<u4")
                ids = np.append(ids, np.array([end_id], "<u4"))
                rows += [
                    (doc, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cut(len(ids), most))
                ]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, most: int) -> np.ndarray:
    """Bin number of each item: largest items first, each into the fullest bin that still has room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by what they still take
    open_rooms = 0  # bit r is set when room[r] is not empty
    made = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_ = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
            left -= size
        else:
            bin_, made, left = made, made + 1, most - size
        bins[item] = bin_
        room[left].append(bin_)
        open_rooms |= 1 << left
    return bins


def _pack_partition(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    items = pa.Table.from_batches(parts).combine_chunks()
    items = items.sort_by([("length", "descending"), ("_first", "ascending")])
    lengths = items.column("length").to_numpy()
    bins = best_fit(lengths, most)
    order = np.argsort(bins, kind="stable")
    members = items.column("members").combine_chunks().take(pa.array(order))
    sizes = np.bincount(bins[order], members.value_lengths().to_numpy()).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.bincount(bins, lengths).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends), members.flatten()),
        ],
        names=["length", "members"],
    )


def pack(
    pieces: DataFrame, most: int, items_per_task: int = 50_000, full_at: float = 0.99, least_gain: float = 0.002
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` should be a written table, as it is read more than once."""
    piece = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    as_bin = pieces.select("length", F.array(piece).alias("members"))
    done = as_bin.where(F.col("length") >= most)
    items = as_bin.where(F.col("length") < most)
    n = items.count()
    tasks, turn = -(-n // items_per_task) if n else 0, 0
    while tasks:
        first = F.xxhash64("members")
        dealt = items.select("length", "members", first.alias("_first")).repartition(
            tasks, F.xxhash64(F.col("members")[0], F.lit(turn))
        )
        bins = stage(dealt.mapInArrow(lambda batches: _pack_partition(batches, most), _BIN), "bins")
        if tasks == 1:
            return _placed(done.unionByName(bins))
        full = F.col("length") >= int(full_at * most)
        left = bins.where(~full)
        before, n = n, left.count()
        if n == 0 or (turn and before - n < least_gain * before):
            return _placed(done.unionByName(bins))
        done, items = done.unionByName(bins.where(full)), left
        tasks, turn = -(-n // items_per_task), turn + 1
    return _placed(done)


def _placed(bins: DataFrame) -> DataFrame:
    """One row per piece; the offset is the sum of the lengths before it."""
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    ends = F.aggregate(
        "members",
        F.array(F.lit(0).cast("long")),
        lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m["length"])),
    )
    rows = numbered.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), ends.alias("at"))).alias("r"))
    return rows.where(F.col("r.m").isNotNull()).select("r.m.*", "sequence_id", F.col("r.at").alias("offset"))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    most: int = 1024,
    end_id: int = 2,
    encoder: Callable[[str], Encode] = byte_bpe,
    **rounds,
) -> DataFrame:
    """Token pieces of ``docs`` placed in sequences of at most ``most`` tokens."""
    pieces = stage(token_pieces(docs, encoder, tokenizer_path, end_id, most), "pieces")
    return pack(pieces, most, **rounds)


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
