"""Operator 12, byte-level BPE encoding and decoding: the ``tiktoken`` library with a local rank file.

The pattern cuts a text into matches and each match is merged by itself, so a text may be cut wherever no match can
reach over: the ids of the parts, put together, are the ids of the whole. Such safe boundaries of ``PATTERN`` are a
visible character before white space, an ASCII letter next to a digit, and a letter or digit before a symbol; a cut
never lies after an apostrophe, which may start a contraction. Texts are encoded in parts of about ``part`` characters
that end at safe boundaries; a stretch without any stays whole. The library's matcher overflows on very long runs of white space,
so those are cut out by the pattern's own rule (a run is one match, without its last character where a visible one
follows) and merged as one match.

A text of more than ``spread`` bytes is cut by one task, its parts are dealt over the cluster, encoded, and put
together again by a number of the row's own. Decoding joins the bytes of the ids and never goes through characters, so
parts of characters survive.

Defined results: a null text has null ids (``op12`` counts it as empty), an empty one none; bytes of a text that are no
UTF-8 count as U+FFFD; null ids decode to null, an id without a rank (or null) to U+FFFD; strings that look like special tokens are
ordinary text; repeated rows stay; other columns are carried along, a column of the result's name is replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.staging import stage

PART = 65_536  # characters of a part
SPREAD = 8_388_608  # bytes of a text whose parts are dealt over the cluster
BLOCK = 2_097_152  # bytes of text that one output batch is made from
_RUN = 4_096  # white space characters that the library's matcher is not asked to take at once
_UNKNOWN = "�".encode()
# fixed values: Unicode White_Space, as the matcher's \s
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_WHITE = regex.compile(f"[{_WHITE}]{{{_RUN},}}")
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
SAFE = (
    rf"(?<=[^{_WHITE}\x1c-\x1f])(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    rf"|(?<=[{_LETTER}0-9])(?=[!-/:-@\[-`{{-~、。！，？])"
)


def cut_points(text: str, part: int, safe: str = SAFE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``part`` characters that end at safe boundaries."""
    boundary, start = regex.compile(safe), 0
    while len(text) - start > part:
        found = boundary.search(text, start + part)
        if found is None:
            break
        yield start, found.start()
        start = found.start()
    yield start, len(text)


class Ranks:
    """A rank file, ready to encode parts of texts and to decode ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self._ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._pattern = pattern

    def _encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})

    @cached_property
    def _by_pattern(self):
        return self._encoding(self._pattern)

    @cached_property
    def _one_match(self):
        return self._encoding(r"[\s\S]+")

    @cached_property
    def _bytes(self) -> list[bytes]:
        out = [_UNKNOWN] * (max(self._ranks.values(), default=-1) + 2)
        for token, rank in self._ranks.items():
            out[rank] = token
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that ends at a safe boundary or is whole."""
        parts: list[np.ndarray] = []
        start = 0
        for run in _LONG_WHITE.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > start:
                parts.append(np.asarray(self._by_pattern.encode_ordinary(text[start : run.start()]), np.int32))
            parts.append(np.asarray(self._one_match.encode_ordinary(text[run.start() : stop]), np.int32))
            start = stop
        if start < len(text):
            parts.append(np.asarray(self._by_pattern.encode_ordinary(text[start:]), np.int32))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode_whole(self, text: str, part: int, safe: str) -> np.ndarray:
        parts = [self.encode(text[a:b]) for a, b in cut_points(text, part, safe)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def decode(self, ids: np.ndarray) -> bytes:
        unknown = len(self._bytes) - 1
        known = np.where((ids >= 0) & (ids < unknown), ids, unknown)
        return b"".join(map(self._bytes.__getitem__, known.tolist()))


@lru_cache(maxsize=4)
def ranks_of(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _text(value: pa.Scalar) -> str | None:
    raw = value.as_buffer()
    return None if raw is None else str(raw, "utf-8", "replace")


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An array column of the rows, null where a row is None."""
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    given = [r for r in rows if r is not None and len(r)]
    flat = pa.array(np.concatenate(given) if given else np.empty(0, np.int32), pa.int32())
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=missing)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``BLOCK`` bytes."""
    done, start = np.cumsum(sizes + 1), 0
    while start < len(done):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + BLOCK, side="right")))
        yield start, stop
        start = stop


def _sizes(column: pa.Array) -> np.ndarray:
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _mapped(
    df: DataFrame, carry: Sequence[str], source: str, into: dict[str, T.DataType], make: Callable[[pa.Array], Sequence[pa.Array]]
) -> DataFrame:
    """The columns ``carry`` of ``df`` and those of ``into``, made from ``source`` a bounded batch of rows at a time."""
    kept = [f for f in df.schema.fields if f.name in carry and f.name not in into]
    columns = [f.name for f in kept]
    fed = columns if source in columns else [*columns, source]
    at = fed.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(_sizes(batch.column(at))):
                rows = batch.slice(start, stop - start)
                made = make(rows.column(at))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], *made], names=[*columns, *into])

    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in into.items())])
    return df.select(*[F.col(f"`{c}`") for c in fed]).mapInArrow(run, schema)


def encode_texts(
    docs: DataFrame,
    ranks: str,
    text: str = "text",
    into: str = "ids",
    pattern: str | None = None,
    safe: str = SAFE,
    part: int = PART,
    spread: int = SPREAD,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all) and the ids of each text as an array.

    ``safe`` must name boundaries that no match of ``pattern`` crosses.
    """
    require_columns(docs, text, *(carry or ()))
    pattern = pattern or _public_pattern()
    number = f"__row_{uuid.uuid4().hex[:8]}"
    carry = [c for c in docs.columns if c != into and (carry is None or c in carry)]
    kind = T.ArrayType(T.IntegerType())

    def encoded(column: pa.Array) -> list[pa.Array]:
        model = ranks_of(ranks, pattern)
        texts = map(_text, column)
        return [_lists([None if t is None else model.encode_whole(t, part, safe) for t in texts])]

    given = docs if docs.schema[text].dataType == T.StringType() else docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    giant = F.coalesce(F.octet_length(F.col(f"`{text}`")) > spread, F.lit(False))
    near = _mapped(given.where(~giant), carry, text, {into: kind}, encoded)
    far = stage(given.where(giant).withColumn(number, F.monotonically_increasing_id()), "giant-texts")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = _text(value)  # one text at a time, its parts one by one
                for i, (a, b) in enumerate(cut_points(whole, part, safe)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([i], pa.int64()), pa.array([whole[a:b].encode()], pa.binary())],
                        names=["row", "part", "raw"],
                    )

    def part_ids(column: pa.Array) -> list[pa.Array]:
        model = ranks_of(ranks, pattern)
        return [_lists([model.encode(_text(v)) for v in column])]

    dealt = far.select(number, F.col(f"`{text}`")).mapInArrow(parts, "row long, part long, raw binary").repartition("row", "part")
    pieces = _mapped(dealt, ["row", "part"], "raw", {"ids": kind}, part_ids)
    joined = pieces.groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("__ids")
    )
    spread_out = far.join(joined, far[number] == joined["row"]).select(*[F.col(f"`{c}`") for c in carry], F.col("__ids").alias(into))
    return near.unionByName(spread_out)


def decode_ids(
    df: DataFrame, ranks: str, ids: str = "ids", into: str = "bytes", digest: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``df`` with the raw bytes of each row's ids.

    ``digest`` names one more column, the SHA-256 of the ids as little-endian unsigned 32-bit integers (null for null ids).
    """
    require_columns(df, ids)
    pattern = pattern or _public_pattern()
    kind = df.schema[ids].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{ids} holds {kind.simpleString()} and no arrays of ids")

    def decoded(column: pa.Array) -> list[pa.Array]:
        model = ranks_of(ranks, pattern)
        rows = [None if not v.is_valid else v.values.fill_null(-1).to_numpy(zero_copy_only=False) for v in column]
        out = [pa.array([None if r is None else model.decode(r) for r in rows], pa.binary())]
        if digest:
            own = [None if r is None else hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
            out.append(pa.array(own, pa.string()))
        return out

    return _mapped(df, df.columns, ids, {into: T.BinaryType(), **({digest: T.StringType()} if digest else {})}, decoded)


@query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode_texts(docs, ranks, carry=["doc_id"])
    decoded = decode_ids(encoded, ranks, digest="ids_sha256")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
