"""Operator 4, substring dedup over words: suffix automata of reference shards, documents matched against them.

A window is 50 words in a row. Words covered by a window that also starts in a document with a smaller id are removed.

``repeats`` finds the pieces of documents whose windows can occur elsewhere. Their distinct contents, in ascending order
of their first document, are the reference; it is split into shards by anchor, so that a piece has all its partners in
one shard and a shard is bounded in words. The task of a shard builds the automaton of its reference and streams the
distinct contents through it for their matching statistics, held at one window's length: the state at each word is the
class of that window's places, and knows the first document that made it. Every copy of a content, in whatever document,
gets its verdict from there by a join. Sending the automaton of each shard to all documents would read the corpus once
per shard; the anchor says beforehand which shard a piece can match.

Hashes only choose what is compared; the automaton compares words.

Defined results: a null or empty text has no words, nothing removed and the digest of an empty string; texts of fewer
than 50 words stay whole; rows with a null id are kept whole and are no one's reference; rows of one id do not count
against each other, whatever their texts; repeated rows get the same result each; other columns are ignored; an empty
table gives no rows. A window that stands twice in one document only is no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.llm.repeats import FOUND, Units, covered_masks, spans_of_repeats, text_key, unpacked, with_spans

WINDOW, GRAM = 50, 8


@lru_cache(maxsize=200_000)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """First word of each text (one more than texts) and all words, split at ASCII white space."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    owner, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), words.filter(real)


def _read(texts: pa.Array):
    starts, words = words_of(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer()
    spaced = memoryview(line)

    def content(text: int, a: int, b: int) -> bytes:
        at = starts[text]
        return bytes(spaced[ends[at + a] : ends[at + b] - 1])

    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else hashes, starts, content


def _again(content: bytes) -> np.ndarray:
    words = content.split(b" ")
    return np.fromiter(map(_word_hash, words), np.uint64, len(words))


WORDS = Units(_read, _again, lambda c, a, b: b" ".join(c.split(b" ")[a:b]), WINDOW, GRAM)


class SuffixAutomaton:
    """Of several word sequences; each state knows the first document (in the order they are added) that reached it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first = [0]

    def _state(self, size: int, first: int, link: int, out: dict[int, int]) -> int:
        self.size.append(size)
        self.first.append(first)
        self.link.append(link)
        self.next.append(out)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the shorter of ``q``'s sequences, those that ``p`` leads to by ``word``."""
        copy = self._state(self.size[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        nexts, links, sizes = self.next, self.link, self.size
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                last = q if sizes[q] == sizes[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(sizes[last] + 1, doc, 0, {})
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = links[p]
            if p >= 0:
                q = nexts[p][word]
                links[new] = q if sizes[q] == sizes[p] + 1 else self._split(p, word, q)
            last = new

    def firsts(self, words: list[int], window: int) -> list[int | None]:
        """For each window of ``words`` the first document that holds it, or None."""
        nexts, links, sizes, first = self.next, self.link, self.size, self.first
        out: list[int | None] = []
        state, length = 0, 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = links[state]
                length = sizes[state]
            step = nexts[state].get(word)
            state, length = (step, length + 1) if step is not None else (0, 0)
            if length >= window:
                while sizes[links[state]] >= window:
                    state = links[state]
                length = window
            if i >= window - 1:
                out.append(first[state] if length >= window else None)
        return out


def value_runs(values: list) -> Iterator[tuple[int, int, int]]:
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            if values[start] is not None:
                yield start, i, values[start]
            start = i


def match_shard(shard: pa.Table) -> pa.Table:
    """``FOUND`` rows of the contents of one shard."""
    rows = shard.select(["doc_id", "anchor", "content_id", "shift", "content"]).sort_by(
        [("doc_id", "ascending"), ("anchor", "ascending"), ("content_id", "ascending")]
    )
    automaton, numbers = SuffixAutomaton(), {}
    contents: dict[tuple[int, int, int], list[int]] = {}
    for row in rows.to_pylist():
        key = (row["anchor"], row["content_id"], row["shift"])
        if key not in contents:
            contents[key] = [numbers.setdefault(w, len(numbers)) for w in row["content"].split(b" ")]
            automaton.add(contents[key], row["doc_id"])
    out = [
        (anchor, name, shift + low, shift + high, first)
        for (anchor, name, shift), words in contents.items()
        for low, high, first in value_runs(automaton.firsts(words, WINDOW))
    ]
    columns = list(zip(*out)) or [[]] * len(FOUND)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.types)], schema=FOUND)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = 100_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: what is left of each document, words joined by one space."""
    require_columns(docs, key, text)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", text_key(), "text")
    spans = spans_of_repeats(own, WORDS, match_shard, units_per_byte=0.2, shard_units=shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, words = words_of(unpacked(batch.column("text"), batch.column("n_bytes")))
            total = np.diff(starts)
            gone = covered_masks(starts, batch.column("spans"), WINDOW)
            owner = np.repeat(np.arange(len(total)), total)
            removed = np.bincount(owner[gone], minlength=len(total))
            ends = np.concatenate([[0], np.cumsum(total - removed)]).astype(np.int32)
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(~gone))), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total), pa.array(removed, pa.int64()), kept],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return with_spans(own, spans).select("doc_id", "text", "n_bytes", "spans").mapInArrow(run, _RESULT)


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
           FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
late AS (SELECT r, i FROM win JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
marked AS (
  SELECT w.r, w.i, w.w, max(late.i) OVER (PARTITION BY w.r ORDER BY w.i) AS last
  FROM words w LEFT JOIN late ON late.r = w.r AND late.i = w.i),
left_over AS (
  SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM marked
  WHERE last IS NULL OR i >= last + {WINDOW} GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""


@query(OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
