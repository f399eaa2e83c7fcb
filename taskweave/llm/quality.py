"""Operator 3, quality rules: clean line by line first, then judge what is left of the document.

Lines are judged by themselves: a line fails if it is short and does not end in punctuation, is mostly punctuation, reads like a
navigation bar, or is short and carries a boilerplate phrase as whole words. Failing lines are taken out, and a document is rejected when it loses
more than half of its word characters. A document of one line (or of one paragraph) is judged like any other.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``. Lines without a word are neither failing nor counted.
The base figures (words, symbols, repeated lines and windows) are taken over the whole original text.

The rows stay where they are: one pass over the texts in Arrow batches, no shuffle. Word and line ids come from Arrow's
dictionary encoding of a batch, so the counts are exact and not those of hashes.

Defined results: a null text counts as no text at all (no words, so ``base_failed``) and its cleaned text is null; an
empty text likewise, but it stays empty; rows are judged one by one, so repeated rows and ids give repeated results;
other columns are carried along by ``clean_documents`` and ignored by ``judge_documents``; an empty table gives no rows.
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

# fixed values: the rules of a line (phrases: English only), RE2 syntax, read by Arrow and by the SQL alike
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
ENDS = r"[.!?:;,…。！？\"'”’»)\]}]" + SPACE + r"*$"
MARKS = r"[^\pL\pN\x20\x09-\x0D]"
BAR = r"[|>»•·/]" + SPACE
PHRASES = (
    r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|javascript|lorem ipsum"
    r"|sign in|log in|subscribe to|click here|read more|skip to content|powered by|share (this|on))\b"
)

MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST_PCT = 50, 50, 50
SHORT = 120  # word characters; a longer line is a paragraph, which may end without punctuation
_BLOCK = 1 << 22  # bytes of text that are worked on at once, unless one text is longer

_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, n_marks_failed long, n_nav_failed long, n_phrase_failed long, kept_chars long, base_failed boolean, kept boolean, cleaned string"


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer for each distinct pair."""
    wide = int(b.max()) + 1 if len(b) else 1
    if len(a) and int(a.max()) * wide >= 1 << 62:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    return a * wide + b


def _sums(owner: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64)


def _pieces(texts: pa.Array, split) -> tuple[np.ndarray, pa.Array]:
    """The flattened pieces of each text and the text that each piece belongs to."""
    lists = split(texts)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()


def _ids(pieces: pa.Array) -> np.ndarray:
    return pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _count(pieces: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _has(pieces: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)


def _repeat_words(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Words that stand in a window of three words found twice or more in their text."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    inside = doc[:-2] == doc[2:]
    key = _combine(_combine(_combine(doc[:-2], word[:-2]), word[1:-1]), word[2:])
    order = np.argsort(key[inside], kind="stable")
    ordered = key[inside][order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(ordered), bool)
    twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    starts = np.flatnonzero(inside)[twice]
    covered = np.zeros(len(word), bool)
    for step in range(3):
        covered[starts + step] = True
    return _sums(doc[covered], None, n)


def judge(texts: pa.Array) -> dict[str, pa.Array | np.ndarray]:
    n = len(texts)
    given = texts
    texts = pc.fill_null(texts.cast(pa.string()), "")
    owner, words = _pieces(texts, pc.ascii_split_whitespace)
    real = pc.greater(pc.binary_length(words), 0)
    owner, words = owner[real.to_numpy(zero_copy_only=False)], words.filter(real)
    n_words = _sums(owner, None, n)
    repeat = _repeat_words(owner, _ids(words), n)
    word_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False) - _count(texts, SPACE)

    doc, lines = _pieces(texts, lambda t: pc.split_pattern(t, "\n"))
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False) - _count(lines, SPACE)
    filled = chars > 0
    key = _combine(doc, _ids(lines))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    marks = (~_has(lines, ENDS) & (chars < SHORT)) | (100 * _count(lines, MARKS) > 30 * chars)
    bars = 100 * _count(lines, BAR) > 5 * chars
    phrase = _has(lines, PHRASES) & (chars < SHORT)
    failed = filled & (marks | bars | phrase)
    kept_chars = _sums(doc, np.where(failed, 0, chars), n)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * n_words)
    kept = ~base_failed & (100 * (word_chars - kept_chars) <= MAX_LOST_PCT * word_chars)

    left = lines.filter(pa.array(~failed))
    sizes = np.bincount(doc[~failed], minlength=n)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left), "\n")
    cleaned = pc.if_else(pc.is_valid(given), cleaned, pa.scalar(None, pa.string()))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _count(texts, SYMBOLS),
        "n_dup_lines": _sums(doc[filled & ~first], None, n),
        "n_repeat_words": repeat,
        "n_lines": _sums(doc[filled], None, n),
        "n_failed_lines": _sums(doc[failed], None, n),
        "n_marks_failed": _sums(doc[filled & marks], None, n),
        "n_nav_failed": _sums(doc[filled & bars], None, n),
        "n_phrase_failed": _sums(doc[filled & phrase], None, n),
        "kept_chars": kept_chars,
        "base_failed": base_failed,
        "kept": kept,
        "cleaned": cleaned,
    }


def blocks(texts: pa.Array, most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield start, stop
        start = stop


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base figures, rule figures, verdict and cleaned text of every row; columns ``doc_id`` and those of ``_FIGURES``."""
    require_columns(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **judge(part.column(1))})

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {_FIGURES}"
    )


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their cleaned texts and all other columns as they were."""
    require_columns(docs, text)
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(at)):
                part = batch.slice(start, stop - start)
                verdict = judge(part.column(at))
                filled = [verdict["cleaned"] if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(filled, names=columns).filter(pa.array(verdict["kept"]))

    return docs.mapInArrow(run, docs.schema)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD = r"'[^\x20\x09-\x0D]+'"
_CHARS = f"length(regexp_replace({{x}}, {_q(SPACE)}, '', 'g'))"
_N = "len(regexp_extract_all({x}, {p}))"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS ws FROM d),
words AS (SELECT i, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS k FROM w),
win AS (
  SELECT i, k, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY i ORDER BY k)),
twice AS (SELECT i, a, b, c FROM win WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
covered AS (
  SELECT i, count(DISTINCT p) AS n
  FROM (SELECT i, unnest([k, k + 1, k + 2]) AS p FROM win JOIN twice USING (i, a, b, c)) GROUP BY i),
raw AS (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d),
measured AS (
  SELECT i, line, {_CHARS.format(x="line")} AS chars,
    NOT regexp_matches(line, {_q(ENDS)}) AND {_CHARS.format(x="line")} < {SHORT} OR 100 * {_N.format(x="line", p=_q(MARKS))} > 30 * {_CHARS.format(x="line")} AS marks,
    100 * {_N.format(x="line", p=_q(BAR))} > 5 * {_CHARS.format(x="line")} AS bars,
    regexp_matches(line, {_q(PHRASES)}) AND {_CHARS.format(x="line")} < {SHORT} AS phrase
  FROM raw),
lined AS (
  SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup,
    count(*) FILTER (marks OR bars OR phrase) AS failed, count(*) FILTER (marks) AS m, count(*) FILTER (bars) AS b,
    count(*) FILTER (phrase) AS p, sum(chars) FILTER (NOT (marks OR bars OR phrase)) AS kept_chars
  FROM measured WHERE chars > 0 GROUP BY i),
figures AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, {_CHARS.format(x="text")}::BIGINT AS word_chars,
    {_N.format(x="text", p=_q(SYMBOLS))}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(failed, 0)::BIGINT AS n_failed_lines, coalesce(m, 0)::BIGINT AS n_marks_failed,
    coalesce(b, 0)::BIGINT AS n_nav_failed, coalesce(p, 0)::BIGINT AS n_phrase_failed,
    coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN covered USING (i) LEFT JOIN lined USING (i))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
    AND 100 * (word_chars - kept_chars) <= {MAX_LOST_PCT} * word_chars AS kept
FROM figures
"""


@query(OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents")).drop("cleaned")
