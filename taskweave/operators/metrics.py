"""Score predictions: J3, P21, A3-A6, M13, S10."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import require_columns
from taskweave.functions.text import PY_SPACES, strip, words
from taskweave.staging import stage

CHAR_ORDERS, WORD_ORDERS, BETA = 6, 2, 2
_ORDERS = CHAR_ORDERS + WORD_ORDERS


def pair_with_references(predictions: DataFrame, references: DataFrame, key: str = "row_id") -> DataFrame:
    """Join predictions to references; raises when either side has rows the other lacks, or a key more than once.

    The check moves keys only.
    """
    one, none = F.lit(1), F.lit(0)
    sides = predictions.select(key, one.alias("_p"), none.alias("_r")).union(references.select(key, none, one))
    both = sides.groupBy(key).agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    lost = both.where(F.col(key).isNull() | (F.col("_p") != 1) | (F.col("_r") != 1)).select(key).head(1)
    if lost:
        raise ValueError(f"predictions and references do not match, for example at {key}={lost[0][0]}")
    return predictions.join(references, key)


def detach_echo(prediction: Column, model_input: Column, reference: Column) -> Column:
    """Remove the model input from a prediction that repeats it, unless the reference contains it too."""
    echoed = F.contains(prediction, model_input) & ~F.contains(reference, model_input)
    return F.when(echoed, F.replace(prediction, model_input, F.lit(""))).otherwise(prediction)


def exact_match(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that equal the reference; without one of the two there is no hit."""
    hit = F.coalesce((F.col("prediction") == F.col("reference")).cast("double"), F.lit(0.0))
    return pairs.groupBy(*by).agg(F.avg(hit).alias("value"))


def containment_accuracy(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that contain the target, without the prompt, in lower case."""
    said = strip(F.lower(F.replace(F.col("prediction"), F.col("model_input"), F.lit(""))))
    hit = F.coalesce(F.contains(said, strip(F.lower(F.col("reference")))).cast("double"), F.lit(0.0))
    return pairs.groupBy(*by).agg(F.avg(hit).alias("value"))


# chrF++ ---------------------------------------------------------------------

# Fixed value: the ASCII punctuation marks, those of string.punctuation.
_MARKS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def metric_words(text: Column) -> Column:
    """Words with one punctuation mark split off the end, or else off the start, of a longer word; ``_visible`` has the same rule."""
    def pieces(w: Column) -> Column:
        n = F.length(w)
        last, first = F.right(w, F.lit(1)), F.left(w, F.lit(1))
        return (
            F.when(n == 1, F.array(w))
            .when(last.rlike(_MARKS), F.array(F.left(w, n - 1), last))
            .when(first.rlike(_MARKS), F.array(first, F.right(w, n - 1)))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(words(text), pieces))


_AT_ONCE = 200_000  # characters whose n-grams are counted together, about; a longer row is counted alone
_ROWS = 256  # rows counted together
_KEY_BITS = 63
_HEAD = 6  # characters that a word's key holds at either end


def _table(members: str) -> np.ndarray:
    """Membership by code point; the last cell stands for all code points beyond."""
    table = np.zeros(0x3002, dtype=bool)
    table[[ord(c) for c in members]] = True
    return table


_SPACES, _MARK_TABLE = _table(PY_SPACES), _table(string.punctuation)


def _visible(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts without white space: code points, rows, and where words as in ``metric_words`` begin."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    place = np.minimum(codes, len(_SPACES) - 1)
    seen = ~_SPACES[place]
    begins, ends = seen.copy(), seen.copy()
    apart = ~seen[:-1] | ~seen[1:] | (row[:-1] != row[1:])
    begins[1:] &= apart
    ends[:-1] &= apart
    mark = _MARK_TABLE[place]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    split_last = (last > first) & mark[last]
    split_first = (last > first) & ~split_last & mark[first]
    begins[last[split_last]] = True
    begins[first[split_first] + 1] = True
    return codes[seen], row[seen], begins[seen]


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Small numbers from 1 for the code points at hand."""
    present = np.zeros(int(codes.max()) + 1, dtype=bool)
    present[codes] = True
    return np.cumsum(present)[codes]


def _keys(symbols: np.ndarray, part: np.ndarray, orders: int, bits: int) -> np.ndarray:
    """The next ``orders`` symbols of each place in one number, the first one highest; 0 beyond the end of a part."""
    cuts = np.concatenate([[False], part[1:] != part[:-1]])
    wide = np.arange(len(symbols)) + (orders - 1) * np.cumsum(cuts)  # room for zeros between parts
    spread = np.zeros(wide[-1] + orders, dtype=np.int64)
    spread[wide] = symbols
    keys = np.zeros(wide[-1] + 1, dtype=np.int64)
    for k in range(orders):
        keys = (keys << bits) | spread[k : k + len(keys)]
    return keys[wide]


def _matches(keys: np.ndarray, row: np.ndarray, side: np.ndarray, n_rows: int, orders: int, bits: int) -> np.ndarray:
    """Per row and order the clipped matches: a sort by the longest n-grams puts equal shorter ones together as well."""
    out = np.zeros((n_rows, orders), dtype=np.int64)
    ordered = np.sort((((row << (orders * bits)) | keys) << 1) | side)
    refs = np.concatenate([[0], np.cumsum(ordered & 1)])
    ordered >>= 1
    for order in range(orders, 0, -1):
        cuts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        gram, size = ordered[cuts[:-1]], np.diff(cuts)
        ref = np.diff(refs[cuts])
        # a last symbol of 0 lies beyond the end
        match = np.where((gram & ((1 << bits) - 1)) > 0, np.minimum(size - ref, ref), 0)
        out[:, order - 1] = np.bincount(gram >> (order * bits), weights=match, minlength=n_rows).astype(np.int64)
        ordered >>= bits
    return out


def _matches_by_number(symbols: np.ndarray, part: np.ndarray, row: np.ndarray, side: np.ndarray, n_rows: int, orders: int) -> np.ndarray:
    """The same where n symbols do not fit into one number: an n-gram is the number of its first n-1 symbols and its last one."""
    out = np.zeros((n_rows, orders), dtype=np.int64)
    base = int(symbols.max()) + 1
    start, prefix = np.arange(len(symbols)), row
    for order in range(orders):
        number, _ = pd.factorize(prefix * base + symbols[start + order])
        total = number.max() + 1
        ref = np.bincount(number[side[start] == 1], minlength=total)
        match = np.minimum(np.bincount(number, minlength=total) - ref, ref)
        of = np.empty(total, dtype=np.int64)
        of[number] = row[start]
        out[:, order] = np.bincount(of, weights=match, minlength=n_rows).astype(np.int64)
        after = start + order + 1
        inside = after < len(symbols)
        inside[inside] = part[after[inside]] == part[start[inside]]
        start, prefix = start[inside], number[inside]
        if not len(start):
            break
    return out


def _word_numbers(codes: np.ndarray, begin: np.ndarray, keys: np.ndarray | None, bits: int) -> np.ndarray:
    """Numbers from 1, equal for equal words: short words by their characters in one or two keys, others by their bytes."""
    length = np.diff(np.concatenate([begin, [len(codes)]]))
    number = np.zeros(len(begin), dtype=np.int64)
    used = reach = 0
    if keys is not None:
        reach = 2 * _HEAD
        short, middle = length <= _HEAD, (length > _HEAD) & (length <= reach)
        beyond = bits * (_HEAD - length[short])
        found, names = pd.factorize((keys[begin[short]] >> beyond) << beyond)
        number[short], used = found + 1, len(names)
        heads, _ = pd.factorize(keys[begin[middle]])
        tails, names = pd.factorize(keys[begin[middle] + length[middle] - _HEAD])
        found, names = pd.factorize((heads * max(1, len(names)) + tails) * reach + length[middle])
        number[middle], used = found + 1 + used, used + len(names)
    rest = np.flatnonzero(length > reach)
    known: dict[bytes, int] = {}
    number[rest] = [
        known.setdefault(codes[at : at + n].tobytes(), used + 1 + len(known)) for at, n in zip(begin[rest].tolist(), length[rest].tolist())
    ]
    return number


def _grams(sizes: np.ndarray, orders: int) -> np.ndarray:
    return np.maximum(sizes[:, None] - np.arange(orders), 0)


def _counted(hyp: list[str], ref: list[str]) -> np.ndarray:
    """Per row and order: clipped matches, hypothesis n-grams, reference n-grams; without hash collisions."""
    n_rows = len(hyp)
    out = np.zeros((n_rows, _ORDERS, 3), dtype=np.int64)
    codes, part, begins = _visible([*hyp, *ref])
    if not len(codes):
        return out
    row, side = part % n_rows, part // n_rows
    symbols = _numbered(codes)
    bits, row_bits = int(symbols.max()).bit_length(), (n_rows - 1).bit_length()
    fits = CHAR_ORDERS * bits + row_bits + 1 <= _KEY_BITS
    keys = _keys(symbols, part, CHAR_ORDERS, bits) if fits else None
    if fits:
        out[:, :CHAR_ORDERS, 0] = _matches(keys, row, side, n_rows, CHAR_ORDERS, bits)
    else:
        out[:, :CHAR_ORDERS, 0] = _matches_by_number(symbols, part, row, side, n_rows, CHAR_ORDERS)
    begin = np.flatnonzero(begins)
    words = _word_numbers(codes, begin, keys, bits)
    word_bits, word_part = int(words.max()).bit_length(), part[begin]
    pairs = _keys(words, word_part, WORD_ORDERS, word_bits)
    out[:, CHAR_ORDERS:, 0] = _matches(pairs, row[begin], side[begin], n_rows, WORD_ORDERS, word_bits)
    for at, first in ((1, 0), (2, n_rows)):
        chars, n_words = (np.bincount(p, minlength=2 * n_rows)[first : first + n_rows] for p in (part, word_part))
        out[:, :CHAR_ORDERS, at], out[:, CHAR_ORDERS:, at] = _grams(chars, CHAR_ORDERS), _grams(n_words, WORD_ORDERS)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _gram_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    counts, start, held = [], 0, 0
    sizes = (hyp.str.len() + ref.str.len()).tolist()
    for at, size in enumerate(sizes):
        if at > start and (held + size > _AT_ONCE or at - start == _ROWS):
            counts.append(_counted(hyp.iloc[start:at].tolist(), ref.iloc[start:at].tolist()))
            start, held = at, 0
        held += size
    if sizes:
        counts.append(_counted(hyp.iloc[start:].tolist(), ref.iloc[start:].tolist()))
    return pd.Series([row for block in counts for row in block.reshape(len(block), -1)], dtype=object)


def chrf(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus-level chrF++ (character 1-6-grams, word 1-2-grams, F2, times 100).

    N-grams are counted where the row is; only 24 sums per group are shuffled. Hypothesis n-grams count
    for an order only when the reference has n-grams of that order.
    """
    hyp_text, ref_text = (F.coalesce(F.col(c), F.lit("")) for c in ("prediction", "reference"))
    counted = pairs.select(*by, _gram_counts(hyp_text, ref_text).alias("g"))
    sums = []
    for order in range(_ORDERS):
        match, hyp, ref = (F.get(F.col("g"), F.lit(3 * order + i)) for i in range(3))
        hyp = F.when(ref > 0, hyp).otherwise(F.lit(0))
        sums += [F.sum(c).alias(f"{n}{order}") for n, c in (("m", match), ("h", hyp), ("r", ref))]
    total = counted.groupBy(*by).agg(*sums)
    precision = recall = used = F.lit(0.0)
    for o in range(_ORDERS):
        both = (F.col(f"h{o}") > 0) & (F.col(f"r{o}") > 0)
        ratio = lambda d: F.when(both, F.col(f"m{o}") / F.col(d)).otherwise(F.lit(0.0))  # noqa: E731, B023
        precision, recall = precision + ratio(f"h{o}"), recall + ratio(f"r{o}")
        used = used + both.cast("double")
    p, r = precision / F.nullif(used, F.lit(0.0)), recall / F.nullif(used, F.lit(0.0))
    score = 100 * (1 + BETA**2) * p * r / F.nullif(BETA**2 * p + r, F.lit(0.0))
    return total.select(*by, F.coalesce(score, F.lit(0.0)).alias("value"))


# greedy matching of token vectors -------------------------------------------

_CHUNK = 512  # token vectors per block


def greedy_match(tokens: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per pair precision, recall and F1 of greedy matching between two sets of token vectors.

    ``tokens``: (pair_id, side, token, embedding), side 0 = prediction, 1 = reference; ``token`` numbers the tokens
    of a side from 0. Each token takes its best cosine on the other side. Vectors travel in
    blocks of 512; a pair whose sides have several blocks becomes a grid of cells, so even a
    very long text is spread over tasks, and only maxima leave a cell.
    """
    dtype = tokens.schema[key].dataType.simpleString()
    blocked = tokens.withColumn("block", F.floor(F.col("token") / _CHUNK)).groupBy(key, "side", "block").agg(
        F.array_sort(F.collect_list(F.struct("token", "embedding"))).alias("t")
    )
    spans = blocked.groupBy(key, "side").agg((F.max("block") + 1).alias("n"))
    other = spans.select(key, (1 - F.col("side")).alias("side"), "n")
    placed = blocked.join(other, [key, "side"]).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    side = lambda s, own, opp, name: placed.where(F.col("side") == s).select(
        key, F.col("block").alias(own), F.col("facing").alias(opp), F.col("t.embedding").alias(name)
    )
    cells = side(0, "p_block", "r_block", "p").join(side(1, "r_block", "p_block", "r"), [key, "p_block", "r_block"])

    def best(batches: Iterable[pd.DataFrame]):
        for cell in batches:
            rows = []
            for k, pb, rb, p, r in zip(cell[key], cell["p_block"], cell["r_block"], cell["p"], cell["r"]):
                a, b = np.stack(p).astype(np.float64), np.stack(r).astype(np.float64)
                # a zero vector has cosine 0 with all others
                a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny) for m in (a, b))
                cosine = a @ b.T
                rows.append((k, 0, pb, cosine.max(axis=1)))
                rows.append((k, 1, rb, cosine.max(axis=0)))
            yield pd.DataFrame(rows, columns=[key, "side", "block", "best"])

    partial = cells.mapInPandas(best, f"{key} {dtype}, side int, block bigint, best array<double>")
    per_token = partial.select(key, "side", "block", F.posexplode("best").alias("token", "best")).groupBy(
        key, "side", "block", "token"
    ).agg(F.max("best").alias("best"))
    means = per_token.groupBy(key).agg(
        F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("recall"),
    )
    # a pair with tokens on one side only matches nothing
    zero = F.lit(0.0)
    means = tokens.select(key).distinct().join(means, key, "left").select(
        key, F.coalesce("precision", zero).alias("precision"), F.coalesce("recall", zero).alias("recall")
    )
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


# the evaluation job ----------------------------------------------------------

Metric = Callable[[DataFrame, Sequence[str]], DataFrame]

# Metric names, and the names results are reported under.
METRICS: dict[str, tuple[str, Metric]] = {
    "chr_f": ("chr_f++", chrf),
    "exact_match": ("exact_match", exact_match),
}
NEEDS_VECTORS = "bert_score"


def evaluate(
    pairs: DataFrame,
    metrics: Sequence[str] | None = None,
    model_input: str | None = None,
    by: Sequence[str] = (),
    token_vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(by..., metric, value) rows for ``pairs`` with ``row_id, prediction, reference``.

    ``token_vectors`` turns the pairs into the token table of ``greedy_match`` with ``pair_id`` = ``row_id``; the embedding
    metric needs it and is left out of the default set without it.
    """
    require_columns(pairs, "prediction", "reference", *by)
    known = {*METRICS, NEEDS_VECTORS}
    if metrics is None:
        metrics = sorted(METRICS) + ([NEEDS_VECTORS] if token_vectors else [])
    if not set(metrics) <= known:
        raise ValueError(f"metrics must be among {sorted(known)}, not {sorted(set(metrics) - known)}")
    if model_input is not None:
        pairs = pairs.withColumn("prediction", detach_echo(F.col("prediction"), F.col(model_input), F.col("reference")))
    if len(metrics) > 1:
        pairs = stage(pairs, "pairs")  # predictions are made once, whatever the number of metrics
    parts = []
    for name in metrics:
        if name == NEEDS_VECTORS:
            if token_vectors is None:
                raise ValueError("bert_score needs token_vectors")
            scored = greedy_match(token_vectors(pairs)).withColumnRenamed("pair_id", "row_id")
            # a pair without any token is a pair all the same
            every = pairs.select("row_id", *by).join(scored, "row_id", "left")
            label, table = "average_bert_score", every.groupBy(*by).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("value"))
        else:
            label, fn = METRICS[name]
            table = fn(pairs, by)
        parts.append(table.select(*by, F.lit(label).alias("metric"), F.col("value").cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
