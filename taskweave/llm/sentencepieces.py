"""Operator 9, SentencePiece encoding and decoding, giant texts in parallel by a max-plus scan over chunks.

A segmentation is a path of pieces. Two pieces may follow each other if merging their joined text gives just them back;
a sequence whose neighbours all may is the segmentation that merging the whole text gives, so every step of the path is
local. Its score is 0 for a step that may be taken and minus infinity for one that may not.

A text longer than a chunk is cut. The state at a cut is the piece that reaches over it or ends at it; a chunk reads some
characters on either side, lists the states at both ends, and gives a matrix: the best score from each entry state to each
exit state. Matrices of one text multiply in the max-plus semiring, which is associative: products from the left say which
states a cut can have, products from the right which can be completed; the best sum is the state there. Every chunk then
traces its own path back between its two states. Matrices are a few numbers wide, whatever the chunk holds.

Most cuts can be laid where no piece of the vocabulary reaches over (before a space), which leaves one state. Within a
chunk, words are merged by themselves and remembered; the matrices carry what lies around the cuts. A run of spaces, whose pieces all score alike, is never cut.

Characters that are no piece become the pieces of their UTF-8 bytes. Ids equal those of the ``sentencepiece`` library
for a byte-fallback BPE model with identity normalization and a space before the text.

Defined results: a null text has null ids (``op9`` counts it as empty), an empty one none; a text that holds U+2581 comes back with
a space in its place; bytes that are no UTF-8 come back as U+FFFD; rows are told apart by a number of their own, so
repeated rows and ids stay; other columns are carried along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table
from taskweave.staging import stage

SPACE = "▁"  # fixed value: how the models write a space
CHUNK = 16_384  # characters
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NEVER = -np.inf
_NO_RANK = 1 << 40
_REMEMBERED = 200_000  # words, and steps between pieces, that a task remembers at most
_ROWS = 128  # rows, and
_CHUNK_ROWS = 16  # chunks of long texts, that a task turns into Python values at once
_SHORT = 32  # characters of the longest word that is merged together with others
_CELLS = 1 << 18  # characters that are merged at once


def _few(batches: Iterator[pa.RecordBatch], rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Pieces:
    """A byte-fallback BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        text = [i for i in range(n) if i not in special and not model.is_byte(i)]
        self.ids = {model.id_to_piece(i): i for i in text}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in text}
        self.longest = max(map(len, self.ids))
        self.back: list[bytes] = [b""] * n
        for piece, i in self.ids.items():
            self.back[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.back[i] = bytes([value])
        self._back = pa.array(self.back, pa.large_binary())
        self.allowed: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Symbols are the pieces and the characters in them; 0 is any other character, which no piece holds.

        ``_pair`` is a hash table of the pairs of symbols that make a piece; ``_made`` has the piece, ``_rank`` the place of
        its score from the best on, the same for equal scores.
        """
        letters = {c for piece in self.ids for c in piece}
        symbols = {s: i for i, s in enumerate(sorted(letters | set(self.ids)), 1)}
        self._width = np.int64(len(symbols) + 1)
        self._letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        for c in letters:
            self._letter[ord(c)] = symbols[c]
        self._id = np.full(len(symbols) + 1, -1, np.int64)
        for piece, i in self.ids.items():
            self._id[symbols[piece]] = i
        place = {score: i for i, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [
            (symbols[a] * int(self._width) + symbols[b], symbols[piece], place[self.score[piece]])
            for piece in self.ids
            for a, b in ((piece[:i], piece[i:]) for i in range(1, len(piece)))
            if a in symbols and b in symbols
        ]
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self._pair = np.full(size, -1, np.int64)
        self._made, self._rank = np.zeros(size, np.int32), np.zeros(size, np.int64)
        left = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        slot = self._slot(left[:, 0])
        while len(left):  # of those that want a free slot the first gets it, the others go one on
            free = np.flatnonzero(self._pair[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._pair[slot[put]], self._made[slot[put]], self._rank[slot[put]] = left[put].T
            left, slot = np.delete(left, put, axis=0), np.delete(slot, put)
            slot = np.where(self._pair[slot] < 0, slot, (slot + 1) & (size - 1))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self._pair).bit_length())).astype(np.int64)

    def merge(self, text: str) -> list[str]:
        """The definition: the best-scored neighbours are joined first, the leftmost of equal ones, until none can be."""
        return self._merge_short(text) if len(text) <= 32 else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        score, parts = self.score, list(text)
        joined = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joined):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = score.get(parts[at] + parts[at + 1])
            if at:
                joined[at - 1] = score.get(parts[at - 1] + parts[at])

    def _merge_long(self, text: str) -> list[str]:
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.score
        heap = [(-score[a + b], i, len(a + b)) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                joined = parts[i] + parts[after[i]]
                if joined in score:
                    heappush(heap, (-score[joined], i, len(joined)))
            if before[i] >= 0:
                joined = parts[before[i]] + parts[i]
                if joined in score:
                    heappush(heap, (-score[joined], before[i], len(joined)))
        return [p for p in parts if p]

    def may_follow(self, a: str, b: str) -> bool:
        known = self.allowed.get((a, b))
        if known is None:
            if len(self.allowed) >= _REMEMBERED:
                self.allowed.clear()
            known = self.allowed[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def endings(self, text: str, end: int) -> Iterator[int]:
        """Starts of the pieces that end at ``end``; a single character always is one."""
        for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
            if start == end - 1 or text[start:end] in self.ids:
                yield start

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            out.extend([known] if known is not None else (self.bytes[b] for b in piece.encode("utf-8", "replace")))
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of symbols the rank of its piece with the place ``at`` of the pair, and the pair's number; -1 if it makes none."""
        key = left * self._width + right
        where = self._slot(key)
        found = self._pair[where]
        other = np.nonzero((found != key) & (found >= 0))
        while len(other[0]):
            where[other] = (where[other] + 1) & (len(self._pair) - 1)
            found[other] = self._pair[where[other]]
            still = (found[other] != key[other]) & (found[other] >= 0)
            other = tuple(o[still] for o in other)
        none = found != key
        rank = self._rank[where] * _SHORT + at
        rank[none] = _NO_RANK
        where[none] = -1
        return rank, where

    def _merge_columns(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words of at most ``size`` characters after merging, a column for each word, which places start a piece, and characters.

        In a round every word joins its best pair, the leftmost of equal ones, as ``merge`` does.
        """
        n = len(words)
        code = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = code.reshape(n, size).T
        lengths = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(size)[:, None]
        held = place < lengths
        symbol = np.where(held, self._letter[np.minimum(code, len(self._letter) - 1)], 0).astype(np.int64)
        after, before = np.repeat(place + 1, n, axis=1), np.repeat(place - 1, n, axis=1)
        # one row more at the end and one that place -1 means: neither makes a pair
        rank = np.full((size, n), _NO_RANK, np.int64)
        number = np.full((size, n), -1, np.int64)
        rank[:-1], number[:-1] = self._joined(symbol[:-1], symbol[1:], np.broadcast_to(place[:-1], (size - 1, n)))
        symbol = np.concatenate([symbol, np.zeros((1, n), np.int64)])
        while True:
            best = rank.min(axis=0)
            word = np.flatnonzero(best < _NO_RANK)
            if not len(word):
                return symbol[:-1], held, code
            left = best[word] % _SHORT
            right = after[left, word]
            symbol[left, word] = self._made[number[left, word]]
            held[right, word] = False
            rank[right, word] = _NO_RANK
            follows = after[right, word]
            after[left, word] = follows
            inside = follows < size
            before[follows[inside], word[inside]] = left[inside]
            rank[left, word], number[left, word] = self._joined(symbol[left, word], symbol[follows, word], left)
            inside = before[left, word] >= 0
            left, word = left[inside], word[inside]
            ahead = before[left, word]
            rank[ahead, word], number[ahead, word] = self._joined(symbol[ahead, word], symbol[left, word], ahead)

    def _spell(self, ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of the characters (``code``) that have none (-1), and how many each place has."""
        plain = ids >= 0
        if plain.all():
            return ids, np.ones(len(ids), np.int64)
        bare = np.flatnonzero(~plain)
        letters, which = np.unique(code[bare], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(c).encode("utf-8", "replace")] for c in letters.tolist()]
        count = np.ones(len(ids), np.int64)
        count[bare] = np.array([len(x) for x in spelled])[which]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        out[at[plain]] = ids[plain]
        padded = np.array([x + [0] * (4 - len(x)) for x in spelled])[which]
        for i in range(4):
            long = count[bare] > i
            out[at[bare][long] + i] = padded[long, i]
        return out, count

    def ids_of_words(self, words: list[str]) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """Words and the ids of their pieces, some at a time; the short ones of about one length are merged together."""
        ordered = sorted(words, key=len)
        lengths = np.fromiter(map(len, ordered), np.int64, len(ordered))
        short = int(np.searchsorted(lengths, _SHORT, side="right"))
        at = 0
        while at < short:
            to = at + max(1, _CELLS // int(lengths[at]))
            to = min(to, short, int(np.searchsorted(lengths, 2 * lengths[at], side="right")))
            symbols, held, code = self._merge_columns(ordered[at:to], max(int(lengths[to - 1]), 2))
            held = held.T
            ids, count = self._spell(self._id[symbols.T[held]], code.T[held])
            last = np.cumsum(held.sum(axis=1)) - 1
            ends = np.cumsum(count)[last].tolist()
            flat = ids.tolist()
            yield ordered[at:to], [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]
            at = to
        for word in ordered[short:]:
            yield [word], [tuple(self.ids_of(self._merge_long(word)))]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start and end where no piece reaches over; the words they have anew are merged together."""
        split = [_UNIT.findall(text) for text in texts]
        every = set().union(*split)
        fresh = every.difference(self.units)
        if len(self.units) + len(fresh) > _REMEMBERED:
            self.units.clear()
            fresh = every
        known = self.units if len(fresh) <= _REMEMBERED else {}  # what does not fit is known for these texts only
        for words, ids in self.ids_of_words(list(fresh)):
            known.update(zip(words, ids))
        out: list[list[int]] = []
        for words in split:
            out.append(ids := [])
            for word in words:
                ids += known[word]
        for word in [w for w in fresh if len(w) > 64]:
            del known[word]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_all(self, rows: pa.ListArray) -> list[str | None]:
        """The text of each list of ids; the bytes of all are put together at once."""
        ends = rows.offsets.to_numpy()
        taken = self._back.take(rows.values.slice(ends[0], ends[-1] - ends[0]))
        at = np.frombuffer(taken.buffers()[1], np.int64)[ends - ends[0]].tolist() if len(taken) else [0] * len(ends)
        held = memoryview(taken.buffers()[2] or b"") if len(taken) else b""
        texts = [str(held[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t[t.startswith(" ") :] if valid else None for t, valid in zip(texts, rows.is_valid().to_pylist())]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def cuts(text: str, size: int, longest: int) -> list[int]:
    """Where to cut: before a space that ends a word if there is one in the next quarter, else away from double spaces."""
    out, at = [0], size
    word_end = re.compile(f"(?<=[^{SPACE}]){SPACE}")
    double = SPACE * 2
    while at + size // 2 < len(text):
        found = word_end.search(text, at, min(len(text), at + size // 4))
        place = found.start() if found else None
        if place is None:
            free = (p for p in range(at, min(at + size // 4, len(text) - longest)) if double not in text[p - longest : p + longest])
            place = next(free, None)
        if place is not None:
            out.append(place)
        at = (place or at) + size
    return [*out, len(text)]


def states(pieces: Pieces, text: str, cut: int) -> list[tuple[int, int]]:
    """Pieces (start, end) with start < cut <= end, in a fixed order; only (cut, cut) at the text's ends and before spaces."""
    if cut == 0 or (text[cut : cut + 1] == SPACE and text[cut - 1] != SPACE):
        return [(cut, cut)]
    found = []
    for end in range(cut, min(cut + pieces.longest, len(text) + 1)):
        for start in pieces.endings(text, end):
            if start < cut:
                found.append((start, end))
    return found if cut < len(text) else [s for s in found if s[1] == cut]


def closed(text: str, cut: int) -> bool:
    """Does no piece reach over this place? It is an end of the text, or before a space that ends a word."""
    return cut in (0, len(text)) or (text[cut] == SPACE and text[cut - 1] != SPACE)


def _whole(state: tuple[int, int]) -> bool:
    return state[0] == state[1]


def transfer(pieces: Pieces, text: str, a: int, b: int) -> tuple[np.ndarray, dict]:
    """Best score from each state at ``a`` to each at ``b``, and for each place the pieces that end there with their scores."""
    entries, exits = states(pieces, text, a), states(pieces, text, b)
    n = len(entries)
    reach: dict[int, dict[int, np.ndarray]] = {}
    for i, (start, end) in enumerate(entries):
        reach.setdefault(end, {}).setdefault(start, np.full(n, _NEVER))[i] = 0
    last = max((e for _, e in exits), default=b)
    closed = _whole(exits[0])
    for end in range(a + 1, last + 1):
        for start in pieces.endings(text, end):
            if start < a or start >= b or (closed and end > b):
                continue
            piece = text[start:end]
            for before, score in reach.get(start, {}).items():
                if pieces.may_follow(text[before:start], piece):
                    at = reach.setdefault(end, {})
                    at[start] = np.maximum(at[start], score) if start in at else score
    none = np.full(n, _NEVER)
    if closed:
        columns = [np.max([none, *reach.get(b, {}).values()], axis=0)]
    else:
        columns = [reach.get(end, {}).get(start, none) for start, end in exits]
    return np.stack(columns, axis=1), reach


def trace(pieces: Pieces, text: str, reach: dict, a: int, entry: tuple[int, int], number: int, exit_: tuple[int, int]) -> list[str]:
    """The pieces after ``entry`` up to and with ``exit_``."""
    path: list[str] = []
    start, end = exit_
    if _whole(exit_):
        start = next(s for s, score in reach[end].items() if score[number] > _NEVER)
    while (start, end) != entry:
        path.append(text[start:end])
        piece = text[start:end]
        before = reach[start]
        start, end = (
            next(s for s, score in before.items() if score[number] > _NEVER and pieces.may_follow(text[s:start], piece)),
            start,
        )
    return path[::-1]


def _normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


_CHUNKS = "row long, chunk int, left string, body string, right string, open boolean"


def _inner(a: int, b: int, pieces: Pieces, text: str) -> tuple[int, int] | None:
    """First and last place in a chunk that no piece reaches over, if it has any."""
    first = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, a + 1, b)
    if not first:
        return None
    low = first.start()
    high = low
    for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text[b - 4 * pieces.longest if b - low > 8 * pieces.longest else low : b]):
        high = max(high, m.start() + (b - 4 * pieces.longest if b - low > 8 * pieces.longest else low))
    return low, high


def _span(row: dict) -> tuple[str, int, int]:
    text = row["left"] + row["body"] + row["right"]
    a = len(row["left"])
    return text, a, a + len(row["body"])


def chunk_matrix(pieces: Pieces, text: str, a: int, b: int) -> np.ndarray:
    """As ``transfer``, by way of the places that no piece reaches over where the chunk has them."""
    inner = _inner(a, b, pieces, text)
    if inner is None:
        return transfer(pieces, text, a, b)[0]
    low, high = inner
    into, out = transfer(pieces, text, a, low)[0], transfer(pieces, text, high, b)[0]
    return into + out  # one state between: the product is a sum


def ids_of_chunks(pieces: Pieces, chunks: list[tuple[str, int, int, int, int]]) -> list[list[int]]:
    """For each (text, a, b, entry, exit) the ids of the pieces after the entry state, up to the exit state."""

    def between(text: str, low: int, high: int, first: int, last: int) -> list[int]:
        _, reach = transfer(pieces, text, low, high)
        entry_, exit__ = states(pieces, text, low)[first], states(pieces, text, high)[last]
        return pieces.ids_of(trace(pieces, text, reach, low, entry_, first, exit__))

    inner = [_inner(a, b, pieces, text) for text, a, b, _, _ in chunks]
    closed = pieces.encode_all([c[0][place[0] : place[1]] if place else "" for c, place in zip(chunks, inner)])
    out = []
    for (text, a, b, entry, exit_), place, ids in zip(chunks, inner, closed):
        if place is None:
            out.append(between(text, a, b, entry, exit_))
        else:
            out.append(between(text, a, place[0], entry, 0) + ids + between(text, place[1], b, 0, exit_))
    return out


def chunk_ids(pieces: Pieces, text: str, a: int, b: int, entry: int, exit_: int) -> list[int]:
    """Ids of the pieces after the entry state, up to the exit state."""
    return ids_of_chunks(pieces, [(text, a, b, entry, exit_)])[0]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chosen_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path through all chunks."""
    ahead = [np.zeros((1, 1))]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    behind = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        behind.append(product(m, behind[-1]))
    return [int((f[0] + b[:, 0]).argmax()) for f, b in zip(ahead, reversed(behind))]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the array column ``out``."""
    require_columns(docs, text)
    at, columns = docs.columns.index(text), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in _few(batches):
            texts = batch.column(at).to_pylist()
            found = pieces.encode_all([_normal(t or "") for t in texts])
            ids = pa.array([None if t is None else i for t, i in zip(texts, found)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*columns, out])

    giant = F.coalesce(F.length(text) > chunk, F.lit(False))
    small = docs.where(~giant).mapInArrow(short, schema)
    # giant texts get a number, and the numbered rows are written: a row read again must keep it
    numbered = stage(docs.where(giant).select(F.monotonically_increasing_id().alias("__row"), F.struct(*columns).alias("__kept")), "giants", compression="zstd")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        reach = 2 * pieces.longest
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = _normal(value.as_py())
                ends = cuts(whole, chunk, pieces.longest)
                rows = [
                    (row, i, whole[max(0, a - reach) : a], whole[a:b], whole[b : b + reach], not (closed(whole, a) and closed(whole, b)))
                    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))
                ]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
                names = [f.split()[0] for f in _CHUNKS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    chunks = stage(
        numbered.select("__row", F.col("__kept")[text].alias("t")).mapInArrow(split, _CHUNKS).repartition("row", "chunk"), "chunks", compression="zstd"
    )
    # a chunk that no piece reaches into or out of is a product by itself, and leaves the others' product as it is
    linked = chunks.where("open")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in _few(batches, _CHUNK_ROWS):
            found = [chunk_matrix(pieces, *_span(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())],
                names=["row", "chunk", "exits", "matrix"],
            )

    def scan(one: pa.Table) -> pa.Table:
        one = one.sort_by("chunk")
        wide = zip(one.column("matrix").to_pylist(), one.column("exits").to_pylist())
        way = chosen_states([np.frombuffer(m).reshape(-1, n) for m, n in wide])
        return pa.Table.from_arrays(
            [one.column("row"), one.column("chunk"), pa.array(way[:-1], pa.int32()), pa.array(way[1:], pa.int32())],
            names=["row", "chunk", "entry", "exit"],
        )

    way = (
        linked.mapInArrow(matrices, "row long, chunk int, exits int, matrix binary")
        .groupBy("row")
        .applyInArrow(scan, "row long, chunk int, entry int, exit int")
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in _few(batches, _CHUNK_ROWS):
            found = [(_span(r), (r["entry"], r["exit"])) for r in batch.to_pylist()]
            ids = ids_of_chunks(pieces, [(*s, *(w if w[0] is not None else chosen_states([chunk_matrix(pieces, *s)]))) for s, w in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "chunk", "ids"]
            )

    alone = chunks.where("NOT open").withColumns({c: F.lit(None).cast("int") for c in ("entry", "exit")})
    parts = linked.join(way, ["row", "chunk"]).unionByName(alone).mapInArrow(traced, "row long, chunk int, ids array<int>")
    whole = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    long = numbered.join(whole, numbered["__row"] == whole["row"]).select(
        *[F.col("__kept")[c].alias(c) for c in columns], F.flatten(F.transform("parts", lambda p: p["ids"])).alias(out)
    )
    return small.unionByName(long)


def decode_ids(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the array column ``ids``; null ids give null."""
    require_columns(rows, ids)
    at, columns = rows.columns.index(ids), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in _few(batches):
            texts = pa.array(pieces.decode_all(batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*columns, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


_DIGEST = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same_text boolean"


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = decode_ids(encode_texts(docs, path), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            ids = [v.values.to_numpy().astype("<u4") for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(v) for v in ids], pa.int64()),
                    pa.array([zlib.crc32(v.tobytes()) for v in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
                    pa.array([a == b for a, b in zip(batch.column("text"), batch.column("decoded"))], pa.bool_()),
                ],
                names=[f.split()[0] for f in _DIGEST.split(", ")],
            )

    return coded.mapInArrow(digest, _DIGEST)
