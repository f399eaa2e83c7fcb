"""Operator 8, personal data: detect in the text as it is and in a deobfuscated copy that remembers where it came from.

A small transducer rewrites disguises and keeps, for every character it writes, the span of source characters that it
read: look-alike letters and digits of other scripts, invisible characters, digits spelled as words, and ``at`` / ``dot``
in brackets or as words. The same detectors then run over both texts, and what they find in the rewritten one is mapped
back to the source. Spans found in the text as it is always stay; a mapped span is added unless a span of its kind
already covers it.

A plain ``at`` counts only before a name with a spelled or bracketed dot, and a lone digit word only next to such a
dot or a digit word, so that prose is left alone.

Rows stay where they are: one pass, whole texts, time linear in the length of the text (every pattern starts at run
starts and gives nothing back). Offsets are code points, ends exclusive.

Defined results: a null text counts as empty (``redact_documents`` keeps it null); an empty text has no spans; rows are
judged one by one, so repeated rows and ids give repeated results; spans of equal start stand in the order email, ip,
card, phone; other columns are carried along by ``redact_documents`` and ignored by ``find_personal_data``; an empty
table gives no rows. ``n_*`` count the spans found in the text as it is, ``spans`` lists all.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]

# Python's possessive runs and the looks behind only spare retries: a match can start at the start of a run alone
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[0-9]")

# fixed values: letters of other scripts that look like ASCII ones; the first of each pair is read as the second
_CYRILLIC = "аa вB сc ԁd еe һh іi јj кk мM нH оo рp ѕs тT уy хx АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT УY ХX ԛq ԝw"
_GREEK = "αa ιi κk νv οo ρp υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
_ALIKE = {pair[0]: pair[1] for pair in f"{_CYRILLIC} {_GREEK}".split()}
# fixed values: digit words of the four languages of the tables
_SPELLED = {
    word: str(i % 10)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, word in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted({f"[{w[0]}{w[0].upper()}]{w[1:]}" for w in _SPELLED}, reverse=True)) + ")"
_GAP = r"[ \t\n,-]{1,3}"
_EDGE = r"(?![^\W_])"
_DOT = r"(?:\s{0,3}[\[({<]\s?(?:dot|DOT|Dot|point|punto|punkt)\s?[\])}>]\s{0,3}|\s{1,3}(?:dot|DOT|Dot)\s{1,3}(?=[A-Za-z0-9]))"
_AT = (
    r"(?:\s{0,3}[\[({<]\s?(?:at|AT|At|arroba)\s?[\])}>]\s{0,3}"
    r"|(?<=[A-Za-z0-9])\s{1,3}(?:at|AT|At)\s{1,3}(?=[A-Za-z0-9-]{1,63}" + _DOT + "))"
)
_RUN = rf"(?<![^\W_])(?:[Pp]lus{_GAP})?{_WORD}(?:{_GAP}{_WORD})+{_EDGE}"
_BY_DOT = rf"(?<![^\W_]){_WORD}(?={_DOT})|(?<=\s){_WORD}{_EDGE}"
_HIDDEN = re.compile(r"[^\x00-ɏ]|­")
_DISGUISE = re.compile(rf"{_RUN}|[\[({{<]\s?(?:dot|DOT|Dot|point|punto|punkt|at|AT|At|arroba)\s?[\])}}>]|\s(?:dot|DOT|Dot)\s")
_STEPS = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})|(?P<run>{_RUN})|(?P<one>{_BY_DOT})|(?P<alike>[^\x00-ɏ]|­)")
_NUMERAL, _DOTTED = re.compile(_WORD), re.compile(_DOT)


@lru_cache(maxsize=4096)
def _plain(char: str) -> str:
    """What a character of another script is read as: nothing, an ASCII character, or itself."""
    if char in _ALIKE:
        return _ALIKE[char]
    if unicodedata.category(char) == "Cf":
        return ""
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and folded.isascii() else char


def deobfuscate(text: str) -> tuple[str, array, array]:
    """The rewritten text and, for each of its characters, start and end of the source it stands for."""
    out: list[str] = []
    starts, ends = array("q"), array("q")

    def copy(start: int, end: int) -> None:
        out.append(text[start:end])
        starts.extend(range(start, end))
        ends.extend(range(start + 1, end + 1))

    def write(char: str, start: int, end: int) -> None:
        out.append(char)
        starts.append(start)
        ends.append(end)

    done = dotted = 0
    for step in _STEPS.finditer(text):
        kind, (start, end) = step.lastgroup, step.span()
        copy(done, start)
        if kind == "at" or kind == "dot":
            write("@" if kind == "at" else ".", start, end)
        elif kind == "alike":
            if plain := _plain(step[0]):
                write(plain, start, end)
        elif kind == "one" and not (dotted == start or _DOTTED.match(text, end)):
            copy(start, end)
        else:
            if step[0][:4].lower() == "plus":
                write("+", start, start + 4)
            for word in _NUMERAL.finditer(text, start, end):
                write(_SPELLED[word[0].lower()], *word.span())
        if kind == "dot":
            dotted = end
        done = end
    copy(done, len(text))
    return "".join(out), starts, ends


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def detect(text: str) -> list[Span]:
    """``(start, kind, end)`` of each kind's leftmost non-overlapping matches, in order of start."""
    found: list[Span] = []
    at, done, before = text.find("@"), 0, 0
    while at >= 0:
        low = max(done, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, "email", done))
        before = at + 1
        at = text.find("@", max(done, before))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if len(m[0]) >= 4 and 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text as it is, and all spans."""
    base = detect(text)
    if not ((not text.isascii() and _HIDDEN.search(text)) or _DISGUISE.search(text)):
        return base, base
    plain, starts, ends = deobfuscate(text)
    every = set(base)
    for start, kind, end in detect(plain):
        span = (starts[start], kind, ends[end - 1])
        if not any(k == kind and s <= span[0] and span[2] <= e for s, k, e in base):
            every.add(span)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by the kind of its first span."""
    out, done, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


_FIGURES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts by kind, digest of the base spans, and all spans."""
    require_columns(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name.split()[0]: [] for name in _FIGURES.split(", ")}
            for value in batch.column(1):
                base, every = find_spans(value.as_py() or "")
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[1] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(as_text(base).encode()).hexdigest())
                rows["spans"].append(as_text(every))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **rows}, schema=None)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {_FIGURES}"
    )


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with every span in ``text`` replaced by ``<KIND>``."""
    require_columns(docs, text)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = (v.as_py() for v in batch.column(at))
            new = pa.array([v if v is None else redact(v, find_spans(v)[1]) for v in old], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=columns)

    return docs.mapInArrow(run, docs.schema)


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
