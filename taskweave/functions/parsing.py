"""Reading model answers: strict JSON pairs, the last JSON object in a text, a name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskweave.functions.text import let, strip, words

_END = "taskweave-end-of-answer"


def _json_map(text: Column, lenient: bool) -> Column:
    """A JSON object as MAP<STRING, STRING>, or NULL unless the *whole* text is one object.

    Spark's reader stops after the first value and ignores what follows. Parsing
    the text as the first of two array items, with a known second item, makes trailing matter visible.
    """
    options = {
        "allowSingleQuotes": "false",
        "allowNonNumericNumbers": "false",
        "allowUnquotedControlChars": str(lenient).lower(),
    }
    both = F.from_json(
        F.concat(F.lit("["), text, F.lit(', {"' + _END + '": "1"}]')), "array<map<string,string>>", options
    )
    return let(both, lambda b: F.when((F.size(b) == 2) & F.map_contains_key(F.get(b, F.lit(1)), _END), F.get(b, F.lit(0))))


def _last_value(fields: Column, key: str) -> Column:
    """The value of a key; of a key given twice, the last one, as Python reads it."""
    given = F.filter(F.map_entries(fields), lambda e: e["key"] == key)
    return F.try_element_at(given, F.lit(-1))["value"]


def _value_text(text: Column, fields: Column, key: str) -> Column:
    """One value as stripped text; a JSON true/false (not the text "true") reads ``True``/``False``."""
    is_bool = F.from_json(text, f"`{key}` boolean")[key].isNotNull()
    as_text = lambda v: F.when(v.isin("true", "false") & is_bool, F.initcap(v)).otherwise(v)
    return strip(let(_last_value(fields, key), as_text))


def strict_pair(content: Column) -> Column:
    """STRUCT<input, output> when the whole answer is a JSON object with both, non-empty; else NULL."""

    def both_sides(fields: Column) -> Column:
        return F.struct(*[_value_text(content, fields, side).alias(side) for side in ("input", "output")])

    def usable(pair: Column) -> Column:
        return F.when((F.length(pair["input"]) > 0) & (F.length(pair["output"]) > 0), pair)

    return let(let(_json_map(content, lenient=False), both_sides), usable)


def last_object_text(content: Column) -> Column:
    """The right-most balanced ``{...}``: from the last ``}`` back to the ``{`` that closes it.

    Only the braces are walked, not the characters, so long answers cost one scan.
    """
    # as far as the last closing brace; empty when there is none
    return let(F.regexp_extract(content, r"(?s)^.*\}", 0), _balanced_end)


def _balanced_end(body: Column) -> Column:
    braces = F.reverse(F.regexp_extract_all(body, F.lit("[{}]"), F.lit(0)))
    start = F.struct(*[F.lit(0).alias(n) for n in ("depth", "seen", "closed_at")])

    def walk(s: Column, brace: Column) -> Column:
        depth = s["depth"] + F.when(brace == "}", F.lit(1)).otherwise(F.lit(-1))
        seen = s["seen"] + 1
        closed = F.when((s["closed_at"] == 0) & (depth == 0), seen).otherwise(s["closed_at"])
        return F.struct(depth.alias("depth"), seen.alias("seen"), closed.alias("closed_at"))

    closed_at = F.aggregate(braces, start, walk)["closed_at"]

    def cut(count: Column) -> Column:
        # everything right of that brace, plus the brace itself
        right = F.call_function("substring_index", F.translate(body, "{", "}"), F.lit("}"), -count)
        return F.when(count > 0, F.right(body, F.length(right) + 1))

    return let(closed_at, cut)


def last_object(content: Column, required: Sequence[str], optional: Sequence[str] = ()) -> Column:
    """Fields of the last JSON object as MAP<STRING, STRING>, or NULL when a required key is missing.

    Values are stripped; optional keys appear when present; a JSON null stays a NULL value.
    """
    wanted = [*required, *optional]

    def checked(fields: Column) -> Column:
        complete = F.lit(True)
        for key in required:
            complete = complete & F.map_contains_key(fields, key)
        entries = F.array(*[F.struct(F.lit(k).alias("key"), strip(_last_value(fields, k)).alias("value")) for k in wanted])
        present = F.filter(entries, lambda e: F.map_contains_key(fields, e["key"]))
        return F.when(complete, F.map_from_entries(present))

    return let(let(last_object_text(content), lambda text: _json_map(text, lenient=True)), checked)


def chosen_name(content: Column) -> Column:
    """The first ``**name**`` on one line, else the last word without dots, else empty."""
    starred = r"\*\*([^\n]*?)\*\*"
    last_word = F.try_element_at(words(content), F.lit(-1))
    return F.when(content.rlike(starred), F.regexp_extract(content, starred, 1)).otherwise(
        F.coalesce(F.replace(last_word, F.lit("."), F.lit("")), F.lit(""))
    )
