"""Text expressions with the meaning Python gives them, all inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() and str.split() treat as white space.
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class that Java and RE2 both read.
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Default stand-in tokenizer: a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a costly expression so that it is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_SPACES))


def words(c: Column) -> Column:
    """Python ``split()``: pieces between white space, no empty ones."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("bigint")


def fill(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` holes as one ``concat``; literal parts fold at plan time."""
    parts, rest = [], template
    while True:
        hits = [(rest.index("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest]
        if not hits:
            break
        at, key = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(fields[key])
        rest = rest[at + len(key) + 2 :]
    if rest or not parts:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def _float_text(c: Column) -> Column:
    """``repr`` of a double: plain digits from 1e-4 up to 1e16, else an exponent of two digits or more."""
    return let(c.cast("double").cast("string"), _float_from_java)


def _float_from_java(raw: Column) -> Column:
    sign = F.when(raw.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    part = lambda i: F.regexp_extract(raw, r"^-?(\d)\.(\d+)E(-?\d+)$", i)
    frac = F.when(part(2) == "0", F.lit("")).otherwise(part(2))
    digits, exp = F.concat(part(1), frac), part(3).cast("int")
    whole = F.when(
        F.length(digits) <= exp + 1, F.concat(F.rpad(digits, exp + 1, F.lit("0")), F.lit(".0"))
    ).otherwise(F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.length(digits))))
    power = F.concat(
        part(1),
        F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exp).cast("string"),
    )
    scientific = F.when(exp.between(0, 15), whole).when(
        exp == -4, F.concat(F.lit("0.000"), digits)
    ).otherwise(power)
    return (
        F.when(raw == "NaN", F.lit("nan"))
        .when(raw.contains("Infinity"), F.concat(sign, F.lit("inf")))
        .when(raw.contains("E"), F.concat(sign, scientific))
        .otherwise(raw)
    )


def _quoted(c: Column) -> Column:
    escaped = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
        [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")],
        c,
    )
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)


def _joined(open_: str, items: Column, close: str) -> Column:
    return F.concat(F.lit(open_), F.array_join(items, ", "), F.lit(close))


def _nested(c: Column, dtype: T.DataType, render, key, name) -> Column | None:
    """Lists, structs and maps: items by ``render``, map keys by ``key``, field names by the Python function ``name``."""
    if isinstance(dtype, T.ArrayType):
        return _joined("[", F.transform(c, lambda x: render(x, dtype.elementType)), "]")
    if isinstance(dtype, T.StructType):
        pairs = [F.concat(F.lit(name(f.name) + ": "), render(c[f.name], f.dataType)) for f in dtype.fields]
        return _joined("{", F.array(*pairs), "}")
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.concat(key(e["key"].cast("string")), F.lit(": "), render(e["value"], dtype.valueType))
        return _joined("{", F.transform(F.map_entries(c), entry), "}")
    return None


def py_repr(c: Column, dtype: T.DataType) -> Column:
    """What Python shows for a value inside a list or dict."""
    nested = _nested(c, dtype, py_repr, _quoted, repr)
    if nested is not None:
        text = nested
    elif isinstance(dtype, T.StringType):
        text = _quoted(c)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("None")).otherwise(text)


def py_str(c: Column, dtype: T.DataType) -> Column:
    """Python ``str(value)``, with NULL as ``None``."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit("None"))
    return py_repr(c, dtype)


def _ascii_only(c: Column) -> Column:
    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - 0x10000
        pair = F.format_string(r"\u%04x\u%04x", F.shiftright(above, 10) + 0xD800, above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        return F.when(ch.rlike("[ -~]"), ch).when(code > 0xFFFF, pair).otherwise(F.format_string(r"\u%04x", code))

    escaped = F.array_join(F.transform(F.split(c, ""), escape), "")
    return F.when(c.rlike(r"[^\x20-\x7e]"), escaped).otherwise(c)


def _json_string(c: Column) -> Column:
    bare = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return let(bare, _ascii_only)


def json_of_ascii(c: Column) -> Column:
    """A JSON string of a text that is known to be printable ASCII."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_text(c: Column, dtype: T.DataType) -> Column:
    """``json.dumps(value)``: spaces after separators, everything beyond ASCII escaped."""
    nested = _nested(c, dtype, json_text, _json_string, json.dumps)
    if nested is not None:
        text = nested
    elif isinstance(dtype, T.StringType):
        text = _json_string(c)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("true")).otherwise(F.lit("false"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)
