"""Rulebook normalisation: 33 operations on typed columns.

A rule is a dict: op, path ("v" or "v.a.b"), on_error (trace, null, passthrough, drop, error,
quarantine) and the operation's parameters.  Scalar operations apply to each element of arrays
and each field of structs below their path.  All rules of a profile become one lazy plan;
rows that a rule drops or rejects are marked and split off at the end.
"""

from __future__ import annotations

import csv
import json
import os
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.functions.expression import compile_expression, kind_of, predicate, parse, quoted

Scalar = Callable[[Column, T.DataType], tuple[Column, Column | None]]

# Symbols that parse_number strips unless told what to strip.
NUMBER_SYMBOLS = "$€£¥₽₴¢ "
# Words that parse_bool knows.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "да", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "нет", "off"]
# Names of currencies, by code.
CURRENCIES = {
    "USD": ["$", "usd", "us$", "usd$", "$usd"],
    "EUR": ["€", "eur", "euro"],
    "GBP": ["£", "gbp", "gb£", "pound"],
    "JPY": ["¥", "jpy", "yen"],
    "RUB": ["₽", "rub", "руб", "руб.", "р", "р."],
    "UAH": ["₴", "uah", "грн", "грн."],
    "CHF": ["chf"], "CAD": ["cad"], "AUD": ["aud"], "NOK": ["nok"], "SEK": ["sek"], "PLN": ["pln"], "CZK": ["czk"],
    "CNY": ["cny", "元"],
}
# Strftime letters and Java's patterns for them.
DATE_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "e": "d", "I": "hh", "p": "a", "z": "xx", "f": "SSSSSSSSS", "j": "DDD", "a": "EEE", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy"}

ERROR_POLICIES = ("trace", "null", "passthrough", "drop", "error", "quarantine")


class RuleError(ValueError):
    """A rulebook that makes no sense."""


@dataclass
class Normalized:
    """Rows that came through, rejected rows with `_error`, and `_trace` labels of rows that had any."""

    data: DataFrame
    errors: DataFrame
    trace: DataFrame


# ---- scalar operations: value and where it fails


def _text_op(change: Callable[[Column], Column]) -> Scalar:
    """An operation on strings that leaves all else alone."""
    return lambda c, t: (change(c), None) if isinstance(t, T.StringType) else (c, None)


def _number_op(change: Callable[[Column], Column]) -> Scalar:
    return lambda c, t: (change(c), None) if isinstance(t, T.NumericType) else (c, None)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _per_word(form: str) -> Callable[[Column], Column]:
    if form == "lower":
        return F.lower
    if form == "upper":
        return F.upper
    if form == "title":
        # a letter or digit begins a word where none stands before it
        def title(c: Column) -> Column:
            parts = F.split(F.lower(c), "(?<=[^\\p{L}\\p{N}])(?=[\\p{L}\\p{N}])")
            return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")

        return title
    if form == "sentence":

        def sentence(c: Column) -> Column:
            head = F.regexp_extract(c, "^[^\\p{L}\\p{N}]*", 0)
            rest = F.substr(c, F.char_length(head) + 1)
            return F.concat(head, F.upper(F.substring(rest, 1, 1)), F.lower(F.substr(rest, F.lit(2))))

        return sentence
    raise RuleError(f"unknown case {form!r}")


def _null_if(values: list[Any]) -> Scalar:
    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        test = F.lit(False)
        for x in values:
            kind = "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "null"
            if kind == kind_of(t):
                test = test | (c == F.lit(x))
        return F.when(F.coalesce(test, F.lit(False)), F.lit(None)).otherwise(c), None

    return run


def _slug(texts: pa.Array) -> pa.Array:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.category(c).startswith("M"))
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")

    return pa.array([one(x) for x in texts.to_pylist()], pa.string())


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def slugify(c: Column) -> Column:
    """ASCII texts stay in the JVM; others need Unicode decomposition and take an Arrow function."""
    native = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(c.rlike("^\\p{ASCII}*$"), native).otherwise(F.arrow_udf(_slug, "string")(c))


def _replace(pattern: str, with_: str, regex: bool = False) -> Callable[[Column], Column]:
    if regex:
        java = re.sub(r"\$\{(\w+)\}", r"$\1", with_)
        return lambda c: F.regexp_replace(c, F.lit(pattern), F.lit(java))
    return lambda c: F.replace(c, F.lit(pattern), F.lit(with_))


def _dict(map: Any, default: Any = "passthrough") -> tuple[Scalar, Callable[[Column, T.DataType], Column] | None]:
    """Literal keys, then /patterns/ in order, then the default.  Gives the operation, and for default drop where rows go."""
    pairs = _pairs(map)
    literal = {k: v for k, v in pairs if not (len(k) >= 2 and k[0] == k[-1] == "/")}
    regexes = [(k[1:-1], v) for k, v in pairs if len(k) >= 2 and k[0] == k[-1] == "/"]
    for _, v in regexes:
        if not isinstance(v, str):
            raise RuleError(f"the value of a pattern has to be a string: {v!r}")

    def filled(c: Column, pattern: str, template: str) -> Column:
        parts = re.split(r"(\$\$|\$\d{1,2})", template)
        return F.concat(*[F.lit("$") if x == "$$" else F.regexp_extract(c, pattern, int(x[1:])) if re.fullmatch(r"\$\d{1,2}", x) and int(x[1:]) <= re.compile(pattern).groups else F.lit("" if re.fullmatch(r"\$\d{1,2}", x) else x) for x in parts])

    texts = all(isinstance(v, str) or v is None for v in literal.values())

    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        key = _as_text(c, t)
        case = F.when(c.isNull(), F.lit(None))
        if literal:
            table = F.create_map(*[F.lit(x if isinstance(x, str) or not texts else x) for k, v in literal.items() for x in (k, v)])
            case = case.when(key.isin(*literal), F.try_element_at(table, key))
        for pattern, template in regexes:
            case = case.when(key.rlike(pattern), filled(key, pattern, template))
        rest = key if texts and not isinstance(t, T.StringType) else c
        last = rest if default == "passthrough" else F.lit(None) if default in ("null", "drop", None) else F.lit(default)
        return case.otherwise(last), None

    def missing(c: Column, t: T.DataType) -> Column:
        key = _as_text(c, t)
        hit = key.isin(*literal) if literal else F.lit(False)
        for pattern, _ in regexes:
            hit = hit | key.rlike(pattern)
        return c.isNotNull() & ~F.coalesce(hit, F.lit(False))

    return run, missing if default == "drop" else None


def _pairs(map: Any) -> list[tuple[str, Any]]:
    if isinstance(map, dict):
        return list(map.items())
    if isinstance(map, str):
        ext = map.rpartition(".")[2].lower()
        if ext in ("csv", "tsv"):
            with open(map, newline="", encoding="utf-8") as file:
                return [(x[0], x[1]) for x in csv.reader(file, delimiter="\t" if ext == "tsv" else ",")]
        with open(map, encoding="utf-8") as file:
            if ext == "json":
                return _pairs(json.load(file))
            if ext in ("yaml", "yml"):
                from siltflow.sources.texts import yaml

                return _pairs(yaml.safe_load(file))
        raise RuleError(f"unknown kind of dictionary file: {map}")
    return [(k, v) for k, v in map]


def _as_text(c: Column, t: T.DataType) -> Column:
    """As JSON would spell it: whole doubles without a fraction."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.format_string("%d", c.cast("long"))).otherwise(c.cast("string"))
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _parse_number(decimal: str = ".", thousand: str | None = None, strip: str | None = None, parens_negative: bool = False, percent: bool = False) -> Scalar:
    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        if isinstance(t, T.NumericType):
            return c.cast("double"), None
        if isinstance(t, T.BooleanType):
            return c.cast("int").cast("double"), None
        if not isinstance(t, T.StringType):
            return F.lit(None).cast("double"), c.isNotNull()
        text = trim(c)
        blank = text == ""
        sign = F.lit(1.0)
        work = text
        if parens_negative:
            inside = text.startswith("(") & text.endswith(")")
            work, sign = F.when(inside, F.substr(text, F.lit(2), F.char_length(text) - 2)).otherwise(text), F.when(inside, -1.0).otherwise(1.0)
        gone = NUMBER_SYMBOLS if strip is None else strip
        if gone:
            work = F.translate(work, gone, "")
        share = F.lit(1.0)
        if percent:
            share = F.when(work.endswith("%"), 100.0).otherwise(1.0)
            work = F.regexp_replace(work, "%$", "")
        if thousand:
            work = F.replace(work, F.lit(thousand), F.lit(""))
        work = trim(work)
        sign = F.when(work.startswith("-"), -sign).otherwise(sign)
        work = F.regexp_replace(work, "^[-+]", "")
        if decimal != ".":
            work = F.replace(work, F.lit(decimal), F.lit("."))
        good = work.rlike("^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$")
        value = F.when(good, work).try_cast("double") * sign / share
        return F.when(blank | ~good, F.lit(None)).otherwise(value), c.isNotNull() & ~blank & ~good

    return run


def _round(decimals: int) -> Callable[[Column], Column]:
    # half away from zero on the binary product, as 1.005 -> 1.0 shows; not Spark's decimal round()
    factor = float(10**decimals)
    return lambda c: F.signum(c.cast("double")) * F.floor(F.abs(c.cast("double")) * factor + 0.5) / factor


def _clamp(min: float | None = None, max: float | None = None) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        out = c.cast("double")
        if min is not None:
            out = F.when(out < min, float(min)).otherwise(out)
        if max is not None:
            out = F.when(out > max, float(max)).otherwise(out)
        return out

    return run


def java_pattern(strftime: str) -> str:
    out, literal = "", ""
    at = 0
    while at < len(strftime):
        c = strftime[at]
        if c == "%":
            rest = strftime[at + 1 :]
            colon = rest.startswith(":z")
            letter = "z" if colon else rest[:1]
            if letter == "%":
                literal += "%"
            elif letter not in DATE_LETTERS:
                raise RuleError(f"no date letter %{letter}")
            else:
                if literal:
                    out, literal = out + _literal(literal), ""
                out += "xxx" if colon else DATE_LETTERS[letter]
            at += 2 + colon
        else:
            literal += c
            at += 1
    return out + (_literal(literal) if literal else "")


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'" if re.search("[A-Za-z']", x) else x


def _parse_date(formats: list[str], assume_tz: str | None = None, convert_tz: str | None = None, output: str = "date") -> Scalar:
    """The session's time zone has to be UTC."""

    def utc(c: Column, fmt: str) -> tuple[Column, Column]:
        """The instant, and whether the text fits the format but names a local time that a zone skips."""
        pattern = java_pattern(fmt)
        got = F.try_to_timestamp(c, F.lit(pattern))
        if "%z" in fmt or "%:z" in fmt or not assume_tz:
            return got, F.lit(False)
        at = F.to_utc_timestamp(got, assume_tz)
        skipped = got.isNotNull() & (F.from_utc_timestamp(at, assume_tz) != got)
        return F.when(~skipped, at), F.coalesce(skipped, F.lit(False))

    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        if isinstance(t, T.NumericType):
            at = F.when(F.abs(c) > 1e10, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c.cast("long")))
            blank, failed = c.isNull(), None
        elif isinstance(t, T.StringType):
            text = trim(c)
            blank = c.isNull() | (text == "")
            # the first format that the text fits decides, even if by a local time that its zone skips
            found = [utc(text, fmt) for fmt in formats]
            hits = [F.when(got.isNotNull() | skipped, F.struct(got.alias("at"))) for got, skipped in found]
            at = F.coalesce(*hits).getField("at") if hits else F.lit(None).cast("timestamp")
            failed = ~blank & at.isNull()
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            at, blank, failed = c.cast("timestamp"), c.isNull(), None
        else:
            return F.lit(None).cast("string"), c.isNotNull()
        local = F.from_utc_timestamp(at, convert_tz) if convert_tz else at
        if output == "epoch_ms":
            return F.unix_millis(at), failed
        if output == "date":
            return F.date_format(local, "yyyy-MM-dd"), failed
        minutes = (F.unix_seconds(local) - F.unix_seconds(at)) / 60
        offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
        fraction = F.when(F.date_format(local, "SSS") != "000", F.date_format(local, ".SSS")).otherwise("") if output == "iso" else F.lit("")
        return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset), failed

    return run


def _parse_bool(truthy: list[str] | None = None, falsy: list[str] | None = None) -> Scalar:
    yes = [x.lower() for x in (TRUE_WORDS if truthy is None else truthy)]
    no = [x.lower() for x in (FALSE_WORDS if falsy is None else falsy)]

    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        if isinstance(t, T.BooleanType):
            return c, None
        if isinstance(t, T.NumericType):
            return c != 0, None
        if not isinstance(t, T.StringType):
            return F.lit(None).cast("boolean"), c.isNotNull()
        low = F.lower(trim(c))
        return F.when(low.isin(*yes), True).when(low.isin(*no), False), c.isNotNull() & ~low.isin(*yes, *no)

    return run


def _normalize_currency(overrides: dict[str, str] | None = None, fallback: str | None = None) -> Scalar:
    table = {name: code for code, names in CURRENCIES.items() for name in names} | {k.lower(): v.upper() for k, v in (overrides or {}).items()}

    def run(c: Column, t: T.DataType) -> tuple[Column, Column | None]:
        if not isinstance(t, T.StringType):
            return F.lit(None).cast("string"), c.isNotNull()
        text = trim(c)
        known = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(text))
        found = F.coalesce(known, F.when(text.rlike("^[A-Za-z]{3}$"), F.upper(text)))
        blank = text == ""
        if fallback is not None:
            return F.when(blank, F.lit(None)).otherwise(F.coalesce(found, F.when(c.isNotNull(), fallback))), None
        return F.when(~blank, found), c.isNotNull() & ~blank & found.isNull()

    return run


def spread_scalar(op: Scalar, c: Column, t: T.DataType) -> tuple[Column, Column | None]:
    """An operation on every scalar below a value: elements of arrays, fields of structs, values of maps.  It fails where any of them does."""
    if isinstance(t, T.ArrayType):
        _, fails = spread_scalar(op, F.lit(None).cast(t.elementType), t.elementType)
        value = F.transform(c, lambda x: spread_scalar(op, x, t.elementType)[0])
        return value, None if fails is None else F.coalesce(F.exists(c, lambda x: spread_scalar(op, x, t.elementType)[1]), F.lit(False))
    if isinstance(t, T.MapType):
        _, fails = spread_scalar(op, F.lit(None).cast(t.valueType), t.valueType)
        value = F.transform_values(c, lambda _, x: spread_scalar(op, x, t.valueType)[0])
        return value, None if fails is None else F.coalesce(F.exists(F.map_values(c), lambda x: spread_scalar(op, x, t.valueType)[1]), F.lit(False))
    if isinstance(t, T.StructType):
        parts = [(f.name, *spread_scalar(op, c.getField(f.name), f.dataType)) for f in t.fields]
        flags = [x for _, _, x in parts if x is not None]
        fails = flags[0] if flags else None
        for x in flags[1:]:
            fails = fails | x
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v, _ in parts])), fails
    return op(c, t)


# ---- paths


def path_parts(path: str) -> list[str | int]:
    """v.a.b[0][-1] as ["a", "b", 0, -1]; v itself is []."""
    found = re.findall(r"([^.\[\]]+)|\[(-?\d+)\]", path)
    if "".join(f"[{i}]" if i else f".{n}" for n, i in found).lstrip(".") != path.replace(".[", "["):
        raise RuleError(f"bad path {path!r}")
    parts: list[str | int] = [int(i) if i else n for n, i in found]
    return parts[1:] if parts and parts[0] == "v" else parts


def read_path(schema: T.StructType, parts: list[str | int]) -> tuple[Column, T.DataType]:
    """The value at a path; null where there is none."""
    kind: T.DataType = schema
    col: Column | None = None
    for x in parts:
        if isinstance(x, int) and isinstance(kind, T.ArrayType):
            col, kind = F.get(col, F.lit(x)) if x >= 0 else F.try_element_at(col, F.lit(x)), kind.elementType
        elif isinstance(x, str) and isinstance(kind, T.StructType) and x in kind.names:
            col, kind = F.col(quoted(x)) if col is None else col.getField(x), kind[x].dataType
        elif isinstance(x, str) and isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(x)), kind.valueType
        else:
            return F.lit(None).cast("string"), T.StringType()
    return (F.struct(*[F.col(quoted(x)) for x in schema.names]), schema) if col is None else (col, kind)


def write_path(df: DataFrame, parts: list[str | int], value: Column) -> DataFrame:
    """Set a path, making structs on the way; array places cannot be set."""
    if not parts or not all(isinstance(x, str) for x in parts):
        raise RuleError(f"cannot set {parts!r}")
    head, *rest = parts
    if not rest:
        return df.withColumn(head, value)
    if head not in df.columns or not isinstance(df.schema[head].dataType, T.StructType):
        for name in reversed(rest):
            value = F.struct(value.alias(name))
        return df.withColumn(head, value)

    def put(col: Column, kind: T.StructType, names: list[str]) -> Column:
        first, *more = names
        inner = value
        if more:
            inside = kind[first].dataType if first in kind.names else None
            if isinstance(inside, T.StructType):
                inner = put(col.getField(first), inside, more)
            else:
                for name in reversed(more):
                    inner = F.struct(inner.alias(name))
        fields = [(inner if n == first else col.getField(n)).alias(n) for n in kind.names]
        return F.struct(*fields, *([] if first in kind.names else [inner.alias(first)]))

    return df.withColumn(head, put(F.col(quoted(head)), df.schema[head].dataType, rest))


def key_matches(name: str, patterns: list[str]) -> bool:
    """x, x*, *x, *x* and *."""
    return any(re.fullmatch(".*".join(map(re.escape, p.split("*"))) if p.strip("*") or p == "" else ".*", name) is not None for p in patterns)


# ---- the fold over rules

SCALARS: dict[str, Callable[..., Scalar]] = {
    "trim": lambda: _text_op(trim),
    "collapse_whitespace": lambda: _text_op(lambda c: trim(F.regexp_replace(c, "(?U)\\s+", " "))),
    "case": lambda to: _text_op(_per_word(to)),
    "null_if": lambda values: _null_if(values),
    "slugify": lambda: _text_op(slugify),
    "normalize_unicode": lambda: _text_op(lambda c: F.arrow_udf(_composed, "string")(c)),
    "replace": lambda pattern, regex=False, **kw: _text_op(_replace(pattern, kw["with"], regex)),
    "parse_number": _parse_number,
    "round": lambda decimals: _number_op(_round(decimals)),
    "scale": lambda factor: _number_op(lambda c: c * float(factor)),
    "clamp": lambda min=None, max=None: _number_op(_clamp(min, max)),
    "abs": lambda: _number_op(F.abs),
    "parse_date": _parse_date,
    "parse_bool": _parse_bool,
    "normalize_currency": _normalize_currency,
}
SHAPES = ("dict", "split_amount_currency", "rename", "whitelist", "blacklist", "prefix_keys", "suffix_keys", "drop_fields", "keep_fields", "add_field", "split_field", "join_fields", "coalesce", "to_object", "compute", "require", "unwrap_formulas", "template")
OPERATIONS = (*SCALARS, *SHAPES)

_DROP, _ERROR, _TRACE = "_rule_drop", "_rule_error", "_rule_trace"
_OWN = (_DROP, _ERROR, _TRACE)


def _fields(df: DataFrame) -> T.StructType:
    return T.StructType([x for x in df.schema.fields if x.name not in _OWN])


class _Fold:
    def __init__(self, df: DataFrame):
        self.df = df.withColumns({_DROP: F.lit(False), _ERROR: F.lit(None).cast("string"), _TRACE: F.array().cast("array<string>")})

    def run(self, number: int, rule: dict[str, Any]) -> None:
        spec = dict(rule)
        op, policy = spec.pop("op", None), spec.pop("on_error", "trace")
        parts = path_parts(spec.pop("path", "v"))
        if op not in OPERATIONS:
            raise RuleError(f"unknown operation {op!r}")
        if policy not in ERROR_POLICIES:
            raise RuleError(f"unknown on_error {policy!r}")
        try:
            if op in SCALARS:
                self._scalar(SCALARS[op](**spec), parts, number, policy)
            else:
                getattr(self, "_" + op)(parts, number, policy, **spec)
        except (TypeError, KeyError) as e:
            raise RuleError(f"rule {number}: {op}: {e}") from e

    def _mark(self, fails: Column | None, number: int, policy: str, what: str) -> None:
        if fails is None:
            return
        fails = F.coalesce(fails, F.lit(False))
        if policy == "trace":
            self.df = self.df.withColumn(_TRACE, F.when(fails, F.concat(_TRACE, F.array(F.lit(f"rule_{number}: {what}")))).otherwise(F.col(_TRACE)))
        elif policy in ("drop", "error", "quarantine"):
            live = fails & ~F.col(_DROP)
            self.df = self.df.withColumns({_DROP: F.col(_DROP) | fails} | ({_ERROR: F.when(live, f"rule_{number}: {what}").otherwise(F.col(_ERROR))} if policy != "drop" else {}))

    def _set(self, parts: list, value: Column, fails: Column | None, number: int, policy: str, what: str, before: Column | None = None) -> None:
        if fails is not None:
            self.df = self.df.withColumn("_fails", F.coalesce(fails, F.lit(False)))
            value = F.when(~F.col("_fails"), value)
            if policy == "passthrough" and before is not None:
                # one column holds both: results are spelled as JSON would
                made = self.df.select(value.alias("x")).schema["x"].dataType
                value = F.when(F.col("_fails"), before).otherwise(_as_text(value, made))
            # the flag is read before its source changes
            self._mark(F.col("_fails"), number, policy, what)
        self.df = write_path(self.df, parts, value).drop("_fails")

    def _scalar(self, op: Scalar, parts: list, number: int, policy: str) -> None:
        targets = [parts] if parts else [[x.name] for x in _fields(self.df) if not x.name.startswith("_")]
        for at in targets:
            col, kind = read_path(_fields(self.df), at)
            value, fails = spread_scalar(op, col, kind)
            self._set(at, value, fails, number, policy, f"cannot convert {'.'.join(map(str, at))}", _as_text(col, kind) if fails is not None and policy == "passthrough" else None)

    def _dict(self, parts, number, policy, map, default="passthrough"):
        op, missing = _dict(map, default)
        if missing is not None:
            col, kind = read_path(_fields(self.df), parts)
            self.df = self.df.withColumn(_DROP, F.col(_DROP) | missing(col, kind))
        self._scalar(op, parts, number, policy)

    def _keys(self, parts: list, change: Callable[[list[str]], list[tuple[str, str]]]) -> None:
        """Rebuild the object at a path from (old name, new name) pairs; a later one wins."""
        if not parts:
            names = [x.name for x in _fields(self.df)]
            chosen = {new: old for old, new in change(names)}
            self.df = self.df.select(*[F.col(quoted(old)).alias(new) for new, old in chosen.items()], *_OWN)
            return
        col, kind = read_path(_fields(self.df), parts)
        if isinstance(kind, T.StructType):
            chosen = {new: old for old, new in change(kind.names)}
            self.df = write_path(self.df, parts, F.when(col.isNotNull(), F.struct(*[col.getField(old).alias(new) for new, old in chosen.items()])))

    def _rename(self, parts, number, policy, map):
        self._keys(parts, lambda names: [(x, x) for x in names if x not in map] + [(x, map[x]) for x in names if x in map])

    def _whitelist(self, parts, number, policy, keys):
        self._keys(parts, lambda names: [(x, x) for x in names if key_matches(x, keys) or (not parts and x.startswith("_"))])

    def _blacklist(self, parts, number, policy, keys):
        self._keys(parts, lambda names: [(x, x) for x in names if not key_matches(x, keys) or (not parts and x.startswith("_"))])

    def _drop_fields(self, parts, number, policy, fields):
        self._blacklist(parts, number, policy, fields)

    def _keep_fields(self, parts, number, policy, fields):
        self._whitelist(parts, number, policy, fields)

    def _prefix_keys(self, parts, number, policy, value):
        self._keys(parts, lambda names: [(x, x if not parts and x.startswith("_") else value + x) for x in names])

    def _suffix_keys(self, parts, number, policy, value):
        self._keys(parts, lambda names: [(x, x if not parts and x.startswith("_") else x + value) for x in names])

    def _add_field(self, parts, number, policy, field, value):
        self.df = write_path(self.df, [*parts, field], _literal_column(value))

    def _split_field(self, parts, number, policy, field, separator, into, regex=False):
        col, kind = read_path(_fields(self.df), [*parts, field])
        names = _fields(self.df).names if not parts else getattr(read_path(_fields(self.df), parts)[1], "names", [])
        if field not in names:
            return
        pieces = F.split(col, separator if regex else re.escape(separator), -1)
        fails = None if isinstance(kind, T.StringType) else col.isNotNull()
        self.df = self.df.withColumn("_pieces", F.when(F.lit(isinstance(kind, T.StringType)), pieces if fails is None else F.array().cast("array<string>")))
        self._mark(fails, number, policy, f"{field} is no string")
        self._keys(parts, lambda own: [(x, x) for x in own if x != field])
        for k, name in enumerate(into):
            if not parts:
                # _pieces is kept by the selection above
                self.df = self.df.withColumn(name, F.get("_pieces", F.lit(k)))
            else:
                self.df = write_path(self.df, [*parts, name], F.get("_pieces", F.lit(k)))
        self.df = self.df.drop("_pieces")

    def _join_fields(self, parts, number, policy, fields, into, separator=""):
        texts = [_as_text(*read_path(_fields(self.df), [*parts, x])) for x in fields]
        self.df = write_path(self.df, [*parts, into], F.concat_ws(separator, *texts))

    def _coalesce(self, parts, number, policy, fields, into):
        found = [read_path(_fields(self.df), [*parts, x]) for x in fields]
        filled = [F.nullif(c, F.lit("")) if isinstance(t, T.StringType) else c for c, t in found]
        if len({kind_of(t) for _, t in found}) > 1:
            filled = [_as_text(c, t) for c, (_, t) in zip(filled, found, strict=True)]
        self.df = write_path(self.df, [*parts, into], F.coalesce(*filled))

    def _compute(self, parts, number, policy, expression, target):
        done = compile_expression(expression, _fields(self.df))
        self._set(path_parts(target), done.value, done.fails, number, policy, f"cannot compute {expression}")

    def _require(self, parts, number, policy, fields):
        gone = F.lit(False)
        for name in fields:
            col, kind = read_path(_fields(self.df), [*parts, *path_parts(name)])
            empty = col.isNull()
            if kind_of(kind) == "string":
                empty = empty | (col == "")
            elif kind_of(kind) in ("array", "map"):
                empty = empty | (F.size(col) == 0)
            gone = gone | empty
        self.df = self.df.withColumn(_DROP, F.col(_DROP) | F.coalesce(gone, F.lit(False)))

    def _template(self, parts, number, policy, template, target, **kw):
        if "${" in template:
            raise RuleError("a template has no ${...}")
        source = kw.get("from") or {}
        pieces: list[Column] = []
        for text in re.findall(r"\{\{|\}\}|\{[^}]*\}|[^{}]+|[{}]", template):
            if text in ("{{", "}}"):
                pieces.append(F.lit(text[0]))
            elif len(text) > 1 and text[0] == "{":
                at = source.get(text[1:-1])
                pieces.append(F.lit("") if at is None else F.coalesce(_as_text(*read_path(_fields(self.df), path_parts(at))), F.lit("")))
            else:
                pieces.append(F.lit(text))
        self.df = write_path(self.df, path_parts(target), F.concat(*pieces) if pieces else F.lit(""))

    def _unwrap_formulas(self, parts, number, policy):
        targets = [[x.name] for x in _fields(self.df)] if not parts else [parts]
        for at in targets:
            col, kind = read_path(_fields(self.df), at)
            inner = kind.names if isinstance(kind, T.StructType) else [None]
            for name in inner:
                own, own_kind = (col, kind) if name is None else (col.getField(name), kind[name].dataType)
                if isinstance(own_kind, T.ArrayType) and isinstance(own_kind.elementType, T.StringType):
                    # a column has one type: other arrays of strings stay as their JSON text
                    formula = (F.size(own) == 2) & F.coalesce(F.get(own, F.lit(1)).startswith("="), F.lit(False))
                    self.df = write_path(self.df, at if name is None else [*at, name], F.when(formula, F.get(own, F.lit(0))).otherwise(F.to_json(own)))

    def _split_amount_currency(self, parts, number, policy, target_amount, target_currency, decimal=".", thousand=None):
        col, kind = read_path(_fields(self.df), parts)
        text = trim(col) if isinstance(kind, T.StringType) else F.lit(None).cast("string")
        amount = F.regexp_replace(text, "[^0-9+().,\\-  ]", "")
        value, fails = _parse_number(decimal, thousand, None, True, False)(amount, T.StringType())
        currency = F.when(text != "", trim(F.regexp_replace(text, "[0-9+().,\\-  ]", "")))
        wrong = fails if isinstance(kind, T.StringType) else col.isNotNull()
        beside = parts[:-1]
        self.df = self.df.withColumns({"_amount": F.when(text != "", value), "_currency": F.when(~F.coalesce(wrong, F.lit(False)), currency)})
        self._mark(wrong, number, policy, "cannot split amount and currency")
        self.df = write_path(write_path(self.df, [*beside, target_amount], F.col("_amount")), [*beside, target_currency], F.col("_currency")).drop("_amount", "_currency")

    def _to_object(self, parts, number, policy, keys, values, target, on_duplicate="array"):
        names, kind = read_path(_fields(self.df), path_parts(keys))
        items, of = read_path(_fields(self.df), path_parts(values))
        wrong = F.lit(not (isinstance(kind, T.ArrayType) and isinstance(of, T.ArrayType))) | names.isNull() | items.isNull()
        if not (isinstance(kind, T.ArrayType) and isinstance(of, T.ArrayType)):
            self._set(path_parts(target), F.lit(None).cast("map<string,string>"), F.lit(True), number, policy, "keys and values have to be arrays")
            return
        texts = F.transform(names, lambda k: F.coalesce(_as_text(k, kind.elementType), F.lit("")))
        self.df = self.df.withColumns({"_k": texts, "_v": items})
        first = F.array_distinct("_k")
        placed = F.transform("_k", lambda k, i: F.struct(k.alias("k"), F.get("_v", i).alias("v"), i.alias("i")))
        self.df = self.df.withColumns({"_p": placed, "_u": first})
        group = lambda k: F.filter("_p", lambda p: p["k"] == k)
        value_of = {
            "first": lambda k: F.get(group(k), F.lit(0))["v"],
            "last": lambda k: F.try_element_at(group(k), F.lit(-1))["v"],
            "max": lambda k: F.array_max(F.transform(group(k), lambda p: p["v"])),
            "sum": lambda k: F.aggregate(group(k), F.lit(None).cast("double"), lambda a, p: F.coalesce(a + p["v"], a, p["v"].cast("double"))),
            # one value stays as it is, several are an array: a variant holds either
            "array": lambda k: F.when(F.size(group(k)) == 1, _variant(F.get(group(k), F.lit(0))["v"])).otherwise(_variant(F.transform(group(k), lambda p: p["v"]))),
            "error": lambda k: F.get(group(k), F.lit(0))["v"],
        }
        if on_duplicate == "suffix":
            named = F.transform("_p", lambda p: F.struct(F.when(F.size(group(p["k"])) <= 1, p["k"]).otherwise(F.concat(p["k"], F.lit("_"), F.size(F.filter("_p", lambda q: (q["k"] == p["k"]) & (q["i"] <= p["i"]))).cast("string"))).alias("k"), p["v"].alias("v")))
            # a name made by a suffix may also be a key: the last one wins
            self.df = self.df.withColumn("_p", named).withColumn("_u", F.array_distinct(F.transform("_p", lambda p: p["k"])))
            out = F.map_from_arrays("_u", F.transform("_u", lambda k: F.try_element_at(F.filter("_p", lambda p: p["k"] == k), F.lit(-1))["v"]))
        elif on_duplicate in value_of:
            out = F.map_from_arrays("_u", F.transform("_u", value_of[on_duplicate]))
        else:
            raise RuleError(f"unknown on_duplicate {on_duplicate!r}")
        if on_duplicate == "error":
            wrong = wrong | (F.size("_u") < F.size("_k"))
        if on_duplicate in ("max", "sum") and not isinstance(of.elementType, T.NumericType):
            wrong = wrong | (F.size("_u") < F.size("_k"))
        self._set(path_parts(target), out, wrong, number, policy, "cannot make an object")
        self.df = self.df.drop("_k", "_v", "_p", "_u")


def _variant(c: Column) -> Column:
    return F.variant_get(F.parse_json(F.to_json(F.array(c), {"ignoreNullFields": "false"})), "$[0]", "variant")


def _literal_column(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal_column(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*map(_literal_column, value))
    return F.lit(value)


def _read_book(path: str) -> Any:
    from siltflow.sources.texts import yaml

    with open(path, encoding="utf-8") as file:
        return json.load(file) if path.endswith(".json") else yaml.safe_load(file)


def _used(path: str, folder: str) -> list[dict[str, Any]]:
    """The rules of a file that a profile names with `use`: a flat rulebook, beside the file that names it."""
    book = _read_book(os.path.join(folder, path))
    rules = book if isinstance(book, list) else book.get("rules") if isinstance(book, dict) else None
    if not isinstance(rules, list) or (isinstance(book, dict) and "profiles" in book):
        raise RuleError(f"use: {path!r} has to be a flat rulebook")
    return rules


def normalize(df: DataFrame, rules: list[dict[str, Any]] | None = None, profiles: list[dict[str, Any]] | None = None, rulebook: str | None = None, on_unmatched: str = "passthrough", folder: str = ".") -> Normalized:
    """Apply rules, or those of the first profile whose `when` holds (a failing `when` doesn't), given as lists or as a YAML or JSON file.

    A profile has `rules`, or names with `use` a file of rules, beside the rulebook (or under `folder`).
    """
    if sum(x is not None for x in (rules, profiles, rulebook)) != 1:
        raise RuleError("give exactly one of rules, profiles and rulebook")
    if rulebook is not None:
        book = _read_book(rulebook)
        folder = os.path.dirname(os.path.abspath(rulebook))
        rules, profiles = (book, None) if isinstance(book, list) else (book.get("rules"), book.get("profiles"))
    if rules is not None:
        return _finish(_folded(df, rules))
    case: Column | None = None
    for profile in profiles:
        if ("rules" in profile) == ("use" in profile):
            raise RuleError("a profile has either rules or use")
    held = [_used(x["use"], folder) if "use" in x else x["rules"] or [] for x in profiles]
    for k, profile in enumerate(profiles):
        test = F.lit(True) if profile.get("when") is None else F.coalesce(predicate(parse(profile["when"]), df.schema), F.lit(False))
        case = F.when(test, k) if case is None else case.when(test, k)
    marked = df.withColumn("_profile", F.coalesce(case, F.lit(-1)) if case is not None else F.lit(-1))
    parts = [_folded(marked.where(F.col("_profile") == k).drop("_profile"), own) for k, own in enumerate(held)]
    rest = _Fold(marked.where("_profile = -1").drop("_profile")).df
    if on_unmatched == "drop":
        rest = rest.withColumn(_DROP, F.lit(True))
    elif on_unmatched == "error":
        rest = rest.withColumns({_DROP: F.lit(True), _ERROR: F.lit("no profile matched")})
    elif on_unmatched != "passthrough":
        raise RuleError(f"unknown on_unmatched {on_unmatched!r}")
    out = rest
    for x in parts:
        out = out.unionByName(x, allowMissingColumns=True)
    return _finish(out)


def _folded(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    fold = _Fold(df)
    for k, rule in enumerate(rules):
        fold.run(k, rule)
    return fold.df


def _finish(df: DataFrame) -> Normalized:
    own = [x for x in df.columns if x not in _OWN]
    live = df.where(~F.col(_DROP))
    errors = df.where(F.col(_ERROR).isNotNull()).select(*[F.col(quoted(x)) for x in own], F.col(_ERROR).alias("_error"))
    trace = df.where(F.size(_TRACE) > 0).select(*[F.col(quoted(x)) for x in own], F.col(_TRACE).alias("_trace"))
    return Normalized(live.select(*[F.col(quoted(x)) for x in own]), errors, trace)
