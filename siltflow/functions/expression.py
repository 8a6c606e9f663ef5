"""The record expression language: parser, per-record evaluator and compiler to Columns.

Two readings of one syntax tree.  `evaluate` works on JSON-like Python values and is exact for
rows whose shape drifts.  `compile_expression` works on typed columns: it gives a value, its
kind, and a column that is true where the evaluator would fail, so that error policies stay
declarative and a predicate that cannot fail stays a plain, pushable one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company suffixes that normalize() strips, the first that matches only.
COMPANY_SUFFIXES = ("ltd", "limited", "llc", "inc", "gmbh")
# Functions and the number of their arguments.
FUNCTIONS = {"lower": 1, "normalize": 1, "length": 1, "empty": 1, "includes": 2, "startsWith": 2, "endsWith": 2, "contains": 2, "matches": 2}

_TOKEN = re.compile(
    r"""\s*(?:(?P<op>==|!=|<=|>=|&&|\|\||[<>!(),\[\].])|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class ExpressionError(ValueError):
    """An expression that doesn't parse, or calls what isn't there."""


class EvaluationError(Exception):
    """A record on which an expression fails."""


@dataclass(frozen=True)
class Node:
    kind: str  # literal, array, path, not, op, call
    value: Any = None
    parts: tuple = field(default_factory=tuple)


def parse(source: str) -> Node:
    tokens: list[tuple[str, Any]] = []
    at, end = 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {source[at : at + 10]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "string":
            text = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.S)
        tokens.append((kind, text))
        at = m.end()
    tokens.append(("end", None))
    place = 0

    def peek() -> tuple[str, Any]:
        return tokens[place]

    def take(text: str | None = None) -> tuple[str, Any]:
        nonlocal place
        got = tokens[place]
        if text is not None and got != ("op", text):
            raise ExpressionError(f"expected {text!r}, found {got[1]!r} in {source!r}")
        place += 1
        return got

    def chain(sign: str, below) -> Node:
        left = below()
        while peek() == ("op", sign):
            take()
            left = Node("op", sign, (left, below()))
        return left

    def disjunction() -> Node:
        return chain("||", conjunction)

    def conjunction() -> Node:
        return chain("&&", negation)

    def negation() -> Node:
        if peek() == ("op", "!"):
            take()
            return Node("not", None, (negation(),))
        left = value()
        if peek()[0] == "op" and peek()[1] in ("==", "!=", "<", "<=", ">", ">="):
            sign = take()[1]
            return Node("op", sign, (left, value()))
        return left

    def listed(close: str) -> tuple:
        out = []
        while peek() != ("op", close):
            out.append(disjunction())
            if peek() != ("op", close):
                take(",")
        take(close)
        return tuple(out)

    def value() -> Node:
        kind, text = take()
        if kind == "number":
            number = float(text)
            return Node("literal", int(number) if number.is_integer() else number)
        if kind == "string":
            return Node("literal", text)
        if (kind, text) == ("op", "("):
            inner = disjunction()
            take(")")
            return inner
        if (kind, text) == ("op", "["):
            return Node("array", None, listed("]"))
        if kind == "name":
            if text in ("true", "false", "null"):
                return Node("literal", {"true": True, "false": False, "null": None}[text])
            if peek() == ("op", "("):
                take()
                args = listed(")")
                if text not in FUNCTIONS:
                    raise ExpressionError(f"unknown function {text!r}")
                if len(args) != FUNCTIONS[text]:
                    raise ExpressionError(f"{text} takes {FUNCTIONS[text]} arguments, not {len(args)}")
                return Node("call", text, args)
            path = [text]
            while peek() == ("op", "."):
                take()
                kind, name = take()
                if kind != "name":
                    raise ExpressionError(f"expected a name after '.', found {name!r}")
                path.append(name)
            return Node("path", tuple(path))
        raise ExpressionError(f"unexpected {text!r} in {source!r}")

    tree = disjunction()
    if peek()[0] != "end":
        raise ExpressionError(f"unexpected {peek()[1]!r} in {source!r}")
    return tree


# ---- on JSON values


def truthy(x: Any) -> bool:
    return not (x is None or x is False or (isinstance(x, (int, float)) and not isinstance(x, bool) and x == 0) or x in ("", [], {}))


def _kind(x: Any) -> str:
    return {type(None): "null", bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(x)]


def same(a: Any, b: Any) -> bool:
    """Deep equality without conversion; numbers compare as doubles."""
    if _kind(a) != _kind(b):
        return False
    if _kind(a) == "number":
        return float(a) == float(b)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


#: A company suffix that stands alone at the end, without and with the sign for the end of a text that Python or Java has.
_SUFFIX = f"(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)})"


def company_name(text: str) -> str:
    bare = re.sub(_SUFFIX + r"\Z", "", text.lower())
    return re.sub(r"[\W_]+", " ", bare).strip()


@lru_cache(maxsize=1024)
def small_pattern(pattern: str) -> tuple[str, str]:
    """A small pattern (^ and $ at its ends, .* between literal pieces) as a regex to be found and the tail that has to end the text.

    The regex is the same for Python and Java; a piece that the end is tied to may stand anywhere
    after the beginning, even over other pieces.  A pattern without ^ $ . * is one literal piece.
    """
    first, body, last = re.fullmatch(r"(\^?)(.*?)(\$?)", pattern, re.S).groups()
    if not re.search(r"[$^.*]", pattern):
        first, body, last = "", pattern, ""
    pieces = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", x) for x in body.split(".*")]
    whole = body.split(".*")
    tail = ""
    if last and not (first and len(pieces) == 1):
        tail = whole[-1]
        pieces = pieces[:-1]
    tied = "^" if first and pieces and pieces[0] else ""
    return tied + ".*?".join(filter(None, pieces)), tail


def small_match(text: str, pattern: str) -> bool:
    regex, tail = small_pattern(pattern)
    return text.endswith(tail) and re.search(regex, text, re.S) is not None


def evaluate(node: Node, scope: dict[str, Any]) -> Any:
    if node.kind == "literal":
        return node.value
    if node.kind == "array":
        return [evaluate(x, scope) for x in node.parts]
    if node.kind == "path":
        if node.value[0] not in ("v", "env") or node.value[0] not in scope:
            raise EvaluationError(f"unknown binding {node.value[0]}")
        now = scope[node.value[0]]
        for name in node.value[1:]:
            if not isinstance(now, dict):
                raise EvaluationError(f"{name}: not an object")
            if name not in now:
                raise EvaluationError(f"missing property {name}")
            now = now[name]
        return now
    if node.kind == "not":
        return not truthy(evaluate(node.parts[0], scope))
    if node.kind == "op":
        left = evaluate(node.parts[0], scope)
        if node.value == "&&":
            return truthy(left) and truthy(evaluate(node.parts[1], scope))
        if node.value == "||":
            return truthy(left) or truthy(evaluate(node.parts[1], scope))
        right = evaluate(node.parts[1], scope)
        if node.value in ("==", "!="):
            return same(left, right) == (node.value == "==")
        kinds = {_kind(left), _kind(right)}
        if kinds not in ({"number"}, {"string"}):
            raise EvaluationError(f"cannot order {_kind(left)} and {_kind(right)}")
        if kinds == {"string"}:
            left, right = left.encode(), right.encode()
        else:
            left, right = float(left), float(right)
        return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[node.value]
    args = [evaluate(x, scope) for x in node.parts]
    if node.value == "empty":
        return args[0] is None or args[0] in ("", [], {}) and not isinstance(args[0], bool)
    if node.value == "length":
        if not isinstance(args[0], (str, list, dict)):
            raise EvaluationError("length of a scalar")
        return len(args[0])
    if not isinstance(args[0], str):
        raise EvaluationError(f"{node.value}: not a string")
    if node.value == "contains":
        if not isinstance(args[1], list) or not all(isinstance(x, str) for x in args[1]):
            raise EvaluationError("contains: the second argument has to be an array of strings")
        return any(x.lower() in args[0].lower() for x in args[1])
    if node.value == "lower":
        return args[0].lower()
    if node.value == "normalize":
        return company_name(args[0])
    if not isinstance(args[1], str):
        raise EvaluationError(f"{node.value}: not a string")
    low, other = args[0].lower(), args[1].lower()
    return {"includes": lambda: other in low, "startsWith": lambda: low.startswith(other), "endsWith": lambda: low.endswith(other), "matches": lambda: small_match(*args)}[node.value]()


# ---- on typed columns


@dataclass
class Compiled:
    """A value and its kind; `fails` is true where evaluation fails, None if it never does."""

    value: Column
    kind: str
    fails: Column | None = None
    literal: Any = ...
    nullable: bool = True
    #: of an object, how many keys it has: all its fields, as a field of null is there
    keys: int = 0

    def truth(self) -> Column:
        return truth_of(self.value, self.kind)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "map" if isinstance(dtype, T.MapType) else "object"
    return "null" if isinstance(dtype, T.NullType) else "string"


def truth_of(col: Column, kind: str) -> Column:
    if kind == "null":
        return F.lit(False)
    test = {"bool": lambda: col, "number": lambda: col != 0, "string": lambda: col != "", "array": lambda: F.size(col) > 0, "map": lambda: F.size(col) > 0, "object": lambda: col.isNotNull()}[kind]()
    return F.coalesce(test, F.lit(False))


def _either(*flags: Column | None) -> Column | None:
    known = [x for x in flags if x is not None]
    return None if not known else known[0] if len(known) == 1 else known[0] | _either(*known[1:])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(path: tuple[str, ...], schema: T.StructType, prefix: str = "") -> tuple[Column, T.DataType] | None:
    """The column of a path of names, or None where the schema has none.  Timestamps and dates are read as ISO text."""
    kind: T.DataType = schema
    col = None
    for name in path:
        if isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(name)), kind.valueType
            continue
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        col = F.col(quoted(prefix + name)) if col is None else col.getField(name)
        kind = kind[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), T.StringType()
    if isinstance(kind, T.DateType):
        return col.cast("string"), T.StringType()
    return col, kind


#: Where env.* of a record is kept among its columns.
ENVELOPE = {"t": "_t", "id": "_id", "src": "_src"}


def compile_node(node: Node, schema: T.StructType) -> Compiled:
    if node.kind == "literal":
        if node.value is None:
            return Compiled(F.lit(None), "null", literal=None)
        return Compiled(F.lit(node.value), _kind(node.value), literal=node.value, nullable=False)
    if node.kind == "array":
        parts = [compile_node(x, schema) for x in node.parts]
        fails = _either(*(x.fails for x in parts))
        plain = [x.literal for x in parts] if all(x.literal is not ... for x in parts) else ...
        if len({x.kind for x in parts}) > 1:
            raise ExpressionError("an array of several kinds has no column type; use a record-wise expression")
        return Compiled(F.array(*[x.value for x in parts]), "array", fails, plain, False)
    if node.kind == "path":
        root, *rest = node.value
        if root == "env" and rest and rest[0] in ENVELOPE:
            rest = [ENVELOPE[rest[0]], *rest[1:]]
        elif root == "env" and rest and rest[0] == "v":
            rest = rest[1:]
        elif root != "v":
            return Compiled(F.lit(None), "null", F.lit(True))
        if not rest:
            own = [x for x in schema.names if x not in ENVELOPE.values()]
            return Compiled(F.struct(*[F.col(quoted(x)) for x in own]) if own else F.create_map(), "object" if own else "map", nullable=False, keys=len(own))
        found = resolve(tuple(rest), schema)
        if found is None:  # missing, or through something that is no object
            return Compiled(F.lit(None), "null", F.lit(True))
        above = resolve(tuple(rest[:-1]), schema) if len(rest) > 1 else None
        keys = len(found[1].fields) if isinstance(found[1], T.StructType) else 0
        return Compiled(found[0], kind_of(found[1]), above[0].isNull() if above else None, keys=keys)
    if node.kind == "not":
        inner = compile_node(node.parts[0], schema)
        return Compiled(~inner.truth(), "bool", inner.fails, nullable=False)
    if node.kind == "op":
        return _operation(node, *(compile_node(x, schema) for x in node.parts))
    return _call(node.value, [compile_node(x, schema) for x in node.parts])


def _operation(node: Node, a: Compiled, b: Compiled) -> Compiled:
    if node.value in ("&&", "||"):
        left, right = a.truth(), b.truth()
        reached = left if node.value == "&&" else ~left
        fails = _either(a.fails, None if b.fails is None else reached & b.fails)
        return Compiled(left & right if node.value == "&&" else left | right, "bool", fails, nullable=False)
    fails = _either(a.fails, b.fails)
    if node.value in ("==", "!="):
        if "null" in (a.kind, b.kind):
            equal = a.value.isNull() & b.value.isNull()
        elif a.kind != b.kind:
            equal = a.value.isNull() & b.value.isNull()
        elif a.kind == "number":
            equal = a.value.cast("double").eqNullSafe(b.value.cast("double")) if a.literal is ... and b.literal is ... else a.value.eqNullSafe(b.value)
        elif a.kind in ("array", "object", "map"):
            told = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
            equal = told(a.value).eqNullSafe(told(b.value))
        else:
            equal = a.value.eqNullSafe(b.value)
        return Compiled(equal if node.value == "==" else ~equal, "bool", fails, nullable=False)
    if a.kind != b.kind or a.kind not in ("number", "string"):
        return Compiled(F.lit(False), "bool", F.lit(True))
    test = {"<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value}[node.value]
    nulls = [x.value.isNull() for x in (a, b) if x.nullable]
    return Compiled(F.coalesce(test, F.lit(False)), "bool", _either(fails, *nulls), nullable=False)


def _call(name: str, args: list[Compiled]) -> Compiled:
    first, fails = args[0], _either(*(x.fails for x in args))
    if name == "empty":
        value = {"null": lambda: F.lit(True), "string": lambda: first.value.isNull() | (first.value == ""), "array": lambda: first.value.isNull() | (F.size(first.value) == 0), "map": lambda: first.value.isNull() | (F.size(first.value) == 0)}.get(first.kind, lambda: first.value.isNull())()
        return Compiled(value, "bool", fails, nullable=False)
    if name == "length":
        value = {"string": lambda: F.char_length(first.value), "array": lambda: F.size(first.value), "map": lambda: F.size(first.value), "object": lambda: F.lit(first.keys)}.get(first.kind)
        if value is None:
            return Compiled(F.lit(None).cast("int"), "number", F.lit(True))
        return Compiled(value(), "number", _either(fails, first.value.isNull() if first.nullable else None))
    if first.kind != "string":
        return Compiled(F.lit(None).cast("boolean"), "bool", F.lit(True))
    fails = _either(fails, first.value.isNull() if first.nullable else None)
    if name == "contains":
        second = args[1]
        if second.kind != "array":
            return Compiled(F.lit(False), "bool", F.lit(True))
        low = F.lower(first.value)
        if second.literal is not ...:
            if not all(isinstance(x, str) for x in second.literal):
                return Compiled(F.lit(False), "bool", F.lit(True))
            tests = [low.contains(x.lower()) for x in second.literal]
            value = tests[0] if tests else F.lit(False)
            for x in tests[1:]:
                value = value | x
        else:
            value = F.exists(second.value, lambda x: low.contains(F.lower(x)))
        return Compiled(F.coalesce(value, F.lit(False)), "bool", fails, nullable=False)
    if name == "lower":
        return Compiled(F.lower(first.value), "string", fails)
    if name == "normalize":
        return Compiled(_company(first.value), "string", fails)
    second = args[1]
    if second.kind != "string":
        return Compiled(F.lit(False), "bool", F.lit(True))
    fails = _either(fails, second.value.isNull() if second.nullable else None)
    if name == "matches":
        if second.literal is ...:
            raise ExpressionError("matches takes a literal pattern on columns")
        return Compiled(F.coalesce(_pattern(first.value, second.literal), F.lit(False)), "bool", fails, nullable=False)
    low, other = F.lower(first.value), F.lower(second.value)
    value = {"includes": low.contains(other), "startsWith": low.startswith(other), "endsWith": low.endswith(other)}[name]
    return Compiled(F.coalesce(value, F.lit(False)), "bool", fails, nullable=False)


def _company(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), _SUFFIX + r"\z", "")
    return F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " "))


def _pattern(text: Column, pattern: str) -> Column:
    regex, tail = small_pattern(pattern)
    test = text.rlike("(?s)" + regex) if regex else text.isNotNull()
    return test & text.endswith(tail) if tail else test


def compile_expression(source: str | Node, schema: T.StructType) -> Compiled:
    return compile_node(parse(source) if isinstance(source, str) else source, schema)


def predicate(node: Node, schema: T.StructType) -> Column:
    """True where the expression is truthy and doesn't fail, false or null elsewhere; plain comparisons stay plain, for pushdown."""
    if node.kind == "op" and node.value == "&&":
        return predicate(node.parts[0], schema) & predicate(node.parts[1], schema)
    done = compile_node(node, schema)
    if node.kind == "op" and node.value == "||" and compile_node(node.parts[0], schema).fails is None:
        return predicate(node.parts[0], schema) | predicate(node.parts[1], schema)
    if node.kind == "op" and node.value in ("<", "<=", ">", ">=", "=="):
        a, b = (compile_node(x, schema) for x in node.parts)
        if a.kind == b.kind and a.kind in ("number", "string", "bool") and (node.value != "==" or not (a.nullable and b.nullable)) and not (node.value != "==" and a.kind == "bool"):
            test = {"<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value, "==": a.value == b.value}[node.value]
            inner = _either(a.fails, b.fails)
            return test if inner is None else test & ~inner
    return done.truth() if done.fails is None else done.truth() & ~done.fails


def as_json(x: Any) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
