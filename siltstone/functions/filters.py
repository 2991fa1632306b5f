"""The metadata filter language: text or JSON -> tree -> Column.

Grammar: OR < AND < NOT < comparison or parentheses; operators = != > >= < <= IN, NOT IN, CONTAINS, ALL; quoted strings with
backslash escapes; keywords in any case; and the short form `k=v,k=v`. Logic is two-valued: a missing field makes
everything false but != and NOT IN, which it makes true. Comparison is by kind, decided from the schema: values of another
kind are never equal. The result is a plain Column without nulls, so what Catalyst can push down is pushed down.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(>=|<=|!=|=|>|<|\(|\)|,)|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s()=<>!,"']+))""")
_WORDS = {"AND", "OR", "NOT", "IN", "CONTAINS", "ALL"}
_JSON = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "IN", "not_in": "NOT IN", "contains": "CONTAINS", "all": "ALL"}


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object  # a typed literal, or a tuple of them


@dataclass(frozen=True)
class Bool:
    op: str  # AND, OR, NOT
    of: tuple


def literal(text: str, quoted: bool):
    if quoted:
        return text
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        try:
            return datetime.date.fromisoformat(text)
        except ValueError:
            return text
    try:
        return text if "_" in text else float(text)
    except ValueError:
        return text


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FilterError(f"can't read {text[at:]!r}")
        at = m.end()
        op, double, single, word = m.groups()
        if op:
            out.append(("op", op))
        elif word is not None:
            out.append(("key", word.upper()) if word.upper() in _WORDS else ("word", word))
        else:
            out.append(("str", re.sub(r"\\(.)", r"\1", double if double is not None else single)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def peek(self, *want) -> bool:
        return self.i < len(self.t) and self.t[self.i] in want

    def take(self, *want):
        if self.i >= len(self.t) or want and self.t[self.i] not in want:
            raise FilterError(f"expected {want or 'more'} at token {self.i}")
        self.i += 1
        return self.t[self.i - 1]

    def any_of(self, op: str, below):
        parts = [below()]
        while self.peek(("key", op)):
            self.i += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Bool(op, tuple(parts))

    def either(self):
        return self.any_of("OR", lambda: self.any_of("AND", self.negation))

    def negation(self):
        if self.peek(("key", "NOT")):
            self.i += 1
            return Bool("NOT", (self.negation(),))
        if self.peek(("op", "(")):
            self.i += 1
            inner = self.either()
            self.take(("op", ")"))
            return inner
        return self.comparison()

    def value(self):
        kind, v = self.take()
        if kind not in ("word", "str"):
            raise FilterError(f"expected a value, not {v}")
        return literal(v, kind == "str")

    def many(self):
        self.take(("op", "("))
        out = []
        while not self.peek(("op", ")")):
            out.append(self.value())
            if not self.peek(("op", ")")):
                self.take(("op", ","))
        self.take()
        return tuple(out)

    def comparison(self):
        kind, field = self.take()
        if kind not in ("word", "str"):
            raise FilterError(f"expected a field, not {field}")
        kind, op = self.take()
        if kind == "op" and op in ("=", "!=", ">", ">=", "<", "<="):
            return Compare(field, op, self.value())
        if (kind, op) == ("key", "NOT"):
            self.take(("key", "IN"))
            return Compare(field, "NOT IN", self.many())
        if kind == "key" and op in ("IN", "ALL"):
            return Compare(field, op, self.many())
        if (kind, op) == ("key", "CONTAINS"):
            return Compare(field, op, self.value())
        raise FilterError(f"expected an operator, not {op}")


def parse(text: str):
    if not text.strip():
        raise FilterError("empty filter")
    if "," in text and not re.search(r"""[\s()<>!"']""", text):  # the short form
        pairs = [p.split("=", 1) for p in text.split(",")]
        if any(len(p) != 2 or not p[0] for p in pairs):
            raise FilterError(f"can't read {text!r}")
        return Bool("AND", tuple(Compare(k, "=", literal(v, False)) for k, v in pairs))
    p = _Parser(text)
    tree = p.either()
    if p.i < len(p.t):
        raise FilterError(f"left over: {p.t[p.i:]}")
    return tree


def from_json(node: dict):
    """{"and": [..]}, {"or": [..]}, {"not": {..}} or {"eq": {"field": .., "value": ..}} and its like (`values` for lists)."""
    ((op, body),) = node.items()
    if op in ("and", "or"):
        return Bool(op.upper(), tuple(map(from_json, body)))
    if op == "not":
        return Bool("NOT", (from_json(body),))
    typed = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else literal(v, not re.fullmatch(r"\d{4}-\d\d-\d\d", v)) if isinstance(v, str) else v
    return Compare(body["field"], _JSON[op], tuple(map(typed, body["values"])) if "values" in body else typed(body["value"]))


def expand(tree, field: str, closure: dict[int, list[int]], pattern: str = r"^(?:CWE-)?(\d+)$"):
    """Taxonomy rewrite: comparisons of `field` with an id become lists of the id and its descendants."""

    def ids(values):
        found = [int(float(m[1])) for v in values if (m := re.match(pattern, str(int(v)) if isinstance(v, float) and v == int(v) else str(v), re.I))]
        return tuple(float(x) for x in sorted({d for i in found for d in closure.get(i, [i])}))

    if isinstance(tree, Bool):
        return Bool(tree.op, tuple(expand(x, field, closure, pattern) for x in tree.of))
    if tree.field != field or tree.op not in ("=", "!=", "IN", "NOT IN"):
        return tree
    many = ids(tree.value if isinstance(tree.value, tuple) else (tree.value,))
    return Compare(field, "IN" if tree.op in ("=", "IN") else "NOT IN", many) if many else tree


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return {T.StringType: "str", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "date", T.TimestampNTZType: "date"}.get(type(t), "other")


def _lit_kind(v) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "date" if isinstance(v, datetime.date) else "str"


def to_column(tree, df: DataFrame) -> Column:
    """The tree as a Column over df; a field that df lacks is missing in every row."""
    if isinstance(tree, Bool):
        parts = [to_column(x, df) for x in tree.of]
        if tree.op == "NOT":
            return ~parts[0]
        out = F.lit(tree.op == "AND")
        for i, p in enumerate(parts):
            out = p if i == 0 else out & p if tree.op == "AND" else out | p
        return out
    yes, no = F.lit(True), F.lit(False)
    negative = tree.op in ("!=", "NOT IN")
    if tree.field not in df.columns:
        return yes if negative else no
    t, c = df.schema[tree.field].dataType, F.col(f"`{tree.field}`")
    sure = lambda x: F.coalesce(x, no)
    values = tree.value if isinstance(tree.value, tuple) else (tree.value,)
    if isinstance(t, T.ArrayType):
        fits = [v for v in values if _lit_kind(v) == _kind(t.elementType)]
        if tree.op == "CONTAINS":
            return sure(F.array_contains(c, F.lit(fits[0]).cast(t.elementType))) if fits else no
        if tree.op == "ALL":
            return sure(F.size(F.array_except(F.array(*map(F.lit, values)).cast(t) if values else F.array().cast(t), c)) == 0) if len(fits) == len(values) else no
        return yes if negative else no
    fits = [v for v in values if _lit_kind(v) == _kind(t)]
    if _kind(t) == "date" and not isinstance(t, T.DateType):
        c = c.cast("date")
    if tree.op in ("=", "IN", "CONTAINS"):
        return sure(c.isin(fits) if len(fits) > 1 else c == fits[0]) if fits else no
    if negative:
        return ~sure(c.isin(fits) if len(fits) > 1 else c == fits[0]) if fits else yes
    if tree.op == "ALL" or not fits or _kind(t) in ("bool", "other"):
        return no
    test = {">": c > fits[0], ">=": c >= fits[0], "<": c < fits[0], "<=": c <= fits[0]}[tree.op]
    return sure(test & ~F.isnan(c)) if isinstance(t, (T.DoubleType, T.FloatType)) else sure(test)


def apply(df: DataFrame, condition) -> DataFrame:
    """The rows that meet a filter: text, its JSON form, or a parsed one."""
    tree = parse(condition) if isinstance(condition, str) else from_json(condition) if isinstance(condition, dict) else condition
    return df.where(to_column(tree, df))


def from_ids(text: str, field: str, closure: dict[int, list[int]]):
    """Of the weakness ids in a query's text, a filter for them and their descendants; None without any."""
    ids = {int(m) for m in re.findall(r"(?i)\bCWE-(\d+)\b", text)}
    found = sorted({d for i in ids for d in closure.get(i, [i])})
    return Compare(field, "IN", tuple(map(float, found))) if found else None


class Field:
    """Builder: (Field("a") == "x") & (Field("b") >= 1) gives filter text."""

    def __init__(self, name: str):
        self.name = name

    def _make(self, op: str, v) -> Text:
        q = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
        return Text(f"{self.name} {op} " + ("(" + ", ".join(map(q, v)) + ")" if isinstance(v, (list, tuple)) else q(v)))

    def __eq__(self, v):  # type: ignore[override]
        return self._make("=", v)

    def __gt__(self, v):
        return self._make(">", v)

    def __ge__(self, v):
        return self._make(">=", v)

    def __lt__(self, v):
        return self._make("<", v)

    def __le__(self, v):
        return self._make("<=", v)

    def in_(self, v):
        return self._make("IN", list(v))


class Text(str):
    def __and__(self, other) -> Text:
        return Text(f"{self} AND {other}")
