"""JSONPath predicates and captures over VARIANT columns: singular paths, comparisons, !, &&, || and parentheses.

A text is compiled once on the driver into a Column, so matching stays inside the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH = r"(?:\.[A-Za-z_]\w*|\[(?:\d+|'[^']*')\])*"
_TOKEN = re.compile(rf"\s*(@{_PATH}|&&|\|\||==|!=|<=|>=|[<>!()]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|'[^']*'|\"[^\"]*\"|true\b|false\b|null\b)")


class Unsupported(ValueError):
    """The text is not in the supported subset."""


def _spark_path(path: str) -> str:
    """A singular path with quoted names written as members of the root."""
    return "$" + re.sub(r"\['([^']*)'\]", r"['\1']", path)


def _node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, _spark_path(path), "variant")


def _typed(v: Column, path: str, kind: str) -> Column:
    """The node's value if it is of the kind (number, string or bool), else null."""
    s = F.schema_of_variant(_node(v, path))
    number = s.startswith("DECIMAL") | s.isin("BIGINT", "DOUBLE", "FLOAT")
    if kind == "number":
        return F.when(number, F.try_variant_get(v, _spark_path(path), "double"))
    return F.when(s == {"string": "STRING", "bool": "BOOLEAN"}[kind], F.try_variant_get(v, _spark_path(path), {"string": "string", "bool": "boolean"}[kind]))


def _literal(t: str) -> tuple[str, object]:
    if t[0] in "'\"":
        return "string", t[1:-1]
    if t in ("true", "false"):
        return "bool", t == "true"
    return ("null", None) if t == "null" else ("number", float(t))


def _compare(v: Column, left: str, op: str, right: str) -> Column:
    if right[0] == "@" and left[0] != "@":
        return _compare(v, right, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), left)
    if left[0] != "@":
        raise Unsupported(f"{left} {op} {right}")
    if right[0] == "@":
        sides = [(_typed(v, left[1:], k), _typed(v, right[1:], k)) for k in ("number", "string", "bool")]
    else:
        kind, value = _literal(right)
        if kind == "null":
            same = F.coalesce(F.is_variant_null(_node(v, left[1:])), F.lit(False))
            return {"==": same, "!=": ~same, "<=": same, ">=": same}.get(op, F.lit(False))
        sides = [(_typed(v, left[1:], kind), F.lit(value))]
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    any_ = F.lit(False)
    for a, b in sides:
        any_ = any_ | F.coalesce(test(a, b), F.lit(False))
    return ~any_ if op == "!=" else any_


def predicate(text: str, v: Column) -> Column:
    """True iff the path `$` or `$[?filter]` selects the payload when it is wrapped in a one-element array."""
    text = text.strip()
    if text == "$":
        return F.lit(True)
    if not (text.startswith("$[?") and text.endswith("]")):
        raise Unsupported(text)
    body, tokens, at = text[3:-1], [], 0
    while body[at:].strip():
        m = _TOKEN.match(body, at)
        if not m:
            raise Unsupported(text)
        tokens.append(m[1])
        at = m.end()

    def any_of() -> Column:
        c = all_of()
        while tokens and tokens[0] == "||":
            tokens.pop(0)
            c = c | all_of()
        return c

    def all_of() -> Column:
        c = one()
        while tokens and tokens[0] == "&&":
            tokens.pop(0)
            c = c & one()
        return c

    def one() -> Column:
        if not tokens:
            raise Unsupported(text)
        t = tokens.pop(0)
        if t == "!":
            return ~one()
        if t == "(":
            c = any_of()
            if not tokens or tokens.pop(0) != ")":
                raise Unsupported(text)
            return c
        if tokens and tokens[0] in ("==", "!=", "<", "<=", ">", ">="):
            op = tokens.pop(0)
            if not tokens:
                raise Unsupported(text)
            return _compare(v, t, op, tokens.pop(0))
        if t[0] != "@":
            raise Unsupported(text)
        return _node(v, t[1:]).isNotNull()

    c = any_of()
    if tokens:
        raise Unsupported(text)
    return c


def capture(path: str, v: Column) -> Column:
    """(present, value as VARIANT) of the first node of a singular path; [*] takes the first element."""
    if not re.fullmatch(rf"\$(?:\.[A-Za-z_]\w*|\[(?:\d+|\*|'[^']*')\])*", path):
        raise Unsupported(path)
    node = _node(v, path[1:].replace("[*]", "[0]"))
    return F.struct(node.isNotNull().alias("present"), node.alias("value"))
