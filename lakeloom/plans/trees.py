"""Catalyst plans as Python trees: one call gives a plan's JSON, the rest is Python.

This is the one module that reaches into the JVM's developer interfaces (not there under Spark Connect).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Node:
    """A plan or an expression: its class's short name, its fields, its children."""

    def __init__(self, kind: str, fields: dict, children: list[Node]):
        self.kind, self.fields, self.children = kind, fields, children

    def __getitem__(self, name: str):
        return self.fields.get(name)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def expressions(self) -> list[Node]:
        """Expressions that are fields of a plan node."""
        out = []
        for v in self.fields.values():
            if isinstance(v, Node):
                out.append(v)
            elif isinstance(v, list):
                out += [x for x in v if isinstance(x, Node)]
        return out

    def deep(self) -> Iterator[Node]:
        """The node, its children and the expressions and plans in its fields, at any depth."""
        yield self
        for x in (*self.expressions(), *self.children):
            yield from x.deep()


def _is_tree(v) -> bool:
    return isinstance(v, list) and v and isinstance(v[0], dict) and "class" in v[0]


def _value(v):
    if _is_tree(v):
        return tree(v)
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, dict) and "class" not in v:
        return {k: _value(x) for k, x in v.items()}
    return v


def tree(rows: list[dict]) -> Node:
    """Nodes in pre-order, each with its number of children."""
    at = 0

    def take() -> Node:
        nonlocal at
        row = rows[at]
        at += 1
        children = [take() for _ in range(row["num-children"])]
        fields = {k: _value(v) for k, v in row.items() if k not in ("class", "num-children")}
        return Node(row["class"].rsplit(".", 1)[-1].rstrip("$"), fields, children)

    return take()


def parse(spark: SparkSession, text: str) -> Node:
    """The unresolved plan of a Spark SQL text; ParseException if there is none."""
    return tree(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON()))


def analyzed(df: DataFrame) -> Node:
    return tree(json.loads(df._jdf.queryExecution().analyzed().toJSON()))


def names(v) -> list[str]:
    """'[a, b]' as the JSON writes lists of names."""
    if isinstance(v, list):
        return [str(x) for x in v]
    return [x.strip() for x in str(v or "[]")[1:-1].split(",") if x.strip()]


def short(v) -> str:
    """A case object's or class's short name."""
    if isinstance(v, dict):
        v = v.get("object") or v.get("product-class") or ""
    return str(v).rsplit(".", 1)[-1].rstrip("$")


_BINARY = {
    "EqualTo": "=", "EqualNullSafe": "<=>", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "And": "AND", "Or": "OR", "Add": "+", "Subtract": "-", "Multiply": "*",
    "Divide": "/", "IntegralDivide": "DIV", "Remainder": "%", "BitwiseAnd": "&", "BitwiseOr": "|", "BitwiseXor": "^", "Like": "LIKE", "RLike": "RLIKE",
}
COMPARISONS = {k for k, v in _BINARY.items() if v in ("=", "<=>", ">", ">=", "<", "<=")}


def text(e: Node) -> str:
    """SQL text of an expression, near to what was written."""
    c = [text(x) for x in e.children]
    k = e.kind
    if k == "UnresolvedAttribute":
        return ".".join(names(e["nameParts"]))
    if k == "AttributeReference":
        return e["name"]
    if k in ("UnresolvedStar", "ResolvedStar"):
        target = names(e["target"]) if isinstance(e["target"], (str, list)) else []
        return ".".join([*target, "*"])
    if k == "Literal":
        v = e["value"]
        return "NULL" if v is None else f"'{v}'" if e["dataType"] == "string" else str(v)
    if k in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = function_name(e)
        return f"{name}({'DISTINCT ' if e['isDistinct'] else ''}{', '.join('*' if name.lower() == 'count' and x == '1' else x for x in c)})"
    if k in _BINARY and len(c) >= 2:
        return f"{_in(e.children[0], c[0])} {_BINARY[k]} {_in(e.children[1], c[1])}"
    if k in ("Alias", "UnresolvedAlias", "NamedParametersSupport"):
        return c[0]
    if k == "Cast":
        return f"CAST({c[0]} AS {str(e['dataType']).upper()})"
    if k == "Not":
        return f"NOT {_in(e.children[0], c[0])}"
    if k == "IsNull":
        return f"{c[0]} IS NULL"
    if k == "IsNotNull":
        return f"{c[0]} IS NOT NULL"
    if k == "In":
        return f"{c[0]} IN ({', '.join(c[1:])})"
    if k == "Between" or k == "UnresolvedBetween":
        return f"{c[0]} BETWEEN {c[1]} AND {c[2]}"
    if k == "CaseWhen":
        n = len(c) // 2
        return "CASE " + " ".join(f"WHEN {c[2 * i]} THEN {c[2 * i + 1]}" for i in range(n)) + (f" ELSE {c[-1]}" if len(c) % 2 else "") + " END"
    if k in ("WindowExpression", "UnresolvedWindowExpression"):
        spec = e["windowSpec"]
        over = spec["name"] if isinstance(spec, dict) and "name" in spec else c[1] if len(c) > 1 else ""
        return f"{c[0]} OVER {over}"
    if k == "WindowSpecDefinition":
        n = len(e["partitionSpec"] or [])
        order = len(e["orderSpec"] or [])
        parts = (["PARTITION BY " + ", ".join(c[:n])] if n else []) + (["ORDER BY " + ", ".join(c[n : n + order])] if order else [])
        parts += [c[-1]] if e.children and e.children[-1].kind == "SpecifiedWindowFrame" else []
        return f"({' '.join(parts)})"
    if k == "SpecifiedWindowFrame":
        return f"{'ROWS' if short(e['frameType']) == 'RowFrame' else 'RANGE'} BETWEEN {c[0]} AND {c[1]}"
    if k in ("UnboundedPreceding", "UnboundedFollowing", "CurrentRow"):
        return {"UnboundedPreceding": "UNBOUNDED PRECEDING", "UnboundedFollowing": "UNBOUNDED FOLLOWING", "CurrentRow": "CURRENT ROW"}[k]
    if k == "SortOrder":
        return f"{c[0]} {'DESC' if short(e['direction']) == 'Descending' else 'ASC'}"
    if k in ("ListQuery", "ScalarSubquery", "Exists", "InSubquery", "LateralSubquery"):
        return f"{', '.join(c[:1])} IN (subquery)" if k == "InSubquery" else "(subquery)" if k != "Exists" else "EXISTS (subquery)"
    if k == "UnresolvedOrdinal":
        return str(e["ordinal"])
    if k == "UnaryMinus":
        return f"-{c[0]}"
    if k == "UnresolvedExtractValue":
        return f"{c[0]}[{c[1]}]" if len(c) > 1 else c[0]
    if k == "UnresolvedNamedLambdaVariable":
        return ".".join(names(e["nameParts"]))
    if k == "LambdaFunction":
        return f"({', '.join(c[1:])}) -> {c[0]}"
    return f"{k}({', '.join(c)})"


def _in(e: Node, t: str) -> str:
    return f"({t})" if e.kind in ("And", "Or", "Add", "Subtract") else t


def function_name(e: Node) -> str:
    if e.kind == "UnresolvedGenerator":
        return (e["name"] or {}).get("funcName", "")
    return names(e["nameParts"])[-1] if e["nameParts"] else e.kind
