"""Texts and JSON of metadata and lineage, and the service's answers as plain functions."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import SparkSession

from lakeloom.plans.lineage import Lineage, lineage, tree
from lakeloom.plans.metadata import Metadata
from lakeloom.plans.tokens import tokenize
from lakeloom.sources.catalog import connect


def summary(meta: Metadata) -> str:
    """Tables, joins and fields of a query, a line each."""
    out = ["tables:"]
    out += [f"  {t['qualified_name']}" + (f" as {t['alias']}" if t["alias"] else "") + (f" in {t['scope']}" if t["scope"] else "") for t in meta.records("tables")]
    out.append("joins:")
    out += [f"  {j['left']} {j['join_type']} {j['right']} on {j['condition'] or ', '.join(j['using'])}" for j in meta.records("joins")]
    out.append("fields:")
    out += [f"  {f['alias'] or f['expression']} = {f['expression']} [{f['category']}]" for f in meta.records("fields")]
    return "\n".join(out)


def listing(found: Lineage) -> str:
    """Tables, then each output column with its sources."""
    out = ["tables: " + ", ".join(found.tables)]
    for c, s in zip(found.columns, found.sources):
        out.append(f"{c.name} = {c.expression} [{c.category}]")
        out += [f"  <- {t}.{n}" for t, n in s]
    return "\n".join(out)


def drawing(found: Lineage, deepest: int = 10) -> str:
    """The lineage tree in box-drawing characters."""
    out: list[str] = []

    def draw(node: dict, lead: str, last: bool, depth: int) -> None:
        text = node["field"] if node["is_leaf"] else f"{node['field']} [{node['category']}] {node['expression']}"
        out.append(f"{lead}{'└── ' if last else '├── '}{text}")
        if depth < deepest:
            below = node["children"]
            for k, c in enumerate(below):
                draw(c, lead + ("    " if last else "│   "), k == len(below) - 1, depth + 1)

    nodes = tree(found, deepest)
    for k, n in enumerate(nodes):
        draw(n, "", k == len(nodes) - 1, 1)
    return "\n".join(out)


class BadRequest(ValueError):
    """A request that lacks what it needs; ``code`` is the HTTP status."""

    code = 400


#: What a service's clients are told.
_MISSING = {"sql": "SQL 语句不能为空", "connectorType": "连接器类型不能为空"}
_UNKNOWN = "接口不存在: "


def error(e: Exception) -> dict:
    return {"error": True, "type": type(e).__name__, "message": str(e), "statusCode": getattr(e, "code", 500)}


def health() -> dict:
    return {"status": "UP", "service": "Lineage"}


def _node(x: dict) -> dict:
    return {"fieldName": x["field"], "expression": x["expression"], "category": x["category"], "isLeaf": x["is_leaf"], "children": [_node(c) for c in x["children"]]}


def answer(spark: SparkSession, path: str, request: Mapping[str, object]) -> dict:
    """What a service answers to /health and /api/lineage/{extract,tables,columns}; errors as an envelope."""
    try:
        if path == "/health":
            return health()
        if path not in ("/api/lineage/extract", "/api/lineage/tables", "/api/lineage/columns"):
            e = BadRequest(_UNKNOWN + path)
            e.code = 404
            raise e
        for name, told in _MISSING.items():
            if not str(request.get(name) or "").strip():
                raise BadRequest(told)
        try:
            catalog = connect(spark, str(request["connectorType"]), request.get("connectorConfig") or {})
        except (ValueError, KeyError) as e:
            raise BadRequest(str(e)) from e
        found = lineage(spark, str(request["sql"]), catalog)
        out: dict = {"sql": request["sql"]}
        if path != "/api/lineage/columns":
            out["tableLineages"] = []
            for name in found.tables:
                t = catalog.resolve(name)
                out["tableLineages"].append({"qualifiedName": name, "database": name.rpartition(".")[0], "tableName": name.rpartition(".")[2], "tableType": t.kind if t else None, "comment": t.comment if t else None})
        if path != "/api/lineage/tables":
            out["columnLineages"] = [
                {"targetField": c.name, "expression": c.expression, "category": c.category, "isFinalOutput": True, "sources": [{"table": t, "column": n} for t, n in s]} for c, s in zip(found.columns, found.sources)
            ]
        if path == "/api/lineage/extract":
            out["columnLineageTree"] = [_node(x) for x in tree(found)]
        return out
    except Exception as e:  # an answer in any case
        return error(e)


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


_BREAKS = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "LATERAL")
_WORDS = frozenset("SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION ALL INTERSECT EXCEPT MINUS JOIN LEFT RIGHT FULL INNER OUTER CROSS SEMI ANTI ON USING AS AND OR NOT IN IS NULL BETWEEN LIKE RLIKE CASE WHEN THEN ELSE END WITH OVER PARTITION ROWS RANGE PRECEDING FOLLOWING CURRENT ROW UNBOUNDED ASC DESC LATERAL VIEW WINDOW EXISTS".split())


def format_sql(text: str, keywords: str = "upper", indent: int = 2) -> str:
    """The query with clauses on lines of their own and keywords in one case; strings and comments stay as they are."""
    out, depth, fresh = [], 0, True
    case = str.upper if keywords == "upper" else str.lower
    for t in tokenize(text.strip()):
        if t.kind == "space":
            if not fresh and out and not out[-1].endswith((" ", "\n", "(")):
                out.append(" ")
            continue
        word = case(t.text) if t.kind == "word" and t.up in _WORDS else t.text
        if t.kind == "op":
            depth += (t.text == "(") - (t.text == ")")
        joins = t.up in ("JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS") and t.kind == "word"
        previous = next((x for x in reversed(out) if x.strip()), "")
        if t.kind == "word" and not depth and (t.up in _BREAKS or joins and previous.upper() not in ("LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "SEMI", "ANTI", "NATURAL")) and out:
            while out and out[-1] == " ":
                out.pop()
            out.append("\n" + (" " * indent if joins else ""))
        if t.text == ",":
            while out and out[-1] == " ":
                out.pop()
        if t.text == ")" and out and out[-1] == " ":
            out.pop()
        out.append(word)
        fresh = False
        if t.text == ",":
            out.append(" ")
        if t.kind == "comment" and t.text.startswith("--"):
            out.append("\n" + " " * indent)
    return "".join(out).strip()
