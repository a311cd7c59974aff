"""Lineage: the tables and columns that each output column of a query comes from.

Catalyst's analyzed plan gives every column an id. An id's sources are those of the ids in the expression that makes it, down
to the columns of tables; set operations and CTE references map by position. Stars, aliases, subqueries and ambiguity are the
analyzer's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import trees
from lakeloom.plans.engine import Engine
from lakeloom.plans.metadata import AGGREGATES
from lakeloom.plans.trees import Node
from lakeloom.sources.catalog import Catalog

EDGES = "ordinal int, target string, expression string, category string, source_table string, source_column string, data_type string, comment string, is_final boolean"
_LEAVES = ("LogicalRelation", "LocalRelation", "HiveTableRelation", "OneRowRelation", "Range", "DataSourceV2Relation", "View", "LogicalRDD", "UnresolvedRelation", "RelationV2")


@dataclass
class Column:
    name: str
    id: int | None
    expression: str
    category: str


@dataclass
class Lineage:
    """``columns``: output columns in order; ``sources``: for each, (table, column) in order of first use; ``steps``: columns inside."""

    tables: list[str]
    columns: list[Column]
    sources: list[list[tuple[str, str]]]
    steps: list[tuple[Column, list[tuple[str, str]]]] = field(default_factory=list)

    def edges(self, spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
        """One row for each output column and source; a column without sources (a constant) has one with nulls."""
        meta = {(t, c.name): c for t in self.tables for c in (catalog.columns(t) if catalog else [])}
        rows = []
        for final, group in ((True, list(zip(self.columns, self.sources))), (False, self.steps)):
            for k, (c, src) in enumerate(group):
                for t, name in src or [(None, None)]:
                    m = meta.get((t, name))
                    rows.append((k, c.name, c.expression, c.category, t, name, m.data_type if m else None, m.comment if m else None, final))
        return spark.createDataFrame(rows, EDGES)


def lineage(spark: SparkSession, sql: str, catalog: Catalog | None = None) -> Lineage:
    """Lineage of a query over the session's tables, or over those of a catalog. Blank text is a ValueError."""
    if sql is None or not sql.strip():
        raise ValueError("a query is wanted")
    engine = Engine(spark)
    text = engine.translate(sql)
    back = {}
    if catalog:
        text, back = catalog.bind(spark, text)
    return of_plan(trees.analyzed(spark.sql(text)), back)


def of_plan(plan: Node, names: dict[str, str] | None = None) -> Lineage:
    walk = _Walk(names or {})
    walk.plan(plan, None)
    out = walk.output(plan)
    passed = _passed(plan)
    columns, sources = [], []
    for name, i in out:
        e = None if i in passed else walk.made.get(i)
        columns.append(Column(name, i, *(walk.describe(e) if e is not None else (name, "DIRECT"))))
        sources.append(walk.resolve(i))
    final = {i for _, i in out}
    steps = [(Column(n, i, *walk.describe(e)), walk.resolve(i)) for i, (n, e) in walk.named.items() if i not in final]
    return Lineage(walk.tables, columns, sources, steps)


def _passed(p: Node) -> set[int]:
    """Ids that the outermost select only names: made further inside, if made at all."""
    while p.kind not in ("Project", "Aggregate") and p.children:
        p = p.children[-1] if p.kind == "WithCTE" else p.children[0]
    if p.kind not in ("Project", "Aggregate"):
        return set()
    here = {_id(e) for e in p["projectList" if p.kind == "Project" else "aggregateExpressions"] or [] if e.kind == "AttributeReference"}
    # nodes of the same select: windows and generators make columns, and beside windows the inner project makes the others
    below, windows = p.children[0], False
    while below.kind in ("Project", "Window", "Generate", "Filter"):
        here -= {_id(e) for e in [*(below["windowExpressions"] or []), *(below["generatorOutput"] or [])]}
        if windows and below.kind == "Project":
            here -= {_id(e) for e in below["projectList"] or [] if e.kind == "Alias"}
        windows = windows or below.kind == "Window"
        below = below.children[0]
    return here


def _id(e: Node) -> int | None:
    return e["exprId"]["id"] if isinstance(e["exprId"], dict) else None


class _Walk:
    def __init__(self, names: dict[str, str]):
        self.names = names
        self.tables: list[str] = []
        self.leaf: dict[int, tuple[str, str]] = {}
        self.made: dict[int, Node] = {}
        self.named: dict[int, tuple[str, Node]] = {}
        self.by_position: dict[int, list[int]] = {}
        self.ctes: dict[int, Node] = {}

    def plan(self, p: Node, table: str | None) -> None:
        """Collects what makes each id. ``table`` is the name under which a leaf is read."""
        if p.kind == "SubqueryAlias":
            ident = p["identifier"]
            name = ".".join([*(x for x in trees.names(ident.get("qualifier")) if x != "spark_catalog"), ident["name"]])
            table = name if self._leaf_below(p.children[0]) else None
            if p.children[0].kind == "SubqueryAlias" and self._leaf_below(p.children[0]):
                table = None
        if p.kind in _LEAVES:
            if p.kind == "OneRowRelation":
                return
            known = self.names.get(table or "", table or "")
            if known and known not in self.tables:
                self.tables.append(known)
            for name, i in self.output(p):
                if i is not None and known:
                    self.leaf.setdefault(i, (known, name))
            return
        if p.kind == "CTERelationDef":
            self.ctes[p["id"]] = p
        for e in p.expressions():
            self.expression(e)
        for c in p.children:
            self.plan(c, table if p.kind in ("SubqueryAlias", "Sample") else None)
        if p.kind in ("Union", "Intersect", "Except"):
            outs = [self.output(c) for c in p.children]
            for col in zip(*outs):
                first = col[0][1]
                if first is not None:
                    self.by_position.setdefault(first, []).extend(i for _, i in col[1:] if i is not None)
        if p.kind == "Expand":
            for k, a in enumerate(p["output"] or []):
                for row in p["projections"] or []:
                    if k < len(row) and _id(a) is not None:
                        self.by_position.setdefault(_id(a), []).extend(_id(x) for x in row[k].walk() if x.kind == "AttributeReference" and _id(x) != _id(a))
        if p.kind == "Generate":
            for a in p["generatorOutput"] or []:
                self.made[_id(a)] = p["generator"]
        if p.kind == "CTERelationRef" and p["cteId"] in self.ctes:
            for a, (_, i) in zip(p["output"] or [], self.output(self.ctes[p["cteId"]].children[0])):
                if _id(a) != i:
                    self.by_position.setdefault(_id(a), []).append(i)

    def _leaf_below(self, p: Node) -> bool:
        while p.kind in ("SubqueryAlias", "Sample"):
            p = p.children[0]
        return p.kind in _LEAVES

    def expression(self, e: Node) -> None:
        for x in e.walk():
            if x.kind == "Alias":
                self.made[_id(x)] = x.children[0]
                self.named[_id(x)] = (x["name"], x.children[0])
            for sub in x.expressions():
                if x.kind in ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery"):
                    self.plan(sub, None)

    def output(self, p: Node) -> list[tuple[str, int | None]]:
        """(name, id) of a plan's columns."""
        k = p.kind
        pair = lambda e: (e["name"] if e.kind in ("Alias", "AttributeReference") else trees.text(e), _id(e))
        if k in ("Project", "Aggregate"):
            return [pair(e) for e in p["projectList" if k == "Project" else "aggregateExpressions"] or []]
        if k == "View":
            return self.output(p.children[0]) if p.children else []
        if isinstance(p["output"], list) and p["output"] and isinstance(p["output"][0], Node):
            return [pair(e) for e in p["output"]]
        if k == "Join":
            semi = trees.short(p["joinType"]) in ("LeftSemi", "LeftAnti")
            return self.output(p.children[0]) + ([] if semi else self.output(p.children[1]))
        if k == "LateralJoin":
            return self.output(p.children[0]) + [x for e in p.expressions() if e.kind == "LateralSubquery" for s in e.expressions() for x in self.output(s)]
        if k == "Generate":
            return self.output(p.children[0]) + [pair(e) for e in p["generatorOutput"] or []]
        if k == "Window":
            return self.output(p.children[0]) + [pair(e) for e in p["windowExpressions"] or []]
        if k == "WithCTE":
            return self.output(p.children[-1])
        return self.output(p.children[0]) if p.children else []

    def resolve(self, i: int | None, seen: frozenset = frozenset()) -> list[tuple[str, str]]:
        """The table columns that an id comes from, each once."""
        if i is None or i in seen:
            return []
        seen = seen | {i}
        out: list[tuple[str, str]] = [self.leaf[i]] if i in self.leaf else []
        for j in self._parts(i):
            out += [x for x in self.resolve(j, seen) if x not in out]
        return out

    def _parts(self, i: int) -> list[int]:
        out = list(self.by_position.get(i, []))
        if i in self.made:
            out += self._references(self.made[i])
        return out

    def _references(self, e: Node) -> list[int]:
        out = []
        for x in e.walk():
            if x.kind == "AttributeReference":
                out.append(_id(x))
            elif x.kind == "OuterReference":
                out += [_id(y) for y in x.deep() if y.kind == "AttributeReference"]
            elif x.kind in ("ScalarSubquery", "Exists", "ListQuery"):
                for sub in x.expressions():
                    if sub.kind not in ("OuterReference", "AttributeReference"):
                        out += [j for _, j in self.output(sub) if j is not None]
        return out

    def describe(self, e: Node) -> tuple[str, str]:
        """(text, category) of an expression."""
        kinds = [x.kind for x in e.walk()]
        windows = any(k == "WindowExpression" for k in kinds)
        aggregate = "AggregateExpression" in kinds and not windows or e.kind == "UnresolvedFunction" and trees.function_name(e).upper() in AGGREGATES
        return _pretty(e), "AGGREGATE" if aggregate else "DIRECT" if e.kind == "AttributeReference" else "EXPRESSION"


def _pretty(e: Node) -> str:
    if e.kind in ("AggregateExpression", "PromotePrecision"):
        return _pretty(e.children[0])
    if e.kind == "WindowExpression":
        return f"{_pretty(e.children[0])} OVER {trees.text(e.children[1])}"
    if e.kind in ("AttributeReference", "Literal", "Cast", "EqualTo", "GreaterThan", "LessThan", "And", "Or", "Add", "Subtract", "Multiply", "Divide"):
        return trees.text(Node(e.kind, e.fields, e.children)) if not any(x.kind == "AggregateExpression" for x in e.walk()) else f"{e.kind.lower()}({', '.join(_pretty(c) for c in e.children)})"
    return f"{e.kind.lower()}({', '.join(_pretty(c) for c in e.children)})"


def tree(found: Lineage, deepest: int = 10) -> list[dict]:
    """Nested dicts for each output column: field, expression, category, is_leaf, children (leaves are table.column)."""
    steps = {c.name: (c, s) for c, s in found.steps}

    def node(c: Column, src: list[tuple[str, str]], depth: int, seen: frozenset) -> dict:
        below = []
        if depth < deepest:
            via = [steps[n] for n in steps if n not in seen and n != c.name and n in c.expression and set(steps[n][1]) <= set(src) and steps[n][1]]
            held = {x for _, s in via for x in s}
            below = [node(a, b, depth + 1, seen | {a.name}) for a, b in via]
            below += [{"field": f"{t}.{n}", "expression": None, "category": "DIRECT", "is_leaf": True, "children": []} for t, n in src if (t, n) not in held]
        return {"field": c.name, "expression": c.expression, "category": c.category, "is_leaf": False, "children": below}

    return [node(c, s, 1, frozenset({c.name})) for c, s in zip(found.columns, found.sources)]
