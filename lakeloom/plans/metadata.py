"""Metadata of a query: what it reads, joins, computes, filters, sorts and calls, as one DataFrame a section."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import trees
from lakeloom.plans.rewrite import Context, rewrite
from lakeloom.plans.tokens import Token, closing, render, significant, tokenize
from lakeloom.plans.trees import Node, text

# Functions by type, in the order in which the types are tried.
AGGREGATES = frozenset("COUNT SUM AVG MIN MAX GROUP_CONCAT STDDEV VARIANCE COLLECT_LIST COLLECT_SET".split())
STRINGS = frozenset("SUBSTRING SUBSTR CONCAT UPPER LOWER TRIM LTRIM RTRIM REPLACE LENGTH CHAR_LENGTH POSITION LOCATE INSTR LPAD RPAD REVERSE SPLIT".split())
MATHS = frozenset("ABS ROUND FLOOR CEIL CEILING POWER SQRT EXP LOG LN MOD SIGN RAND RANDOM TRUNCATE TRUNC".split())
DATES = frozenset("DATE_FORMAT YEAR MONTH DAY HOUR MINUTE SECOND WEEK QUARTER NOW CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATE_ADD DATE_SUB DATEDIFF TO_DATE FROM_UNIXTIME UNIX_TIMESTAMP".split())
CASTS = frozenset("CAST CONVERT TO_NUMBER TO_STRING TO_DATE TO_CHAR".split())
CONDITIONALS = frozenset("IF CASE COALESCE NULLIF IFNULL NVL DECODE".split())

#: Sections and the columns of their DataFrames.
SCHEMAS = {
    "tables": "scope string, name string, alias string, kind string, qualified_name string",
    "joins": "scope string, left string, right string, join_type string, condition string, pairs array<struct<left:string,right:string,op:string>>, using array<string>",
    "fields": "scope string, ordinal int, alias string, expression string, category string, columns array<string>",
    "conditions": "scope string, clause string, expression string, columns array<string>",
    "groups": "scope string, ordinal int, expression string, kind string",
    "orders": "scope string, clause string, ordinal int, expression string, direction string, nulls string",
    "limits": "scope string, offset long, row_count long",
    "ctes": "name string, columns array<string>",
    "hints": "scope string, name string, arguments array<string>",
    "lateral_views": "scope string, function string, table_alias string, column_aliases array<string>, is_outer boolean",
    "set_operations": "scope string, type string, is_all boolean",
    "windows": "name string, partition_by array<string>, order_by array<string>, frame string",
    "window_functions": "scope string, alias string, function string, arguments array<string>, window_name string, partition_by array<string>, order_by array<string>, frame string",
    "functions": "scope string, name string, type string, arguments array<string>, arg_count int, expression string, clause string, is_window boolean, is_aggregate boolean, is_distinct boolean",
    "comments": "text string, start int, stop int, target_type string, target_name string",
    "flags": "scope string, is_distinct boolean",
}


def function_type(name: str, window: bool = False) -> str:
    """WINDOW, AGGREGATE, STRING, MATH, DATE_TIME, CAST, CONDITIONAL or OTHER."""
    up = name.upper()
    if window:
        return "WINDOW"
    for kind, known in (("AGGREGATE", AGGREGATES), ("STRING", STRINGS), ("MATH", MATHS), ("DATE_TIME", DATES), ("CAST", CASTS), ("CONDITIONAL", CONDITIONALS)):
        if up in known:
            return kind
    return "OTHER"


@dataclass
class Metadata:
    """Rows by section; ``errors`` are (line, column, message) if the text has no plan."""

    sql: str
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {k: [] for k in SCHEMAS})
    errors: list[tuple[int, int, str]] = field(default_factory=list)

    def frames(self, spark: SparkSession, query_id: str = "q") -> dict[str, DataFrame]:
        """A DataFrame for each section, with the query's id in front."""
        return {k: spark.createDataFrame([(query_id, *r) for r in v], f"query_id string, {SCHEMAS[k]}") for k, v in self.rows.items()}

    def records(self, section: str) -> list[dict]:
        names = [re.split(r"\s+", x.strip())[0] for x in re.split(r",\s*(?![^<]*>)", SCHEMAS[section])]
        return [dict(zip(names, r)) for r in self.rows[section]]

    @property
    def status(self) -> str:
        return "error" if self.errors else "success"


def columns(e: Node) -> list[str]:
    """Columns that an expression names, each once, those of its subqueries not."""
    return list(dict.fromkeys(text(x) for x in e.walk() if x.kind in ("UnresolvedAttribute", "UnresolvedStar")))


def extract(spark: SparkSession, sql: str) -> Metadata:
    """Metadata of one query of the dialect. None is a TypeError, a blank text or one without a plan has errors."""
    if sql is None:
        raise TypeError("sql must not be None")
    out = Metadata(sql)
    if not significant(tokenize(sql)):
        out.errors.append((1, 0, "empty statement"))
        return out
    plain = sql.strip().rstrip(";；")
    try:
        spark_text = rewrite(plain, Context(), parse_only=True)
        plan = trees.parse(spark, spark_text)
    except ParseException as e:
        m = re.search(r"line (\d+), pos (\d+)", str(e))
        out.errors.append((int(m[1]) if m else 1, int(m[2]) if m else 0, str(e).strip().split("\n")[0]))
        return out
    except ValueError as e:
        out.errors.append((1, 0, str(e)))
        return out
    _Walk(out).plan(plan, "")
    # what the rewriter or the parser takes away comes from the tokens
    _hints(out, plain)
    _named_windows(out, plain)
    out.rows["comments"] = comments(sql)
    return out


class _Walk:
    def __init__(self, out: Metadata):
        self.out, self.subqueries = out.rows, 0
        sig = significant(tokenize(out.sql))
        self.named = [b.text.strip("`") for a, b in zip(sig, sig[1:]) if a.up == "OVER" and b.kind in ("word", "quoted")]

    def plan(self, p: Node, scope: str) -> None:
        do = getattr(self, f"_{p.kind}", None)
        if do:
            do(p, scope)
            return
        for e in p.expressions():
            self.calls(e, scope, p.kind.upper())
        for c in p.children:
            self.plan(c, scope)

    def _UnresolvedWith(self, p: Node, scope: str) -> None:
        for cte in p["cteRelations"] or []:
            body = cte["_2"]
            cols: list[str] = []
            if body.kind == "SubqueryAlias":
                body = body.children[0]
            if body.kind == "UnresolvedSubqueryColumnAliases":
                cols = trees.names(body["outputColumnNames"])
                body = body.children[0]
            self.out["ctes"].append((cte["_1"], cols))
            self.plan(body, cte["_1"])
        self.plan(p.children[0], scope)

    def _UnresolvedRelation(self, p: Node, scope: str, alias: str | None = None) -> None:
        parts = trees.names(p["multipartIdentifier"])
        row = (scope, parts[-1], alias, "table", ".".join(parts))
        if row not in self.out["tables"]:
            self.out["tables"].append(row)

    def _SubqueryAlias(self, p: Node, scope: str) -> None:
        alias, child = p["identifier"]["name"], p.children[0]
        while child.kind in ("UnresolvedSubqueryColumnAliases", "Sample"):
            child = child.children[0]
        if child.kind == "UnresolvedRelation":
            self._UnresolvedRelation(child, scope, alias)
        else:
            kind = {"UnresolvedInlineTable": "values", "UnresolvedTableValuedFunction": "function"}.get(child.kind, "subquery")
            self.out["tables"].append((scope, alias, alias, kind, alias))
            self.plan(child, alias)

    def _Project(self, p: Node, scope: str) -> None:
        self.fields(p["projectList"] or [], scope)
        self.plan(p.children[0], scope)

    def _Aggregate(self, p: Node, scope: str) -> None:
        for g in p["groupingExpressions"] or []:
            kind = {"Cube": "CUBE", "Rollup": "ROLLUP", "GroupingSets": "GROUPING SETS"}.get(g.kind, "KEY")
            for e in g.children if kind != "KEY" else [g]:
                self.out["groups"].append((scope, len([x for x in self.out["groups"] if x[0] == scope]), text(e), kind))
                self.calls(e, scope, "GROUP BY")
        self.fields(p["aggregateExpressions"] or [], scope)
        self.plan(p.children[0], scope)

    def fields(self, found: list[Node], scope: str) -> None:
        done = sum(1 for x in self.out["fields"] if x[0] == scope)
        for i, e in enumerate(found):
            e = e.children[0] if e.kind == "UnresolvedAlias" and e.children else e
            alias = e["name"] if e.kind == "Alias" else trees.names(e["names"])[0] if e.kind == "MultiAlias" else None
            inner = e.children[0] if e.kind in ("Alias", "MultiAlias") else e
            calls = [x for x in inner.walk() if x.kind == "UnresolvedFunction"]
            windows = {id(x.children[0]) for x in inner.walk() if x.kind.endswith("WindowExpression")}
            if inner.kind in ("UnresolvedAttribute", "UnresolvedStar"):
                kind = "DIRECT"
            elif any(trees.function_name(x).upper() in AGGREGATES | {"LISTAGG"} for x in calls if id(x) not in windows):
                kind = "AGGREGATE"
            else:
                kind = "EXPRESSION"
            self.out["fields"].append((scope, done + i, alias, text(inner), kind, columns(inner)))
            self.windows(inner, scope, alias)
            self.calls(inner, scope, "SELECT")

    def windows(self, e: Node, scope: str, alias: str | None) -> None:
        for w in e.walk():
            if w.kind in ("WindowExpression", "UnresolvedWindowExpression"):
                f = w.children[0]
                f = f.children[0] if f.kind in ("FilterExpression",) else f
                spec = w.children[1] if len(w.children) > 1 else None
                named = self.named.pop(0) if spec is None and self.named else None  # the plan's JSON lacks it
                part, order, frame = _spec(spec) if spec is not None else ([], [], None)
                self.out["window_functions"].append((scope, alias, trees.function_name(f), [text(x) for x in f.children], named, part, order, frame))

    def _Filter(self, p: Node, scope: str) -> None:
        self.condition(p["condition"], scope, "WHERE")
        self.plan(p.children[0], scope)

    def _UnresolvedHaving(self, p: Node, scope: str) -> None:
        self.condition(p["havingCondition"], scope, "HAVING")
        self.plan(p.children[0], scope)

    def condition(self, e: Node, scope: str, clause: str) -> None:
        self.out["conditions"].append((scope, clause, text(e), columns(e)))
        self.calls(e, scope, clause)

    def _Sort(self, p: Node, scope: str) -> None:
        clause = "ORDER BY" if p["global"] else "SORT BY"
        for i, o in enumerate(p["order"] or []):
            e = o.children[0] if o.children else o
            self.out["orders"].append((scope, clause, i, text(e), "DESC" if trees.short(o["direction"]) == "Descending" else "ASC", "LAST" if trees.short(o["nullOrdering"]) == "NullsLast" else "FIRST"))
            self.calls(e, scope, clause)
        self.plan(p.children[0], scope)

    def _GlobalLimit(self, p: Node, scope: str) -> None:
        child = p.children[0]
        while child.kind == "LocalLimit":
            child = child.children[0]
        skip = None
        if child.kind == "Offset":
            skip, child = _number(child["offsetExpr"]), child.children[0]
        self.out["limits"].append((scope, skip, _number(p["limitExpr"])))
        self.plan(child, scope)

    def _Distinct(self, p: Node, scope: str) -> None:
        child = p.children[0]
        if child.kind == "Union":
            self.combine("UNION", False, child, scope)
        else:
            self.out["flags"].append((scope, True))
            self.plan(child, scope)

    def _Union(self, p: Node, scope: str) -> None:
        self.combine("UNION", True, p, scope)

    def _Intersect(self, p: Node, scope: str) -> None:
        self.combine("INTERSECT", bool(p["isAll"]), p, scope)

    def _Except(self, p: Node, scope: str) -> None:
        self.combine("EXCEPT", bool(p["isAll"]), p, scope)

    def combine(self, kind: str, all_: bool, p: Node, scope: str) -> None:
        self.out["set_operations"].append((scope, kind, all_))
        for c in p.children:
            self.plan(c, scope)

    def _UnresolvedHint(self, p: Node, scope: str) -> None:
        self.plan(p.children[0], scope)  # hints come from the tokens, as written

    def _Generate(self, p: Node, scope: str) -> None:
        g = p["generator"]
        self.out["lateral_views"].append((scope, text(g), p["qualifier"], [text(x) for x in p["generatorOutput"] or []], bool(p["outer"])))
        self.calls(g, scope, "LATERAL VIEW")
        self.plan(p.children[0], scope)

    def _Join(self, p: Node, scope: str) -> None:
        kind, using = p["joinType"], []
        if trees.short(kind) == "UsingJoin":
            using, kind = trees.names(kind.get("usingColumns")), kind.get("tpe")
        elif trees.short(kind) == "NaturalJoin":
            kind = kind.get("tpe")
        cond = p["condition"]
        pairs = []
        for c in _conjuncts(cond) if isinstance(cond, Node) else []:
            if c.kind in trees.COMPARISONS and all(x.kind == "UnresolvedAttribute" for x in c.children):
                pairs.append({"left": text(c.children[0]), "right": text(c.children[1]), "op": trees._BINARY[c.kind]})
        self.out["joins"].append((scope, _endpoint(p.children[0]), _endpoint(p.children[1]), _JOINS.get(trees.short(kind), trees.short(kind)), text(cond) if isinstance(cond, Node) else None, pairs, using))
        if isinstance(cond, Node):
            self.calls(cond, scope, "JOIN")
        for c in p.children:
            self.plan(c, scope)

    def calls(self, e: Node, scope: str, clause: str) -> None:
        """Function calls of an expression, outer ones first, and the plans of its subqueries."""
        windows = {id(x.children[0]) for x in e.walk() if x.kind.endswith("WindowExpression")}
        for x in e.walk():
            name = trees.function_name(x) if x.kind in ("UnresolvedFunction", "UnresolvedGenerator") else {"Cast": "cast", "CaseWhen": "case"}.get(x.kind)
            if name:
                w = id(x) in windows
                args = [text(a) for a in x.children]
                if name.lower() == "count" and args == ["1"]:
                    args = ["*"]
                self.out["functions"].append((scope, name, function_type(name, w), args, len(args), text(x), clause, w, name.upper() in AGGREGATES, bool(x["isDistinct"])))
            for sub in x.expressions():
                if x.kind in ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery"):
                    self.subqueries += 1
                    self.plan(sub, f"subquery{self.subqueries}")


_JOINS = {"Inner": "INNER", "Cross": "CROSS", "LeftOuter": "LEFT", "RightOuter": "RIGHT", "FullOuter": "FULL", "LeftSemi": "LEFT SEMI", "LeftAnti": "LEFT ANTI"}


def _conjuncts(e: Node) -> list[Node]:
    return [x for c in e.children for x in _conjuncts(c)] if e.kind == "And" else [e]


def _endpoint(p: Node) -> str:
    """The table on a join's side; of several, the rightmost."""
    if p.kind == "SubqueryAlias":
        return p["identifier"]["name"]
    if p.kind == "UnresolvedRelation":
        return ".".join(trees.names(p["multipartIdentifier"]))
    return _endpoint(p.children[-1]) if p.children else p.kind


def _number(e: Node) -> int | None:
    """A constant's value; sums and products of constants too."""
    if e.kind == "Literal":
        return int(e["value"]) if str(e["value"]).lstrip("-").isdigit() else None
    v = [_number(c) for c in e.children]
    if len(v) == 2 and None not in v and e.kind in ("Add", "Subtract", "Multiply"):
        return {"Add": v[0] + v[1], "Subtract": v[0] - v[1], "Multiply": v[0] * v[1]}[e.kind]
    return None


def _spec(s: Node) -> tuple[list[str], list[str], str | None]:
    n, m = len(s["partitionSpec"] or []), len(s["orderSpec"] or [])
    frame = s.children[-1] if s.children and s.children[-1].kind == "SpecifiedWindowFrame" else None
    return [text(c) for c in s.children[:n]], [text(c) for c in s.children[n : n + m]], text(frame) if frame else None


def _hints(out: Metadata, sql: str) -> None:
    from lakeloom.plans.rewrite import _split

    for t in tokenize(sql):
        if t.kind == "hint":
            for item in _split(tokenize(t.text[3:-2])):
                sig = significant(item)
                if sig:
                    args = render(item).strip()[len(sig[0].text) :].strip()[1:-1]
                    out.rows["hints"].append(("", sig[0].text.upper(), [render(x).strip() for x in _split(tokenize(args))] if args else []))


def _named_windows(out: Metadata, sql: str) -> None:
    from lakeloom.plans.rewrite import _split

    ts = significant(tokenize(sql))
    k = next((i for i, t in enumerate(ts) if t.up == "WINDOW" and i + 2 < len(ts) and ts[i + 2].up == "AS"), None)
    while k is not None and k + 3 < len(ts) and ts[k + 2].up == "AS" and ts[k + 3].text == "(":
        z = closing(ts, k + 3)
        clauses: dict[str, list[str]] = {"partition": [], "order": [], "frame": []}
        now, held = None, {"partition": [], "order": [], "frame": []}
        body = ts[k + 4 : z]
        i = 0
        while i < len(body):
            up = body[i].up
            if up in ("PARTITION", "ORDER", "DISTRIBUTE", "SORT", "CLUSTER") and i + 1 < len(body) and body[i + 1].up == "BY":
                now = "order" if up in ("ORDER", "SORT") else "partition"
                i += 2
                continue
            if up in ("ROWS", "RANGE", "GROUPS"):
                now = "frame"
            if now:
                held[now].append(body[i])
            i += 1
        for name in ("partition", "order"):
            clauses[name] = [" ".join(t.text for t in part).replace(" . ", ".") for part in _split(held[name])] if held[name] else []
        frame = " ".join(t.up if t.kind == "word" else t.text for t in held["frame"]) or None
        out.rows["windows"].append((ts[k + 1].text.strip("`"), clauses["partition"], clauses["order"], frame))
        k = z if z + 1 < len(ts) and ts[z + 1].text == "," else None
        if k is not None:
            k = z + 1
    return


_CLAUSES = {"SELECT": "FIELD", "FROM": "TABLE", "JOIN": "TABLE", "WHERE": "WHERE", "GROUP": "GROUP_BY", "HAVING": "HAVING", "ORDER": "ORDER_BY", "LIMIT": "LIMIT", "WITH": "WITH", "LATERAL": "LATERAL_VIEW", "WINDOW": "WINDOW", "ON": "JOIN"}


def comments(sql: str) -> list[tuple]:
    """(text, start, stop, target type, target name) of each comment.

    A comment belongs to what ends last before it on its line (a field, a table, a clause); one on a line of its own belongs
    to what follows it.
    """
    ts = tokenize(sql)
    out = []
    for k, t in enumerate(ts):
        if t.kind != "comment":
            continue
        before = [x for x in ts[:k] if x.kind not in ("space", "comment")]
        gap = sql[before[-1].stop : t.start] if before else "\n"
        own_line = "\n" in gap
        following = [x for x in ts[k + 1 :] if x.kind not in ("space", "comment")]
        if not before and own_line and following:
            kind, name = "STATEMENT", ""
        elif own_line and following:
            kind, name = _target(ts, following[0])
        elif before:
            kind, name = _target(ts, before[-1])
        else:
            kind, name = "STATEMENT", ""
        body = t.text[2:] if t.text[:2] == "--" else t.text[2:-2]
        out.append((body.strip(), t.start, t.stop, kind, name))
    return out


def _target(ts: list[Token], at: Token) -> tuple[str, str]:
    sig = [x for x in ts if x.kind not in ("space", "comment")]
    k = sig.index(at)
    if at.kind == "hint":
        return "HINT", at.text[3:-2].strip()
    if at.text == "," and k:
        k -= 1
    depth, start = 0, None
    for j in range(k, -1, -1):
        x = sig[j]
        if x.kind == "op" and j < k:
            depth += (x.text == ")") - (x.text == "(")
        if depth < 0:
            depth = 0
        if x.kind == "word" and x.up in _CLAUSES and depth == 0:
            start = j
            break
    if start is None:
        return "STATEMENT", ""
    kind = _CLAUSES[sig[start].up]
    if kind == "FIELD":
        if start == k:
            return "FIELD", _field_name(sig, k + 1)
        lo = k
        depth = 0
        while lo > start + 1:
            x = sig[lo - 1]
            depth += (x.text == ")") - (x.text == "(") if x.kind == "op" else 0
            if x.text == "," and depth == 0:
                break
            lo -= 1
        return "FIELD", _field_name(sig, lo)
    if kind == "TABLE":
        j = start + 1
        name = []
        while j < len(sig) and (sig[j].kind in ("word", "quoted") and (not name or name[-1] == ".") or sig[j].text == "." and name):
            name.append(sig[j].text)
            j += 1
        return "TABLE", "".join(name)
    return kind, ""


def _field_name(sig: list[Token], at: int) -> str:
    """The alias of the field that starts at a token, else its last name."""
    depth, end = 0, at
    while end < len(sig):
        x = sig[end]
        if x.kind == "op":
            depth += (x.text == "(") - (x.text == ")")
        if depth < 0 or not depth and (x.text == "," or x.up == "FROM"):
            break
        end += 1
    names = [x for x in sig[at:end] if x.kind in ("word", "quoted")]
    return names[-1].text.strip("`") if names else ""
