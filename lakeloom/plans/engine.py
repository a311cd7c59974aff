"""The engine: statements and scripts of the dialect on a Spark session."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import changes, layout
from lakeloom.plans.rewrite import Context, rewrite
from lakeloom.plans.tokens import closing, render, significant, split_statements, tokenize
from lakeloom.sources import tables


class Refused(ValueError):
    """A statement that is understood and has no meaning without the service it administers."""


class Engine:
    """Runs the dialect. ``sql`` takes one statement, ``script`` several; both give a DataFrame (the last one's).

    With a folder, its tables are views of the session, each made when a text first names it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.waiting = set(tables.TABLES) if folder else set()
        self.functions: dict[str, tuple[Callable, str]] = {}
        self.context = Context(table_bytes=self.table_bytes, scan=self.scan)

    def use(self, text: str) -> None:
        """Make views of the folder's tables that the text names."""
        named = {t.text.strip("`").lower() for t in tokenize(text) if t.kind in ("word", "quoted")} & self.waiting
        if named:
            tables.use_folder(self.spark, self.folder, sorted(named))
            self.waiting -= named

    def scan(self, name: str, options: dict[str, str]) -> str:
        """A table read with options of its source: a view of the folder's table, or Spark's own clause."""
        plain = name.strip("`").lower()
        if self.folder and plain in tables.TABLES:
            view = f"{plain}__{uuid.uuid4().hex[:12]}"
            self.spark.read.options(**options).parquet(f"{self.folder}/{plain}.parquet").createOrReplaceTempView(view)
            return view
        return f"{name} WITH ({', '.join(f'`{k}` = {quoted(v)}' for k, v in options.items())})"

    def register(self, name: str, f: Callable, schema: str) -> None:
        """A Python function for ``name(ON t PARTITION BY k)``, f(key, rows, **arguments), or ``JOIN b ON .. USING name(..)``, f(left, right).

        It gets pandas frames of one key and gives one of ``schema``.
        """
        self.functions[name.lower()] = f, schema

    def table_bytes(self, name: str) -> int | None:
        """Catalyst's estimate of a table's size, or None."""
        self.use(name)
        try:
            plan = self.spark.table(name)._jdf.queryExecution().optimizedPlan()
        except AnalysisException:  # an unknown table fails later, with a better message
            return None
        return int(str(plan.stats().sizeInBytes()))

    def translate(self, text: str, params: dict[str, object] | None = None) -> str:
        """The Spark SQL that a statement becomes."""
        c = Context(params or {}, self.context.tables, self.context.scalars, self.table_bytes, self.scan, [])
        self.use(text)
        text = python_sources(self, text)
        out = rewrite(text.strip().rstrip(";；"), c)
        self.context.zorder = c.zorder
        return out

    def sql(self, text: str, params: dict[str, object] | None = None) -> DataFrame:
        statements = split_statements(text)
        if len(statements) != 1:
            raise ValueError(f"one statement is wanted, not {len(statements)}")
        text = statements[0]
        self.use(text)
        words = [t.up for t in significant(tokenize(text))[:4]]
        for start, run in _STATEMENTS:
            if tuple(words[: len(start)]) == start:
                return run(self, text, params)
        if words and words[0][:1] == "@" and ":=" in [t.text for t in significant(tokenize(text))[:4]]:
            return self._assign(text, params)
        spark_text = _table_clauses(self.translate(text, params)) if words[:1] == ["CREATE"] else self.translate(text, params)
        zorder = list(self.context.zorder)
        df = self.spark.sql(spark_text)
        if zorder:
            names = [df.columns[int(z) - 1] if z.isdigit() else z.strip("`").split(".")[-1] for z in zorder]
            df = layout.z_order(df, names)
        return df

    def script(self, text: str, params: dict[str, object] | None = None) -> DataFrame:
        out = None
        for s in split_statements(text):
            out = self.sql(s, params)
        if out is None:
            raise ValueError("an empty script")
        return out

    # statements that Spark has not, or not on plain tables

    def _none(self) -> DataFrame:
        return self.spark.range(0).select(F.lit("").alias("result"))

    def _assign(self, text: str, params) -> DataFrame:
        """@v [type] := [CACHE ON] query or expression: a view, or a session variable."""
        ts = tokenize(text)
        k = next(i for i, t in enumerate(ts) if t.text == ":=")
        head, body = significant(ts[:k]), ts[k + 1 :]
        name = head[0].text.lstrip("@")
        sig = significant(body)
        cache = [t.up for t in sig[:2]] == ["CACHE", "ON"]
        if cache:
            body = body[body.index(sig[1]) + 1 :]
            sig = sig[2:]
        first = next((t.up for t in sig if t.text != "("), "")
        if first in ("SELECT", "FROM", "WITH", "VALUES"):
            df = self.spark.sql(self.translate(render(body), params))
            (df.cache() if cache else df).createOrReplaceTempView(name)
            self.context.tables.add(name.lower())
            return df
        kind = render([x for t in head[1:] for x in (t, *tokenize(" "))]).strip()
        value = self.translate(render(body), params)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} DEFAULT {value}" if kind else f"DECLARE OR REPLACE VARIABLE {name} DEFAULT {value}")
        self.context.scalars.add(name.lower())
        return self.spark.sql(f"SELECT {name} AS {name}")

    def _replace(self, table: str, df: DataFrame) -> DataFrame:
        """New rows for a table that they were read from, written beside it first; the table keeps its columns, format and properties.

        Without partitions, the new table then takes the old one's name: a driver lost on the way leaves all the old rows, under that
        name or that name with ``__old``. With partitions, each is replaced by its new files, and those without rows go; until
        the end the new rows are all there with ``__new``.
        """
        new, old = f"{table}__new", f"{table}__old"
        for name in (new, old):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(f"CREATE TABLE {new} LIKE {table}")
        df.select(self.spark.table(new).columns).write.insertInto(new)
        keys = [c.name for c in self.spark.catalog.listColumns(table.replace("`", "")) if c.isPartition]
        if keys:
            parts = lambda t: {r[0] for r in self.spark.sql(f"SHOW PARTITIONS {t}").collect()}
            empty = parts(table) - parts(new)
            self.spark.table(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)
            for spec in sorted(empty):
                values = dict(x.split("=", 1) for x in spec.split("/"))
                self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({', '.join(f'`{k}` = {quoted(unquote(v))}' for k, v in values.items())})")
            self.spark.sql(f"DROP TABLE {new}")
            return self._none()
        props = [(r.key, r.value) for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if not r.key.startswith(("transient", "spark.sql."))]
        if props:
            self.spark.sql(f"ALTER TABLE {new} SET TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in props)})")
        self.spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        self.spark.sql(f"DROP TABLE {old}")
        return self._none()

    # materialized views are tables that know their query

    def _materialize(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)CREATE\s+MATERIALIZED\s+VIEW\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`]+)(.*?)\sAS\s+(?=SELECT|WITH|FROM|\()(.*)$", text)
        name, extra, query = m[2], m[3], self.translate(m[4], params)
        if m[1] and self.spark.catalog.tableExists(name.replace("`", "")):
            return self._none()
        comment = re.search(r"(?is)\bCOMMENT\s+('(?:[^'\\]|\\.)*')", extra)
        on = re.search(r"(?is)\bPARTITION(?:ED)?\s+(?:ON|BY)\s*(\([^)]*\))", extra)
        rewrite_ = "false" if re.search(r"(?i)\bDISABLE\s+REWRITE\b", extra) else "true"
        props = f"TBLPROPERTIES ('view.query' = {quoted(query)}, 'view.rewrite' = '{rewrite_}')"
        self.spark.sql(f"CREATE TABLE {name} USING PARQUET {f'PARTITIONED BY {on[1]}' if on else ''} {f'COMMENT {comment[1]}' if comment else ''} {props} AS {query}")
        return self._none()

    def _alter_materialized(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)ALTER\s+MATERIALIZED\s+VIEW\s+([\w.`]+)\s+(?:(REBUILD)(?:\s+PARTITION\s*\((.*)\))?|(ENABLE|DISABLE)\s+REWRITE)\s*$", text)
        if not m:
            raise ValueError("ALTER MATERIALIZED VIEW v REBUILD [PARTITION (..)] or ENABLE | DISABLE REWRITE")
        if m[4]:
            self.spark.sql(f"ALTER TABLE {m[1]} SET TBLPROPERTIES ('view.rewrite' = '{str(m[4].upper() == 'ENABLE').lower()}')")
            return self._none()
        found = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {m[1]}").collect()}
        if "view.query" not in found:
            raise ValueError(f"{m[1]} is no materialized view")
        self.use(found["view.query"])
        df = self.spark.sql(found["view.query"])
        if m[3]:  # the rows of some partitions, and the others as they are
            where = " AND ".join(f"({render(x).strip()})" for x in _parts(tokenize(m[3])))
            df = df.where(where).unionByName(self.spark.table(m[1]).where(f"NOT coalesce({where}, false)"))
        return self._replace(m[1], df)

    def _drop_materialized(self, text: str, params) -> DataFrame:
        return self.spark.sql(re.sub(r"(?i)^DROP\s+MATERIALIZED\s+VIEW", "DROP TABLE", text))

    def _refuse(self, text: str, params) -> DataFrame:
        words = " ".join(t.up for t in significant(tokenize(text))[:2])
        raise Refused(f"{words}: indexes, models, grants, users, roles, packages, instances and resources belong to a service; files and folders have none of them")

    def _delete(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)DELETE\s+FROM\s+([\w.`]+)(?:\s+(?:AS\s+)?(?!WHERE\b)\w+)?(?:\s+WHERE\s+(.*))?$", self.translate(text, params))
        return self._replace(m[1], changes.delete(self.spark.table(m[1]), m[2] or "true"))

    def _update(self, text: str, params) -> DataFrame:
        ts = tokenize(self.translate(text, params))
        sig = significant(ts)
        table = sig[1].text
        at = next(i for i, t in enumerate(ts) if t.up == "SET" and t.kind == "word")
        depth, end = 0, len(ts)
        for i in range(at, len(ts)):
            depth += (ts[i].text == "(") - (ts[i].text == ")")
            if ts[i].up == "WHERE" and not depth:
                end = i
                break
        where = render(ts[end + 1 :]).strip() or None
        return self._replace(table, changes.update(self.spark.table(table), _assignments(ts[at + 1 : end]), where))

    def _merge(self, text: str, params) -> DataFrame:
        ts = [t for t in tokenize(self.translate(text, params)) if t.kind != "comment"]
        at = [i for i, t in enumerate(ts) if t.up == "WHEN" and t.kind == "word" and significant(ts[i + 1 :])[0].up in ("MATCHED", "NOT")]
        head = render(ts[: at[0]])
        m = re.match(r"(?is)MERGE\s+INTO\s+([\w.`]+)(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+(.*?)\s+(?:AS\s+)?(\w+)\s+ON\s+(.*)$", head)
        target, t, source, s, on = m[1], m[2] or m[1], m[3].strip(), m[4], m[5].strip()
        src = self.spark.sql(f"SELECT * FROM {source} {s}")
        matched, missing = [], []
        for a, z in zip(at, [*at[1:], len(ts)]):
            clause = render(ts[a:z]).strip()
            m = re.match(r"(?is)WHEN\s+(NOT\s+)?MATCHED(?:\s+AND\s+(.*?))?\s+THEN\s+(INSERT|UPDATE|DELETE)\b(.*)$", clause)
            cond, what, rest = m[2], m[3].upper(), tokenize(m[4].strip().rstrip(";"))
            if what == "INSERT":
                o = [i for i, x in enumerate(rest) if x.text == "("]
                v = next(i for i, x in enumerate(rest) if x.up == "VALUES")
                cols = [render(c).strip() for c in _parts(rest[o[0] + 1 : closing(rest, o[0])])] if o[0] < v else self.spark.table(target).columns
                first = next(i for i in o if i > v)
                values = [render(c).strip() for c in _parts(rest[first + 1 : closing(rest, first)])]
                missing.append((cond, dict(zip(cols, values))))
            elif what == "UPDATE":
                body = rest[next(i for i, x in enumerate(rest) if x.up == "SET") + 1 :]
                matched.append((cond, "update", {k.split(".")[-1]: v for k, v in _assignments(body).items()}))
            else:
                matched.append((cond, "delete", {}))
        return self._replace(target, changes.merge(self.spark.table(target), src, on, matched, missing, t, s))

    def _clone(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)CLONE\s+TABLE\s+([\w.`]+)(?:\s+PARTITION\s*\((.*?)\))?\s+TO\s+([\w.`]+)(?:\s+IF\s+EXISTS\s+(OVERWRITE|IGNORE))?", self.translate(text, params))
        df = self.spark.table(m[1])
        if m[2]:
            df = df.where(" AND ".join(m[2].split(",")))
        mode = {"OVERWRITE": "overwrite", "IGNORE": "ignore"}.get((m[4] or "").upper(), "errorifexists")
        df.write.mode(mode).format("parquet").saveAsTable(m[3])
        return self._none()

    def _unload(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)UNLOAD\s+FROM\s+(\(.*\)|[\w.`]+)\s+INTO\s+LOCATION\s+'([^']*)'(?:\s+STORED\s+AS\s+(\w+))?", self.translate(text, params))
        self.spark.sql(f"SELECT * FROM {m[1]} q").write.mode("overwrite").format((m[3] or "parquet").lower()).save(m[2])
        return self._none()

    def _export(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)EXPORT\s+TABLE\s+([\w.`]+)\s+TO\s+'([^']*)'", text)
        self.spark.table(m[1]).write.mode("overwrite").parquet(m[2])
        return self._none()

    def _import(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)IMPORT\s+(?:TABLE\s+)?([\w.`]+)\s+FROM\s+'([^']*)'", text)
        self.spark.read.parquet(m[2]).write.mode("overwrite").format("parquet").saveAsTable(m[1])
        return self._none()

    def _load(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)LOAD\s+DATA\s+(?:LOCAL\s+)?INPATH\s+'([^']*)'\s+(OVERWRITE\s+)?INTO\s+TABLE\s+([\w.`]+)", text)
        df = self.spark.read.parquet(m[1]).select(self.spark.table(m[3]).columns)
        df.write.mode("overwrite" if m[2] else "append").insertInto(m[3])
        return self._none()

    def _read(self, text: str, params) -> DataFrame:
        m = re.match(r"(?is)READ\s+([\w.`]+)(?:\s*\(([^)]*)\))?(?:\s+PARTITION\s*\((.*?)\))?(?:\s+(\d+))?\s*$", text)
        df = self.spark.table(m[1])
        if m[3]:
            df = df.where(" AND ".join(m[3].split(",")))
        if m[2]:
            df = df.select(*[c.strip() for c in m[2].split(",")])
        return df.limit(int(m[4] or 1000))  # a preview

    def _count(self, text: str, params) -> DataFrame:
        return self.spark.table(significant(tokenize(text))[1].text).agg(F.count(F.lit(1)).alias("count"))

    def _statistic(self, text: str, params) -> DataFrame:
        """ADD STATISTIC t kind [column] [condition]: the figure, as one row (table, kind, value)."""
        m = re.match(r"(?is)ADD\s+STATISTIC\s+([\w.`]+)\s+(\w+)(?:\s+(.*))?$", text)
        table, kind, rest = m[1], m[2].upper(), (m[3] or "").strip()
        df = self.spark.table(table)
        value = {
            "TABLE_COUNT": lambda: F.count(F.lit(1)), "NULL_VALUE": lambda: F.count_if(F.col(rest).isNull()), "DISTINCT_VALUE": lambda: F.count_distinct(F.col(rest)),
            "COLUMN_SUM": lambda: F.sum(rest), "COLUMN_MAX": lambda: F.max(rest), "COLUMN_MIN": lambda: F.min(rest), "EXPRESSION_CONDITION": lambda: F.count_if(F.expr(rest)),
        }[kind]()
        return df.agg(value.cast("double").alias("value")).select(F.lit(table).alias("table"), F.lit(kind).alias("kind"), "value")

    def _macro(self, text: str, params) -> DataFrame:
        """CREATE TEMPORARY MACRO f(x type) expression: a SQL function; its type is the expression's."""
        m = re.match(r"(?is)CREATE\s+TEMPORARY\s+MACRO\s+(\w+)\s*\((.*?)\)\s*(.*)$", text)
        body = self.translate(m[3], params)
        names = ", ".join(f"CAST(NULL AS {p.split(None, 1)[1]}) AS {p.split()[0]}" for p in m[2].split(",") if p.strip())
        kind = self.spark.sql(f"SELECT {body} AS v FROM (SELECT {names or '1'}) q").dtypes[0][1]
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[1]}({m[2]}) RETURNS {kind} RETURN {body}")
        return self._none()

    def _set_project(self, text: str, params) -> DataFrame:
        return self.spark.sql(re.sub(r"(?i)^SETPROJECT", "SET", text))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def python_sources(e: Engine, text: str) -> str:
    """``f(ON t PARTITION BY k ORDER BY x, name(value))`` and ``a JOIN b ON .. USING f(..) c AS (..)`` of registered functions, as views."""
    ts, k = tokenize(text), 0
    while e.functions and k < len(ts):
        if ts[k].kind == "word" and ts[k].text.lower() in e.functions:
            sig = [i for i, t in enumerate(ts) if t.kind not in ("space", "comment")]
            at = sig.index(k)
            after = ts[sig[at + 1]] if at + 1 < len(sig) else None
            if after is not None and after.text == "(" and at + 2 < len(sig) and ts[sig[at + 2]].up == "ON":
                z = closing(ts, sig[at + 1])
                view = _table_function(e, ts[k].text.lower(), ts[sig[at + 2] + 1 : z])
                ts[k : z + 1] = tokenize(view)
            elif at and ts[sig[at - 1]].up == "USING":
                ts = tokenize(_joined(e, ts, sig, at))
                k = -1
        k += 1
    return render(ts)


def _view(e: Engine, df: DataFrame) -> str:
    name = f"made_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def _clause(ts, heads: dict[str, str]) -> dict[str, list]:
    """Tokens by the clause they follow; before any of them, under ''."""
    out, now, depth = {"": []}, "", 0
    for t in ts:
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
        if not depth and t.kind == "word" and t.up in heads:
            now = heads[t.up]
            out.setdefault(now, [])
        elif not (t.up == "BY" and not significant(out[now])):
            out[now].append(t)
    return out


def _table_function(e: Engine, name: str, inner) -> str:
    parts = _clause(inner, {"PARTITION": "by", "DISTRIBUTE": "by", "ORDER": "order", "SORT": "order"})
    last = [k for k in ("by", "order", "") if k in parts][0] if "order" not in parts else "order"
    items, args = _parts(parts[last]), {}
    # arguments follow the last clause: name(value), after a space and then commas
    kept = []
    for i, item in enumerate(items):
        sig = significant(item)
        call = next((j for j in range(1, len(sig)) if sig[j].text == "(" and sig[j - 1].kind == "word" and (j > 1 or i) and sig[-1].text == ")"), None)
        if call is None or last == "":
            kept.append(item)
            continue
        if call > 1:
            kept.append(sig[: call - 1])
        args[sig[call - 1].text.lower()] = e.spark.sql(f"SELECT {render([x for t in sig[call + 1 : -1] for x in (t, *tokenize(' '))])} AS v").first()[0]
    parts[last] = [x for i, item in enumerate(kept) for x in (*(tokenize(", ") if i else ()), *item)]
    f, schema = e.functions[name]
    df = e.spark.sql(e.translate(f"SELECT * FROM {render(parts['']).strip()}"))
    keys = [render(x).strip() for x in _parts(parts.get("by", [])) if significant(x)]
    order = [(significant(x)[0].text, significant(x)[-1].up != "DESC") for x in _parts(parts.get("order", [])) if significant(x)]

    def run(key, rows):
        if order:
            rows = rows.sort_values([c for c, _ in order], ascending=[up for _, up in order], kind="stable")
        return f(key, rows, **args)

    import pandas as pd

    def typed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows)

    return _view(e, df.groupBy(*map(F.expr, keys)).applyInPandas(typed, schema))


def _joined(e: Engine, ts, sig: list[int], at: int) -> str:
    """The text with a user-defined join's two sides replaced by a view of its result."""
    from lakeloom.operators import joins

    f, schema = e.functions[ts[sig[at]].text.lower()]
    start = max(i for i in range(at) if ts[sig[i]].up == "FROM" and ts[sig[i]].kind == "word" and sum((ts[sig[j]].text == "(") - (ts[sig[j]].text == ")") for j in range(i, at)) == 0)
    depth, join, on = 0, None, None
    for i in range(start + 1, at):
        t = ts[sig[i]]
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.kind == "word" and t.up == "JOIN" and join is None:
            join = i
        elif not depth and t.kind == "word" and t.up == "ON":
            on = i
    if join is None or on is None:
        raise ValueError("JOIN .. ON a.k = b.k USING f(..)")
    lead = 1 if ts[sig[join - 1]].up == "INNER" else 0
    left, right = (ts[sig[a] : sig[b]] for a, b in ((start + 1, join - lead), (join + 1, on)))
    la, ra = (significant(x)[-1].text.strip("`") for x in (left, right))
    pairs = []
    for part in re.split(r"(?i)\bAND\b", render(ts[sig[on] + 1 : sig[at - 1]])):
        a, b = (x.strip().strip("()") for x in part.split("="))
        pairs.append((a, b) if a.split(".")[0].strip("`") == la else (b, a))
    o = sig[at + 1]
    z = closing(ts, o)
    exprs = [render(x).strip() for x in _parts(ts[o + 1 : z]) if significant(x)]
    side = lambda alias: [x for x in exprs if x.split(".")[0].strip("`") == alias]
    rest = [i for i in sig if i > z]
    alias, end, names, sort = "", z, [], []
    j = 0
    if j < len(rest) and ts[rest[j]].kind == "word" and ts[rest[j]].up not in _AFTER_JOIN:
        alias, end = ts[rest[j]].text, rest[j]
        j += 1
    if j < len(rest) and ts[rest[j]].up == "AS":
        j += 1
    if j < len(rest) and ts[rest[j]].text == "(":
        end = closing(ts, rest[j])
        names = [render(x).strip() for x in _parts(ts[rest[j] + 1 : end])]
        j = next((i for i, x in enumerate(rest) if x > end), len(rest))
    if j + 1 < len(rest) and ts[rest[j]].up == "SORT" and ts[rest[j + 1]].up == "BY":
        stop = next((x for x in rest[j + 2 :] if ts[x].up in _AFTER_JOIN), len(ts))
        sort, end = [render(x).strip().split(".")[-1] for x in _parts(ts[rest[j + 1] + 1 : stop])], stop - 1
    keys = [f"k{i}" for i in range(len(pairs))]

    def rows(source, alias_, which):
        cols = [f"{p[which]} AS k{i}" for i, p in enumerate(pairs)] + [f"{x} AS `{x.split('.')[-1]}`" for x in side(alias_)]
        return e.spark.sql(e.translate(f"SELECT {', '.join(cols)} FROM {render(source)}"))

    df = joins.user_defined_join(rows(left, la, 0), rows(right, ra, 1), keys, f, schema, sort or None)
    if names:
        df = df.toDF(*names)
    return render(ts[: sig[start] + 1]) + f" {_view(e, df)} {alias} " + render(ts[end + 1 :])


_AFTER_JOIN = frozenset("AS SORT WHERE GROUP HAVING ORDER LIMIT UNION INTERSECT EXCEPT MINUS JOIN LEFT RIGHT FULL INNER CROSS LATERAL WINDOW ON WITH DISTRIBUTE CLUSTER".split())


def _parts(ts) -> list:
    from lakeloom.plans.rewrite import _split

    return _split(ts)


def _assignments(ts) -> dict[str, str]:
    """a = x, (b, c) = (y, z) -> {a: x, b: y, c: z}."""
    out = {}
    for part in _parts(ts):
        eq = next(i for i, t in enumerate(part) if t.text == "=")
        left, right = significant(part[:eq]), part[eq + 1 :]
        if left[0].text == "(":
            names = [render(x).strip() for x in _parts(left[1:-1])]
            sig = significant(right)
            a = right.index(sig[0])
            values = [render(x).strip() for x in _parts(right[a + 1 : closing(right, a)])]
            out.update(zip(names, values))
        else:
            out[render(left)] = render(right).strip()
    return out


def _table_clauses(text: str) -> str:
    """LIFECYCLE n, SHARDS n and HUBLIFECYCLE n of CREATE TABLE become table properties."""
    found = re.findall(r"(?i)\b(LIFECYCLE|HUBLIFECYCLE)\s+(\d+)|\bINTO\s+(\d+)\s+SHARDS\b", text)
    if not found:
        return text
    text = re.sub(r"(?i)\b(?:HUB)?LIFECYCLE\s+\d+|\bINTO\s+\d+\s+SHARDS\b", "", text)
    props = ", ".join(f"'{(a or 'shards').lower()}' = '{b or c}'" for a, b, c in found)
    m = re.search(r"(?i)\sAS\s+(?=SELECT|WITH|\()", text)
    cut = m.start() if m else len(text)
    return f"{text[:cut].rstrip()} TBLPROPERTIES ({props}){text[cut:]}"


_STATEMENTS = [
    (("DELETE", "FROM"), Engine._delete), (("UPDATE",), Engine._update), (("MERGE", "INTO"), Engine._merge), (("CLONE", "TABLE"), Engine._clone), (("UNLOAD",), Engine._unload),
    (("EXPORT", "TABLE"), Engine._export), (("IMPORT",), Engine._import), (("LOAD", "DATA"), Engine._load), (("READ",), Engine._read), (("COUNT",), Engine._count),
    (("ADD", "STATISTIC"), Engine._statistic), (("CREATE", "TEMPORARY", "MACRO"), Engine._macro), (("SETPROJECT",), Engine._set_project),
    (("CREATE", "MATERIALIZED", "VIEW"), Engine._materialize), (("ALTER", "MATERIALIZED", "VIEW"), Engine._alter_materialized), (("DROP", "MATERIALIZED", "VIEW"), Engine._drop_materialized),
    *((start, Engine._refuse) for start in (
        ("CREATE", "INDEX"), ("DROP", "INDEX"), ("ALTER", "INDEX"), ("CREATE", "MODEL"), ("DROP", "MODEL"), ("GRANT",), ("REVOKE",), ("ADD", "USER"), ("REMOVE", "USER"), ("CREATE", "ROLE"), ("DROP", "ROLE"),
        ("SHOW", "GRANT"), ("SHOW", "GRANTS"), ("CREATE", "PACKAGE"), ("DROP", "PACKAGE"), ("INSTALL", "PACKAGE"), ("UNINSTALL", "PACKAGE"), ("ADD", "RESOURCE"), ("KILL",), ("STATUS",), ("WAIT",),
    )),
]
