"""Metadata, lineage, validation and presentation of queries, as DataFrames with known rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans import lineage as lin
from lakeloom.plans import metadata as meta
from lakeloom.plans import report, validate
from lakeloom.plans.engine import Engine
from lakeloom.plans.registry import register
from lakeloom.sources import catalog
from lakeloom.sources.tables import use_folder

JOINED = """SELECT u.id, -- user id
  o.amount AS paid, upper(u.name) AS big, count(DISTINCT o.order_id) AS n
FROM ods.user_table u LEFT JOIN ods.order_table o ON u.id = o.user_id AND o.amount > 10
WHERE u.age > 18 AND u.name LIKE 'a%' GROUP BY u.id, o.amount, upper(u.name) HAVING count(*) > 1
ORDER BY u.id DESC NULLS LAST LIMIT 10, 5"""
NESTED = "WITH t AS (SELECT user_id AS k, sum(amount) AS total FROM ods.order_table GROUP BY user_id) SELECT s.nick, t.total + 1 AS more, row_number() OVER w AS rn FROM (SELECT id, concat(name, email) AS nick FROM ods.user_table) s JOIN t ON t.k = s.id WINDOW w AS (PARTITION BY s.nick ORDER BY t.total DESC)"


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def _section(name: str, section: str, sql: str, columns: list[str], rows: list[tuple], names: str) -> None:
    """A query that gives some columns of a section of a text's metadata (lists joined by commas), and its known rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = meta.extract(spark, sql).frames(spark)[section]
        kinds = dict(df.dtypes)
        return df.select(*(F.array_join(c, ",").alias(c) if kinds[c] == "array<string>" else F.col(c) for c in columns))

    register(name, _values(rows, names))(run)


_section("mtd_02_tables", "tables", JOINED, ["qualified_name", "alias", "kind"], [("ods.user_table", "u", "table"), ("ods.order_table", "o", "table")], "qualified_name, alias, kind")
_section("mtd_03_subquery_tables", "tables", NESTED, ["scope", "qualified_name", "kind"], [("", "s", "subquery"), ("s", "ods.user_table", "table"), ("", "t", "table"), ("t", "ods.order_table", "table")], "scope, qualified_name, kind")
_section("mtd_05_fields_by_scope", "fields", NESTED, ["scope", "ordinal", "alias", "category"], [("t", 0, "k", "DIRECT"), ("t", 1, "total", "AGGREGATE"), ("", 0, None, "DIRECT"), ("", 1, "more", "EXPRESSION"), ("", 2, "rn", "EXPRESSION"), ("s", 0, None, "DIRECT"), ("s", 1, "nick", "EXPRESSION")], "scope, ordinal, alias, category")
_section("mtd_06_joins", "joins", JOINED, ["left", "right", "join_type", "condition"], [("u", "o", "LEFT", "u.id = o.user_id AND o.amount > 10")], '"left", "right", join_type, condition')
_section("jon_18_join_record", "joins", "SELECT 1 FROM a JOIN b ON a.x = b.y JOIN c USING (id, name)", ["left", "right", "join_type", "using"], [("a", "b", "INNER", ""), ("b", "c", "INNER", "id,name")], '"left", "right", join_type, "using"')
_section("mtd_07_field_categories", "fields", JOINED, ["alias", "expression", "category"], [(None, "u.id", "DIRECT"), ("paid", "o.amount", "DIRECT"), ("big", "upper(u.name)", "EXPRESSION"), ("n", "count(DISTINCT o.order_id)", "AGGREGATE")], "alias, expression, category")
_section("mtd_08_columns", "fields", "SELECT a.x + b.y AS s, CASE WHEN c > 1 THEN d ELSE e END AS k, CAST(f AS INT) AS g FROM a, b", ["alias", "columns"], [("s", "a.x,b.y"), ("k", "c,d,e"), ("g", "f")], "alias, columns")
_section("mtd_11_conditions", "conditions", JOINED, ["clause", "expression", "columns"], [("WHERE", "u.age > 18 AND u.name LIKE 'a%'", "u.age,u.name"), ("HAVING", "count(*) > 1", "")], "clause, expression, columns")
_section("mtd_11_order_limit", "orders", JOINED, ["expression", "direction", "nulls"], [("u.id", "DESC", "LAST")], "expression, direction, nulls")
_section("mtd_11_limit", "limits", "SELECT x FROM t ORDER BY x LIMIT 10, 20 + 5", ["offset", "row_count"], [(10, 25)], '"offset", row_count')
_section("mtd_12_ctes", "ctes", "WITH a(x, y) AS (SELECT 1, 2), b AS (SELECT * FROM a) SELECT * FROM b", ["name", "columns"], [("a", "x,y"), ("b", "")], "name, columns")
_section("mtd_12_hints", "hints", "SELECT /*+ MAPJOIN(a, b), SKEWJOIN(c) */ 1 FROM a JOIN b ON a.x = b.x JOIN c ON c.x = a.x", ["name", "arguments"], [("MAPJOIN", "a,b"), ("SKEWJOIN", "c")], "name, arguments")
_section("mtd_12_lateral_views", "lateral_views", "SELECT k, v FROM a LATERAL VIEW OUTER explode(a.m) t AS k, v", ["function", "table_alias", "column_aliases", "is_outer"], [("explode(a.m)", "t", "k,v", True)], "function, table_alias, column_aliases, is_outer")
_section("set_09_set_operations", "set_operations", "SELECT x FROM a UNION ALL SELECT x FROM b INTERSECT SELECT x FROM c", ["type", "is_all"], [("UNION", True), ("INTERSECT", False)], "type, is_all")
_section("mtd_13_windows", "windows", "SELECT sum(x) OVER w FROM t WINDOW w AS (PARTITION BY a, t.b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", ["name", "partition_by", "order_by", "frame"], [("w", "a,t.b", "c", "ROWS BETWEEN 1 PRECEDING AND CURRENT ROW")], "name, partition_by, order_by, frame")
_section("mtd_13_window_functions", "window_functions", NESTED, ["alias", "function", "window_name"], [("rn", "row_number", "w")], "alias, function, window_name")
_section("mtd_14_functions", "functions", "SELECT concat(upper(a), trim(b)) AS c FROM t WHERE length(a) > 1 GROUP BY substr(a, 1) HAVING sum(x) > 0 ORDER BY abs(y)", ["name", "type", "clause"], [("concat", "STRING", "SELECT"), ("upper", "STRING", "SELECT"), ("trim", "STRING", "SELECT"), ("length", "STRING", "WHERE"), ("substr", "STRING", "GROUP BY"), ("sum", "AGGREGATE", "HAVING"), ("abs", "MATH", "ORDER BY")], "name, type, clause")
_section("mtd_15_arguments", "functions", "SELECT coalesce(nvl(a, 'x,y'), ')') AS v, if(a > 1, b, c) AS w FROM t", ["name", "arguments", "arg_count"], [("coalesce", "nvl(a, 'x,y'),')'", 2), ("nvl", "a,'x,y'", 2), ("if", "a > 1,b,c", 3)], "name, arguments, arg_count")
_section("agg_22_aggregate_detection", "functions", "SELECT count(*), sum(a), avg(a), min(a), max(a), group_concat(a), stddev(a), variance(a), collect_list(a), collect_set(a) FROM t", ["type", "is_aggregate"], [("AGGREGATE", True)] * 10, "type, is_aggregate")
_section("mtd_18_comments", "comments", "SELECT a, -- first\n b -- second\nFROM t -- table\nWHERE a > 1 -- cond\nGROUP BY a, b -- keys\nHAVING count(*) > 1 -- having\nORDER BY a -- order\nLIMIT 5 -- few", ["text", "target_type", "target_name"], [("first", "FIELD", "a"), ("second", "FIELD", "b"), ("table", "TABLE", "t"), ("cond", "WHERE", ""), ("keys", "GROUP_BY", ""), ("having", "HAVING", ""), ("order", "ORDER_BY", ""), ("few", "LIMIT", "")], "text, target_type, target_name")
_section("mtd_17_comment_places", "comments", "-- head\nSELECT a /* block */ FROM t", ["text", "start", "stop"], [("head", 0, 7), ("block", 17, 28)], "text, start, stop")


_section("mtd_04_outer_aliases", "tables", "SELECT x.a, y.b FROM (SELECT a FROM p q) x JOIN r y ON x.a = y.a", ["scope", "alias"], [("", "x"), ("x", "q"), ("", "y")], "scope, alias")
_section("mtd_09_owners", "fields", "SELECT u.id, user_table.id AS i, id AS j FROM ods.user_table u", ["alias", "columns"], [(None, "u.id"), ("i", "user_table.id"), ("j", "id")], "alias, columns")
_section("mtd_10_expression_text", "fields", "SELECT a + b * 2 AS x, CASE WHEN a > 1 THEN 'y' ELSE 'n' END AS z, NOT a IN (1, 2) AS w, -a AS v FROM t", ["alias", "expression"], [("x", "a + b * 2"), ("z", "CASE WHEN a > 1 THEN 'y' ELSE 'n' END"), ("w", "NOT a IN (1, 2)"), ("v", "-a")], "alias, expression")
_section("mtd_19_statement_comments", "comments", "-- the whole\nSELECT a,\n-- before b\nb FROM t\n-- before where\nWHERE a > 1", ["text", "target_type", "target_name"], [("the whole", "STATEMENT", ""), ("before b", "FIELD", "b"), ("before where", "WHERE", "")], "text, target_type, target_name")


@register("mtd_01_errors", _values([("SELECT 1", "success"), ("SELECT (a FROM t", "error"), ("  ", "error")], "sql, status"))
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(q, meta.extract(spark, q).status) for q in ("SELECT 1", "SELECT (a FROM t", "  ")], "sql string, status string")


@register("mtd_16_function_types", _values([("row_number", "WINDOW"), ("count", "AGGREGATE"), ("upper", "STRING"), ("abs", "MATH"), ("to_date", "DATE_TIME"), ("to_char", "CAST"), ("nvl", "CONDITIONAL"), ("md5", "OTHER")], "name, type"))
def function_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [("row_number", True), *((n, False) for n in ("count", "upper", "abs", "to_date", "to_char", "nvl", "md5"))]
    return spark.createDataFrame([(n, meta.function_type(n, w)) for n, w in names], "name string, type string")


@register("mtd_20_summary", _values([(0, "tables:"), (1, "  a"), (2, "  b"), (3, "joins:"), (4, "  a INNER b on a.k = b.k"), (5, "fields:"), (6, "  a.x = a.x [DIRECT]"), (7, "  n = count(*) [AGGREGATE]")], "place, line"))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = report.summary(meta.extract(spark, "SELECT a.x, count(*) AS n FROM a JOIN b ON a.k = b.k GROUP BY a.x"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "place int, line string")


def _lineage(name: str, sql: str, rows: list[tuple], fixture: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not fixture:
            Engine(spark, sf_dir).use(sql)
        known = catalog.fixture() if fixture else None
        return lin.lineage(spark, sql, known).edges(spark, known).where("is_final").select("target", "category", "source_table", "source_column")

    register(name, _values(rows, "target, category, source_table, source_column"))(run)


_U, _O = "ods.user_table", "ods.order_table"
_lineage("lin_03_columns", "SELECT u.id, o.amount AS paid FROM ods.user_table u JOIN ods.order_table o ON u.id = o.user_id", [("id", "DIRECT", _U, "id"), ("paid", "DIRECT", _O, "amount")])
_lineage("lin_04_expressions", "SELECT concat(name, email) AS c, 1 AS one, count(*) AS n FROM ods.user_table GROUP BY name, email", [("c", "EXPRESSION", _U, "name"), ("c", "EXPRESSION", _U, "email"), ("one", "EXPRESSION", None, None), ("n", "AGGREGATE", None, None)])
_lineage("lin_05_star", "SELECT o.* FROM ods.user_table u JOIN ods.order_table o ON u.id = o.user_id", [(c, "DIRECT", _O, c) for c in ("order_id", "user_id", "amount", "order_date")])
_lineage("lin_06_unqualified", "SELECT name, amount FROM user_table JOIN order_table ON id = user_id", [("name", "DIRECT", _U, "name"), ("amount", "DIRECT", _O, "amount")])
_lineage("lin_07_subquery", "SELECT s.i AS x, s.n AS y FROM (SELECT u.id AS i, nvl(o.amount, 0) AS n FROM ods.user_table u LEFT JOIN ods.order_table o ON u.id = o.user_id) s", [("x", "DIRECT", _U, "id"), ("y", "DIRECT", _O, "amount")])
_lineage("lin_08_final_fields", "SELECT id, id + 1 AS x FROM ods.user_table", [("id", "DIRECT", _U, "id"), ("x", "EXPRESSION", _U, "id")])
_lineage("lin_07_cte", NESTED, [("nick", "DIRECT", _U, "name"), ("nick", "DIRECT", _U, "email"), ("more", "EXPRESSION", _O, "amount"), ("rn", "EXPRESSION", _U, "name"), ("rn", "EXPRESSION", _U, "email"), ("rn", "EXPRESSION", _O, "amount")])
_lineage("lin_07_set_operation", "SELECT id AS k FROM ods.user_table UNION SELECT user_id FROM ods.order_table", [("k", "DIRECT", _U, "id"), ("k", "DIRECT", _O, "user_id")])
_lineage("lin_10_duplicate_names", "SELECT u.id, o.order_id AS id FROM ods.user_table u JOIN ods.order_table o ON u.id = o.user_id", [("id", "DIRECT", _U, "id"), ("id", "DIRECT", _O, "order_id")])
_lineage("lin_12_session_tables", "WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_name, t FROM customer LEFT JOIN s ON k = c_custkey", [("c_name", "DIRECT", "customer", "c_name"), ("t", "DIRECT", "orders", "o_totalprice")], False)


@register("lin_01_tables", _values([(_U,), (_O,)], "name"))
def lineage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lin.lineage(spark, "SELECT 1 AS one FROM ods.user_table WHERE id IN (SELECT user_id FROM ods.order_table)", catalog.fixture())
    return spark.createDataFrame([(t,) for t in found.tables], "name string")


@register("lin_02_default_database", _values([("user_table", "ods.user_table"), ("ods.user_table", "ods.user_table"), ("nope", None)], "name, resolved"))
def default_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.fixture()
    found = [(n, c.resolve(n)) for n in ("user_table", "ods.user_table", "nope")]
    return spark.createDataFrame([(n, f"{t.database}.{t.name}" if t else None) for n, t in found], "name string, resolved string")


@register("lin_09_steps", _values([("k", "DIRECT", _O, "user_id"), ("total", "AGGREGATE", _O, "amount"), ("nick", "EXPRESSION", _U, "name"), ("nick", "EXPRESSION", _U, "email")], "target, category, source_table, source_column"))
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns inside the query; ``nick`` and the others are not outputs as they stand."""
    found = lin.lineage(spark, NESTED.replace("s.nick,", "s.nick AS who,"), catalog.fixture())
    return found.edges(spark).where("NOT is_final AND target IN ('k', 'total', 'nick')").select("target", "category", "source_table", "source_column").distinct()


@register("lin_11_tree", _values([("who", "nick", "ods.user_table.email"), ("who", "nick", "ods.user_table.name")], "a, b, c"))
def lineage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lin.lineage(spark, "SELECT upper(nick) AS who FROM (SELECT concat(name, email) AS nick FROM ods.user_table) s", catalog.fixture())
    rows = [(a["field"], b["field"], c["field"]) for a in lin.tree(found) for b in a["children"] for c in b["children"]]
    return spark.createDataFrame(rows, "a string, b string, c string")


def _validated(name: str, sql: str, rows: list[tuple]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validate.validate(spark, sql, _conflicted()).select("type")

    register(name, _values(rows, "type") if rows else "SELECT 'x' AS type WHERE false")(run)


def _conflicted() -> catalog.Catalog:
    c = catalog.ColumnMeta
    return catalog.Catalog([
        catalog.TableMeta("ods", "user_table", [c("id", "BIGINT"), c("name", "STRING"), c("project_name", "STRING")]),
        catalog.TableMeta("ods", "order_table", [c("order_id", "BIGINT"), c("name", "STRING"), c("project_name", "STRING")]),
    ])


_validated("val_01_star_conflict", "SELECT * FROM ods.user_table t1 JOIN ods.order_table t2 ON t1.id = t2.order_id", [("COLUMN_CONFLICT",)])
_validated("val_01_no_conflict", "SELECT t1.* FROM ods.user_table t1 JOIN ods.order_table t2 ON t1.id = t2.order_id", [])
_validated("val_02_valid", "SELECT id, name FROM ods.user_table", [])
_validated("val_03_missing_table", "SELECT id FROM ods.nothing", [("TABLE_NOT_FOUND",)])
_validated("val_03_missing_column", "SELECT nothing FROM ods.user_table", [("COLUMN_NOT_FOUND",)])
_validated("val_04_join_types", "SELECT t1.id FROM ods.user_table t1 JOIN ods.order_table t2 ON t1.name = t2.order_id", [("TYPE_MISMATCH",)])


@register("val_05_format", _values([("SELECT a, b\nFROM t\n  LEFT JOIN u ON t.k = u.k\nWHERE a > 'from x'\nORDER BY a",)], "text"))
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(report.format_sql("select a,b from t left join u on t.k = u.k where a > 'from x' order by a"),)], "text string")


@register("prs_01_listing", _values([("tables: ods.user_table",), ("id = id [DIRECT]",), ("  <- ods.user_table.id",)], "line"))
def console_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lin.lineage(spark, "SELECT id FROM ods.user_table", catalog.fixture())
    return spark.createDataFrame([(x,) for x in report.listing(found).split("\n")], "line string")


@register("prs_02_drawing", _values([("└── id [DIRECT] id",), ("    └── ods.user_table.id",)], "line"))
def console_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lin.lineage(spark, "SELECT id FROM ods.user_table", catalog.fixture())
    return spark.createDataFrame([(x,) for x in report.drawing(found).split("\n")], "line string")


@register("snk_13_text_lines", _values([("tables: ods.order_table",), ("n = count(1) [AGGREGATE]",)], "value"))
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as a text file and read again."""
    from lakeloom.sources import scratch

    at = scratch.path(spark, "report")
    found = lin.lineage(spark, "SELECT count(*) AS n FROM ods.order_table", catalog.fixture())
    spark.createDataFrame([(x,) for x in report.listing(found).split("\n")], "value string").write.text(at)
    return spark.read.text(at)


_REPLY = "tables: ods.user_table\nid = id [DIRECT]\n  <- ods.user_table.id\n└── id [DIRECT] id\n    └── ods.user_table.id"


@register("prs_03_console", _values([("SELECT id FROM ods.user_table;", _REPLY), ("help", "type a query to see its lineage; exit or quit ends"), ("SELECT nothing FROM ods.user_table", "AnalysisException")], "line, answer"))
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.console import reply

    lines = ("SELECT id FROM ods.user_table;", "help", "SELECT nothing FROM ods.user_table")
    answers = [reply(spark, x, catalog.fixture()) for x in lines]
    return spark.createDataFrame([(x, a.split(":")[0] if "Exception" in a else a) for x, a in zip(lines, answers)], "line string, answer string")


_ASK = {"sql": "SELECT id FROM ods.user_table", "connectorType": "mock"}


@register("api_01_health", _values([("UP", "Lineage")], "status, service"))
def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = _served(spark, "/health")
    return spark.createDataFrame([(a["status"], a["service"])], "status string, service string")


def _served(spark: SparkSession, path: str, request: dict | None = None) -> tuple[int, dict]:
    """Status and answer of a service that listens for this one request."""
    import http.client
    import json
    import threading

    from lakeloom.service import serve

    server = serve(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=60)
        c.request("GET" if request is None else "POST", path, None if request is None else json.dumps(request), {"Content-Type": "application/json"})
        r = c.getresponse()
        return r.status, json.loads(r.read())
    finally:
        server.shutdown()
        server.server_close()


@register("api_02_extract", _values([("SELECT id FROM ods.user_table", "ods.user_table", "id", "DIRECT", "id", "ods.user_table.id", True)], 'sql, "table", target, category, field, leaf, is_leaf'))
def api_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = _served(spark, "/api/lineage/extract", _ASK)
    node = a["columnLineageTree"][0]
    row = (a["sql"], a["tableLineages"][0]["qualifiedName"], a["columnLineages"][0]["targetField"], a["columnLineages"][0]["category"], node["fieldName"], node["children"][0]["fieldName"], node["children"][0]["isLeaf"])
    return spark.createDataFrame([row], "sql string, table string, target string, category string, field string, leaf string, is_leaf boolean")


@register("api_03_tables", _values([("ods", "user_table", "MANAGED_TABLE")], '"database", "table", kind'))
def api_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = _served(spark, "/api/lineage/tables", _ASK)
    return spark.createDataFrame([(t["database"], t["tableName"], t["tableType"]) for t in a["tableLineages"]], "database string, table string, kind string")


@register("api_04_columns", _values([("id", "DIRECT", "ods.user_table", "id")], 'target, category, "table", "column"'))
def api_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = _served(spark, "/api/lineage/columns", _ASK)
    return spark.createDataFrame([(c["targetField"], c["category"], s["table"], s["column"]) for c in a["columnLineages"] for s in c["sources"]], "target string, category string, table string, column string")


@register("api_05_errors", _values([("/api/lineage/extract", 400, True, "SQL 语句不能为空"), ("/api/lineage/tables", 400, True, "连接器类型不能为空"), ("/nothing", 404, True, "接口不存在: /nothing"), ("/health", 200, False, None)], 'path, code, error, message'))
def api_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("/api/lineage/extract", {"connectorType": "mock"}), ("/api/lineage/tables", {"sql": "SELECT 1"}), ("/nothing", {}), ("/health", None)]
    got = [(p, *_served(spark, p, r)) for p, r in asked]
    return spark.createDataFrame([(p, code, bool(a.get("error")), a.get("message")) for p, code, a in got], "path string, code int, error boolean, message string")


# --- catalogs

@register("src_21_catalog_interface", _values([("ods", "order_table", 4), ("ods", "product_table", 3), ("ods", "user_table", 4)], "db, tab, n"))
def catalog_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.fixture()
    return spark.createDataFrame([(d, t, len(c.table(d, t).columns)) for d in c.databases() for t in sorted(c.tables(d))], "db string, tab string, n int")


@register("src_22_session_catalog", _values([("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")], "name, type"))
def session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_folder(spark, sf_dir, ["nation"])
    return spark.createDataFrame([(c.name, c.data_type) for c in catalog.connect(spark, "session").columns("nation")], "name string, type string")


_SHEET = "SELECT 's' AS sheet, CAST(NULL AS STRING) AS catalog, 'analytics' AS database, CAST(NULL AS STRING) AS db_owner, CAST(NULL AS STRING) AS db_comment, 'orders' AS table, 'me' AS table_owner, 'MANAGED' AS table_type, CAST(NULL AS STRING) AS table_comment, c AS column, 'STRING' AS data_type, p = false AS nullable, CAST(NULL AS STRING) AS column_comment, o AS ordinal, p AS is_partition, CAST(NULL AS STRING) AS default_value FROM VALUES ('ds', 1, true), ('id', 0, false) AS v(c, o, p)"


def _workbook() -> bytes:
    """A small .xlsx file: shared and inline texts, numbers, truth values, gaps."""
    import io
    import zipfile

    cells = lambda row, at: "".join(f'<c r="{chr(65 + k)}{at}" t="{t}">{f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>"}</c>' for k, (t, v) in enumerate(row) if v is not None)
    head = [("s", i) for i in range(6)]
    rows = [[("inlineStr", "analytics"), ("inlineStr", "orders"), ("inlineStr", c), ("inlineStr", "STRING"), ("n", o), ("b", p)] for c, o, p in (("ds", 1, 1), ("id", 0, None))]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="first" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{x}</t></si>" for x in "database table column data_type ordinal is_partition".split()) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{k}">{cells(r, k)}</row>' for k, r in enumerate([head, *rows], 1)) + "</sheetData></worksheet>")
    return out.getvalue()


@register("src_23_excel_catalog", _values([("id", "STRING", 0, False, "first"), ("ds", "STRING", 1, True, "first")], "name, type, ordinal, partition_, sheet"))
def excel_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.sources import scratch

    at = scratch.path(spark, "workbook") + ".xlsx"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    file = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    file.write(_workbook())
    file.close()
    c = catalog.connect(spark, "excel", {"path": at})
    sheet = c.frame.first().sheet
    return spark.createDataFrame([(x.name, x.data_type, x.ordinal, x.partition, sheet) for x in c.columns("analytics.orders")], "name string, type string, ordinal int, partition_ boolean, sheet string")


@register("src_23_rows_catalog", _values([("id", 0, False), ("ds", 1, True)], "name, ordinal, partition_"))
def rows_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.RowsCatalog(spark.sql(_SHEET))
    return spark.createDataFrame([(x.name, x.ordinal, x.partition) for x in c.columns("analytics.orders")], "name string, ordinal int, partition_ boolean")


@register("src_24_mock_catalog", _values([("order_table",), ("product_table",), ("user_table",)], "name"))
def mock_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.connect(spark, "mock").rows(spark).select(F.col("table").alias("name")).distinct()


@register("src_25_csv_catalog", _values([("id", 0), ("ds", 1)], "name, ordinal"))
def csv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.sources import scratch

    at = scratch.path(spark, "catalog")
    spark.sql(_SHEET).write.csv(at, header=True)
    c = catalog.connect(spark, "csv", {"path": at})
    return spark.createDataFrame([(x.name, x.ordinal) for x in c.columns("orders")], "name string, ordinal int")


@register("src_26_catalog_factory", _values([("mock", True), ("session", True), ("nothing", False)], "kind, made"))
def catalog_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for kind in ("mock", "session", "nothing"):
        try:
            out.append((kind, catalog.connect(spark, kind) is not None))
        except ValueError:
            out.append((kind, False))
    return spark.createDataFrame(out, "kind string, made boolean")
