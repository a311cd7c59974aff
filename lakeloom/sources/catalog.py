"""Catalogs: databases, tables and columns that queries are resolved against.

A catalog is rows of columns, from the session, a DataFrame, CSV, Parquet or .xlsx files, or given in Python. Large catalogs are
grouped by Spark; what a query names is looked up table by table and kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.tokens import Token, render, significant, tokenize

#: One row for each column of each table.
ROWS = (
    "sheet string, catalog string, database string, db_owner string, db_comment string, table string, table_owner string, table_type string, table_comment string, column string, data_type string, "
    "nullable boolean, column_comment string, ordinal int, is_partition boolean, default_value string"
)


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    data_type: str
    nullable: bool = True
    comment: str | None = None
    ordinal: int = 0
    partition: bool = False
    default: str | None = None


@dataclass
class TableMeta:
    database: str
    name: str
    columns: list[ColumnMeta]
    kind: str = "MANAGED_TABLE"
    comment: str | None = None
    owner: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


class Catalog:
    """What a connector answers: databases, tables, one table. Subclasses give ``_load(database, table)`` and the lists."""

    kind = "memory"

    def __init__(self, tables: Iterable[TableMeta] = ()):
        self._tables = {(t.database, t.name): t for t in tables}

    def databases(self) -> list[str]:
        return list(dict.fromkeys(d for d, _ in self._tables))

    def tables(self, database: str) -> list[str]:
        return [t for d, t in self._tables if d == database]

    def table(self, database: str, name: str) -> TableMeta | None:
        return self._tables.get((database, name))

    def resolve(self, name: str) -> TableMeta | None:
        """A table by its name; without a database, in the first one."""
        database, _, table = name.rpartition(".")
        if not database:
            found = self.databases()
            database = found[0] if found else ""
        return self.table(database.split(".")[-1], table)

    def columns(self, name: str) -> list[ColumnMeta]:
        t = self.resolve(name)
        return t.columns if t else []

    def diagnostics(self) -> dict[str, object]:
        return {"kind": self.kind, "databases": len(self.databases())}

    def rows(self, spark: SparkSession) -> DataFrame:
        """The catalog as rows of columns."""
        out = []
        for d in self.databases():
            for name in self.tables(d):
                t = self.table(d, name)
                out += [(None, None, d, None, None, name, t.owner, t.kind, t.comment, c.name, c.data_type, c.nullable, c.comment, c.ordinal, c.partition, c.default) for c in t.columns]
        return spark.createDataFrame(out, ROWS)

    def bind(self, spark: SparkSession, text: str) -> tuple[str, dict[str, str]]:
        """The text with the catalog's tables replaced by empty views of their columns, and those views' table names."""
        ts = tokenize(text)
        sig = [k for k, t in enumerate(ts) if t.kind not in ("space", "comment")]
        back: dict[str, str] = {}
        at = 0
        while at < len(sig):
            k = sig[at]
            prev = ts[sig[at - 1]] if at else None
            if prev is not None and (prev.up in ("FROM", "JOIN") or prev.text == "," and _in_from(ts, sig, at)) and ts[k].kind in ("word", "quoted"):
                end, parts = at, [ts[k].text.strip("`")]
                while end + 2 < len(sig) and ts[sig[end + 1]].text == ".":
                    parts.append(ts[sig[end + 2]].text.strip("`"))
                    end += 2
                t = self.resolve(".".join(parts))
                if t is not None:
                    view = re.sub(r"\W", "_", f"cat__{t.database}__{t.name}")
                    back[view] = f"{t.database}.{t.name}"
                    schema = ", ".join(f"`{c.name}` {_spark_type(c.data_type)}" for c in t.columns)
                    spark.createDataFrame([], schema).createOrReplaceTempView(view)
                    follow = ts[sig[end + 1]] if end + 1 < len(sig) else None
                    named = follow is not None and (follow.up == "AS" or follow.kind in ("word", "quoted") and follow.up not in _KEYWORDS)
                    ts[k] = Token("word", view if named else f"{view} AS {parts[-1]}", ts[k].start, ts[k].stop)
                    for j in sig[at + 1 : end + 1]:
                        ts[j] = Token("space", "", ts[j].start, ts[j].stop)
                at = end
            at += 1
        return render(ts), back


_KEYWORDS = frozenset("ON USING WHERE GROUP HAVING ORDER SORT CLUSTER DISTRIBUTE LIMIT UNION INTERSECT EXCEPT MINUS JOIN LEFT RIGHT FULL INNER CROSS NATURAL LATERAL WINDOW TABLESAMPLE SEMI ANTI".split())


def _in_from(ts: list[Token], sig: list[int], at: int) -> bool:
    """Whether a comma stands between tables: the last keyword at its depth is FROM."""
    depth = 0
    for j in range(at - 1, -1, -1):
        t = ts[sig[j]]
        if t.kind == "op":
            depth += (t.text == ")") - (t.text == "(")
        if depth < 0:
            return False
        if not depth and t.kind == "word" and t.up in ("SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "BY", "ON", "VALUES", "FROM"):
            return t.up == "FROM"
    return False


def _spark_type(name: str) -> str:
    up = name.upper().strip()
    return {"DATETIME": "TIMESTAMP", "DECIMAL": "DECIMAL(38,18)"}.get(up, up)


class SessionCatalog(Catalog):
    """The session's own databases; temporary views are in a database of no name."""

    kind = "session"

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def databases(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def tables(self, database: str) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(database)]

    def table(self, database: str, name: str) -> TableMeta | None:
        key = (database, name)
        if key not in self._tables:
            for full in (f"{database}.{name}", name):
                if self.spark.catalog.tableExists(full):
                    cols = self.spark.catalog.listColumns(full)
                    self._tables[key] = TableMeta(database, name, [ColumnMeta(c.name, c.dataType, c.nullable, c.description, i, c.isPartition) for i, c in enumerate(cols)])
                    break
        return self._tables.get(key)


class RowsCatalog(Catalog):
    """A catalog from rows of columns (see ROWS): a spreadsheet's export, CSV or Parquet.

    Grouping is a Spark aggregate; only names of databases and tables, and the columns of tables that are asked for, come
    to the driver.
    """

    kind = "rows"

    def __init__(self, rows: DataFrame):
        super().__init__()
        self.frame = rows

    def grouped(self) -> DataFrame:
        """database, table, columns (sorted by ordinal; partition columns after the others)."""
        col = F.struct(F.coalesce("is_partition", F.lit(False)).alias("is_partition"), "ordinal", F.col("column").alias("name"), "data_type", F.coalesce("nullable", F.lit(True)).alias("nullable"), F.col("column_comment").alias("comment"), F.col("default_value").alias("default"))
        return self.frame.where("database IS NOT NULL AND table IS NOT NULL").groupBy("database", "table").agg(F.sort_array(F.collect_list(F.when(F.col("column").isNotNull(), col))).alias("columns"), F.max("table_type").alias("kind"), F.max("table_comment").alias("comment"), F.max("table_owner").alias("owner"))

    def databases(self) -> list[str]:
        return [r.database for r in self.frame.where("database IS NOT NULL").select("database").distinct().orderBy("database").collect()]

    def tables(self, database: str) -> list[str]:
        return [r.table for r in self.frame.where((F.col("database") == database) & F.col("table").isNotNull()).select("table").distinct().orderBy("table").collect()]

    def table(self, database: str, name: str) -> TableMeta | None:
        if (database, name) not in self._tables:
            r = self.grouped().where((F.col("database") == database) & (F.col("table") == name)).first()
            if r is None:
                return None
            self._tables[(database, name)] = TableMeta(database, name, [ColumnMeta(c.name, c.data_type, c.nullable, c.comment, c.ordinal or 0, c.is_partition, c.default) for c in r["columns"]], r.kind or "MANAGED_TABLE", r.comment, r.owner)
        return self._tables[(database, name)]


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows (see ROWS) of a workbook's sheets, whose first rows name the columns; ``sheet`` is the sheet's own name.

    A workbook is read on the driver: its size is that of one file that people fill in.
    """
    from lakeloom.sources.workbook import sheets

    kinds = [x.split(" ") for x in ROWS.split(", ")]
    read = {"string": str, "int": lambda x: int(float(x)), "boolean": lambda x: x.strip().lower() in ("true", "1", "y", "yes", "是")}
    out = []
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        for name, rows in sheets(bytes(r.content)):
            for row in rows:
                low = {k.lower(): v for k, v in row.items()} | {"sheet": name}
                out.append(tuple(read[kind](low[c]) if c in low else None for c, kind in kinds))
    return spark.createDataFrame(out, ROWS)


def fixture() -> Catalog:
    """A small database ``ods`` of users, orders and products, for trying things out."""
    c = ColumnMeta
    return Catalog([
        TableMeta("ods", "user_table", [c("id", "BIGINT", False, "id", 0), c("name", "STRING", True, "name", 1), c("age", "INT", True, "age", 2), c("email", "STRING", True, "email", 3)], owner="owner"),
        TableMeta("ods", "order_table", [c("order_id", "BIGINT", False, "order", 0), c("user_id", "BIGINT", False, "user", 1), c("amount", "DECIMAL", True, "amount", 2), c("order_date", "DATE", True, "date", 3)], owner="owner"),
        TableMeta("ods", "product_table", [c("product_id", "BIGINT", False, "product", 0), c("product_name", "STRING", True, "name", 1), c("price", "DECIMAL", True, "price", 2)], owner="owner"),
    ])


_KINDS: dict[str, Callable[[SparkSession, Mapping[str, str]], Catalog]] = {
    "session": lambda spark, conf: SessionCatalog(spark),
    "csv": lambda spark, conf: RowsCatalog(spark.read.csv(conf["path"], header=True, schema=ROWS)),
    "parquet": lambda spark, conf: RowsCatalog(spark.read.parquet(conf["path"])),
    "rows": lambda spark, conf: RowsCatalog(spark.table(conf["table"])),
    "excel": lambda spark, conf: RowsCatalog(workbook_rows(spark, conf["path"])),
    "mock": lambda spark, conf: fixture(),
}


def connect(spark: SparkSession, kind: str, config: Mapping[str, str] | None = None) -> Catalog:
    """A catalog by kind: session, csv, parquet, excel (an .xlsx workbook), rows (a table or view of the session) or mock."""
    if kind.lower() not in _KINDS:
        raise ValueError(f"no catalog kind {kind!r}; there are {', '.join(_KINDS)}")
    return _KINDS[kind.lower()](spark, config or {})
