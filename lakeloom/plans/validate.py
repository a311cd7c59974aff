"""Checks of a query against a catalog: tables and columns that are not there, conflicts of a bare star, types of join keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.lineage import lineage
from lakeloom.plans.metadata import Metadata, extract
from lakeloom.sources.catalog import Catalog

SCHEMA = "type string, message string, line int, column int"


def star_conflicts(spark: SparkSession, meta: Metadata, catalog: Catalog) -> DataFrame:
    """Columns that several tables under a bare ``*`` share: (column, tables)."""
    tables = [t["qualified_name"] for t in meta.records("tables") if t["scope"] == "" and t["kind"] == "table"]
    star = any(f["scope"] == "" and f["expression"] == "*" for f in meta.records("fields"))
    rows = [(t, c.name) for t in dict.fromkeys(tables) for c in catalog.columns(t)] if star and len(tables) > 1 else []
    each = spark.createDataFrame(rows, "table string, column string")
    return each.groupBy("column").agg(F.sort_array(F.collect_set("table")).alias("tables")).where(F.size("tables") > 1).orderBy("column")


def validate(spark: SparkSession, sql: str, catalog: Catalog) -> DataFrame:
    """Errors as rows (type, message, line, column); a valid query has none."""
    meta = extract(spark, sql)
    out = [("SYNTAX_ERROR", m, line, col) for line, col, m in meta.errors]
    if not out:
        ctes = {c["name"].lower() for c in meta.records("ctes")}
        names = [t["qualified_name"] for t in meta.records("tables") if t["kind"] == "table" and t["qualified_name"].lower() not in ctes]
        missing = [n for n in dict.fromkeys(names) if catalog.resolve(n) is None]
        out += [("TABLE_NOT_FOUND", f"table {n} is not in the catalog", 0, 0) for n in missing]
        shared = [r["column"] for r in star_conflicts(spark, meta, catalog).collect()]
        if shared:
            out.append(("COLUMN_CONFLICT", "several tables under * have " + ", ".join(shared), 0, 0))
        if not missing:
            try:
                lineage(spark, sql, catalog)
            except AnalysisException as e:
                kind = {"UNRESOLVED_COLUMN": "COLUMN_NOT_FOUND", "DATATYPE_MISMATCH": "TYPE_MISMATCH", "AMBIGUOUS_REFERENCE": "AMBIGUOUS_COLUMN"}
                cond = (e.getCondition() or "").split(".")[0]
                out.append((kind.get(cond, cond or "ANALYSIS_ERROR"), str(e).split("\n")[0][:300], 0, 0))
            else:
                out += _join_types(meta, catalog)
    return spark.createDataFrame(out, SCHEMA)


def _join_types(meta: Metadata, catalog: Catalog) -> list[tuple]:
    """Pairs of join keys of which one is a number and the other is text."""
    where = {(t["alias"] or t["name"]): t["qualified_name"] for t in meta.records("tables") if t["kind"] == "table"}
    family = lambda t: "text" if t.upper().split("(")[0] in ("STRING", "VARCHAR", "CHAR") else "number" if t.upper().split("(")[0] in ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL") else t.upper()
    out = []
    for j in meta.records("joins"):
        for p in j["pairs"]:
            kinds = []
            for side in (p["left"], p["right"]):
                owner, _, column = side.rpartition(".")
                kinds += [c.data_type for c in catalog.columns(where.get(owner, owner)) if c.name == column]
            if len(kinds) == 2 and family(kinds[0]) != family(kinds[1]):
                out.append(("TYPE_MISMATCH", f"{p['left']} is {kinds[0]}, {p['right']} is {kinds[1]}", 0, 0))
    return out
