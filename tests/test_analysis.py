import pytest

from lakeloom.plans import lineage as lin
from lakeloom.plans import metadata as meta
from lakeloom.plans import report
from lakeloom.sources import catalog


@pytest.mark.parametrize("sql", [None, "", "   "])
def test_lineage_wants_a_query(spark, sql):
    with pytest.raises(ValueError):
        lin.lineage(spark, sql, catalog.fixture())


def test_metadata_of_nothing(spark):
    with pytest.raises(TypeError):
        meta.extract(spark, None)
    assert meta.extract(spark, " ").errors == [(1, 0, "empty statement")]


@pytest.mark.parametrize("kind, wanted", [("LEFT JOIN", "LEFT"), ("INNER JOIN", "INNER"), ("RIGHT JOIN", "RIGHT"), ("FULL OUTER JOIN", "FULL"), ("CROSS JOIN", "CROSS"), ("LEFT SEMI JOIN", "LEFT SEMI")])
def test_join_types(spark, kind, wanted):
    on = "" if kind == "CROSS JOIN" else " ON a.x = b.x"
    assert meta.extract(spark, f"SELECT 1 FROM a {kind} b{on}").records("joins")[0]["join_type"] == wanted


@pytest.mark.parametrize("sql", ["SELECT x FROM t LIMIT 10, 20", "SELECT x FROM t LIMIT 20 OFFSET 10"])
def test_limits(spark, sql):
    m = meta.extract(spark, sql).records("limits")[0]
    assert (m["offset"], m["row_count"]) == (10, 20)


def test_every_section_makes_a_frame(spark):
    m = meta.extract(spark, "SELECT DISTINCT a FROM x LATERAL VIEW explode(y) t AS b WHERE a IN (SELECT c FROM z)")
    frames = m.frames(spark, "q1")
    assert set(frames) == set(meta.SCHEMAS)
    assert all(f.columns[0] == "query_id" for f in frames.values())
    assert frames["flags"].count() == 1
    assert {r.qualified_name for r in frames["tables"].collect()} == {"x", "z"}


def test_conjuncts_give_pairs(spark):
    j = meta.extract(spark, "SELECT 1 FROM a JOIN b ON a.x = b.x AND a.y >= b.y AND a.z > 3").records("joins")[0]
    assert [(p["left"], p["op"], p["right"]) for p in j["pairs"]] == [("a.x", "=", "b.x"), ("a.y", ">=", "b.y")]


def test_deep_nesting(spark):
    sql = "SELECT v FROM (SELECT k + 1 AS v FROM (SELECT id * 2 AS k FROM ods.user_table) a) b"
    found = lin.lineage(spark, sql, catalog.fixture())
    assert found.sources == [[("ods.user_table", "id")]]
    assert {c.name for c, _ in found.steps} == {"k"}


def test_case_and_cast_keep_sources(spark):
    found = lin.lineage(spark, "SELECT CASE WHEN age > 1 THEN CAST(name AS STRING) ELSE email END AS v FROM ods.user_table", catalog.fixture())
    assert {c for _, c in found.sources[0]} == {"age", "name", "email"}


def test_answers(spark):
    assert report.answer(spark, "/api/lineage/tables", {"connectorType": "mock"})["statusCode"] == 400
    assert report.answer(spark, "/api/lineage/tables", {"sql": "SELECT 1", "connectorType": "none"})["statusCode"] == 400
    assert report.answer(spark, "/api/lineage/tables", {"sql": "SELECT (", "connectorType": "mock"})["statusCode"] == 500


def test_format_keeps_meaning(spark, data):
    from lakeloom.plans.engine import Engine

    sql = "select n_name,count(*) as n from nation left join region on n_regionkey = r_regionkey where n_name like '%1 from%' or n_nationkey in (1,2) group by n_name order by n_name limit 5"
    e = Engine(spark, data)
    assert e.sql(sql).collect() == e.sql(report.format_sql(sql)).collect()
