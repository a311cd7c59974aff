"""Scalar functions, operators and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans.engine import Engine
from lakeloom.plans.registry import dialect, register

# name: (expression over part p, DuckDB's expression where it differs)
_STRINGS = {
    "str_01_substring": ("substring(p_name, 2, 5)", None),
    "str_02_substr": ("substr(p_name, -4)", "right(p_name, 4)"),
    "str_03_concat": ("concat(p_name, '-', p_brand)", "p_name || '-' || p_brand"),
    "str_04_upper": ("upper(p_name)", None),
    "str_05_lower": ("lower(p_brand)", None),
    "str_06_trim": ("trim(concat('  ', p_name, ' '))", "trim('  ' || p_name || ' ')"),
    "str_07_ltrim": ("ltrim(concat('  ', p_name))", "ltrim('  ' || p_name)"),
    "str_08_rtrim": ("rtrim(concat(p_name, '  '))", "rtrim(p_name || '  ')"),
    "str_09_replace": ("replace(p_type, 'A', '*')", None),
    "str_10_length": ("length(p_name)", "CAST(length(p_name) AS INTEGER)"),
    "str_11_char_length": ("char_length(p_name)", "CAST(length(p_name) AS INTEGER)"),
    "str_12_position": ("position('a' IN p_name)", "CAST(strpos(p_name, 'a') AS INTEGER)"),
    "str_13_locate": ("locate('r', p_name)", "CAST(strpos(p_name, 'r') AS INTEGER)"),
    "str_14_instr": ("instr(p_name, 't')", "CAST(strpos(p_name, 't') AS INTEGER)"),
    "str_15_lpad": ("lpad(p_brand, 12, '.')", None),
    "str_16_rpad": ("rpad(p_brand, 12, '.')", None),
    "str_17_reverse": ("reverse(p_name)", None),
    "str_18_split": ("split(p_type, ' ')[0]", "string_split(p_type, ' ')[1]"),
    "str_19_substring_from": ("substring(p_name FROM 3 FOR 4)", "substring(p_name, 3, 4)"),
    "str_20_concat_operator": ("p_name || '/' || p_type", None),
}
for _k, (_a, _b) in _STRINGS.items():
    dialect(_k, f"SELECT p_partkey, {_a} AS v FROM part", f"SELECT p_partkey, {_b or _a} AS v FROM part")

_X = "(p_retailprice - 1200)"
_MATHS = {
    "mth_01_abs": (f"abs({_X})", None),
    "mth_02_round": (f"round({_X} / 7, 2)", None),
    "mth_03_floor": (f"floor({_X})", f"CAST(floor({_X}) AS BIGINT)"),
    "mth_04_ceil": (f"ceil({_X})", f"CAST(ceil({_X}) AS BIGINT)"),
    "mth_05_ceiling": (f"ceiling({_X} / 3)", f"CAST(ceiling({_X} / 3) AS BIGINT)"),
    "mth_06_power": ("power(p_size, 2)", "CAST(power(p_size, 2) AS DOUBLE)"),
    "mth_07_sqrt": ("round(sqrt(p_retailprice), 6)", None),
    "mth_08_exp": ("round(exp(p_size / 50), 6)", None),
    "mth_09_log": ("round(log(2, p_size), 6)", None),
    "mth_10_ln": ("round(ln(p_retailprice), 6)", None),
    "mth_11_mod": ("mod(p_partkey, 7)", None),
    "mth_12_sign": (f"sign({_X})", f"CAST(sign({_X}) AS DOUBLE)"),
    "mth_15_truncate": ("round(truncate(p_retailprice / 7, 2), 4)", "round(sign(p_retailprice / 7) * floor(abs(p_retailprice / 7) * 100) / 100, 4)"),
    "mth_16_trunc_number": (f"round(trunc({_X} / 7, 1), 4)", f"round(sign({_X} / 7) * floor(abs({_X} / 7) * 10) / 10, 4)"),
}
for _k, (_a, _b) in _MATHS.items():
    dialect(_k, f"SELECT p_partkey, {_a} AS v FROM part", f"SELECT p_partkey, {_b or _a} AS v FROM part")
dialect("mth_13_rand", "SELECT count(*) AS n FROM part WHERE rand(7) >= 0 AND rand(8) < 1", "SELECT count(*) AS n FROM part")
dialect("mth_14_random", "SELECT count(*) AS n FROM part WHERE random() BETWEEN 0 AND 1", "SELECT count(*) AS n FROM part")

_D = "o_orderdate"
_DATES = {
    "dat_01_date_format": (f"date_format({_D}, 'yyyy-MM-dd')", f"strftime({_D}, '%Y-%m-%d')"),
    "dat_02_year": (f"year({_D})", f"CAST(year({_D}) AS INTEGER)"),
    "dat_03_month": (f"month({_D})", f"CAST(month({_D}) AS INTEGER)"),
    "dat_04_day": (f"day({_D})", f"CAST(day({_D}) AS INTEGER)"),
    "dat_08_week": (f"week({_D})", f"CAST(weekofyear({_D}) AS INTEGER)"),
    "dat_09_quarter": (f"quarter({_D})", f"CAST(quarter({_D}) AS INTEGER)"),
    "dat_14_date_add": (f"date_add({_D}, 10)", f"CAST({_D} AS DATE) + 10"),
    "dat_15_date_sub": (f"date_sub({_D}, 10)", f"CAST({_D} AS DATE) - 10"),
    "dat_16_datediff": (f"datediff({_D}, DATE '1995-01-01')", f"CAST(date_diff('day', DATE '1995-01-01', CAST({_D} AS DATE)) AS INTEGER)"),
    "dat_17_to_date": (f"to_date({_D})", f"CAST({_D} AS DATE)"),
    "dat_19_unix_timestamp": (f"unix_timestamp({_D})", f"CAST(epoch({_D}) AS BIGINT)"),
    "dat_20_extract": (f"extract(YEAR FROM {_D}) * 100 + extract(MONTHS FROM {_D})", f"CAST(year({_D}) * 100 + month({_D}) AS INTEGER)"),
    "mth_16_trunc_date": (f"trunc({_D}, 'MM')", f"CAST(date_trunc('month', {_D}) AS DATE)"),
}
for _k, (_a, _b) in _DATES.items():
    dialect(_k, f"SELECT o_orderkey, {_a} AS v FROM orders", f"SELECT o_orderkey, {_b or _a} AS v FROM orders")
for _k, _f in (("dat_05_hour", "hour"), ("dat_06_minute", "minute"), ("dat_07_second", "second")):
    dialect(_k, f"SELECT event_id, {_f}(ts) AS v FROM events", f"SELECT event_id, CAST({_f}(ts) AS INTEGER) AS v FROM events")
dialect("dat_10_now", "SELECT count(*) AS n FROM nation WHERE now() > TIMESTAMP '2020-01-01 00:00:00'")
dialect("dat_11_current_date", "SELECT count(*) AS n FROM nation WHERE current_date() > DATE '2020-01-01' AND current_date > DATE '2020-01-01'", "SELECT count(*) AS n FROM nation")
dialect("dat_12_current_time", "SELECT count(current_time()) AS n FROM nation", "SELECT count(*) AS n FROM nation")
dialect("dat_13_current_timestamp", "SELECT count(*) AS n FROM nation WHERE current_timestamp() > TIMESTAMP '2020-01-01 00:00:00' AND current_timestamp > TIMESTAMP '2020-01-01 00:00:00'", "SELECT count(*) AS n FROM nation")
dialect("dat_18_from_unixtime", "SELECT event_id, from_unixtime(unix_timestamp(ts)) AS v FROM events", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS v FROM events")

dialect("cst_01_cast", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS a, CAST(o_orderkey AS STRING) AS b, CAST(o_orderdate AS DATE) AS c FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(o_orderkey AS VARCHAR) AS b, CAST(o_orderdate AS DATE) AS c FROM orders")
dialect("cst_01_cast_datetime", "SELECT event_id, CAST(ts AS DATETIME) AS v FROM events", "SELECT event_id, ts AS v FROM events")
dialect("cst_02_convert", "SELECT p_partkey, convert(p_size, STRING) AS v FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v FROM part")
dialect("cst_03_to_number", "SELECT round(CAST(to_number('12.5') AS DOUBLE), 4) AS a, CAST(to_number('1,234', '9,999') AS INT) AS b", "SELECT CAST(12.5 AS DOUBLE) AS a, 1234 AS b")
dialect("cst_04_to_string", "SELECT n_nationkey, to_string(n_regionkey) AS v FROM nation", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS v FROM nation")
dialect("cst_05_to_date", "SELECT o_orderkey, to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS v FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS v FROM orders")
dialect("cst_06_to_char", "SELECT n_nationkey, to_char(n_nationkey, '099') AS v FROM nation", "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS v FROM nation")
dialect("cnd_01_if", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS v FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS v FROM part")
dialect("cnd_02_case_value", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS v FROM orders")
dialect("cnd_03_case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS v FROM orders")
dialect("cnd_04_coalesce", "SELECT p_partkey, coalesce(nullif(p_size, 5), -1) AS v FROM part")
dialect("cnd_05_nullif", "SELECT count(nullif(p_brand, 'Brand#11')) AS n FROM part")
dialect("cnd_06_ifnull", "SELECT p_partkey, ifnull(nullif(p_size, 7), 0) AS v FROM part")
dialect("cnd_07_nvl", "SELECT p_partkey, nvl(nullif(p_size, 7), 0) AS v FROM part", "SELECT p_partkey, coalesce(nullif(p_size, 7), 0) AS v FROM part")
dialect("cnd_08_decode", "SELECT o_orderkey, decode(o_orderstatus, 'F', 1, 'O', 2, 0) AS v FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS v FROM orders")
dialect("oth_01_other", "SELECT p_partkey, md5(p_name) AS m, crc32(p_name) % 2 >= 0 AS c, greatest(p_size, 10) AS g FROM part", "SELECT p_partkey, md5(p_name) AS m, true AS c, greatest(p_size, 10) AS g FROM part")
dialect("oth_01_qualified", "SELECT p_partkey, default:upper(p_brand) AS u, ::lower(p_brand) AS l FROM part", "SELECT p_partkey, upper(p_brand) AS u, lower(p_brand) AS l FROM part")

dialect("opr_01_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, round(p_size / 4, 4) AS d FROM part")
dialect("opr_02_mod_div", "SELECT p_partkey, p_size % 7 AS m, p_partkey DIV 7 AS d FROM part", "SELECT p_partkey, p_size % 7 AS m, p_partkey // 7 AS d FROM part")
dialect("opr_03_bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, p_size ^ 2 + 1 AS x, ~p_size AS n FROM part", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, xor(p_size, 2) + 1 AS x, ~p_size AS n FROM part")
dialect("opr_04_unary", "SELECT p_partkey, -p_size AS a, +p_size AS b, - -p_size AS c FROM part")
dialect("opr_05_precedence", "SELECT p_partkey, 1 + 2 * p_size - 4 % 3 AS v, NOT p_size > 3 AND p_size < 10 OR p_size = 40 AS b FROM part")
dialect("lit_01_numbers", "SELECT 1 AS i, CAST(1.5 AS DOUBLE) AS d, CAST(2e3 AS DOUBLE) AS e", "SELECT 1 AS i, CAST(1.5 AS DOUBLE) AS d, CAST(2e3 AS DOUBLE) AS e")
dialect("lit_02_typed_numbers", "SELECT 1L AS l, 2S AS s, 3Y AS t, CAST(1.5BD AS DOUBLE) AS b", "SELECT CAST(1 AS BIGINT) AS l, CAST(2 AS SMALLINT) AS s, CAST(3 AS TINYINT) AS t, CAST(1.5 AS DOUBLE) AS b")
dialect("lit_03_strings", "SELECT 'it\\'s' AS a, \"two\" AS b, 'a' 'b' AS c", "SELECT 'it''s' AS a, 'two' AS b, 'ab' AS c")
dialect("lit_04_charset_strings", "SELECT _utf8'abc' AS a, length(_x 0x4142) AS n", "SELECT 'abc' AS a, 2 AS n")
dialect("lit_05_dates", "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 12:30:00' AS t", "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 12:30:00' AS t")
dialect("lit_06_datetime", "SELECT DATETIME '2024-02-29 12:30:00' AS t", "SELECT TIMESTAMP '2024-02-29 12:30:00' AS t")
dialect("lit_07_localtimestamp", "SELECT LOCALTIMESTAMP > TIMESTAMP_NTZ '2020-01-01 00:00:00' AS later", "SELECT true AS later")
dialect("lit_08_intervals", "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS a, o_orderdate - INTERVAL '2' MONTH AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b FROM orders")
dialect("lit_09_interval_expression", "SELECT p.p_partkey, DATE '2024-01-01' + INTERVAL (p.p_size + 1) DAY AS v FROM part p", "SELECT p_partkey, CAST(DATE '2024-01-01' + (p_size + 1) AS TIMESTAMP) AS v FROM part")
dialect("lit_10_booleans_null", "SELECT TRUE AS t, FALSE AS f, CAST(NULL AS INT) AS n")
dialect("lit_11_full_width", "SELECT concat（n_name，'，'） AS v FROM nation", "SELECT n_name || '，' AS v FROM nation")


@register("lit_12_parameters", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("SELECT count(*) AS n FROM ${table} WHERE o_orderstatus = '${unused}' OR o_orderstatus = ${status}", {"table": "orders", "status": "'F'"})
