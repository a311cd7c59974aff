"""Arrays, maps, structs, lateral views, lambdas, JSON."""

from __future__ import annotations

from lakeloom.plans.registry import dialect

dialect("arr_01_lateral_view", "SELECT n_nationkey, t.w FROM nation LATERAL VIEW explode(split(n_name, '_')) t AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation")
dialect("arr_01_words", "SELECT w, count(*) AS n FROM documents LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
dialect("arr_02_lateral_outer", "SELECT n_nationkey, w FROM nation LATERAL VIEW OUTER explode(if(n_regionkey = 1, array(1, 2), array())) t AS w", "SELECT n_nationkey, w FROM nation LEFT JOIN (SELECT * FROM (VALUES (1), (2)) v(w)) ON n_regionkey = 1")
dialect("arr_03_several", "SELECT n_nationkey, a, b FROM nation LATERAL VIEW explode(array(1, 2)) x AS a LATERAL VIEW explode(array('p', 'q')) y AS b", "SELECT n_nationkey, a, b FROM nation, (VALUES (1), (2)) x(a), (VALUES ('p'), ('q')) y(b)")
dialect("arr_04_map_generator", "SELECT n_nationkey, k, v FROM nation LATERAL VIEW explode(map('r', n_regionkey, 'n', n_nationkey)) t AS k, v", "SELECT n_nationkey, 'r' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'n', n_nationkey FROM nation")
dialect("arr_04_posexplode", "SELECT n_nationkey, p, w FROM nation LATERAL VIEW posexplode(split(n_name, '_')) t AS p, w", "SELECT n_nationkey, CAST(p - 1 AS INTEGER) AS p, w FROM (SELECT n_nationkey, generate_subscripts(string_split(n_name, '_'), 1) AS p, unnest(string_split(n_name, '_')) AS w FROM nation)")
dialect("arr_04_inline", "SELECT a, b FROM nation LATERAL VIEW inline(array(struct(n_nationkey, n_name))) t AS a, b", "SELECT n_nationkey AS a, n_name AS b FROM nation")
dialect("arr_05_no_from", "SELECT w FROM (SELECT 1) LATERAL VIEW explode(array(3, 4)) t AS w", "SELECT unnest([3, 4]) AS w")
dialect("arr_06_index", "SELECT vec_id, round(embedding[0], 5) AS e, map('a', label)['a'] AS m FROM embeddings", "SELECT vec_id, CAST(round(embedding[1], 5) AS FLOAT) AS e, label AS m FROM embeddings")
dialect("arr_07_struct_member", "SELECT s.k AS k, s.n.name AS name FROM (SELECT named_struct('k', n_nationkey, 'n', named_struct('name', n_name)) AS s FROM nation) t", "SELECT n_nationkey AS k, n_name AS name FROM nation")
dialect("arr_08_method_call", "SELECT n_nationkey, n_name.length() AS l, n_name.substr(2, 3).lower() AS s FROM nation", "SELECT n_nationkey, CAST(length(n_name) AS INTEGER) AS l, lower(substr(n_name, 2, 3)) AS s FROM nation")
dialect("arr_09_constructors", "SELECT n_nationkey, array(n_regionkey, 1)[0] AS a, map('x', n_name)['x'] AS m, struct(n_name, n_regionkey).n_regionkey AS s FROM nation", "SELECT n_nationkey, n_regionkey AS a, n_name AS m, n_regionkey AS s FROM nation")
dialect("arr_10_lambdas", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x * x AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS norm, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x * x AS FLOAT) AS DOUBLE))), 4) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos FROM embeddings")
dialect("arr_10_function_argument", "SELECT n_nationkey, transform(array(1, 2), FUNCTION(@x) AS @x + n_regionkey)[1] AS v FROM nation", "SELECT n_nationkey, 2 + n_regionkey AS v FROM nation")
dialect("arr_11_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS j FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS j FROM events")
dialect("src_20_lateral_view_source", "SELECT c.c_custkey, t.part FROM customer c LATERAL VIEW explode(split(c.c_name, '#')) t AS part WHERE c.c_acctbal > 9000", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer WHERE c_acctbal > 9000")
