"""The registered queries of this subpackage, and the DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontam, htmlblocks, langid, lattice, license, lines, minhash, packing, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (its source in place of a host) and every page."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), none.alias("html"), none.alias("url"), F.col("source").alias("host"))
    rows = rows.unionByName(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), none.alias("text"), "html", "url", none.alias("host")))
    found = langid.identify(spark, rows, langid.train(docs))
    number = F.expr("cast(substr(key, 2) AS bigint)")
    return found.select(F.when(F.col("key").startswith("d"), number).alias("doc_id"), F.when(F.col("key").startswith("p"), number).alias("page_id"), "lang", "confidence", "declared", "host")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=4)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(spark, _table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lines.digests(docs, lines.keep_bitmaps(spark, docs, min_docs=10))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(spark, _table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(spark, docs, toxicity.train(spark, docs, _table(spark, sf_dir, "labels")), hits=False)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(_table(spark, sf_dir, "documents"), license.known_digests(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.extract(spark, _table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_minhash": op2_minhash,
    "op3_suffix": op3_suffix,
    "op4_lines": op4_lines,
    "op5_lattice": op5_lattice,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_decontam": op8_decontam,
    "op9_license": op9_license,
    "op10_html": op10_html,
}

#: a document's words, as op2 takes them
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: and as op8 does
_PLAIN = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

def _canonical_sql(text: str) -> str:
    x = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = f"regexp_replace({x}, '{license.COPYRIGHT.replace('(?md)', '(?m)')}', ' ', 'g')"
    x = rf"' ' || trim(regexp_replace({x}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) || ' '"
    for a, b in license.SPELLINGS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"trim({x})"


def _known_sql() -> str:
    from lakeloom.llm.license_texts import NOTICES, TEXTS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k.split('#')[0])}, {quoted(v)}, {whole})" for table, whole in ((TEXTS, "true"), (NOTICES, "false")) for k, v in table.items())


ORACLE: dict[str, str] = {
    "op2_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_lines": r"""
WITH l AS (SELECT doc_id, pos, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(bad.k) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON bad.k = l.k GROUP BY l.doc_id""",
    "op8_decontam": rf"""
WITH w AS (SELECT true AS item, item_id AS id, {_PLAIN} AS ws FROM benchmark UNION ALL SELECT false, doc_id, {_PLAIN} FROM documents),
s AS (
  SELECT DISTINCT item, id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT item, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT id, count(*) AS n_item FROM s WHERE item GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s b JOIN s d ON d.g = b.g AND b.item AND NOT d.item GROUP BY 1, 2)
SELECT p.doc_id, p.item_id, n.n_item, p.n_shared, p.n_shared / n.n_item AS containment
FROM p JOIN n ON n.id = p.item_id WHERE 100 * p.n_shared >= 80 * n.n_item""",
    "op5_lattice": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT k.a AS vec_id, coalesce(n.n_links, 0) AS n_links, k.component_id, k.a = k.component_id AS kept FROM k LEFT JOIN n ON n.a = k.a""",
    "op9_license": rf"""
WITH k AS (SELECT sha256({_canonical_sql("text")}) AS digest, whole, min(license) AS license FROM (VALUES {_known_sql()}) v(license, text, whole) GROUP BY 1, 2),
d AS (SELECT doc_id, text, {_canonical_sql("text")} AS c FROM documents),
g AS (SELECT doc_id, text, CASE WHEN length(c) > 0 THEN sha256(c) END AS digest FROM d),
l AS (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT l.doc_id, array_to_string(list_sort(list_distinct(list(k.license))), ',') AS notices, count(*) AS n_lines FROM l JOIN k ON k.digest = l.digest AND NOT k.whole GROUP BY 1)
SELECT g.doc_id, g.digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_lines, 0) AS n_lines
FROM g LEFT JOIN k ON k.digest = g.digest AND k.whole LEFT JOIN n ON n.doc_id = g.doc_id""",
}
