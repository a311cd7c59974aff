"""License scans: digests of canonical texts, hash-joined to known licences.

Canonical: A-Z lower-cased, copyright lines taken out, spellings that license texts treat as equal made one, all else but
letters, digits and characters outside ASCII made one space. Whole texts are compared, and each line of a text for the short notices that stand in for
a licence. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.license_texts import NOTICES, TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of copyright holders, and pairs of equal spellings (of canonical words).
COPYRIGHT = r"(?md)^[ \t/*#;>-]*(copyright\b.*|\(c\).*|©.*|all rights reserved\.?[ \t]*)$"
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("noninfringement", "non infringement"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorisation", "authorization"), ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("judgement", "judgment"), ("analogue", "analog"), ("centre", "center"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("wilful", "willful"),
]


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    x = F.translate(text, _UPPER, _LOWER)
    x = F.regexp_replace(x, COPYRIGHT, " ")
    x = F.trim(F.regexp_replace(x, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that has one, from one pass over the whole text."""
    x = F.translate(text, _UPPER, _LOWER)
    x = F.regexp_replace(x, COPYRIGHT, " ")
    x = F.regexp_replace(x, r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")
    # each line has spaces of its own around it and around what separates words
    x = F.concat(F.lit(" "), F.replace(x, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    x = F.regexp_replace(x, " {2,}", " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(digest, license, whole) of known licences: whole texts, and one-line notices."""
    rows = [(k, v, True) for k, v in (TEXTS if texts is None else texts).items()] + [(k, v, False) for k, v in (NOTICES if notices is None else notices).items()]
    made = spark.createDataFrame(rows, "name string, text string, whole boolean").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), F.split("name", "#")[0].alias("license"), "whole")
    return made.groupBy("digest", "whole").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, most_literals: int = 1000, most_broadcast: int = 100_000) -> DataFrame:
    """doc_id, digest (of the canonical text), license (that of the whole text, or null), notices (sorted licences that
    single lines name), n_lines (lines that are such notices), one row per row of ``docs``.

    Texts that are null, empty or empty in canonical form have digest null, no licence and no notices. Rows are scanned one by one, so
    repeated rows and null ids are rows like others; other columns are ignored, and texts count whole. A digest of several
    licences is that of the first by name. Known whole texts and known notices, each by its own count, are joined by broadcast
    up to ``most_broadcast`` rows, else by shuffle; up to ``most_literals`` notices are looked up in the expression itself. The result
    is the same.
    """
    known = known.groupBy("digest", "whole").agg(F.min("license").alias("license"))
    sizes = {r["whole"]: r["count"] for r in known.groupBy("whole").count().collect()}
    near = lambda x, whole: F.broadcast(x) if sizes.get(whole, 0) <= most_broadcast else x
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("canon", canonical(F.col("text")))
    text = text.select("doc_id", F.when(F.length("canon") > 0, F.sha2("canon", 256)).alias("digest"), F.transform(canonical_lines(F.col("text")), lambda x: F.sha2(x, 256)).alias("lines"))
    whole = text.join(near(known.where("whole").select("digest", "license"), True), "digest", "left")
    notices = known.where("NOT whole").select("digest", "license")
    if sizes.get(False, 0) <= most_literals:
        pairs = [F.lit(x) for r in sorted(notices.collect()) for x in (r.digest, r.license)]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        hit = F.filter(F.transform("lines", lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
        out = whole.withColumn("hit", F.coalesce(hit, F.array().cast("array<string>")))
    else:
        rows = whole.withColumn("row", F.monotonically_increasing_id())
        named = rows.select("row", F.explode("lines").alias("digest")).join(near(notices.withColumnRenamed("license", "notice"), False), "digest")
        named = named.groupBy("row").agg(F.collect_list("notice").alias("hit"))
        out = rows.join(named, "row", "left").withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))
    return out.select("doc_id", "digest", "license", F.array_sort(F.array_distinct("hit")).alias("notices"), F.size("hit").cast("long").alias("n_lines"))
