import re

from lakeloom.llm import license
from lakeloom.llm.license_texts import TEXTS
from tests.llm.util import DOCS


def scan(spark, rows, **known):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return license.scan(df, license.known_digests(spark, **known))


def test_spelling_case_and_holders_make_no_difference(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + TEXTS["MIT"]
    other = "© 1999 X\n" + TEXTS["MIT"].upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence")
    got = {r.doc_id: r for r in scan(spark, [(1, mit), (2, other), (3, TEXTS["MIT"] + " and more"), (4, TEXTS["Zlib"])]).collect()}
    assert [got[i].license for i in (1, 2, 3, 4)] == ["MIT", "MIT", None, "Zlib"]
    assert got[1].digest == got[2].digest


def test_notices(spark):
    got = scan(spark, [(1, "words\nReleased under the  MIT licence.\nLicensed under CC BY-NC 4.0\nreleased under the mit license")]).first()
    assert (got.license, got.notices, got.n_lines) == (None, ["CC-BY-NC-4.0", "MIT"], 3)


def test_known_tables_of_any_size(spark):
    """Up to a thousand as an expression, more as a broadcast."""
    many = {f"L{i}": f"licensed under no {i}" for i in range(1500)}
    for notices in ({"MIT": "Released under the MIT License."}, many | {"MIT": "Released under the MIT License."}):
        got = scan(spark, [(1, "Released under the MIT License.\nx"), (2, None), (2, ""), (None, "?!")], notices=notices, texts={}).collect()
        assert sorted((r.doc_id or -1, ",".join(r.notices), r.n_lines, r.digest is None) for r in got) == [(-1, "", 0, True), (1, "MIT", 1, False), (2, "", 0, True), (2, "", 0, True)]


def test_plans_of_any_size_and_awkward_rows(spark):
    """As literals, by broadcast and by shuffle; columns of clashing names, very long texts, digests of two names."""
    known = license.known_digests(spark, {"B": "One licence text", "A": "one license TEXT"}, {"N": "a notice of one line"})
    long = "kind words of no licence\n" * 100_000
    rows = [(1, "One license: text", "x", 1, "y"), (2, long + "A notice of one line", "x", 1, "y"), (2, long, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, row int, license string")
    for sizes in ({}, {"most_literals": 0}, {"most_literals": 0, "most_broadcast": 0}):
        got = sorted((r.doc_id or -1, r.license or "", r.notices, r.n_lines) for r in license.scan(df, known, **sizes).collect())
        assert got == [(-1, "", [], 0), (1, "A", [], 0), (2, "", [], 0), (2, "", ["N"], 1)]


def test_empty_table(spark):
    assert scan(spark, []).count() == 0


def test_notices_of_any_words_and_spelling(spark):
    known = {"CC0-1.0": "Dedicated to the public domain under CC0 1.0.", "X": "Free for all, favour us"}
    text = "a\nDedicated to the public-domain under CC0 1.0.\n\tdedicated to the PUBLIC  domain under cc0 1.0\n\n* free for all: favor us\nFree for all\nfavour us"
    got = scan(spark, [(1, text)], texts={}, notices=known).first()
    assert (got.notices, got.n_lines) == (["CC0-1.0", "X"], 3)


def test_lines_at_once_are_as_lines_apart(spark):
    from pyspark.sql import functions as F

    texts = ["", "\n\n", "a\nb", "sub licence\nsub\nlicense per cent per\ncent", "x licence licence y\n  (c) 2020 z\nCopyright q\r\nall rights reserved.\nwilful  É\tpublic-domain\n!\n©", "\ncopyright holder\x0bcopyright\rholder\u2028x"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    apart = F.filter(F.transform(F.split("text", "\n"), license.canonical), lambda x: x != "")
    for r in df.select("text", license.canonical_lines(F.col("text")).alias("got"), apart.alias("want")).collect():
        assert r.got == r.want


def test_every_known_text_in_altered_spelling(spark):
    """Upper case, other punctuation and spaces, copyright lines and British spelling make no difference; another word does."""
    assert {k.split("#")[0] for k in TEXTS if k.endswith("#full")} == {"Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"}

    def altered(text):
        text = re.sub(r"\b([Ll]icen)s(e|es|ed)\b", r"\1c\2", text)
        for a, b in (("organization", "organisation"), ("authorized", "authorised"), (",", " ;"), ('"', "''"), (" the ", "  the\t"), (".\n", "!!\n")):
            text = text.replace(a, b)
        return "Copyright (c) 2020 Someone Else\n© 2021\nAll rights reserved.\n\n" + text.upper()

    names, rows = sorted(TEXTS), []
    for k, name in enumerate(names):
        rows += [(2 * k, altered(TEXTS[name])), (2 * k + 1, TEXTS[name] + "\nand one more condition")]
    got = {r.doc_id: r.license for r in scan(spark, rows).collect()}
    for k, name in enumerate(names):
        assert (got[2 * k], got[2 * k + 1]) == (name.split("#")[0], None)
