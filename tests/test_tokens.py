import pytest
from hypothesis import given
from hypothesis import strategies as st

from lakeloom.plans.rewrite import Context, rewrite
from lakeloom.plans.tokens import render, split_statements, tokenize

PIECES = st.sampled_from(["SELECT", " ", "\n", "a.b", "'it\\'s, LIMIT 1, 2'", '"x;y"', "-- c ^ ; LIMIT 3, 4\n", "/* DATETIME '1' */", "(", ")", ",", "1.5BD", "`q;r`", "^", "@v", "，", "12", "<=>", "${p}"])


@given(st.lists(PIECES, max_size=30))
def test_tokens_make_up_the_text(parts):
    text = "".join(parts)
    assert render(tokenize(text)) == text


@given(st.text(max_size=60))
def test_any_text_has_tokens(text):
    assert render(tokenize(text)) == text


@given(st.text(alphabet="abc,;()^ LIMIT1234", max_size=20))
def test_strings_and_comments_stay(body):
    text = f"SELECT '{body}' AS v -- {body}\nFROM t"
    assert rewrite(text) == text


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("SELECT a FROM t LIMIT 10, 5", "SELECT a FROM t LIMIT 5 OFFSET 10 "),
        ("SELECT CAST(a AS DATETIME)", "SELECT CAST(a AS TIMESTAMP)"),
        ("SELECT DATETIME '2020-01-01'", "SELECT TIMESTAMP '2020-01-01'"),
        ("SELECT 5 ^ 2 + 1", "SELECT (5 ^ 2) + 1"),
        ("SELECT a.x ^ f(b) * 2", "SELECT (a.x ^ f(b)) * 2"),
        ("SELECT week(d)", "SELECT weekofyear(d)"),
        ("SELECT trunc(d, 'MM')", "SELECT trunc(d, 'MM')"),
        ("SELECT sum(x) FILTER (WHERE p > 1) OVER (ORDER BY y)", "SELECT sum(CASE WHEN p > 1 THEN x END) OVER (ORDER BY y)"),
        ("SELECT /*+ SKEWJOIN(a(b)((1),(2))) */ 1", "SELECT   1"),
        ("SELECT x FROM a JOIN b ON a.x = b.x ON a.y > 1 WHERE z", "SELECT x FROM a JOIN b ON (a.x = b.x) AND (a.y > 1) WHERE z"),
        ("SELECT d + INTERVAL (n + 1) DAY", "SELECT d + (((n + 1)) * INTERVAL '1' DAY)"),
        ("SELECT db:f(x), ::g(y)", "SELECT f(x), g(y)"),
        ("SELECT concat（a，b）", "SELECT concat(a,b)"),
    ],
)
def test_rules(text, wanted):
    assert rewrite(text) == wanted


def test_parameters():
    assert rewrite("SELECT * FROM t_${day} WHERE a = ${v}", Context({"day": "0101", "v": 3})) == "SELECT * FROM t_0101 WHERE a = 3"


def test_statements():
    assert split_statements("SELECT ';' ; -- a; b\n SELECT 2; ;") == ["SELECT ';'", "-- a; b\n SELECT 2"]
    assert len(split_statements("BEGIN SELECT 1; IF a THEN SELECT CASE WHEN b THEN 1 END; END IF; END; SELECT 2")) == 2
