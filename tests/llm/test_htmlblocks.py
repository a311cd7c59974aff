import html
import re

import numpy as np

from lakeloom.llm import htmlblocks as hb
from lakeloom.llm import train_blocks as tb

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-consent"><p>We use cookies.</p></div><article><h1>Big &amp; small</h1><p>One  &lt;b&gt;
two&#33;<br>three <i>four</i></p><p>Unclosed paragraph <b>here.<p>Last &copy; one.</article>
<aside class="sidebar"><p>Related things</p></aside><section id="comments"><p>Nice post, said a reader.</p></section>
<form><label>Mail</label><input></form><footer>All rights reserved</footer><script>var t = "</p>"; if (a < b) {}</script></body></html>"""


def test_a_page():
    assert hb.main_texts([PAGE], hb.BiLSTM.load()) == ["Big & small\nOne <b> two! three four\nUnclosed paragraph here.\nLast © one."]


def test_awkward_pages():
    net = hb.BiLSTM.load()
    pages = ["", "no markup at all", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<p>" * 500, "<a title='>'>x</a>", "\x00<p>\x00</p>"]
    assert len(hb.main_texts(pages, net)) == len(pages)
    assert hb.main_texts(["", "<div></div>"], net) == ["", ""]


def test_the_papers_of_the_test_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    clean = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
    for r, got in zip(rows, hb.main_texts([r.html for r in rows], hb.BiLSTM.load())):
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got == "\n".join(x for x in map(clean, re.split(r"</?(?:p|h1)>", inside)) if x)


def test_held_out_accuracy():
    assert tb.accuracy(hb.BiLSTM.load(), pages=200, seed=1234) > 0.99


def test_gradients():
    x, y = tb.labelled(3, 8)
    t = max(map(len, x))
    a, mask, b = np.zeros((3, t, hb.WIDTH), np.float32), np.zeros((3, t), np.float32), np.zeros((3, t), np.float32)
    for r in range(3):
        a[r, : len(x[r])], mask[r, : len(x[r])], b[r, : len(x[r])] = x[r], 1, y[r]
    net = hb.BiLSTM(4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, g = tb.gradients(net, a, mask, b)
    for name, at in (("xf", (140, 3)), ("hb", (1, 5)), ("cf", (2,)), ("o", (6,))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-2
        up = tb.gradients(net, a, mask, b)[0]
        net.w[name][at] = old - 1e-2
        down = tb.gradients(net, a, mask, b)[0]
        net.w[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-3 + 0.05 * abs(g[name][at])


def test_batches_make_no_difference():
    net = hb.BiLSTM.load()
    x, _ = tb.labelled(20, 77)
    one = [net.chances([v])[0] for v in x]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one, net.chances(x, batch=7)))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or -1, r.n_chars == len(r.text), r.text[:3]) for r in hb.extract(spark, df).collect())
    assert got == [(-1, True, ""), (1, True, "Big"), (1, True, "Big")]
    assert hb.extract(spark, df.limit(0)).count() == 0


def test_elements_without_text_swallow_no_more_than_themselves():
    texts = lambda x: [b.text for b in hb.blocks(x)]
    main = "<p>main</p>"
    for name in ("svg", "button", "select", "object", "iframe", "template", "noscript", "title", "textarea"):
        assert texts(f"<p>a</p><{name}-x n='x'></{name}-x>{main}") == ["a", "main"]
        assert texts(f"<p>a</p><{name} class='i'>{main}<p>b</p>") == ["a", "main", "b"]
        assert texts(f"<p>a</p><{name}>{main}<{name}>gone</{name.upper()} ><p>b</p>") == ["a", "main", "b"]
        assert texts(f"<p>a <{name} t='>'>gone</{name}>b</p>{main}") == ["a b", "main"]
    assert texts(f'<p>a <svg class="i"/>b</p>{main}<svg><title>gone</title></svg><p>c</p>') == ["a b", "main", "c"]
    assert texts(f"<svg>x<svg>y</svg>z</svg>{main}<template><template>x</template>y</template>") == ["main"]
    assert texts(f"<button>{main}<script>'</button>'</script><!-- </button> --><p>b</p>") == ["main", "b"]
    assert texts(f"<scripty>a</scripty>{main}<script>x {main}") == ["a", "main"]


def test_the_tables_pages_have_the_same_blocks_as_their_plain_tags(spark):
    page = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").first().html
    with_icons = page.replace("<p>", '<svg-icon name="x"></svg-icon><svg class="i"/><button hidden><p>')
    assert [b.text for b in hb.blocks(with_icons)] == [b.text for b in hb.blocks(page)]


def test_deep_and_wide_pages_take_linear_time():
    """Tags that nest without end, end tags of nothing, and very many blocks."""
    import time

    net, n = hb.BiLSTM.load(), 100_000
    took = time.time()
    for page, many in (("<div>x" * n, n), ("<p>x</p>" * n, n), ("<div><a>" * n + "x", 1), ("<div>" * n + "</x>" * n + "y", 1), ("<p><b>" * n + "z", 1), ("<svg>" * n + "x" + "</svg>" * n, 0), ("<a '" * n, 0)):
        found = hb.blocks(page)
        assert len(found) == many and len(net.chances([found])[0]) == many
    assert time.time() - took < 30  # some 6 s; at the square of it, hours
    assert [b.path.tolist() for b in hb.blocks("<div>" * 9 + "<p>a</div><p>b")][0][:96] != [b.path.tolist() for b in hb.blocks("<p>b")][0][:96]


def test_pieces_of_a_page_make_no_difference():
    net = hb.BiLSTM.load()
    x, _ = tb.labelled(20, 78)
    want = net.chances(x)
    for chunk in (1, 5, 8):
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(want, net.chances(x, chunk=chunk)))
    for v, w in zip(x, want):  # as each direction by itself has it
        a, m = v[None], np.ones((1, len(v)), np.float32)
        y = np.concatenate((net.run(a, m, "f"), net.run(a, m, "b")), axis=2) @ net.w["o"] + net.w["p"]
        assert np.allclose(hb._sigmoid(y[0]), w, atol=1e-5)
