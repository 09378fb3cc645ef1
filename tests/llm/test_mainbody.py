import itertools

import numpy as np

from pagesieve.llm import mainbody as M

PAGE = """<!doctype html><html><head><title>x</title><script>var a="<p data-bid='99'>no</p>";</script></head><body><!-- <p data-bid="98">no</p> -->
<nav><ul><li><a data-bid="0" href="/a">Home</a><li><a data-bid="1" href="/b">Help centre</a></ul></nav>
<a data-bid="2" href="/">Home</a> &gt; <a data-bid="3" href="/">Help</a> &gt; <main><article><h1 data-bid="4">Opening hours of Rasnest</h1>
<p data-bid="5">The billing portal explains the second step of the sign-in before the page is shown. It helps that a <b>small</b> shop &amp; we agree.
<div><span data-bid="6">Share this page</span> <span data-bid="7">Print</span></div>
<ul><li data-bid="8">The parking site blocks the reason for the warning.<li data-bid="9">Kovrion parcel</ul>
<table><tr><td data-bid="10">Zintova verify</td><td data-bid="11">890.00 cr</td><tr><td data-bid="12">Quowick parcel</td></table></article></main>
<aside><h3 data-bid="13">Popular this week</h3><div><a data-bid="14" href="/x">Sign in to Morlume</a></div><div><a data-bid="15" href="/y">Guide to safer passwords</a></div></aside>
<div id="cookie-bar"><p data-bid="16">We use cookies to remember your choices and to count visits.<button>OK</button></div>
<footer><a data-bid="17" href="/i">Imprint</a> <a data-bid="18" href="/p">Press</a> <small data-bid="19">© 2011 Zingard</small></footer></body></html>"""


def test_parse():
    p = M.parse(PAGE)
    assert p.bids == list(range(20))
    texts = [M._clean(t) for t in p.texts]
    assert texts[5].endswith("a small shop & we agree.") and texts[9] == "Kovrion parcel" and texts[16].endswith("visits.")
    assert p.separated[2] and p.separated[3] and not p.separated[7]
    assert p.kinds[p.container[10]] == "table"


def _flags(html):
    b = M.Blocks([M.parse(html)])
    return [int(x) for x, f in zip(b.bids, M.body_flags(b, M.load())) if f]


def test_body_of_a_page():
    assert _flags(PAGE) == [4, 5, 8, 9, 10, 11, 12]
    # the same page built of divs with misleading names
    other = PAGE.replace("<nav>", '<div class="content-top">').replace("</nav>", "</div>").replace("<main><article>", '<div class="sidebar-layout">').replace("</article></main>", "</div>").replace("<aside>", "<div>").replace("</aside>", "</div>").replace("<footer>", '<div class="main-info">').replace("</footer>", "</div>")
    assert _flags(other) == [4, 5, 8, 9, 10, 11, 12]


def test_viterbi_and_gradient_like_brute_force():
    rng = np.random.default_rng(0)
    score, step, trans = rng.normal(size=(3, 5)), rng.integers(0, 3, (3, 5)), rng.normal(size=(3, 2, 2))
    there = np.arange(5) < np.array([5, 3, 1])[:, None]

    def value(k, y):
        n = int(there[k].sum())
        return sum(score[k, i] * y[i] for i in range(n)) + sum(trans[step[k, i], y[i - 1], y[i]] for i in range(1, n))

    best = M.viterbi(score, step, there, trans)
    for k in range(3):
        n = int(there[k].sum())
        assert value(k, best[k]) == max(value(k, y + (0,) * (5 - n)) for y in itertools.product((0, 1), repeat=n))
    label = (rng.random((3, 5)) < 0.5) & there
    total, g_score, g_trans = M.log_likelihood(score, step, there, label.astype(int), trans)
    z = sum(np.log(sum(np.exp(value(k, y + (0,) * (5 - int(there[k].sum())))) for y in itertools.product((0, 1), repeat=int(there[k].sum())))) for k in range(3))
    assert abs(total - (sum(value(k, label[k].astype(int)) for k in range(3)) - z)) < 1e-9
    for i, j in ((0, 2), (1, 1), (2, 0)):
        moved = score.copy()
        moved[i, j] += 1e-5
        assert abs((M.log_likelihood(moved, step, there, label.astype(int), trans)[0] - total) / 1e-5 - g_score[i, j]) < 1e-3
    moved = trans.copy()
    moved[1, 0, 1] += 1e-5
    assert abs((M.log_likelihood(score, step, there, label.astype(int), moved)[0] - total) / 1e-5 - g_trans[1, 0, 1]) < 1e-3


def test_labels_by_cleaned_text():
    p = M.parse(PAGE)
    clean = " ".join(M._clean(p.texts[i]) for i in (4, 5, 8, 9, 10, 11))
    labels, whole = M.aligned_labels(p, clean + " Quowick", 400)
    assert whole and [i for i, y in enumerate(labels) if y] == [4, 5, 8, 9, 10, 11, 12] and len(labels) == 20
    labels, whole = M.aligned_labels(p, clean[:120], 120)
    assert not whole and len(labels) == 6 and labels[4:] == [1, 1]


def test_held_out_accuracy(spark):
    """Pages whose cleaned text is known: at least 99 percent of their known blocks are right."""
    from pagesieve.llm import train_mainbody as R

    rows = [(r["html"], r["clean"]) for r in R.labelled_pages(spark, "/root/testdata/sf0.01", 300).collect()]
    pages = [M.parse(h) for h, _ in rows]
    flags = M.body_flags(whole := M.Blocks(pages), M.load())
    right = total = 0
    for s, p, (_, c) in zip(np.cumsum(whole.count) - whole.count, pages, rows):
        known = np.array(M.aligned_labels(p, c, R.CUT)[0], bool)
        right, total = right + int((flags[s : s + len(known)] == known).sum()), total + len(known)
    assert total > 2000 and right >= 0.99 * total


def test_operator_and_edges(spark):
    rows = [("a", PAGE, 1), ("a", PAGE, 1), ("b", None, 1), ("c", "", 1), ("d", "<p data-bid=0></p><div", 1), ("e", "plain text, no tags", 1), ("f", "<h1 data-bid=0>A</h1>" + "<p data-bid=1>The second reviewer forwards the date on the certificate to all of us.</p>" * 3000, 1), ("g", "<p>No numbers here, but a sentence of some length.</p>", 1)]
    out = M.page_bodies(spark.createDataFrame(rows, "id string, html string, bids int"), "id", "html").collect()
    got = {r["id"]: r["bids"] for r in out}
    assert len(out) == 6 and got["a"] == [4, 5, 8, 9, 10, 11, 12] and got["d"] == got["e"] == [] and len(got["f"]) > 2900
    assert M.page_bodies(spark.createDataFrame([], "id string, html string"), "id", "html").count() == 0


def test_fitting_learns(spark):
    pages = [M.parse(PAGE) for _ in range(8)]
    blocks = M.Blocks(pages)
    y = np.array([int(b in (4, 5, 8, 9, 10, 11, 12)) for b in blocks.bids])
    model = M.fit(blocks, y, rounds=60)
    assert (M.body_flags(blocks, (model["weights"], np.array(model["transitions"]))) == (y == 1)).all()


def test_containers_however_deep():
    nav = '<nav><a data-bid="0" href="/a">Home</a></nav>'
    for depth in (3, 14, 80, 400):
        deep = "<nav>" + "<div>" * depth + '<a data-bid="0" href="/a">Home</a>' + "</div>" * depth + "</nav>"
        b = M.Blocks([M.parse(f"<body>{deep}<main><h1 data-bid='1'>Head of it</h1></main></body>")])
        on = {b.labels[i] for r, i in zip(b.rows, b.ids) if r == 0}
        assert "in_nav=1" in on
    b = M.Blocks([M.parse(f"<body>{nav}" + "<div>" * 100 + "<p data-bid='1'>One whole sentence stands here.</p>" * 5 + "</div>" * 100 + "</body>")])
    shapes = {b.labels[i] for r, i in zip(b.rows, b.ids) if r == 1 and b.labels[i].startswith("shape")}
    assert len({x.split("=")[1] for x in shapes}) == 1  # all the containers around hold the same


def test_body_tags_in_comments_and_capitals():
    page = "<html><!-- <body> --><script>'<body>'</script><BODY><P data-bid=3>Text of it.</P><!-- <body> --><p data-bid=4>More.</p></BODY>"
    assert M.parse(page).bids == [3, 4] and [M._clean(x) for x in M.parse(page).texts] == ["Text of it.", "More."]


def test_invented_names_say_nothing():
    a, b = (M.Blocks([M.parse(f"<body><div class='{c}'><p data-bid=1>Text of it.</p></div></body>")]) for c in ("zyawdx", "footer-links"))
    assert not [x for x in a.labels if x.startswith("name")] and "name0=foot" in b.labels


def test_visible_text():
    texts, body = ["Home", "Head", "One text.", "Menu", "Two text goes on."], [False, True, True, False, True]
    assert M.visible_body("Home Head One text. Send Menu Two text goes on.", texts, body) == "Head\nOne text.\nTwo text goes on."
    assert M.visible_body("Home Head One text. Menu Two text go", texts, body) == "Head\nOne text.\nTwo text go"
    assert M.visible_body("", texts, body) == "" and M.visible_body("Home", texts, body) == ""


def test_visible_bodies(spark):
    pages = spark.createDataFrame([("a", PAGE), ("a", PAGE), ("n", None)], "id string, html string")
    seen = spark.createDataFrame([("a", "Home Help centre Home > Help > Opening hours of Rasnest The billing portal explains the second"), ("n", "just text"), ("z", None)], "id string, visible string")
    got = {r["id"]: r["body"] for r in M.visible_bodies(pages, "id", "html", seen, "id", "visible").collect()}
    assert got == {"a": "Opening hours of Rasnest\nThe billing portal explains the second", "n": "just text", "z": None}
    assert M.visible_bodies(pages.limit(0), "id", "html", seen.limit(0), "id", "visible").count() == 0
