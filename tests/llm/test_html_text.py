import itertools
import random

from pyspark.sql import functions as F

from millrace.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div><div class="ad">Buy now.</div><!-- no -->
<article><h1>A &amp; B</h1><p><b>First   <i>line</i> of
the story.<br><p>Second one, which is a good deal longer than the first one was.<ul><li>An item</li></ul>
<div class=sidebar>See also this.</div><p>1 &lt; 2 &#233;</p></article>
<section id="comments"><p>I disagree with all of that, says a reader here.</p></section>
<form><p>Your name</p><input></form><aside>Related</aside><footer>&copy; Site &middot; all rights</footer></body></html>"""


def test_article_alone():
    assert ht.main_text(PAGE) == "A & B\n\nFirst line of the story.\n\nSecond one, which is a good deal longer than the first one was.\n\nAn item\n\n1 < 2 é"


def test_odd_pages(spark):
    pages = [None, "", "   ", "<", "<p", "<div>" * 3000 + "deep words in here stand alone.", "<script>x", "<!-- open", "plain words without any markup, but a whole sentence.", "<article><p>" + "word " * 100000 + "</article>"]
    got = [r.x for r in spark.createDataFrame([(p,) for p in pages], "html string").select(ht.extract(F.col("html")).alias("x")).collect()]
    assert got[:3] == ["", "", ""] and got[6] == got[7] == ""
    assert len(got[-1]) == 100000 * 5 - 1
    assert spark.createDataFrame([], "html string").select(ht.extract(F.col("html"))).collect() == []


def test_minimum_cut_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        a, b = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        edges = [(i, j, rng.random() * 0.5) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(c for i, j, c in edges if s[i] != s[j])
        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert abs(cost(ht.minimum_cut(a, b, edges)) - best) < 1e-9


def test_pages_give_the_article(spark, sf):
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = ht.op6_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        m = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        if m:
            words = re.sub(r"<[^>]*>", " ", m[1]).split()
            import html

            assert r.text.split() == [w for x in words for w in html.unescape(x).split()]


def test_formulas_stay_in_their_paragraph():
    page = "<article><p>The law of the falling stone, which is known to all, says <math display='block'><mi>s</mi><mo>=</mo><mi>g</mi></math> for every stone that falls.</p></article>"
    assert ht.main_text(page) == "The law of the falling stone, which is known to all, says s=g for every stone that falls."


def test_broken_quotes_and_deep_nesting_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<a " + "\"" * 100001 + "'" * 100001 + " text", "<a " * 100000, "<a \"'" * 50000 + ">", "<div>" * 5000 + "a<div>b</div>c" * 500):
        ht.main_text(page)
    assert time.perf_counter() - began < 2


def test_prose_in_articles_stays_whatever_its_class():
    page = "<article><p class='legal'>The court held that the claim was barred.</p><p class='side-note text'>A note that stands beside the text.</p><object>What an object holds.</object></article><div class='legal'>All rights.</div>"
    assert ht.main_text(page) == "The court held that the claim was barred.\n\nA note that stands beside the text.\n\nWhat an object holds."


def soup(rng):
    """A page without any marks, and its blocks: (text, content)."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "light", "over", "the", "of"]) for _ in range(n))
    body = []
    for _ in range(rng.randint(4, 7)):
        body.append((f"<p>{words(rng.randint(20, 40))}.</p>", True))
        if rng.random() < 0.6:
            body.append((rng.choice([f"<div>{words(2)}</div>", f"<li>{words(3)}", f"<p><a href=x>{words(5)}</a></p>"]), True))
            body.append((f"<p>{words(rng.randint(20, 40))}.</p>", True))
    menu = [(f"<li><a href=y>{words(1)}</a></li>", False) for _ in range(rng.randint(4, 8))]
    foot = [(f"<div><a href=z>{words(2)}</a></div>", False) for _ in range(3)]
    page = "<div><ul>" + "".join(t for t, _ in menu) + "</ul></div><div>" + "".join(t for t, _ in body) + "</div><table><tr><td>" + "".join(t for t, _ in foot) + "</table>"
    return page, [k for part in (menu, body, foot) for _, k in part]


def test_the_cut_mends_what_the_classifier_gets_wrong(spark):
    rng = random.Random(5)
    marked = [(i, f"<nav><ul><li><a href=a>Home</a></li><li><a href=b>All news</a></li></ul></nav><article><h1>Of stone</h1><p>{'A longer line of the text stands here. ' * rng.randint(1, 4)}</p><p>Short one.</p></article><footer><div>Site 2020</div></footer>") for i in range(60)]
    weights = ht.fit(spark.createDataFrame(marked, "page_id long, html string"))
    assert weights != ht.PRIOR and weights[1] < 0 < weights[2]
    alone = cut = changed = total = 0
    for _ in range(60):
        page, want = soup(rng)
        found = ht.labelled(page, weights)
        assert len(found) == len(want)
        alone += sum((o > 0) == w for (_, o, _), w in zip(found, want))
        cut += sum(k == w for (_, _, k), w in zip(found, want))
        changed += sum((o > 0) != k for _, o, k in found)
        total += len(want)
    print(alone / total, cut / total, changed)
    assert changed > 50 and cut > alone and cut / total > 0.95
    assert ht.fit(spark.createDataFrame(marked[:3], "page_id long, html string")) == ht.PRIOR
