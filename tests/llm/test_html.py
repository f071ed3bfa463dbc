import pytest
from pyspark.sql import functions as F

from lumenfold.llm import html
from lumenfold.llm.queries import op1_html


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = {
    "<nav>menu</nav><article><h1>A &amp; b</h1><p>one\n\t two&nbsp;x<br>three</p></article><footer>f</footer>": "A & b\none two x three",
    "<p><b>open<br><p>next": "open\nnext",
    "<header>h</header><main><p>x</p><aside>s</aside><form>f<input></form><div class='cookie-notice'>c</div></main>": "x",
    "<article><p>x</p><div class='comments'><p>reader</p></div><div class='ad'>buy</div><section id='related-posts'>r</section></article>": "x",
    "<div class='has-sidebar'><article><p>x</p></article></div>": "x",
    "<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>": "a\nb\n1 2\n3",
    "<article><p>a <a href='/x'>link</a> b</p><!-- no --><pre>  k  v </pre>tail</article>": "a link b\nk v\ntail",
    "<article><p>&lt;b&gt; &#233; &eacute; &#x1F600;</p></article>": "<b> é é 😀",
    "<article><p hidden>no</p><p aria-hidden='true'>no</p><p>yes</p></article>": "yes",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
    "<div role='navigation'>n</div><div><p>long text of the page that is here</p><p>more</p></div>": "long text of the page that is here\nmore",
    "<article><svg><text>no</text></svg><p>x<script>if (a<b) y()</script>y</p></article>": "x\ny",
    "<article class='post ad-free comments-enabled'><h1 class='entry-header'>T</h1><p>x</p><article class='comment'>no</article><p style='display: none'>no</p></article>": "T\nx",
    "<div class='legal'>l</div><main><div class='reader-comments'>c</div><p>x</p></main>": "x",
    "<section class='intro'><p>first part</p></section><section class='rest'><p>the second part is longer than that</p></section>": "first part\nthe second part is longer than that",
    "<article><p class='legal-analysis'>a</p><div class='poll-results'>b</div><p class='comment-on-text'>c</p><p class='social-history'>d</p></article>": "a\nb\nc\nd",
    "<article><p>one <span class='ad'>x <span>y</span> z</span> two</p><p>three <span class='ad'>open</p></article>": "one two\nthree open",
    "<article><header><h1>Title</h1><p>by someone</p></header><p>x</p><footer>f</footer></article><header><h2>Site</h2></header>": "Title\nx",
    "<div><a href='/'>all</a> <a href='/b'>links</a></div><div><p>text with <a href='/c'>one</a> link in it</p></div>": "text with one link in it",
    "<div id='content'><h1>Title</h1><p>The long main text of this page</p></div><div id='more'><article><a href='/t'>Teaser</a></article></div>": "Title\nThe long main text of this page",
    "<div><p>The long main text of this page, which goes on for a while</p></div><article><h3>Other</h3><p>abstract</p></article>": "The long main text of this page, which goes on for a while",
    "<main><article><p>Main text here</p></article><article><h3><a href='/o'>Another story</a></h3></article></main>": "Main text here",
    "<article><p>short</p></article><div><p>not much</p></div>": "short",
    "<article><p>We saw a <span class='alert'>warning</span> and <a class='footer'>note</a> there.</p></article>": "We saw a warning and note there.",
    "<article><section id='survey'><p>We asked people.</p></section><div class='poll'><p>They said yes.</p></div></article>": "We asked people.\nThey said yes.",
    "<article><p>a</p><aside>x<p>b</p><nav>n</nav></article><p>c</p>": "a\nb",
    "<article><p>a</p><aside><p>x</p><p>y</p></aside><p>b</p></article>": "a\nb",
    "<div><p>one</p></div><nav>menu<ul><li>item</ul></nav><aside>x<p>two</p>": "one\ntwo",
    "": "",
    "<nav>only</nav>": "",
}


@pytest.mark.parametrize("body", CASES)
def test_text(body):
    assert html.main_text(page(body)) == CASES[body]


@pytest.mark.parametrize("source", [None, "", "plain", "<", "</", "<p", "<!--", "<!-- x", "<script>", "&amp;", "<p>" * 3000, "a<b" * 500, "<div>" * 3000 + "x" + "</div>" * 10])
def test_odd_sources(source):
    assert isinstance(html.main_text(source), str)


def test_template_of_a_host(spark, monkeypatch):
    rows = [
        (i, f"https://h.example.org/{i}?x", f"<div class='q'><div class='n1'>Join our list today</div><div class='z'><p>words of page {i} here</p><p>and {i * i} more of them</p></div><div class='n2'>All rights</div></div>")
        for i in range(12)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert texts == {i: f"words of page {i} here\nand {i * i} more of them" for i in range(12)}
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == texts


def host_pages(spark, bodies, host="h.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", page(b, "T")) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_a_paragraph_that_all_articles_share_is_kept(spark):
    bodies = [f"<nav>menu</nav><article><h1>Title {i}</h1><p>own paragraph of {i}</p><p>shared by all</p></article><div class='x7'><p>Read more here</p></div>" for i in range(6)]
    texts = {r.page_id: r.text for r in html.extract(host_pages(spark, bodies)).collect()}
    assert texts == {i: f"Title {i}\nown paragraph of {i}\nshared by all" for i in range(6)}


def test_template_text_in_an_article_goes(spark):
    bodies = [f"<article><h1>Title {i}</h1><p>own paragraph of {i}</p><div class='x7'><p>Read more here</p></div></article>" for i in range(6)]
    texts = {r.page_id: r.text for r in html.extract(host_pages(spark, bodies)).collect()}
    assert texts == {i: f"Title {i}\nown paragraph of {i}" for i in range(6)}


def final_text(source, starts, texts, shared):
    """The main text by a plain reading of the rules, a page at a time, from blocks as :func:`html.parse` has them."""
    blocks = [b for b in html.parse(source).items if not isinstance(b, str) and not b.out]
    kinds = {id(b): "fixed" if html.token_of(b) in texts else "shared" if html.token_of(b) in shared else "own" for b in blocks}

    def plain(of):
        return sum(len(b.text) - b.linked for b in of)

    def data(scope):
        return plain([b for b in blocks if kinds[id(b)] == "own" and b.scope == scope])

    most = max([data(b.scope) for b in blocks], default=0)
    kept = [b for b in blocks if kinds[id(b)] == "own" or kinds[id(b)] == "shared" and (b.scope == b.within or 4 * data(b.scope) >= most)]
    articles = [b for b in kept if b.whole] or [b for b in blocks if b.whole]
    articles = [b for b in articles if 2 * plain([x for x in articles if x.within == b.within]) > sum(len(x.text) for x in articles if x.within == b.within)]
    rest = [b for b in kept if not b.whole and 2 * b.linked < len(b.text)]
    fullest = max([plain([x for x in rest if x.scope == b.scope]) for b in rest], default=0)
    if articles and fullest <= 2 * plain(articles):
        return "\n".join(b.text for b in articles)
    return "\n".join(b.text for b in rest or kept or [b for b in blocks if kinds[id(b)] == "own"])


def test_a_line_below_the_page_goes(spark, monkeypatch):
    for start, end in (("<article>", "</article>"), ("<div class='x1'>", "</div>")):
        bodies = [f"<div class='m'><b>Site</b></div>{start}<h1>Title {i}</h1><p>own paragraph number {i} of the host</p>{end}<div><p>Rights</p><p>promo {i}</p></div>" for i in range(8)]
        texts = {r.page_id: r.text for r in html.extract(host_pages(spark, bodies)).collect()}
        assert all("Rights" not in t and t.startswith(f"Title {i}\nown paragraph number {i} of the host") for i, t in texts.items())
        with monkeypatch.context() as m:
            m.setattr(html, "BROADCAST_BYTES", 0)
            assert {r.page_id: r.text for r in html.extract(host_pages(spark, bodies)).collect()} == texts


def deduced(sources):
    """The template of one host by brute force: vectors, order and nesting over all its pages at once."""
    pages = [html.parse(s) for s in dict.fromkeys(sources)]
    rows = [[(html.token_of(x), x) for x in p.items if isinstance(x, str) or not x.out] for p in pages]
    vectors, item = {}, {}
    for i, row in enumerate(rows):
        for token, x in row:
            vectors.setdefault(token, [0] * len(rows))[i] += 1
            item[token] = x
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)

    def on(row, c):
        return [(k, t) for k, (t, _) in enumerate(row) if t in c]

    def support(v):
        return sum(x > 0 for x in v)

    good = []
    for v, c in classes.items():
        if len(c) < html.MIN_CLASS or not any(isinstance(item[t], str) for t in c) or support(v) < html.MIN_PAGES or 2 * support(v) < len(rows):
            continue
        orders = {tuple(t for _, t in on(row, c)[at : at + len(c)]) for row in rows for at in range(0, len(on(row, c)), len(c))}
        if len(orders) == 1:
            good.append((v, c))

    def gaps(outer, inner):
        found = set()
        for row in rows:
            a, b = on(row, outer), on(row, inner)
            if a and b:
                for at in range(0, len(b), len(inner)):
                    first, last = b[at][0], b[at + len(inner) - 1][0]
                    n = sum(k < first for k, _ in a)
                    found.add(n % len(outer) if n == sum(k < last for k, _ in a) else -1)
        return found

    def crosses(one, other):
        return not any(len(g) == 1 and g != {-1} for g in (gaps(one, other), gaps(other, one)))

    better = lambda x, y: (support(x[0]), len(x[1])) > (support(y[0]), len(y[1]))
    valid = [x for x in good if not any(better(y, x) and crosses(y[1], x[1]) for y in good)]
    tokens = set().union(*[c for _, c in valid])
    starts = {t for t in tokens if isinstance(item[t], str)}
    texts = {t for t in tokens - starts if all(u in tokens for u in vectors if not isinstance(item[u], str) and item[u].path == item[t].path)}
    return starts, texts, tokens - starts - texts


def odd_bodies(rng, n):
    """Pages of one design: fixed parts, lists of a varying length, parts that swap places, and repeated pages."""
    bodies = []
    for i in range(n):
        items = "".join(f"<div class='card'><h3>c{rng.randrange(99)}</h3><div class='k'><em>e</em>Buy now</div><p>price {rng.randrange(9)}</p></div>" for _ in range(1 + i % 4))
        swapped = ["<section class='a'><div class='a1'>left</div><div class='a2'>l2</div></section>", "<section class='b'><div class='b1'>right</div></section>"]
        rng.shuffle(swapped)
        bodies.append(f"<div class='q'><div class='n'>Fixed words</div>{''.join(swapped)}<div class='z'><p>page {i} says</p>{items}</div><div class='n2'>Rights</div></div>")
    return bodies + bodies[:2]


@pytest.mark.parametrize("seed", range(4))
def test_template_against_brute_force(spark, seed):
    import random

    pages = host_pages(spark, odd_bodies(random.Random(seed), 9 + seed))
    sources = [r.html for r in pages.collect()]
    want = deduced(sources)
    (got,) = html.templates(pages.select("url", "html")).collect()
    assert (set(got.starts), set(got.texts), set(got.shared)) == want and want[0] and want[1]
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert found == {i: final_text(source, *want) for i, source in enumerate(sources)}


def test_relations():
    ab = [(1, 5, 3, 10, [0]), (1, 5, 3, 11, [1]), (1, 5, 3, 12, [8])]
    cd = [(2, 5, 2, 20, [2, 4]), (2, 5, 2, 21, [3, 5])]
    rows = {(r[0], r[1]): r[2:] for r in html.relations(ab + cd)}
    assert rows[1, 1][2] and rows[2, 2][2] and rows[1, 2] == (2, -1, True)
    crossed = {(r[0], r[1]): r[2:] for r in html.relations(ab + [(2, 5, 2, 20, [2]), (2, 5, 2, 21, [9])])}
    assert crossed[1, 2] == (-1, -1, False)
    assert not html.relations([(2, 5, 2, 20, [2, 5]), (2, 5, 2, 21, [3, 4])])[0][4]


def test_repeated_article_is_kept(spark):
    rows = [(i, "http://h.example/", page("<nav>m</nav><article><p>the same text everywhere</p></article>")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {"the same text everywhere"}


def test_nulls_extra_columns_and_empty(spark):
    rows = [(1, None, None, "k"), (None, "no url", "<article>x</article>", None), (1, None, None, "k"), (2, "http://a/", "", "l")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("host", F.lit(1)).withColumn("n_chars", F.lit("z"))
    out = html.extract(pages)
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("", 0), ("", 0), ("x", 1)]
    assert out.columns.count("text") == 1 and html.extract(pages.limit(0)).count() == 0


def test_query(spark, sf):
    out = op1_html(spark, sf)
    docs = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    rows = out.collect()
    # Each page is one document under a heading.
    assert len(rows) == 50 and all(r.text.partition("\n")[2] in docs and r.n_chars == len(r.text) for r in rows)
