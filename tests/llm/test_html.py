import random

from sparkrecall.llm import html_text, queries

SCHEMA = "page_id long, url string, html string, uid long, text string"


def texts(spark, pages, **options):
    df = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in pages], SCHEMA).repartition(3)
    rows = html_text.main_text(df, **options).collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return rows


def one(spark, html):
    return texts(spark, [(1, "http://a.example/x", html)])[0].text


def test_article_without_the_rest(spark):
    html = """<!DOCTYPE html><html><head><title>Site &amp; page</title><style>p > b {x}</style><script>var a="</p><p>no";</script></head>
    <body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>Side</p></div>
    <article class="post"><header><h1>Title &copy;</h1><span>By someone</span></header><p>First <b>bold</b>
      and <a href="a>b" title="x > y">link</a>&nbsp;text &lt;tag&gt; &#233;.<p>Second<br>line
    <div class="ad">Buy</div><form><input value="q"><button>Go</button></form><ul><li>One<li>Two</ul><!-- <p>hidden</p> -->
    <aside>Also read</aside><section class="comments"><article><p>Nice!</p></article></section><p hidden>no</p><p>Last &amp;amp; end</p></article>
    <div class="comments"><article class="comment"><p>A reader wrote.</p></article></div><footer>&copy; 2020</footer></body>"""
    assert one(spark, html) == "Title ©\nFirst bold and link text <tag> é.\nSecond\nline\nOne\nTwo\nLast &amp; end"


def test_awkward_pages(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>open"), (4, "u", "plain text"), (5, None, "<p>a < b and c > d</p>"),
             (None, "u", "<article>x</article>"), (7, "u", "<article><script>x"), (8, "u", "<article><p>same</article>"),
             (8, "u", "<article><p>same</article>"), (9, "u", "<article><p title=\"a>b</p><p>t</p></article>"), (10, "u", "<article>" + "<p>w</p>" * 20_000)]
    got = {(r.page_id, r.url): r.text for r in texts(spark, pages)}
    assert got[1, None] == "" and got[2, "u"] == "" and got[3, "u"] == "open" and got[4, "u"] == "plain text"
    assert got[5, None] == "a < b and c > d" and got[None, "u"] == "x" and got[7, "u"] == "" and got[8, "u"] == "same"
    assert got[10, "u"] == "\n".join("w" * 20_000)
    assert len(texts(spark, pages)) == len(pages)
    empty = spark.createDataFrame([], SCHEMA)
    assert html_text.main_text(empty).count() == 0


def test_names_that_only_look_like_boilerplate(spark):
    inside = """<h2 id="social-impact">Impact</h2><p>one</p><section id="related-work"><h3>Work</h3><p>two</p></section>
    <div class="header-image">three</div><h2 id="comments">On comments</h2>"""
    want = "Impact\none\nWork\ntwo\nthree\nOn comments"
    rest = """<div class="share-buttons">s</div><div class="main-nav">m</div><div class="ad-300x250">a</div><div id="sidebar-1">b</div>
    <section class="comment-list"><article>c</article></section><div class="related-posts"><article>r</article></div><article class="comment">d</article>"""
    for html in (f'<article class="overflow-hidden">{inside}</article>{rest}',
                 f'<form id="aspnetForm"><div class="header">x</div><main>{inside}</main>{rest}</form>',
                 f'<div><form><article>{inside}{rest}</article></form></div>',
                 f'<div class="overlay banner"><p>x</p><article>{inside}</article></div>{rest}',
                 f'<form>{inside}{rest}</form>', f"<article>{inside}<ul><li class=ad>x</ul></article>"):
        assert one(spark, f"<body>{html}</body>") == want, html
    assert one(spark, "<article><ul><li class=ad>x<li>y</ul></article>") == "y"


def test_attributes_count_by_their_whole_names(spark):
    words = "one two three"
    for html in ('<article style="overflow:hidden">{}</article>', '<article><p style="overflow: hidden">{}</p></article>',
                 '<article><p title="a hidden truth">{}</p></article>', '<article><p data-id="comments">{}</p></article>',
                 "<article><p data-role='navigation' aria-hidden=false>{}</p></article>", '<article><p title=hidden>{}</p></article>',
                 '<article><p title="id=comments">{}</p></article>', "<article><div x-class='ad' data-hidden>{}</div></article>"):
        assert one(spark, html.format(words)) == words, html
    assert one(spark, '<article><p>see <a href="/places/hidden-gems">the places</a> now</p></article>') == "see the places now"
    for html in ('<article>x<p hidden>{}</p></article>', '<article>x<p HIDDEN="">{}</p></article>', "<article>x<div CLASS = 'ad'>{}</div></article>",
                 '<article>x<div id=comments>{}</div></article>', '<article>x<p aria-hidden="true">{}</p></article>'):
        assert one(spark, html.format(words)) == "x", html


def test_time_grows_with_the_length_of_nested_pages():
    import time
    page = "<article>" + "<div>" * 16_000 + "text" + "</p></section>" * 16_000 + "</div>" * 16_000
    begin = time.process_time()
    assert html_text.blocks(page) == [("keep", "text")]
    assert time.process_time() - begin < 2


def brute(pages, least_tokens, least_pages):
    """Covered tokens of open blocks by a table of all windows of all pages of a host."""
    on = {}
    blocks = [(html_text.host_of(u), [b for k, b in html_text.blocks(h) if k != "keep"]) for _, u, h in pages]
    for p, (host, found) in enumerate(blocks):
        for b in found:
            t = b.split()
            for i in range(max(1, len(t) - least_tokens + 1)):
                on.setdefault((host, tuple(t[i:i + least_tokens])), set()).add(p)
    out = []
    for (i, u, h) in pages:
        found, left = html_text.blocks(h), []
        if any(k == "keep" for k, _ in found):
            out.append((i, "\n".join(b for k, b in found if k == "keep")))
            continue
        for b in (b for k, b in found if not k):
            t = b.split()
            gone = {x for j in range(max(1, len(t) - least_tokens + 1)) for x in range(j, min(len(t), j + least_tokens))
                    if len(on[html_text.host_of(u), tuple(t[j:j + least_tokens])]) >= least_pages}
            left.append(" ".join(w for x, w in enumerate(t) if x not in gone))
        out.append((i, "\n".join(x for x in left if x)))
    return sorted(out)


def test_repeated_runs_of_a_host(spark):
    rnd = random.Random(1)
    common = [" ".join(f"c{k}x{j}" for j in range(12)) for k in range(5)]
    pages = []
    for i in range(120):
        host = f"https://{'big' if i % 3 else 'small' + str(i % 9)}.example/{i}"
        own = [" ".join(f"p{i}w{rnd.randrange(99)}" for _ in range(rnd.randint(1, 30))) for _ in range(3)]
        parts = [common[0], own[0], f"{own[1]} {rnd.choice(common)} tail{i}", "Home", own[2], rnd.choice(common)]
        body = "".join(f"<div><p>{x}</p></div>" for x in parts)
        pages.append((i, host, f"<body>{body}</body>" if i % 5 else f"<body><nav>{common[1]}</nav><article>{body}</article></body>"))
    for shard in (100_000, 300):  # one shard a host, and many
        got = sorted((r.page_id, r.text) for r in texts(spark, pages, shard_tokens=shard))
        assert got == brute(pages, html_text.LEAST_TOKENS, html_text.LEAST_PAGES)
    assert "c0x0" not in dict(got)[1] and "p1w" in dict(got)[1] and "c0x0" in dict(got)[0]


def test_whole_table_keeps_articles(spark):
    import html
    import re
    rows = {r.page_id: r for r in queries.op6_html_text(spark, "/root/testdata/sf0.001").collect()}
    for p in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.sub(r"</?b>", "", p.html.split("<article>")[1].split("</article>")[0])
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>", inside)]
        assert rows[p.page_id].text == "\n".join(x for x in want if x) and rows[p.page_id].url == p.url
