import re
from html import unescape

from tickloom.llm.html import extract, main_text


def test_leaves_out_what_is_no_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use cookies, always.</div><main><h1>Ti&amp;tle</h1><p>First  one,
    <b>bold</b> word.<p>Second&nbsp;one.<br>Line</p><form>Sign up</form><script>var t="</p>"</script><!-- no --><ul><li>a<li>b</ul>
    <section id="comments"><p>I like this very much, really.</p></section></main><aside>Side</aside><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Ti&tle\nFirst one, bold word.\nSecond one. Line\na\nb"
    assert main_text("<div class=ad>Buy, now.</div><div><p>One text, long enough.</p><p>Two.</p></div>") == "One text, long enough.\nTwo."


def test_odd_pages():
    assert [main_text(x) for x in (None, "", " ", "<p>", "<script>x", "<nav>x</nav>")] == [""] * 6
    assert main_text("only text") == "only text"
    assert main_text("<div>" * 50_000 + "deep") == "deep"


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id] == (want, len(want))
    assert extract(pages.limit(0)).collect() == []


def test_names_count_as_whole_tokens_of_containers():
    text = "<h1>Title</h1><p>One text, long enough to read.</p><p>Another, just as long as that.</p>"
    want = "Title\nOne text, long enough to read.\nAnother, just as long as that."
    for name in ("content has-sidebar", "comments-open", "no-sidebar", "sidebar", "header content"):
        assert main_text(f"<body><div class='{name}'><article>{text}</article></div></body>") == want
        assert main_text(f"<body><div class='{name}'>{text}</div></body>") == want
    page = "<body><article><h2 id='search-algorithms'>Search</h2><p>One text, long enough.</p><h2 id='related-work'>Related</h2><p class='notice'>Do note this, too.</p>{}</article></body>"
    want = "Search\nOne text, long enough.\nRelated\nDo note this, too."
    assert main_text(page.format("")) == want
    assert main_text(page.format("<div class='share-buttons'>Share, like.</div><div id='comments'>" + "<p>A reader's view, long and long.</p>" * 20 + "</div>")) == want
    assert main_text("<p>One text <span class='ad'>Buy</span>, long <a class='has-share'>enough</a>.</p>") == "One text , long enough."


def test_ratios_alone_choose_between_layouts():
    prose = ["Long prose, with marks; and more of it, as articles have.", "It goes on, and on, for some time: that is what prose does."]
    links = ["Home", "About us", "Contact"]
    items = lambda tag, texts: "".join(f"<{tag}>{x}</{tag}>" for x in texts)
    assert main_text(f"<body><div><ul>{items('li', links)}</ul></div><section>{items('p', prose)}</section></body>") == "\n".join(prose)
    assert main_text(f"<body><div><ul>{items('li', prose)}</ul></div><section>{items('p', links)}</section></body>") == "\n".join(prose)


def test_names_later_in_a_token_say_nothing():
    text = "<p>Words, and more of them, to read.</p>" * 3
    page = f"<body><div class='page'><div class='post-header'><h1>Head line</h1></div>{text}<p class='related-work'>Others did so, too, at length.</p></div></body>"
    assert main_text(page).startswith("Head line\nWords") and main_text(page).endswith("at length.")


def test_clashing_columns_and_null_ids(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(None, None, "<p>a</p>", "x", "y"), (1, "u", None, "x", "y"), (1, "u", "<p>b</p>", None, None), (1, "u", "<p>b</p>", None, None)], schema)
    assert sorted((tuple(r) for r in extract(pages).collect()), key=repr) == sorted([(None, None, "a", 1), (1, "u", "", 0), (1, "u", "b", 1), (1, "u", "b", 1)], key=repr)
