import pytest

from plumbline.llm import html_text

LONG = "A long sentence, with commas; it goes on and on, and says a lot. "
PAGES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("plain  text", "plain text"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
    ("<article><h1>Title</h1><p>One  two\nthree.</p><p>Four &amp; five&#33;</p></article>", "Title One two three. Four & five!"),
    ("<article><p>foo <b>bar</b> <i>ba</i>z<br>next</p></article>", "foo bar baz next"),
    ("<article><p><b>unclosed<br><p>next</article><footer>foot</footer>", "unclosed next"),
    (f"<nav><a href=/>Home</a></nav><article><h1>H</h1><p>{LONG}</p></article><div class='comments'>{LONG}</div>", f"H {LONG}".strip()),
    (f"<body><div class=ad>Buy</div><div id=main-text><h2>H</h2><p>{LONG}</p><p>{LONG}</p></div><aside>x</aside></body>", f"H {LONG}{LONG}".strip()),
    (f"<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><main><p>{LONG}</p><form>f<input></form></main>", LONG.strip()),
    ("<article><p>1 < 2 and 3 > 2</p><p title='a>b'>x</p></article>", "1 < 2 and 3 > 2 x"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><p>a</p><script>never closed", "a"),
    ("<ARTICLE><P>Upper<P>case</ARTICLE>", "Upper case"),
    ("<article><div class='cookie-notice'>We use</div><div hidden>no</div><div role=navigation>no</div><p>yes</p></article>", "yes"),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_main_text(source, text):
    assert html_text.main_text(source) == text


def test_query_form(spark):
    rows = [(i, None if i == 3 else f"u{i}", s, 1) for i, (s, _) in enumerate(PAGES)] + [(0, "again", PAGES[5][0], 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    assert len(got) == len(rows)
    for i, (_, text) in enumerate(PAGES):
        assert got[(i, None if i == 3 else f"u{i}")] == (text, len(text))
    assert html_text.extract(frame.limit(0)).collect() == []


def test_long_pages_are_whole():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(3000))
    text = html_text.main_text(f"<nav>n</nav><article><h1>H</h1>{body}</article>")
    assert text.startswith("H A long") and text.endswith(" 2999") and len(text) > 3000 * len(LONG)
    assert html_text.main_text("<div>" * 3000 + "deep text.") == "deep text."


MORE = " ".join([LONG.strip()] * 6)


@pytest.mark.parametrize("source, text", [
    (f"<body><div class=post><div class=lead><p>{LONG}</p></div><div class=body><p>{MORE}</p></div></div></body>", f"{LONG}{MORE}"),
    (f"<body><section><p>{LONG}</p></section><section><p>{MORE}</p></section></body>", f"{LONG}{MORE}"),
    (f"<main><article><p>{LONG}</p></article><article><p>{MORE}</p></article></main>", f"{LONG}{MORE}"),
    (f"<body><div class='layout has-sidebar'><div class=sidebar>Links</div><p>{MORE}</p></div></body>", MORE),
    (f"<article class='post category-social'><p>{MORE}</p><div class=share>Share</div></article>", MORE),
    (f"<body><form id=f><div><p>{MORE}</p></div></form></body>", MORE),
    (f"<article><p>{LONG}</p></article><div class=comments><p>{MORE}</p></div>", LONG.strip()),
])
def test_all_of_the_content_is_kept(source, text):
    assert html_text.main_text(source) == text
