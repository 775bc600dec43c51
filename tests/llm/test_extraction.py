"""Main text of pages."""

import html
import re

import pytest

from pactscope.llm.extraction import blocks_of, extract_text, main_text
from pactscope.llm.queries import QUERIES

GOOD = (
    "It was the best of times and the worst of times, it was the age of wisdom and it was the age of foolishness; it was "
    "that epoch of belief, a time of light and a season of dark, and that is all there is to say."
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p> \n <br>", ""),
        (GOOD, GOOD),
        (f"<article><h1>A &amp; B</h1><p>{GOOD}<p>no &lt;end&gt; <b>bo</b>ld<br>next</article><footer>f</footer>", f"A & B {GOOD} no <end> bold next"),
        (f"<div class='ad'>Buy <div>now<article><p>{GOOD}</p></article>", GOOD),
        (f"<article><p>{GOOD}</p><aside>more</aside><section id='comments'><p>{GOOD}</p></section></article>", GOOD),
        (f"<article><header><h2>Title</h2></header><p>x</p><form>name</form><script>if (a < b) '</p>'</script></article>", "Title x"),
        (f"<nav><a href='/'>Home</a></nav><div><p>{GOOD}</p><p>Short.</p><p>{GOOD}</p></div><div id=footer>c</div>", f"{GOOD} Short. {GOOD}"),
        (f"<div><p>{GOOD}</p></div><ul><li><a href='/a'>{GOOD}</a></li><li><a href='/b'>Next</a></li></ul>", GOOD),
        (f"<div style='display:none'>{GOOD}</div><div><p>{GOOD}</p><span hidden>h</span></div>", GOOD),
        (f"<p>{GOOD}</p><!-- {GOOD} --><p>&copy; 2020</p>", GOOD),
        (f"<main><p>a \t b</p><p>&eacute;&#233;&#xe9;&nosuch;</p></main>", "a b ééé&nosuch;"),
        ("<article><p>tail <b>unclosed <i>tags", "tail unclosed tags"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_short_blocks_take_the_nearest_label():
    page = f"<p>{GOOD}</p><p>near</p><p><a>{'link ' * 20}</a></p><p>far</p>"
    assert main_text(page) == GOOD  # "near" lies between: as near to the links as to the text
    assert main_text(f"<p>{GOOD}</p><p>near</p><p>also</p><p>far</p><p><a>{'link ' * 20}</a></p>") == f"{GOOD} near"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>Teaser</p></article><div><p>{GOOD}</p><p>{GOOD}</p></div>", f"Teaser {GOOD} {GOOD}"),
        (f"<div class='story'><a href='/1'>One</a></div><div><p>{GOOD}</p></div>", GOOD),
        (f"<article><p>{GOOD}</p></article><p>{'link ' * 9}<a>{'link ' * 20}</a></p><div><p>{GOOD}</p></div>", f"{GOOD} {GOOD}"),
        (f"<ul><li><a href='/'>Home</a></ul><article><h1>A</h1><p>b</p><p>c</p><p>{GOOD}</p></article>", f"A b c {GOOD}"),
    ],
)
def test_text_outside_the_marked_element(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<p>a <svg class='i'/> b</p><p>c</p>", "a b c"),
        ("<p>a <math x=1 /> b</p><script src='s'/><p>c</p>", "a b c"),
        *((f"<p>a <{tag}>x</p><p>c</p>", "a c") for tag in ("button", "select", "object", "audio", "video")),
        ("<div>a <button><p>x</p><b>y</div><p>c <button>z</button>d</p>", "a c d"),
        ("<p>a <svg><title>t</title><g><path d=''/></g></i></svg> b</p><object>x<object>y</object>z</object><p>c</p>", "a b c"),
        ("<p>a</p><noscript><div>x</div><br>y</noscript><style>p{}</style><p>c</p><script>x</p><p>y", "a c"),
    ],
)
def test_dropped_elements_end(inside, text):
    assert main_text(f"<article>{inside}</article>") == text


def test_nesting_and_length():
    assert main_text("<div>" * 3_000 + f"<p>{GOOD}</p>" + "</div>" * 2_000) == GOOD
    assert len(blocks_of("<p>x" * 50_000)) == 50_000
    assert len(main_text(f"<article><p>{'word ' * 200_000}</p></article>")) == 999_999


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op8_block_rules"](spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:  # all of these pages have one article, with markup inside blocks and between them only
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(b|i|em|a|strong)\b[^>]*>", "", re.sub(r"<(br|/?p|/?h1)>", " ", inner))).split())
        assert r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None, "kept"), (1, "u", None, "kept"), (None, None, "", "kept"), (2, "u", f"<p>{GOOD}</p>", "kept")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, blocks string"))
    assert found.columns == ["page_id", "url", "html", "blocks", "text"]
    assert sorted((r.text, r.blocks) for r in found.collect()) == sorted([("", "kept")] * 3 + [(GOOD, "kept")])
    assert extract_text(spark.createDataFrame([], "html string")).count() == 0


POLISH = "Wieczorem poszliśmy nad rzekę, bo było ciepło i nikt nie chciał jeszcze wracać do domu. Na moście stał stary rybak, który od lat łowi tu ryby i zna każdy kamień."
RUSSIAN = "Вечером мы пошли к реке, потому что было тепло и никто не хотел идти домой. На мосту стоял старый рыбак, он давно ловит тут рыбу и знает каждый камень у воды."
CHINESE = "傍晚我们去了河边，因为天气很暖和，谁也不想回家。桥上站着一位老渔夫，他在这里钓鱼很多年了，认识每一块石头。他告诉我们，春天的时候，水会涨到桥边的树下，孩子们都喜欢在那里玩耍，一直玩到天黑才回家吃饭，从来没有人抱怨过什么。老人说完以后，又慢慢地把鱼线抛进水里，看着远处的山。"
ARABIC = "في المساء ذهبنا إلى النهر لأن الجو كان دافئا ولم يرد أحد أن يعود إلى البيت. على الجسر كان يقف صياد كبير في السن، وهو يصطاد هنا من زمن ويعرف كل حجر في الماء. قال لنا إن الماء يصل في كل عام إلى هذه الشجرة."


@pytest.mark.parametrize("text", [POLISH, RUSSIAN, CHINESE, ARABIC])
def test_text_of_any_language_without_marks(text):
    items = "".join(f"<li><a href='/{i}'>{text[i * 5 : i * 5 + 12]}</a></li>" for i in range(6))
    page = f"<html><body><ul>{items}</ul><div>" + f"<p>{text}</p>" * 3 + f"</div><ul>{items}</ul></body></html>"
    assert main_text(page) == " ".join([text] * 3)
