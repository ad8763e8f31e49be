"""Pages whose shape once lost the article: omitted end tags, a form around the page, formulas, hidden parts, quotes that do not end."""

import time

import pytest

from scholia.llm import html_extract

STORY = "story words go on " * 12
LONG = f"<p>{STORY}</p>"
TEXT = STORY.strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><body><article>{LONG}</article>", f"<html><head><title>t</title><meta charset=x><div>{LONG}</div>", f"<head><script>x</script></head><body>{LONG}", f"<html><head><link rel=x></body><article>{LONG}</article>",
        f"<body><form id=f action=x><main><article>{LONG}</article></main></form>", f"<body><form><div>{LONG}</div><input><button>Go</button></form>", f"<body><form><nav><a href=x>menu</a></nav><article>{LONG}</article></form>",
    ],
)
def test_article_is_kept(page):
    assert html_extract.extract(page, []) == TEXT


def test_forms_beside_the_article_go():
    page = f"<body><form><label>Search here for all that you want</label></form><article>{LONG}<form><p>Write what you think of it</p></form></article>"
    assert html_extract.extract(page, []) == TEXT
    assert html_extract.extract(f"<body>{LONG}<form><p>{STORY[:100]}</p></form>", []) == TEXT


def test_formulas_are_text():
    page = f"<article>{LONG}<p>The sum <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation encoding=x>a+1</annotation></math> is known.</p></article>"
    assert html_extract.extract(page, []) == f"{TEXT}\n\nThe sum a+1 is known."


@pytest.mark.parametrize("mark", ["hidden", "hidden=hidden", 'class="x" hidden', "HIDDEN id=a", 'style="color:red; display: none"'])
def test_hidden_parts_go(mark):
    assert html_extract.extract(f"<article>{LONG}<div {mark}>{LONG}</div><p data-hidden=1 title='is hidden here'>end</p></article>", []) == f"{TEXT}\n\nend"


@pytest.mark.parametrize("piece", ['<a ">"', "<a '", '<a href="', "<a", '<p "', "<!", "<!--", "<form>", "<head>", "<math>"])
def test_tags_without_end_take_linear_time(piece):
    def seconds(n):
        begin = time.perf_counter()
        html_extract.extract("<p>x</p>" + piece * n, [])
        return time.perf_counter() - begin

    small, large = max(seconds(4000), 0.02), seconds(32_000)
    assert large < 30 * small
    assert seconds(170_000) < 20 or piece not in ('<a ">"',)
