"""Pages that the block rules got wrong, pages made to be slow, and rows with nulls, repeats and other columns."""

import time

import pytest

from runloom.llm import html_text

RUSSIAN = "Это длинный абзац статьи на русском языке, который рассказывает о погоде. Вчера шёл дождь, сегодня светит солнце."
CHINESE = "这是一篇关于天气的文章。昨天下了很大的雨，今天出了太阳，人们都到公园里去散步了。明天可能还会下雨。"
LINKS = "<ul><li><a href=a>Один</a></li><li><a href=b>Два</a></li></ul>"
PROSE = "The storm is on the way and it was said that all of the people have to be in the house by then."


@pytest.mark.parametrize("page, text", [
    ("<article><p><a href=x>All of it is a link</a></p></article>", "All of it is a link"),
    (f"<article><p>{PROSE}</p><ul><li><a href=x>One link</a></li></ul></article>", f"{PROSE} One link"),
    (f"<article><div class=alert>{PROSE}</div><div class='side'>{PROSE}</div></article>", f"{PROSE} {PROSE}"),
    (f"<article><p>{PROSE}</p><div class=share>Share this</div></article>", PROSE),
    (f"<article><p>{PROSE}</p><section class='reader-responses'><p>{PROSE}</p></section></article>", PROSE),
    (f"<article><p>{PROSE}</p><section id='readerComments'><p>{PROSE}</p></section></article>", PROSE),
    (f"<body>{LINKS}<div><h1>Погода</h1><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div></body>", f"Погода {RUSSIAN} {RUSSIAN}"),
    (f"<body>{LINKS}<div><p>{CHINESE}</p></div></body>", CHINESE),
    (f"<form id=page><main><p>{PROSE}</p></main></form>", PROSE),
    (f"<main><form><p>{PROSE}</p></form><p>{PROSE}</p></main>", PROSE),
    (f"<article><p title='a > b' data-class=ad>{PROSE}</p></article>", PROSE),
    ("<article><p>a < b &lt; c <3 &#99999999999999;</p></article>", "a < b < c <3 �"),
    ("<article><p>text</p><!-- never closed <p>gone</p>", "text"),
    ("<article><p>text</p><p class='never closed", "text"),
    ("", ""), (None, ""), ("<", ""), ("</", ""), ("no markup", "")])
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("unit", [
    "<a '", "<a x='>'", "<a ", "<head>", "<", "<!--", "<p class='", "<script>", "</script", "<a x=\"", "<li>", "<p>a", "&", "<a = =", "<div></p>"])
def test_long_pages_are_read_in_linear_time(unit):
    page = unit * (400_000 // len(unit))
    start = time.process_time()
    html_text.main_text(page)
    html_text.main_text("<p " + unit[-1] * 400_000 + ">")
    html_text.main_text("&#" + "9" * 400_000 + ";")
    assert time.process_time() - start < 4


def test_rows(spark):
    page = f"<article><p>{PROSE}</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "v", None, None), (3, "w", "", "y")],
                                  "page_id long, url string, html string, text string")
    got = html_text.extract_main(pages)
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, len(PROSE)), (1, len(PROSE)), (1, len(PROSE)), (2, 0), (3, 0)]
    assert html_text.extract_main(pages.limit(0)).count() == 0
