"""Main text of a page by two passes over its blocks.

First pass: stop-word density, length and link density decide blocks; blocks that stand in page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) are decided by
their place. On pages whose language has no stop words here, length and sentence marks take the
place of their density. Second pass: short, middling and link-heavy article blocks take the label
of the nearest decided neighbours; both neighbours bad makes bad, otherwise a block inside an
article is good.

A page is read once from left to right: a tag ends at the first ">" outside of quoted values, and a
tag, comment or script that is never closed reaches to the end of the page, as in browsers.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from runloom.llm.common import table

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
#: Numbers beyond all code points: int() would refuse the longest of them.
_FAR_REFERENCE = re.compile(r"&#0*+([1-9][0-9]{7})[0-9]*+;?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title svg math iframe object select head".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that name page furniture, and those that do so inside an article for short blocks only.
_FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|sidebar|nav|navbar|navigation|breadcrumbs?|footer|"
    r"masthead|comments?|replies|responses?|reactions?|discussion|disqus|newsletter|subscribe|related|pagination|pager|complementary|"
    r"contentinfo)(?:$|[\s_-])", re.IGNORECASE)
_MAYBE_NAME = re.compile(
    r"(?:^|[\s_-])(?:banner|side|menu|nav\w*|header|share|social|widget|toolbar|login|search|alert)(?:$|[\s_-])", re.IGNORECASE)
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one were all "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux "
    "el los las del y por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre".split())
_SENTENCE_MARK = re.compile(r"[.!?…。！？｡؟۔।॥።]")
NONE, MAYBE, FORM, SURE = range(4)


def blocks_of(page: str) -> list[list]:
    """Blocks in page order: [text, characters in links, furniture (NONE to SURE), inside article or main?, heading?]."""
    blocks: list[list] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = [("", NONE, False, False)]  # name, furniture, main, link
    opened: Counter = Counter()
    endless: set[str] = set()
    linked = at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append([text, linked, stack[-1][1], stack[-1][2], bool(re.fullmatch("h[1-6]", stack[-1][0]))])
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(_FAR_REFERENCE.sub("\ufffd", raw)) if "&" in raw else raw
        parts.append(text)
        if stack[-1][3]:
            linked += len("".join(text.split()))

    def skip(end: str, start: int) -> int:
        found = page.find(end, start)
        return found + len(end) if found >= 0 else len(page)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        at = start + 1
        mark = page[at:at + 2]
        if mark[:1] in ("!", "?"):
            at = skip("-->", at + 3) if page.startswith("!--", at) else skip("]]>", at) if page.startswith("![CDATA[", at) else skip(">", at)
            continue
        if not (mark[1:] if mark[:1] == "/" else mark[:1]).isascii() or not (mark[1:] if mark[:1] == "/" else mark[:1]).isalpha():
            add("<")
            continue
        m = _TAG.match(page, start)
        if not m:
            break
        at = m.end()
        name = m[2].lower()
        closing = m[1] == "/"
        if name in RAW:
            if not closing and not m[3].endswith("/") and name not in endless:
                end = re.compile(rf"</{name}\s*+>" if name != "head" else r"</head\s*+>|<body", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end() if not end[0].startswith("<b") else end.start()
                elif name != "head":
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name in BLOCK:
            close()
        if name in VOID or m[3].endswith("/"):
            continue
        if not closing:
            if name in ("p", "li", "tr", "td", "option") and stack[-1][0] == name:
                opened[stack.pop()[0]] -= 1
            _, furniture, main, link = stack[-1]
            marks = " ".join(x or y or z for key, x, y, z in _ATTRIBUTE.findall(m[3]) if key.lower() in ("class", "id", "role")) if m[3] else ""
            if name in ("article", "main"):
                furniture = NONE if furniture == FORM else furniture
                main = True
            elif name in FURNITURE and not (name == "header" and main):
                furniture = max(furniture, FORM if name == "form" else SURE)
            elif marks and name not in ("html", "body"):
                marks = _CAMEL.sub("-", marks)
                furniture = max(furniture, SURE if _FURNITURE_NAME.search(marks) else MAYBE if _MAYBE_NAME.search(marks) else NONE)
            stack.append((name, furniture, main, link or name == "a"))
            opened[name] += 1
        elif opened[name]:
            while True:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == name:
                    break
    close()
    return blocks


def _density(text: str) -> float:
    """Share of stop words among the words of a block."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _weight(text: str) -> int:
    """Length of a block; a wide character, which is about half a word, counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * sum(unicodedata.east_asian_width(c) == "W" for c in text)


def classify(blocks: list[list], long_chars: int = 140, short_chars: int = 60, stop_low: float = 0.1,
             stop_high: float = 0.2, most_links: float = 0.4) -> list[bool]:
    """Label of each block after both passes."""
    anywhere = any(b[3] and b[2] < FORM for b in blocks)
    dense = [_density(b[0]) for b in blocks]
    # A language without stop words here: no long block outside of furniture has some.
    unknown = not any(d >= stop_low and b[2] < FORM and len(b[0]) >= short_chars for d, b in zip(dense, blocks, strict=True))
    first: list[str] = []
    for (text, linked, furniture, main, heading), density in zip(blocks, dense, strict=True):
        size = _weight(text) if unknown else len(text)
        links = linked / max(1, len(text.replace(" ", "")))
        if unknown:
            prose = size >= short_chars and links <= most_links / 2 and bool(_SENTENCE_MARK.search(text))
        else:
            prose = density >= stop_high or (size > long_chars and density >= stop_low)
        prose = prose and size >= short_chars and not heading and links <= most_links
        if furniture >= FORM or (anywhere and not main) or (furniture == MAYBE and not (main and prose)):
            first.append("bad")
        elif links > most_links and not main:
            first.append("bad")
        elif text.startswith("©") and not main:
            first.append("bad")
        elif size < short_chars or heading or links > most_links:
            first.append("short")
        else:
            first.append("good" if prose else "near")
    before: list[str] = []
    last = ""
    for x in first:
        before.append(last)
        last = x if x in ("good", "bad") else last
    after, last = [], ""
    for x in reversed(first):
        after.append(last)
        last = x if x in ("good", "bad") else last
    after.reverse()
    return [x == "good" or (x != "bad" and (b[3] or "good" in (p, q) or (x == "near" and not p and not q)))
            for x, p, q, b in zip(first, before, after, blocks, strict=True)]


def main_text(page: str | None) -> str:
    return text_of(blocks_of(page)) if page else ""


def text_of(blocks: list[list]) -> str:
    """Main text of the blocks of a page."""
    return " ".join(b[0] for b, good in zip(blocks, classify(blocks), strict=True) if good)


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (columns page_id, url, html).

    Null or empty html gives empty text; a page without article text gives empty text; repeated rows
    are each extracted; other columns are ignored; an empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main(table(spark, folder, "pages"))
