"""HTML extraction by line-block distribution.

A page's markup is stripped to lines, one for each block of text, in page order, and the
text lengths of ``WIDTH`` lines from each line on are summed.  A surge point is where the
sums reach the threshold and a dive point where they fall below it; the threshold is a
``SHARE`` of the page's own largest sum, at most ``SURGE``.  The lines from the first to the
last heavy one between surge and dive are kept, whatever they hold.

Tags are evidence for the sums.  Lines of menus, headers, footers, sidebars, notices,
adverts, forms, comments and hidden parts have no length, and neither has text in links, or,
where a page marks articles, text outside of them.  A left-out part inside one container
isn't a line at all, elsewhere it is as many empty lines as a window has.  What is kept is
completed to its container, so short lines before a surge or behind a dive aren't lost:
the marked article as a whole, elsewhere the containers of the heavy lines, as far as no
window of empty or link-only lines comes between.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

#: Lines in a window, the largest threshold, and the threshold's share of the page's largest sum.
WIDTH, SURGE, SHARE = 3, 120, 0.4
#: The threshold on pages whose marked article has nothing to keep.
DOUBTFUL = 60
#: Empty lines that stand for a part that is left out, so that no window bridges it.
BREAK = WIDTH

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^'">])*+)>|<[/a-zA-Z][^<>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside form script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml canvas object audio video select button dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that tell one part of a page from another; other blocks belong to what is around them.
CONTAINERS = frozenset("body div td th center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of their kind ends, and those that it doesn't look beyond.
SELF_CLOSING = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words for parts that aren't the article: a class or id name says so if it has one of them
#: and otherwise only words of layout, and a class name also by a first word of ``FIRST`` and a known last one.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus respond replies newsletter subscribe subscription signup social share sharing related recommended popup modal overlay toolbar pagination pager widget widgets footer masthead login".split()
)
FIRST = frozenset("ad ads advert advertisement adsense adsbygoogle cookie cookies consent gdpr navbar breadcrumb breadcrumbs disqus newsletter pagination masthead sidebar".split())
LAYOUT = frozenset(
    "main primary secondary top bottom left right middle site page global local post posts article articles story stories entry entries content header head foot body area bar block box button buttons card cards container wrapper wrap inner outer holder slot unit zone column columns col section sections group list lists item items link links icon icons text title heading label form field fields input image media panel module region row set stack strip desktop mobile tablet inline sticky fixed float large small more count number numbers previous prev next dialog message thread tree google dfp mpu leaderboard skyscraper rectangle facebook twitter email print".split()
)
#: Elements whose ids count inside an article; ids of sections, headings, paragraphs and the like come from titles.
ID_INSIDE = frozenset("div ul ol".split())
WHOLE_NAMES = frozenset("header site-header page-header top-header global-header siteheader pageheader".split())
STATES = frozenset("no has with without is".split())
#: Words for what an article's own header says of the article, beside its headings.
STANDFIRST = frozenset("standfirst lede lead intro introduction summary subtitle subheading subhead dek deck abstract excerpt strapline".split())
KNOWN, SIZE = PARTS | LAYOUT, re.compile(r"\d+(?:x\d+)?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _left_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")) or attributes.get("role", "").lower() in ROLES:
        return True
    classes = attributes.get("class", "").lower().split()
    by_id = name in ID_INSIDE and "section" not in classes if in_article else name in BLOCKS - HEADINGS - {"p"}
    for k, own in enumerate(classes + (attributes.get("id", "").lower().split() if by_id else [])):
        words = [x for x in re.split(r"[^a-z0-9]+", own) if x and not SIZE.fullmatch(x)]
        if own in WHOLE_NAMES or k < len(classes) and words and words[0] in FIRST and words[-1] in KNOWN:
            return True
        if words and words[0] not in STATES and not PARTS.isdisjoint(words) and KNOWN.issuperset(words):
            return True
    return False


def page_lines(page: str) -> tuple[list[tuple[str, int, int, int]], bool, list[int]]:
    """The page's lines, whether it marks an article, and the container around each container.

    A line has its text, characters outside of links, the number of the article that has it
    (0 for none), and its block's container; left-out parts are empty lines.
    """
    lines: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, bool, int, bool, int, int]] = []  # name, left out, in an article, in a link, container of its block and of blocks in it
    buffer: list[str] = []
    plain: list[str] = []
    out = link = marked = False
    article = articles = 0
    parents = [0]

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            lines.append((text, len(" ".join("".join(plain).split())), article, stack[-1][4] if stack else 0))
        buffer.clear()
        plain.clear()

    def add(raw: str) -> None:
        if raw and not out:
            text = html.unescape(raw)
            buffer.append(text)
            plain.append(" " if link else text)

    def pop(to: int) -> None:
        nonlocal out, article, link
        if any(x[0] in BLOCKS for x in stack[to:]):
            flush()
        del stack[to:]
        was = out
        _, out, article, link, _, _ = stack[-1] if stack else ("", False, 0, False, 0, 0)
        if was and not out:
            lines.extend([("", 0, 0, 0)] * BREAK)

    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if to is not None:
                pop(to)
            elif name in BLOCKS:
                flush()
            continue
        if name in ("br", "hr", "wbr", "img"):
            if name == "hr":
                flush()
            elif name != "wbr":
                add(" ")
        if name in VOID:
            continue
        if name in BLOCKS:
            flush()
            ends, bounds = (name, SELF_CLOSING[name].split()) if name in SELF_CLOSING else ("p", ())
            for i in range(len(stack) - 1, -1, -1):
                other = stack[i][0]
                if other == ends or name in ("td", "th") and other in ("td", "th"):
                    pop(i)
                    break
                if other in bounds or ends == "p" and other in BLOCKS:
                    break
        attributes = _attributes(m["attributes"]) if m["attributes"] else {}
        if not out:
            now = _left_out(name, attributes, article > 0)
            if now and name in BLOCKS:
                flush()
            if article and stack and any(x[0] == "header" for x in stack) and name not in HEADINGS and name in BLOCKS - {"div", "hgroup", "header"}:
                now = now or STANDFIRST.isdisjoint(re.split(r"[^a-z0-9]+", attributes.get("class", "").lower()))
            out = now
        if not article and (name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop") == "articleBody"):
            article = articles = articles + 1
        marked = marked or article > 0 and not out
        link = link or name == "a"
        around, inside = stack[-1][4:] if stack else (0, 0)
        if name in BLOCKS:
            around = inside
        if name in CONTAINERS:
            parents.append(inside)
            inside = len(parents) - 1
        stack.append((name, out, article, link, around, inside))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if name == "textarea" and not out:
                add(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            pop(len(stack) - 1)
    add(page[at:])
    flush()
    return lines, marked, parents


def stretches(sizes: list[int], threshold: float) -> list[list[int]]:
    """The heavy lines between each surge and its dive: those of at least the threshold's share of a line."""
    found: list[list[int]] = []
    end = -1  # the last line of the last window that reached the threshold
    for i in range(len(sizes)):
        if sum(sizes[i : i + WIDTH]) < threshold:
            continue
        if i == 0 or sum(sizes[i - 1 : i - 1 + WIDTH]) < threshold:
            found.append([])
        last = min(i + WIDTH, len(sizes))
        found[-1].extend(k for k in range(max(i, end + 1), last) if WIDTH * sizes[k] >= threshold)
        end = last - 1
    return [f for f in found if f]


def _containers(heavy: list[int], parents: list[int]) -> set[int]:
    """The containers that heavy lines in ``heavy`` complete: their own, and what is around three of them or more."""
    own = set(heavy)
    around = Counter(parents[c] for c in own if c and parents[c] > 1)  # the body is no part of a page
    return own | {c for c, n in around.items() if n >= 3}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty where there is none."""
    lines, marked, parents = page_lines(page or "")
    inside = any(article for text, _, article, _ in lines if text)
    rows: list[tuple[str, int, int]] = []  # text, length for the sums, container
    last = None  # container of the last line with text
    for text, size, article, container in lines:
        if inside:
            text, size, container = (text, len(text), article) if article else ("", 0, 0)
        while text and container == last and rows and not rows[-1][0]:
            rows.pop()
        rows.append((text, size, container))
        last = container if text else last
    sizes = [size for _, size, _ in rows]
    peak = max((sum(sizes[i : i + WIDTH]) for i in range(len(sizes))), default=0)
    threshold = DOUBTFUL if marked and not inside else min(SURGE, max(1, peak * SHARE))
    kept: set[int] = set()
    for heavy in stretches(sizes, threshold):
        kept.update(range(heavy[0], heavy[-1] + 1))
        held = [rows[k][2] for k in heavy]
        parts = set(held) if inside else _containers(held, parents)
        for step, at in ((-1, heavy[0] - 1), (1, heavy[-1] + 1)):
            empty, part = 0, []
            while 0 <= at < len(rows) and (inside or empty < WIDTH):
                text, size, container = rows[at]
                own = text and (container in parts or not inside and parents[container] in parts)
                empty = 0 if own and size else empty + 1
                if own:
                    part.append(at)
                at += step
            while not inside and part and not sizes[part[-1]]:  # a menu's beginning
                part.pop()
            kept.update(part)
    return "\n".join(rows[k][0] for k in sorted(kept) if rows[k][0])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text and n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks
    are trimmed and joined by one line feed.  A line break inside a block is white space.

    A null, empty or text-free page gives an empty text.  Broken markup is read as far as it
    can be: open elements end with their parents, stray end tags are ignored.  Null ids and
    URLs and repeated rows pass through; other columns are ignored; an empty table gives an
    empty result.
    """
    bound_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = base.mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
