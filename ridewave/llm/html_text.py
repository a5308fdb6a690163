"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element.  On every page a line weighs its characters outside links; inside an
article or main element it weighs ``raised`` times all its characters.  Lines of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments weigh nothing, article elements so named included.  The weights are summed over windows of ``width`` lines.
Text surges where a window reaches ``surge`` and dives where the next window is empty; the lines between a surge and
its dive that have weight are kept.  A class or id names such a part by a whole class token, or by the part of it before the
first hyphen, underscore or change of case.

Defined results: a null or empty page, or one without an article text, gives an empty text; unclosed elements
end with their parent, with the article or with the page; script and style text never counts, whatever it holds; repeated rows
give equal texts; nothing is capped; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import slices, small_batches

# Element names of HTML and customary names of page parts.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
    tbody td tfoot th thead tr ul""".split())
LEFT_OUT = frozenset("aside button datalist dialog fieldset footer form header input label menu nav option search select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted
    promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|audio|video)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LEADING = re.compile(r"[A-Z]*[a-z]*")


def _names_part(value: str) -> bool:
    """Whether a class token, or its leading part, is the name of a page part."""
    return any(t.lower() in PARTS or LEADING.match(t)[0].lower() in PARTS for t in value.split())


def _left_out(name: str, rest: str, in_article: bool) -> bool:
    if name in LEFT_OUT and not (in_article and name == "header"):
        return True
    if rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "role" and value.lower() in ROLES:
                return True
            if key in ("class", "id") and name not in ("body", "html", "main") and _names_part(value):
                return True
    return False


def _unclosed(tokens: list[re.Match]) -> set[int]:
    """Where elements start that no end tag closes."""
    open_at: dict[str, list[int]] = {}
    for token in tokens:
        if name := token["name"]:
            held = open_at.setdefault(name.lower(), [])
            if not token["end"]:
                held.append(token.start()) if not token["rest"].endswith("/") else None
            elif held:
                held.pop()
    return {at for held in open_at.values() for at in held}


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Lines (text, characters outside links, inside an article or main element) of a page.

    Left-out parts give empty lines, which end a run of text.
    """
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    skip, depth, inner, loose, link, article = "", 0, 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, max(0, len(text) - linked), article > 0))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skip:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    at, tokens = 0, list(TOKEN.finditer(page))
    unclosed = _unclosed(tokens)
    for token in tokens:
        add(page[at:token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            if token["raw"]:
                parts.append(" ") if not skip else None
            continue
        name, closing = name.lower(), bool(token["end"])
        if name in ("article", "main"):
            if skip and not closing and (name == "main" or loose and not article):
                skip = ""  # a part without an end tag ends where an article begins
            elif skip and name != skip:
                if not closing:
                    inner += 1
                elif inner:
                    inner -= 1
                else:
                    skip = ""  # the article ends around the part
            if not skip and (closing or not _left_out(name, token["rest"], article > 0)):
                flush()
                article = max(0, article + (-1 if closing else 1))
                link = 0
                continue
        if skip:
            if name == skip:
                depth += -1 if closing else not token["rest"].endswith("/")
                if depth <= 0:
                    skip = ""
                    lines.append(("", 0, article > 0))
            elif closing and name in ("body", "html"):
                skip = ""
            continue
        if not closing and _left_out(name, token["rest"], article > 0):
            flush()
            if name not in VOID and not token["rest"].endswith("/"):
                skip, depth, inner, loose = name, 1, 0, token.start() in unclosed
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name in BLOCKS:
            flush()
            link = 0
        elif name == "br":
            parts.append(" ")
    add(page[at:])
    flush()
    return lines


def main_text(page: str, width: int = 3, surge: int = 80, raised: int = 8) -> str:
    lines: list[tuple[str, int, bool]] = []
    for line in page_lines(page):
        if lines and line[2] != lines[-1][2]:
            lines += [("", 0, line[2])] * width  # windows do not reach across the edge of an article
        lines.append(line)
    weights = [raised * len(text) if inside else n for text, n, inside in lines]
    sums = [sum(weights[i:i + width]) for i in range(len(weights))]
    keep = [False] * len(lines)
    at = 0
    while at < len(lines):
        if sums[at] < surge or not weights[at]:
            at += 1
            continue
        end = at  # from the surge to the dive
        while end < len(lines) and sums[end] > 0:
            end += 1
        for i in range(at, end):
            keep[i] = weights[i] > 0
        at = end
    return "\n\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract_text(pages: DataFrame, width: int = 3, surge: int = 80) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8_000_000):
            texts = [main_text(p, width, surge) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
