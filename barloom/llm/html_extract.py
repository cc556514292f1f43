"""Main-text extraction by line-block distribution."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Element names of the HTML standard, by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is no tags (they end at their end tag alone), and others that show no text of the page.
RAW = "script|style|textarea|title|iframe|xmp"
MUTE = frozenset("template noscript svg math select object canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button search".split())
CONTENT = frozenset("article main".split())
#: Words of a class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments respond disqus reply replies share sharing social related recommended"
    " newsletter subscribe subscription signup login search toolbar pager pagination widget complementary contentinfo disclaimer".split()
)
#: Words that go with them in a name such as site-footer or share_buttons; any other word makes the name one of its own.
FILLERS = frozenset(
    "site page main top bottom left right upper lower inner outer wrap wrapper container box block bar area section region group row col column list item items link links button buttons"
    " icon icons post posts article articles story stories content text form field unit slot primary secondary global mobile desktop fixed sticky the my js".split()
)
_ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^=>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b" + _ATTRIBUTES + r">.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?![a-zA-Z0-9:-])" + _ATTRIBUTES + r")>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Lines a window sums, and the sum at which text surges.
WINDOW = 3
SURGE = 80


class _Line:
    __slots__ = ("boiler", "content", "linked", "text", "title")

    def __init__(self, text: str, linked: int, boiler: bool, content: bool, title: bool):
        self.text, self.linked, self.boiler, self.content, self.title = text, linked, boiler, content, title


def lines_of(page: str) -> list[_Line]:
    """The page's blocks in order as lines without markup, each with the length of its link text and its region."""
    lines: list[_Line] = []
    parts: list[str] = []
    linked = 0
    in_link = title = False
    boiler: list[list] = []  # open boilerplate elements: [tag, depth of the same tag inside]
    content = 0
    mute: list = []  # the open element without text: [tag, depth of the same tag inside]
    ends_at: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            lines.append(_Line(text, linked, bool(boiler), content > 0, title))
        parts.clear()
        linked = 0

    def closes(tag: str, at: int) -> bool:
        """Whether an end tag follows; one that doesn't would hide the rest of the page."""
        if tag not in ends_at:
            ends_at[tag] = max((m.start() for m in re.finditer(f"</{tag}\\b", page, re.I)), default=-1)
        return ends_at[tag] > at

    last = 0
    for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):  # beyond it no tag ends, and looking for its end takes long
        if m.start() > last and not mute:
            piece = page[last : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        last = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
            continue
        tag, ends, rest = tag.lower(), bool(m["end"]), m["rest"]
        if mute:
            if tag == mute[0] and not rest.endswith("/"):
                mute[1] += -1 if ends else 1
                if not mute[1]:
                    mute = []
            continue
        if tag in MUTE:
            parts.append(" ")
            if not ends and not rest.endswith("/") and closes(tag, m.end()):
                mute = [tag, 1]
            continue
        if tag == "a":
            in_link = not ends
        if tag in BLOCKS:
            flush()
            title = tag == "h1" and not ends
            if boiler and (boiler[-1][0] == "p" or boiler[-1][0] == tag == "li") and not ends:
                boiler.pop()  # these end where the next one begins
        elif tag in ("br", "td", "th", "option", "img"):
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in CONTENT and not boiler:
            content = content + 1 if not ends else max(0, content - 1)
        elif tag == "main" and not ends:
            boiler.clear()  # an earlier region that never ended
            content += 1
        if ends:
            for k in range(len(boiler) - 1, -1, -1):
                if boiler[k][0] == tag:
                    if boiler[k][1]:
                        boiler[k][1] -= 1
                    else:
                        del boiler[k:]
                    break
        elif boiler and boiler[-1][0] == tag:
            boiler[-1][1] += 1
        elif tag in BOILERPLATE or (rest and tag in BLOCKS | {"span", "button"} and tag not in ("html", "body", "article", "main") and _marked(rest, tag in HEADINGS)):
            if tag not in BLOCKS:
                flush()
            boiler.append([tag, 0])
    if last < len(page) and not mute:
        parts.append(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", page[last:]))
    flush()
    return lines


def _names_boilerplate(token: str) -> bool:
    """Whether a class, id or role is made of marks, and of words that go with them, alone."""
    words = re.split(r"[-_]+", token.strip("-_"))
    return any(w in MARKS for w in words) and all(w in MARKS or w in FILLERS for w in words)


def _marked(rest: str, heading: bool) -> bool:
    """Whether the attributes hide an element or name it boilerplate; the name of a heading is an anchor to its text."""
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDING.search(value)):
            return True
        if name in ("class", "id", "role") and not heading and any(map(_names_boilerplate, value.lower().split())):
            return True
    return False


def weights_of(lines: list[_Line]) -> np.ndarray:
    """A line weighs its length; one in a region that markup names as content weighs a surge more.

    Regions named as boilerplate weigh nothing; nor do lines outside the content of a page that names it, and lines
    that are mostly links elsewhere.
    """
    named = any(x.content and not x.boiler for x in lines)

    def weigh(x: _Line) -> int:
        if x.boiler:
            return 0
        if x.content:
            return len(x.text) + SURGE
        return 0 if named or 2 * x.linked > len(x.text) else len(x.text)

    return np.array([weigh(x) for x in lines])


def main_text(page: str | None) -> str:
    """The blocks between the surges and dives of the line-block distribution, joined by blank lines.

    The lines' weights are summed over sliding windows, from each line on. Where the sum surges over SURGE (or over the
    page's highest sum, if that is lower) a block begins: at the first line with a weight, or, where no content is
    named, at a title in the same run of lines up to a window on, since what stands before the title is not the
    article. The block ends where the sum dives to nothing, and its lines without weight go.
    """
    lines = lines_of(page) if page else []
    if not lines:
        return ""
    weight = weights_of(lines)
    sums = np.convolve(weight, np.ones(WINDOW, int))[WINDOW - 1 :]  # of a line and those after it
    surge = min(SURGE, int(sums.max(initial=0))) or 1
    kept: list[str] = []
    i = run = 0  # run: the first of the lines with weight up to i
    while i < len(lines):
        if sums[i] < surge:
            i += 1
            run = run if weight[i - 1] else i
            continue
        while not weight[i]:
            run = i = i + 1
        if not lines[i].content:
            i = next((k for k in range(run, min(i + WINDOW, len(lines))) if lines[k].title and weight[k]), i)
        while i < len(lines) and sums[i]:  # until the dive
            if weight[i]:
                kept.append(lines[i].text)
            run = i = i + 1
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text, and n_chars, its code points, in the place of html_col.

    A null or empty page has the empty text. Rows are independent: repeated ones give the same text, and an empty table
    gives no rows. Columns of pages named like out_col or n_chars are replaced.
    """
    others = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    rows = pages.select(*others, text_of(html_col).alias("_html"))

    def extract(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], out_col, "n_chars"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(extract, f"{out}, `{out_col}` string, n_chars long")
