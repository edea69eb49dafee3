"""Main text of web pages: the contiguous region of a page whose words and tags have the highest total score.

A page is a sequence of words, which score by where they stand (plain text, link, list of links, boilerplate), and of
tags, which score below zero. The weights are log odds counted on labelled pages. One linear scan finds the region with
the highest sum; its blocks become the text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Where a comment, a declaration or a tag may begin.
START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: A tag after its "<": a slash, the name, attributes whose quoted values may hold ">".
TAG = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""")
#: Characters within which a quoted value has to end; beyond it a quote is an ordinary character of a tag that ends at the next ">".
QUOTED = 4096
#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head", "select", "audio", "video", "xmp"}
#: Elements that never hold the main text.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Class names, ids and roles of containers that hold something else than the main text: whole names, with a few words of place or form.
NAMED = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|entry|article|user|reader)[_-])?(?:ads?|adverts?|advertis\w+|banner|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|copyright|disqus|footer|foot|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|pagination|pager|popup|print-only|promo|promoted|recommend\w*|related|replies|share|sharing|sidebar|signup|site-header|skip|sponsor\w*|subscribe|subscription|teaser|toolbar|topbar|tracking|widget)(?:[_-](?:area|banner|bar|box|buttons?|consent|container|form|links?|list|menu|notice|posts|section|slot|unit|widget|wrapper|wrap|inner|content))?(?:$|\s)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: An open element of these is ended by the next of the same kind.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

BORDER = {"ul", "ol", "dl", "table", "tbody", "div", "td", "th", "blockquote", "section", "article", "form", "nav", "aside", "footer", "main", "header", "body"}

#: Labelled pages, fixed values: the page with its main text between the marks [[ and ]].
LABELLED = (
    "<html><head><title>A day</title><script>x()</script></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>News pages</a></ul></nav><div class=ad>Buy one get one</div><article>[[<h1>A day at the sea</h1><p>The water was cold and the wind came up early in the morning.</p><p>We walked for an hour along the <a href=3>old wall</a> and back.</p>]]</article><footer>All rights reserved 2020</footer></body></html>",
    "<body><div id=header><a href=/>Site</a> <a href=/a>About us</a></div><div id=main>[[<h2>Small gardens</h2><p>Plant the seeds in rows and water them well.<p>After two weeks the first leaves show; thin them out then.<ul><li>Use good soil.<li>Keep the bed free of weeds.</ul>]]</div><div class=comments><p>Great post, thank you!</p><p>I agree with all of it.</p></div><div class=footer>Contact</div></body>",
    "<body><header><h1>The Paper</h1><p>Your daily news</p></header><main>[[<h1>Council votes on bridge</h1><p>The council voted on Tuesday to build a second bridge across the river, after years of debate.</p><blockquote>It is the right step, said the mayor.</blockquote><p>Work begins next spring and will take three years.</p>]]</main><aside><h3>Read also</h3><ul><li><a>Ten best bridges</a><li><a>Rivers of the north</a></ul></aside><form>Your mail <input> Subscribe</form></body>",
    "<body><table><tr><td><a href=1>One</a><a href=2>Two</a></td><td>[[<p>This page tells how the mill works and who built it first.</p><p>Its wheel turns with the stream, day and night.</p>]]</td></tr></table><p class=cookie-notice>We use cookies on this site.</p></body>",
    "<body><nav>Start Shop</nav><article>[[<h1>Bread</h1><p>Knead the dough for ten minutes and let it rest.</p><aside>Our offer today</aside><p>Bake it until it is brown.</p>]]<div class=comments>So good! I made it twice.</div></article></body>",
)


class Source:
    """Finds the tags of a page; every search looks ahead a bounded way, or remembers that there is nothing ahead."""

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.ends: dict[str, re.Pattern] = {}
        self.missing: set[str] = set()

    def next_tag(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next markup from ``at`` on, and of a tag its slash, name and attributes (else no name)."""
        text = self.text
        while (m := START.search(text, at)) is not None:
            start, kind = m.start(), m[0]
            if kind == "<!--":
                end = text.find("-->", start + 4)
                return start, len(text) if end < 0 else end + 3, "", "", ""
            if kind == "<![CDATA[" and "]]>" not in self.missing:
                end = text.find("]]>", start)
                if end >= 0:
                    return start, end + 3, "", "", ""
                self.missing.add("]]>")
            if self.last < start:
                return None  # nothing ends any more: the rest is text
            end = text.find(">", start)
            if kind[1] in "!?":
                return start, end + 1, "", "", ""
            if '"' in (own := text[start + 1 : end + 1]) or "'" in own:
                tag = TAG.match(text, start + 1, max(end + 1, start + QUOTED)) or TAG.match(own.replace('"', " ").replace("'", " "))
                return start, tag.end() if tag.string is text else end + 1, tag[1], tag[2].lower(), tag[3]
            tag = TAG.match(own)
            return start, end + 1, tag[1], tag[2].lower(), tag[3]
        return None

    def element_end(self, name: str, at: int) -> int:
        """Where the next end tag of an element without markup inside begins, -1 if there is none."""
        if name in self.missing:
            return -1
        if name not in self.ends:
            self.ends[name] = re.compile(f"</{name}(?![a-z0-9])", re.I | re.A)
        m = self.ends[name].search(self.text, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.start()


class Page:
    """A page as segments: (kind, words, text, breaks a block) for text, (kind, 1, None, breaks) for tags."""

    def __init__(self, source: str, named: bool = True):
        self.named = named  # whether names tell boilerplate
        self.items: list[tuple[str, int, str | None, bool]] = []
        # of open elements: name, whether it or one around it is boilerplate, whether it stands in an article, and in one or a section
        stack: list[tuple[str, bool, bool, bool]] = []
        open_: dict[str, int] = {}
        at, n, items, pages = 0, len(source), self.items, Source(source)

        def close(i: int) -> None:
            for gone in stack[i:]:
                open_[gone[0]] -= 1
            del stack[i:]

        while at < n:
            tag = pages.next_tag(at)
            end = tag[0] if tag else n
            outside, within = stack[-1][1:3] if stack else (False, False)
            if end > at:
                text = html.unescape(source[at:end])
                kind = ("inner" if within else "boiler") if outside else "list" if open_.get("ul") or open_.get("ol") else "link" if open_.get("a") else "text"
                items.append((kind, len(text.split()), text, False))
            if not tag:
                break
            _, at, slash, name, attributes = tag
            if not name:
                continue
            if slash:
                if open_.get(name):
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            else:
                empty = attributes.endswith("/")
                if name in RAW and name != "head" and not empty:  # the end of a head may be left out
                    if (end := pages.element_end(name, at)) >= 0:
                        at = source.find(">", end) + 1 or n
                    elif name in ("script", "style"):  # others without an end are read as if the tag was not there
                        at = n
                    continue
                if name in SELF_ENDING and open_.get(name):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            close(i)
                            break
                        if stack[i][0] in BORDER:
                            break
                if name not in VOID and not empty:
                    if name == "a" and any(e[0] == "a" for e in stack[-3:]):
                        i = max(i for i, e in enumerate(stack[-3:]) if e[0] == "a") + max(0, len(stack) - 3)
                        open_["a"] -= 1
                        del stack[i]
                    outside, within, section = stack[-1][1:] if stack else (False, False, False)
                    own = self.boilerplate(name, attributes, within, section)
                    body = name in ("article", "main") and not (outside or own)
                    stack.append((name, outside or own, within or body, section or body or name == "section"))
                    open_[name] = open_.get(name, 0) + 1
            outside, within = stack[-1][1:3] if stack else (False, False)
            block = name not in INLINE
            # boilerplate within an article, such as an advert between its paragraphs, is of another kind than that around it
            items.append((("innertag" if within else "boilertag") if outside else "block" if block else "inline", 1, None, block))

    def boilerplate(self, name: str, attributes: str, within: bool, section: bool) -> bool:
        if name in OUTSIDE:
            return not (within and name == "label")
        if name == "header":  # a head inside an article holds its title
            return not section
        if not attributes or name in ("body", "html", "main", "article"):
            return False
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if self.named and key in ("class", "id", "role") and (NAMED.search(value) or re.fullmatch(r"(?:(?:page|site|main|global|top)[-_]?)?header", value)):
                return True
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return True
        return False


def weights(labelled: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Log odds, by kind of word or tag, of standing inside the main text."""
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for page in labelled:
        before, _, rest = page.partition("[[")
        own, _, after = rest.partition("]]")
        n = [sum(1 for _ in Page(p).items) for p in (before, before + own)]
        for i, (kind, words, _, _) in enumerate(Page(before + own + after).items):
            to = inside if n[0] <= i < n[1] else outside
            to[kind] = to.get(kind, 0) + words
    out = {k: math.log((inside.get(k, 0) + 1) / (outside.get(k, 0) + 1)) for k in ("text", "link", "list", "boiler", "inner", "block", "inline", "boilertag", "innertag")}
    out["inner"] = min(out["inner"], -0.1)
    for k in ("block", "inline", "boilertag", "innertag"):  # a tag never speaks for a region, and a paragraph of one word may end one
        out[k] = max(min(out[k], -0.1), -out["text"] / 16)
    return out


WEIGHTS = weights()


def region(items: list[tuple[str, int, str | None, bool]], weight: dict[str, float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest total score; nothing if none is above zero."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, words, _, _) in enumerate(items):
        total += weight[kind] * words
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(source: str | None, weight: dict[str, float] = WEIGHTS) -> str:
    """The main text of a page: white space within a block as one space, blocks joined by one."""
    items = Page(source or "").items
    low, high = region(items, weight)
    if low == high:  # all text stands in containers with such names
        items = Page(source or "", False).items
        low, high = region(items, weight)
    blocks: list[str] = []
    inline: list[str] = []
    for kind, _, text, breaks in items[low:high]:
        if text is not None:
            if kind not in ("boiler", "inner"):
                inline.append(text)
        elif breaks:
            if inline:
                blocks.append("".join(inline))
                inline = []
    blocks.append("".join(inline))
    return " ".join(" ".join(blocks).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    A null, empty or text-free page has the text "" and 0 characters. Repeated ids are read row by row, null ids and urls stay
    null, no rows give no rows, and other columns are not read.
    """

    def make():
        def run(part: pa.RecordBatch) -> list:
            texts = [main_text(s) for s in part.column(2).to_pylist()]
            return [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return run

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias(html_col))
    return map_rows(rows, make, f"{id_col} long, {url_col} string, text string, n_chars long", text=2)
