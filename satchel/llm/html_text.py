"""Main text of web pages by tag-path ratios.

A page is read once, in time linear in its length, into blocks of text. A block's path are the block elements from the root
to it; elements with a class are told apart by it, others that hold blocks by their place among their like. Text length and
punctuation are summed for each path and divided by its number of blocks. These two ratios and the path's text are scaled
by the page's largest, smoothed over neighbouring blocks in page order by a Gaussian kernel, and fused, smoothed and as they
are, by a geometric mean. Paths whose mean score is a share of the scores' standard deviation or more are content, and their
blocks are the article. Headings and short blocks that score less belong to it where the smallest element that holds most
of the content holds them too. Tags, roles and class names that say menu, header, footer, side column, notice, advert, form
or reader comment divide a path's score by a hundred, unless the element holds most of the page's text and its heading, or
nearly all there is. Paths that are mostly links are no content.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
#: The rest of a tag; a quote counts only after an equals sign.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: Elements whose inside is no text of the page.
UNREAD = frozenset("script style noscript template svg iframe textarea select title object math".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset details summary address hr center dialog menu head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_BREAKS = frozenset("br img input".split())
#: An opening tag ends an open element of these kinds, if no element of the second kinds is between.
ENDS = {
    "p": ({"p"}, {"td", "th", "blockquote", "div", "li", "article", "section"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that are marked as no article, and those of them that stay marked whatever they hold.
LEFT_OUT = frozenset("nav footer aside header form head button dialog menu label fieldset".split())
NEVER = frozenset("nav menu footer".split())
#: What an open head may hold; anything else ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 article main".split())
#: Elements that hold one block and so are never the article's element.
LEAVES = frozenset("p li dt dd td th caption summary figcaption blockquote pre h1 h2 h3 h4 h5 h6".split())
#: A marked element that holds over half of the text counts as unmarked if less than this share is outside such elements.
ELSEWHERE = 0.1
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names of elements that are not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|adsense|banner|sponsor|sponsored|promo|promotion|promoted|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|toolbar|topbar|"
    r"header|masthead|footer|foot|copyright|sidebar|side|aside|rail|widget|widgets|related|recommended|recommendations|popular|trending|notice|notices|cookie|cookies|consent|gdpr|alert|banner|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|form|search|share|sharing|social|comment|comments|commentlist|respond|reply|replies|discussion|disqus|tags|toc|skip)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words of class names that name a part's absence or presence, and the header of an article.
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:has|with|no|without)[_-][\w-]+|(?:entry|post|article|story|content)[_-]+header)(?=$|\s)", re.I)
#: An attribute without a value, and styles, that hide an element.
HIDDEN, UNSEEN = re.compile(r"(?:^|\s)hidden(?=$|[\s/])", re.I), re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What the score of a marked path is multiplied by, and the least score of a content path.
PENALTY, LEAST = 0.01, 0.02
#: Weight of the smoothed ratios beside a path's own.
SMOOTH = 0.25
#: Open elements; deeper ones count as part of the last.
MAX_DEPTH = 256


@dataclass
class Block:
    text: str
    path: int
    element: int
    linked: int


@dataclass
class Open:
    """An open element: its block element, that element's path, the path for elements inside, whether text is left out."""

    tag: str
    element: int
    path: int
    inner: int
    out: bool
    like: dict[str, int] = field(default_factory=dict)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _named_out(attributes: dict[str, str]) -> bool:
    names = LAYOUT.sub("", CAMEL.sub("-", f"{attributes.get('class', '')} {attributes.get('id', '')}")).strip()
    return bool(names and NAMES.search(names)) or attributes.get("role", "").lower() in ROLES


class Page:
    """The blocks of a page in order, and of each element its parent, tag and marks. Element 0 is the page."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.tags, self.parent, self.marked, self.never = [""], [0], [False], [True]
        self.paths: dict[tuple[int, str], int] = {}
        self.headed: set[int] = set()
        self._stack = [Open("", 0, 0, 0, False)]
        self._count: dict[str, int] = defaultdict(int)
        self._skipped: dict[str, int] = defaultdict(int)
        self._parts: list[str] = []
        self._linked = 0
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        lower, at, last = page.lower(), 0, page.rfind(">")
        if len(lower) != len(page):  # a few capitals become two letters
            lower = re.sub("[A-Z]+", lambda m: m[0].lower(), page)
        quoted = True
        while (lt := page.find("<", at)) >= 0:
            following = page[lt + 1 : lt + 2]
            if following == "!" or following == "?":
                self._add(page[at:lt])
                long = page.startswith("<!--", lt)
                end = page.find("-->" if long else ">", lt + (4 if long else 1))
                at = len(page) if end < 0 else end + (3 if long else 1)
                continue
            close = following == "/"
            name = NAME.match(page, lt + 1 + close)
            if not name or lt > last:  # no tag, or one without an end
                if lt > last:
                    self._add(page[at:lt])
                    at = len(page) if name else lt
                    if not name:
                        break
                    continue
                self._add(page[at : lt + 1])
                at = lt + 1
                continue
            self._add(page[at:lt])
            rest = REST.match(page, name.end()) if quoted else None
            if rest is None:  # a quote that nothing closes: from here on quotes mean nothing
                quoted = False
            at = rest.end() if rest else page.find(">", name.end()) + 1
            tag = name[0].lower()
            if close:
                self._close_tag(tag)
            elif tag in UNREAD:
                end = lower.find(f"</{tag}", at)
                end = len(page) if end < 0 else page.find(">", end)
                at = len(page) if end < 0 else end + 1
            else:
                self._open_tag(tag, page[name.end() : at - 1])
        self._add(page[at:])

    def _add(self, text: str) -> None:
        if not text:
            return
        if self._stack[-1].tag == "head" and text.strip():
            self._close(len(self._stack) - 1)
        if not self._stack[-1].out:
            self._parts.append(html.unescape(text))  # here, as a tag ends a reference
            if self._count["a"]:
                self._linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            own = next(s for s in reversed(self._stack) if s.tag in BLOCKS or not s.element)
            self.blocks.append(Block(text, own.path, own.element, self._linked))
        self._parts, self._linked = [], 0

    def _close(self, to: int) -> None:
        if any(s.tag in BLOCKS for s in self._stack[to:]):
            self._flush()
        for s in self._stack[to:]:
            self._count[s.tag] -= 1
        del self._stack[to:]

    def _close_tag(self, tag: str) -> None:
        if self._skipped[tag]:
            self._skipped[tag] -= 1
            return
        if not self._count[tag]:
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._close(i)
                return
            if self._stack[i].tag in BLOCKS and tag not in BLOCKS:
                return

    def _close_first(self, tag: str) -> None:
        if self._count[tag]:
            self._close(next(i for i, s in enumerate(self._stack) if s.tag == tag))

    def _open_tag(self, tag: str, raw: str) -> None:
        if tag not in IN_HEAD:
            self._close_first("head")
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            for i in range(len(self._stack) - 1, 0, -1) if any(self._count[t] for t in ended) else ():
                if self._stack[i].tag in ended:
                    self._close(i)
                    break
                if self._stack[i].tag in bounds:
                    break
        elif tag in BLOCKS:
            self._close_first("p")
        if tag in BLOCKS:
            self._flush()
        if tag in INLINE_BREAKS:
            self._add(" ")
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCKS:
            return
        if len(self._stack) > MAX_DEPTH:
            self._skipped[tag] += 1
            return
        above, block, attributes = self._stack[-1], tag in BLOCKS, _attributes(raw)
        titled = tag == "header" and bool(self._count["article"] or self._count["main"])  # an article's own header has its title
        hidden = attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(ATTRIBUTE.sub(" ", raw))) or "hidden" in attributes and attributes["hidden"] != "until-found" or bool(UNSEEN.search(attributes.get("style", "")))
        marked = tag in LEFT_OUT and not titled or hidden or (tag not in ("html", "body", "article", "main") or "comment" in attributes.get("class", "")) and _named_out(attributes)
        element, path, inner = above.element, above.path, above.inner
        if block:
            element = len(self.tags)
            self.tags.append(tag)
            self.parent.append(above.element)
            self.marked.append(marked)
            self.never.append(tag in NEVER)
            if tag in HEADINGS:
                self.headed.add(element)
            kind = attributes.get("class", "").split()
            name = (f"{tag}.{kind[0]}" if kind else tag) + "!" * marked
            above.like[name] = above.like.get(name, 0) + 1
            path = self._path(above.inner, name)
            inner = path if kind or tag in LEAVES else self._path(path, f"[{above.like[name]}]")
        self._count[tag] += 1
        out = above.out or hidden or tag == "head" or marked and not block
        self._stack.append(Open(tag, element, path, inner, out))

    def _path(self, above: int, name: str) -> int:
        return self.paths.setdefault((above, name), len(self.paths) + 1)

    def inside(self, sizes: dict[int, int]) -> list[int]:
        """Sums for each element, with all elements inside it, of what its own blocks have."""
        total = [sizes.get(e, 0) for e in range(len(self.tags))]
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def penalised(self) -> list[bool]:
        """Whether each element is marked or in a marked one; those do not count that hold most of the text and its
        heading, or nearly all."""
        sizes: dict[int, int] = defaultdict(int)
        for b in self.blocks:
            sizes[b.element] += len(b.text)
        inside, under = self.inside(sizes), [False] * len(self.tags)
        headed = self.inside(dict.fromkeys(self.headed, 1))
        for e in range(1, len(under)):
            under[e] = self.marked[e] or under[self.parent[e]]
        elsewhere = sum(n for e, n in sizes.items() if not under[e])
        out = [False] * len(self.tags)
        for e in range(1, len(out)):
            stays = 2 * inside[e] > inside[0] and not self.never[e] and (headed[e] or elsewhere < ELSEWHERE * inside[0])
            out[e] = out[self.parent[e]] or self.marked[e] and not stays
        return out


def path_scores(page: Page, penalised: list[bool]) -> dict[int, float]:
    """The fused score of each path."""
    blocks, out = page.blocks, np.array([penalised[b.element] for b in page.blocks])
    number = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    path = np.array([number[b.path] for b in blocks])
    n = np.bincount(path)
    length, marks = np.bincount(path, [len(b.text) for b in blocks]), np.bincount(path, [len(PUNCTUATION.findall(b.text)) + 0.5 for b in blocks])
    ratios = [length / n, marks / n, length]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weights = np.convolve(np.ones(len(blocks)), kernel)[2:-2]
    fused = np.zeros(len(blocks))  # logarithms
    for ratio in ratios:
        each = ratio[path]
        each = np.minimum(each / (each[~out] if not out.all() else each).max(), 1)
        fused += (1 - SMOOTH) * np.log(each) + SMOOTH * np.log(np.convolve(each, kernel)[2:-2] / weights)
    score = np.bincount(path, np.exp(fused / len(ratios)) * np.where(out, PENALTY, 1)) / n
    return {p: score[i] for p, i in number.items()}


def main_text(page: str | None, threshold: float = 0.8, share: float = 0.8) -> str:
    """The article's blocks, joined by an empty line.

    threshold: times the scores' standard deviation that a path needs. share: of the content that the article's element
    holds. Elements that are hidden, by attribute or style, are not read. Null, empty and text-free pages give the empty string; text without any markup is one block. Tags whose quote
    or end is missing end at the next ``>`` or with the page; elements nested deeper than MAX_DEPTH count as part of it.
    """
    found = Page(page or "")
    blocks = found.blocks
    if not blocks:
        return ""
    penalised = found.penalised()
    scores = path_scores(found, penalised)
    each = np.array([scores[b.path] for b in blocks])
    least = max(min(threshold * each.std(), each.max()), LEAST)
    text, links = defaultdict(int), defaultdict(int)
    for b in blocks:
        text[b.path] += len(b.text)
        links[b.path] += min(b.linked, len(b.text))
    of_links = {p for p in text if 2 * links[p] > text[p]}
    content = [scores[b.path] >= least and b.path not in of_links for b in blocks]
    if not any(content):
        return ""
    sizes: dict[int, int] = defaultdict(int)
    for b, c in zip(blocks, content):
        sizes[b.element] += len(b.text) * c
    inside = found.inside(sizes)
    # the innermost element with most of the content
    holder = max(e for e in range(len(inside)) if inside[e] >= share * inside[0] and found.tags[e] not in LEAVES)
    held = [e == holder for e in range(len(inside))]
    for e in range(1, len(held)):
        held[e] = held[e] or held[found.parent[e]]
    whole = found.tags[holder] in ("", "html", "body")
    at = [i for i, c in enumerate(content) if c]
    first, last = at[0], at[-1]
    while first and found.tags[blocks[first - 1].element] in TITLES:
        first -= 1
    kept = []
    for i, b in enumerate(blocks):
        # a page's own element holds menus and notices too: of its other blocks only those between content belong to it
        belongs = held[b.element] and not penalised[b.element] and b.path not in of_links and (not whole or first <= i <= last)
        if content[i] or belongs:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of each row; repeated rows come as often as they are there,
    null keys and urls stay null, other columns are not read, whatever their names, and a table without rows gives no rows.
    Pages are read whole, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(F.col(key), F.col(url), F.col(page).alias("html")).mapInArrow(run, f"`{key}` {kind[key]}, `{url}` {kind[url]}, text string, n_chars long")
