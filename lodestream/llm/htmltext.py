"""Main text of HTML pages by composite text density.

Every node of the DOM has its characters per tag, adjusted by how many of its characters and tags belong to links. Of all nodes the one whose children's
densities have the largest sum is the centre of the article; the least density on the path from it to the body is the threshold for
further subtrees. Menus, footers and the like by their tags are no part of the tree. A form, and what a role, class or id calls a menu, sidebar, advert,
notice or comment, is only marked: it is left out where the text around it outweighs it, and stays where it holds the page.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import map_batches

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOISE_WORD = re.compile(r"[a-z]+|\d+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp svg math object".split())
#: Of these, those that hold nothing without an end tag.
OPEN_ENDED = frozenset("svg math object".split())
#: What a head may hold: any other element ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open element of the second kind, as far as the third kind does not stand between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
KEEPS_P = frozenset("button table td th caption object article section div body li".split())

#: What is never main text, by tag; what is marked, by role and by words of class and id.
NOISE_TAGS = frozenset("head nav footer aside script style noscript template iframe button select textarea input label svg math object embed dialog menu search title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget toolbar pagination pager "
    "comment comments commentlist disqus respond replies reply form skip copyright disclaimer".split()
)
#: The same for article elements, of which comments and teasers are made as well.
NOISE_ARTICLES = frozenset("ad ads advert advertisement sponsored promo related recommended teaser comment comments reply".split())
#: Class names that say what an element lacks or has beside itself.
NEGATED = re.compile(r"(?:no|not|has|with|without|is)[-_]|ad-?free\b", re.I)
#: Elements that are parts of an article, never all of it.
PARTS = frozenset("p a b i u s em strong span font small big sub sup code q cite mark abbr time li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th figure figcaption hr br img details summary".split())


#: A marked element stays if it has more than so many times the unlinked text of its surroundings that isn't marked.
OUTWEIGHS = 16
CUT, MARKED, PLAIN = 2, 1, 0


def _noise(tag: str, attributes: str, in_article: bool) -> int:
    """CUT: an element that is never main text; MARKED: one that is said to be something else."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return CUT
    found = MARKED if tag == "form" else PLAIN
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return CUT
        if name == "role" and not NOISE_ROLES.isdisjoint(value.split()):
            found = MARKED
        if name in ("class", "id") and tag != "main":
            names = NOISE_ARTICLES if tag == "article" else NOISE_NAMES
            if any(not names.isdisjoint(NOISE_WORD.findall(HUMP.sub("-", word).lower())) for word in (m[2] or m[3] or m[4] or "").split() if not NEGATED.match(word)):
                found = MARKED
    return found


class Tags:
    """Tags, comments and declarations of a page, in order, in time linear in its length.

    Quotes inside a tag hide a > if they are closed. Where they leave a tag without end, it ends at its first >, and quotes hide nothing from there on. What
    begins like a tag and has no > behind it is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), {'"', "'"}

    def _end(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at ``at``."""
        first = pos = -1
        while self.quotes:
            m = STOP.search(self.page, pos + 1 if pos >= 0 else at)
            if not m:
                self.quotes = set()
                break
            pos, first = m.start(), first if first >= 0 else m.start()
            if m[0] == ">":
                return pos
            if m[0] in self.quotes:
                closed = self.page.find(m[0], pos + 1)
                if closed < 0:
                    self.quotes = self.quotes - {m[0]}
                else:
                    pos = closed
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """The next one from ``at`` on: begin, end, whether it closes, its name (null: no element), its attributes."""
        page = self.page
        while 0 <= (begin := page.find("<", at)) < self.last:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, False, None, ""
            m = TAG.match(page, begin)
            if m:
                end = self._end(m.end())
                return begin, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                return begin, page.find(">", begin) + 1, False, None, ""
            at = begin + 1
        if begin >= 0 and page.startswith("<!--", begin):
            return begin, len(page), False, None, ""
        return None


class Tree:
    """Nodes in page order with what their subtrees hold; texts and block borders as they come. What is cut by its tag is left out with all it holds,
    marked nodes that don't hold the page stay as empty ones."""

    def __init__(self, page: str):
        self.tag, self.parent, self.last, self.marked = ["#page"], [-1], [0], [False]
        self.chars, self.link_chars, self.link_tags = [0], [0], [0]
        self.parts: list[tuple[int, str | None]] = []  # node and text; None: a block begins or ends
        self._read(page)
        self.left_out = self._left_out()
        self.tags = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            self.last[p] = max(self.last[p], self.last[i])
            if self.left_out[i]:
                self.chars[i] = self.link_chars[i] = self.link_tags[i] = 0
                continue
            self.chars[p] += self.chars[i]
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i]
            self.tags[p] += self.tags[i] + 1

    def _left_out(self) -> list[bool]:
        """Which nodes are in marked elements that are left out.

        The page and each marked element have unlinked text of their own, which is in no marked element inside. Of the marked elements right inside, the one with
        most text is kept if it outweighs that: then it wraps what the page is about, and its text counts to the outer one's. Others are left out.
        """
        if True not in self.marked:
            return [False] * len(self.tag)
        scope, own = [0] * len(self.tag), [0] * len(self.tag)
        for i in range(len(self.tag)):
            scope[i] = i if self.marked[i] else scope[self.parent[i]] if i else 0
            own[scope[i]] += self.chars[i] - self.link_chars[i]
        heaviest, kept = [0] * len(self.tag), set()  # 0: nothing marked inside
        for i in range(len(self.tag) - 1, -1, -1):
            if i and not self.marked[i]:
                continue
            inner = heaviest[i]
            if inner and own[inner] > OUTWEIGHS * own[i]:
                kept.add(inner)
                own[i] += own[inner]
            if i:
                outer = scope[self.parent[i]]
                if own[i] and (not heaviest[outer] or own[i] >= own[heaviest[outer]]):
                    heaviest[outer] = i
        found = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            found[i] = found[self.parent[i]] or self.marked[i] and i not in kept
        return found

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # node -1: noise
        links = articles = at = 0
        open_at: dict[str, list[int]] = {}  # depths of open elements by tag
        endless: set[str] = set()  # raw elements without an end tag from here on

        def text(a: int, b: int) -> None:
            if b > a and stack[-1][1] >= 0:
                n = stack[-1][1]
                s = page[a:b]
                self.parts.append((n, s))
                size = len(s) if s.isascii() and "  " not in s and "\n" not in s else len(" ".join(s.split()))
                self.chars[n] += size
                if links:
                    self.link_chars[n] += size

        def close(depth: int) -> None:
            nonlocal links, articles
            while len(stack) > depth:
                tag, _ = stack.pop()
                open_at[tag].pop()
                links -= tag == "a"
                articles -= tag in ("article", "main")
                if tag in BLOCK:
                    self.parts.append((0, None))

        def innermost(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        tags = Tags(page)
        while (found := tags.after(at)) is not None:
            begin, end, closing, tag, attributes = found
            text(at, begin)
            at = end
            if tag is None:
                continue
            if closing:
                if open_at.get(tag):
                    close(open_at[tag][-1])
                continue
            if open_at.get("head") and tag not in IN_HEAD:
                close(open_at["head"][0])
            if tag in CLOSES and any(open_at.get(x) for x in CLOSES[tag][0]):
                targets, walls = CLOSES[tag]
                wall = innermost(walls)
                depths = [d[bisect_right(d, wall)] for d in map(open_at.get, targets) if d and d[-1] > wall]
                if depths:
                    close(min(depths))
            if tag in BLOCK:
                if open_at.get("p") and open_at["p"][-1] > innermost(KEEPS_P):
                    close(open_at["p"][-1])
                self.parts.append((0, None))
            parent = stack[-1][1]
            noise = CUT if parent < 0 else _noise(tag, attributes, articles > 0)
            node = -1
            if noise != CUT:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(parent)
                self.last.append(node)
                self.marked.append(noise == MARKED)
                self.chars.append(0)
                self.link_chars.append(0)
                self.link_tags.append(int(tag == "a"))
                if tag == "br":
                    self.parts.append((node, " "))
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                last = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                past = page.find(">", last.end()) + 1 if last else 0
                if past:
                    at = past
                    continue
                endless.add(tag)
                if tag not in OPEN_ENDED:
                    at = len(page)
                continue
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
            links += tag == "a"
            articles += tag in ("article", "main")
        text(at, len(page))

    def densities(self, body: int) -> list[float]:
        """Composite text density of every node; ``body`` gives the page's share of links."""
        ratio = self.link_chars[body] / max(1, self.chars[body])
        found = []
        for c, lc, t, lt in zip(self.chars, self.link_chars, self.tags, self.link_tags, strict=True):
            if not c:
                found.append(0.0)
                continue
            t, free = t or 1, c - lc
            base = math.log(c / max(1, free) * lc + ratio * c + math.e + 1)  # 1 more than e, so that the base is over 1 without links
            found.append(c / t * math.log(c / (lc or 1) * t / (lt or 1), base))
        return found


def _find_content(tree: Tree) -> list[tuple[int, int]]:
    """Intervals of nodes (first, last) whose texts are the main text."""
    body = next((i for i, t in enumerate(tree.tag) if t == "body"), 0)
    density = tree.densities(body)
    sums = [0.0] * len(density)
    for i in range(len(density) - 1, 0, -1):
        sums[tree.parent[i]] += density[i]
    inside = range(body, tree.last[body] + 1)
    centre = max(inside, key=lambda i: (sums[i], -i))
    path = [centre]
    while path[-1] != body:
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    root = centre
    while root != body and tree.tag[root] in PARTS:
        root = tree.parent[root]
    found = [(root, tree.last[root])]
    # other subtrees as dense as the thinnest node on the path: each by its topmost node beside it
    i = body
    while i <= tree.last[body]:
        if root <= i <= tree.last[root]:
            i = tree.last[root] + 1
        elif i < root <= tree.last[i]:
            i += 1
        elif density[i] >= threshold > 0 and tree.link_chars[i] * 2 <= tree.chars[i]:
            found.append((i, tree.last[i]))
            i = tree.last[i] + 1
        else:
            i += 1
    return sorted(found)


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one line each. Null or empty pages, and pages without text, give an empty string.

    White space is what str.split takes for it, no-break spaces included; br is white space of its block.
    """
    if not page:
        return ""
    tree = Tree(page)
    inside = np.zeros(len(tree.tag), bool)
    for first, last in _find_content(tree):
        inside[first : last + 1] = True
    inside &= ~np.array(tree.left_out)
    blocks: list[str] = []
    held: list[str] = []
    for node, text in [*tree.parts, (0, None)]:
        if text is None:
            if held:
                block = " ".join(html.unescape("".join(held)).split())
                if block:
                    blocks.append(block)
                held = []
            continue
        if inside[node]:
            held.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points). Repeated rows keep their rows, an empty table gives none, other columns are ignored."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in part.column("html").to_pylist()]
        return pa.record_batch([part.column("id"), part.column("url"), pa.array(found, pa.string()), pa.array(np.fromiter(map(len, found), np.int64, count=len(found)))], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, "html", "id long, url string, text string, n_chars long", work)
