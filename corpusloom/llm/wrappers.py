"""HTML extraction by wrapper induction over the pages of each host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed
from corpusloom.llm.dom import INLINE, Node, parse

#: Elements that are no article text.
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe object embed svg canvas button select "
    "textarea input dialog menu audio video map".split()
)
#: Words of class, id and role that name such an element.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager comment comments disqus replies respond share sharing social "
    "related footer contentinfo complementary masthead toolbar search hidden".split()
)
HEADS = frozenset(("header",))
#: Deeper nodes are not aligned; templates made by more hosts than this are sent on by a task.
DEPTH, HOSTS = 60, 5000
#: Different pages of a host that must agree before a text counts as template.
AGREE = 3
#: Templates up to this size together are broadcast; beyond, pages are joined by host.
BROADCAST = 8 << 20
_WORD = re.compile(r"[a-z]+")

# -- templates ---------------------------------------------------------------------------------
# A template node is [label, value, pages, children]. A text's value is its hash while all pages
# agree, then None; ``pages`` counts the pages it was met on.


def label_of(node: Node) -> str:
    """Name and class words; numbers in them do not count."""
    return ".".join([node.name, *sorted(set(_WORD.findall(node.attrs.get("class", "").lower())))])


def clean(text: str) -> str:
    return " ".join(text.split())


def fold(node: Node, depth: int = 0) -> tuple[list, list]:
    """The node as a template of one page, neighbours with one label folded into one, and beside it
    the same tree of what was folded: lists of the page's texts' (parent, place)."""
    children, members = [], []
    if depth < DEPTH:
        for k, child in enumerate(node.children):
            if isinstance(child, str):
                said = clean(child)
                if not said:
                    continue
                one, own = ["#", xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass")), 1, []], [[(node, k)], []]
            else:
                one, own = fold(child, depth + 1)
            if children and children[-1][0] == one[0]:
                merge(children[-1], one, members[-1], own, same_page=True)
            else:
                children.append(one)
                members.append(own)
    return [label_of(node), None, 1, children], [[], members]


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: pairs of the largest order-keeping match of two trees with one root label."""
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + table(a[3], b[3], memo)[-1][-1]
    return memo[key]


def table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x[0] == y[0]:
                best = max(best, above[j] + match(x, y, memo))
            row.append(best)
        rows.append(row)
    return rows


def align(xs: list, ys: list, memo: dict) -> list[tuple[int | None, int | None]]:
    """Children of two matched nodes in one order: pairs, and those that only one has."""
    if len(xs) == len(ys) and all(x[0] == y[0] for x, y in zip(xs, ys)):
        return [(i, i) for i in range(len(xs))]
    rows, i, j, out = table(xs, ys, memo), len(xs), len(ys), []
    while i or j:
        if i and rows[i][j] == rows[i - 1][j]:
            i -= 1
            out.append((i, None))
        elif j and rows[i][j] == rows[i][j - 1]:
            j -= 1
            out.append((None, j))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: list, b: list, own: list | None = None, other: list | None = None, same_page: bool = False) -> None:
    """Put template ``b`` into ``a``. ``own`` and ``other`` are what was folded, for one page."""
    if a[0] == "#" and a[1] != b[1]:
        a[1] = None
    if not same_page:
        a[2] += b[2]
    if own is not None:
        own[0] += other[0]
    children, members = [], []
    for i, j in align(a[3], b[3], {}):
        if i is not None and j is not None:
            merge(a[3][i], b[3][j], own and own[1][i], other and other[1][j], same_page)
        children.append(a[3][i] if i is not None else b[3][j])
        if own is not None:
            members.append(own[1][i] if i is not None else other[1][j])
    a[3] = children
    if own is not None:
        own[1] = members


class Template:
    """What the pages of a host have in common: ``tree``, and up to AGREE hashes of different pages."""

    def __init__(self, tree: list, pages: list[int]):
        self.tree, self.pages = tree, pages

    def add(self, other: Template) -> None:
        merge(self.tree, other.tree)
        self.pages = sorted({*self.pages, *other.pages})[:AGREE]

    def dumps(self) -> str:
        return json.dumps([self.tree, self.pages], separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Template:
        return Template(*json.loads(text))

    def constants(self, page: Node) -> set[tuple[int, int]]:
        """The page's texts that every page of the host has in this place, as (id of parent, place)."""
        out: set[tuple[int, int]] = set()
        if len(self.pages) < AGREE:
            return out
        tree, members = fold(page)
        todo = [(self.tree, tree, members)]
        while todo:
            a, b, own = todo.pop()
            if b[0] == "#":
                if a[1] is not None and a[1] == b[1] and a[2] >= AGREE:
                    out.update((id(node), k) for node, k in own[0])
                continue
            for i, j in align(a[3], b[3], {}):
                if i is not None and j is not None:
                    todo.append((a[3][i], b[3][j], own[1][j]))
        return out


# -- extraction --------------------------------------------------------------------------------


def hinted(node: Node) -> set[str]:
    a = node.attrs
    if not a:
        return set()
    return set(_WORD.findall(" ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))).lower()))


def is_dropped(node: Node) -> bool:
    if node.name in DROPPED:
        return True
    if not node.attrs or node.name in ("html", "body", "main"):
        return False
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    return bool(hinted(node) & HINTS)


def is_head(node: Node) -> bool:
    return node.name in HEADS or bool(node.attrs) and bool(hinted(node) & HEADS)


def has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.name in ("h1", "h2"):
            return True
        todo += [c for c in x.children if isinstance(c, Node)]
    return False


def is_link_list(node: Node) -> bool:
    """A list of nothing but links."""
    if node.name not in ("ul", "ol"):
        return False
    items = [c for c in node.children if isinstance(c, Node)]
    only = lambda x: [c for c in x.children if not isinstance(c, str) or c.strip()]
    return bool(items) and all(len(got := only(x)) == 1 and isinstance(got[0], Node) and got[0].name == "a" for x in items)


def roots(page: Node) -> tuple[list[Node], bool]:
    """The outermost articles that are not in dropped elements, else the main element, else all."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [page]
    while todo:
        node = todo.pop()
        role = node.attrs.get("role", "") if node.attrs else ""
        kind = "article" if node.name == "article" or role == "article" or node.attrs.get("itemprop") == "articleBody" else None
        if kind:
            found["article"].append(node)
            continue
        if node.name == "main" or role == "main":
            found["main"].append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not is_dropped(c)]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind][: 1 if kind == "main" else None], True
    return [page], False


def blocks(node: Node, inside: bool, constant: set[tuple[int, int]]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        said = clean("".join(run))
        if said:
            out.append(said)
        run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        x, k = stack.pop()
        if k == len(x.children):
            if x.name not in INLINE:
                flush()
            continue
        stack.append((x, k + 1))
        c = x.children[k]
        if isinstance(c, str):
            if (id(x), k) in constant and x.name != "h1":
                continue
            run.append(c)
            continue
        if c.name not in INLINE:
            flush()
        if is_dropped(c) or is_head(c) and not (inside and has_heading(c)) or not inside and is_link_list(c):
            continue
        stack.append((c, 0))
    flush()
    return out


def main_text(page: str, template: Template | None = None) -> str:
    """The article's text, without what the host's template repeats."""
    tree = parse(page)
    constant = template.constants(tree) if template else set()
    chosen, inside = roots(tree)
    found = [b for r in chosen for b in blocks(r, inside, constant)]
    if not found and constant:
        found = [b for r in chosen for b in blocks(r, inside, set())]
    return " ".join(found)


# -- tables ------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, template)`` from all pages of every host.

    A task folds the pages it reads into one template per host, so pages are not shuffled. Templates
    of a host are merged first in up to 64 groups, then once more; a host with a third of all pages
    costs no more than one template per task.
    """
    rows = pages.select(host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = "host string, template string, part int"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Template] = {}
        part = TaskContext.get().partitionId() % 64

        def send() -> pd.DataFrame:
            out = pd.DataFrame({"host": list(held), "template": [t.dumps() for t in held.values()], "part": np.int32(part)})
            held.clear()
            return out

        for f in frames:
            for host, page in zip(f["host"], f["html"]):
                one = Template(fold(parse(page))[0], [xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))])
                if host in held:
                    held[host].add(one)
                else:
                    held[host] = one
            if len(held) > HOSTS:
                yield send()
        if held:
            yield send()

    def together(f: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(f["template"])
        whole = Template.loads(texts[0])
        for t in texts[1:]:
            whole.add(Template.loads(t))
        return pd.DataFrame({"host": f["host"].iloc[:1], "template": [whole.dumps()], "part": np.int32(0)})

    rows = rows.where(F.col("host").isNotNull() & F.col("html").isNotNull())
    partial = rows.mapInPandas(read, schema)
    partial = partial.groupBy("host", "part").applyInPandas(together, schema)
    return partial.groupBy("host").applyInPandas(together, schema).select("host", "template")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row: the main text of the whole page.

    The trees of a host's pages are aligned by simple tree matching. A text that stands in the same
    place of all pages of the host that have this place (AGREE different ones at least) is template;
    places whose texts vary are content. Content counts inside the page's articles (else its main
    element, else the page) outside of menus, headers, footers, asides, notices, adverts, forms,
    scripts, styles and reader comments, told by element, class, id or role. Headings of level one
    are content always. White space in a block becomes one space, blocks are joined by one.

    Null and empty pages have the empty text. Pages without a host (null or relative URLs) are read
    without a template. Repeated rows give repeated rows; an empty table gives an empty table.
    """
    templates = checkpointed(induce(pages, url_col, html_col))
    size = templates.agg(F.coalesce(F.sum(F.length("template")), F.lit(0))).first()[0]
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    met = rows.join(F.broadcast(templates) if size <= BROADCAST else templates, "host", "left")

    @F.pandas_udf("string")
    def text_of_page(html: pd.Series, template: pd.Series) -> pd.Series:
        known: dict[str, Template] = {}
        out = []
        for page, t in zip(html, template):
            if t is not None and t not in known:
                if len(known) > 1000:
                    known.clear()
                known[t] = Template.loads(t)
            out.append(main_text(page, known[t] if t is not None else None))
        return pd.Series(out, dtype=object)

    got = met.select("page_id", "url", text_of_page("html", "template").alias("text"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
