"""Main text of web pages: site templates are found by counting element subtrees per host, then removed.

1. Each page is parsed once; every block element outside scripts and styles gives a hash of its subtree (tag and text).
2. Spark counts, per host, on how many different pages each hash occurs (copies of one page count once).
3. Subtrees that recur on many pages of their host are deleted, with the elements whose role is never main text (menus,
   headers, footers, sidebars, notices, adverts, forms, comments); what is left of the article is joined to one line.

Only (host, page, hash) rows are shuffled, never the pages: the hashes to delete come back as a table of a page's own hits, which
Spark broadcasts where its written size is small and joins otherwise.

The article is the main element; without one, all articles that no other holds; without any, the longest element named so; else the page.

Defined cases: null html is an empty page, an address without a host belongs to the host ''; repeated pages give one row each;
unclosed and truncated markup is closed at the end of its parent; a quote that is not closed ends with its tag; nesting and length are
without bound, in time proportional to the page; ids pass through unchanged, null included; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, with_python

#: A subtree is a template's if it is on this many different pages of a host and on this share of them. Of an article's own prose only whole
#: sentences are counted: paragraphs of so many words.
MIN_PAGES, MIN_SHARE, SENTENCE = 3, 0.3, 4
#: A form is a page's frame, and not dropped, if it holds an article or main element, or paragraphs of so many characters that are most of the page's text.
FRAME_CHARS = 200

RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = RAW | frozenset("head template nav footer aside form fieldset button select option input svg canvas math object embed audio video dialog menu datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br caption option legend".split()
)
#: Elements that close an open paragraph.
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "html", "body"}
#: Elements of which a new one ends an open one, up to the container named.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: Names (classes and ids) of elements that hold no main text, and what such a name may be joined with.
BOILER = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|"
    "subscribe|subscription|signup|sidebar|widget|widgets|navigation|nav|navbar|menu|breadcrumb|breadcrumbs|footer|comment|comments|disqus|replies|respond|reactions|related|recommended|share|sharing|social|"
    "pagination|pager|toolbar|masthead|topbar|search|login|skip|tag|tags|paywall"
)
AROUND = "site|page|main|global|top|bottom|left|right|header|post|article|entry|content|wp|js|sticky|inline|mobile|primary|secondary|user|reader"
PARTS = "area|bar|block|blocks|box|button|buttons|cloud|container|content|form|group|holder|inner|item|items|label|links?|list|menu|module|panel|posts?|row|section|slot|stories|title|unit|widgets?|wrap|wrapper|[0-9]+"
#: A name that is one of these words, or such with words around it; in paragraphs and headings only the word itself counts.
NAMED = re.compile(rf"(?:(?:{AROUND})[_-]+)*(?:{BOILER})(?:[_-]*(?:{BOILER}|{PARTS}))*")
BARE = re.compile(f"(?:{BOILER})")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|main|content|story)(?:$|[\s_-])")
#: A quoted value with a `>` that ends with `=` has run into the next element: its quote isn't closed.
QUOTED = r"\"(?:[^\">]*|[^\"]*[^\"=\s])\"|'(?:[^'>]*|[^']*[^'=\s])'"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:{QUOTED}|[^\s>]*))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"([^\s\"'>/=]+)(?:\s*=\s*({QUOTED}|[^\s>]*))?", re.S)


@dataclass
class Node:
    tag: str
    attrs: str = ""
    children: list = field(default_factory=list)  # nodes and strings
    hash: int = 0
    drop: bool = False
    chars: int = 0  # of text below that is not dropped
    prose: int = 0  # of that in paragraphs
    frame: bool = False  # a form that holds an article or main element

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(self.attrs)}


def parse(page: str) -> Node:
    root = Node("html")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where in the stack each tag is open

    def close(k: int) -> None:
        for n in stack[k:]:
            places[n.tag].pop()
        del stack[k:]

    def pop(to: set, within: set) -> None:
        last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
        if (k := last(to)) > last(within):
            close(k)

    def said(text: str) -> str:
        return entities.unescape(text) if "&" in text else text

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(said(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(said(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            pop({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            pop(*SIBLINGS[tag])
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def mark(node: Node, inside: bool = False) -> None:
    """Hashes subtrees and marks elements that never hold main text. inside: within an article or main element."""
    todo = [(node, inside, False)]
    while todo:  # no recursion: markup can be nested without bound
        n, within, done = todo.pop()
        if done:
            h = hashlib.blake2b(n.tag.encode(), digest_size=8)
            for c in n.children:
                h.update(c.hash.to_bytes(8, "big") if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "replace"))
            n.hash = int.from_bytes(h.digest(), "big")
            below = [c for c in n.children if isinstance(c, Node)]
            n.frame = any(c.tag in ("article", "main") and c.chars or c.frame for c in below)
            _measure(n, below)
            continue
        a = n.attributes() if n.attrs.strip() else {}
        names = f"{a.get('class', '')} {a.get('id', '')}".split()
        form = BARE if n.tag in PROSE else NAMED
        n.drop = (
            n.tag in DROP and n.tag != "form"
            or n.tag == "header" and not within
            or a.get("role") in ROLES
            or n.tag not in ("article", "main") and any(form.fullmatch(x) for x in names)
            or "hidden" in a
            or a.get("aria-hidden") == "true"
            or "display:none" in a.get("style", "").replace(" ", "")
        )
        within = within or n.tag in ("article", "main")
        todo.append((n, within, True))
        todo += [(c, within, False) for c in n.children if isinstance(c, Node)]
    _drop_forms(node)


def _measure(n: Node, below: list[Node]) -> None:
    n.chars = 0 if n.drop else sum(c.chars if isinstance(c, Node) else len(c) for c in n.children)
    n.prose = 0 if n.drop else n.chars if n.tag == "p" else sum(c.prose for c in below)


def _drop_forms(root: Node) -> None:
    """Drops the forms, but for those that frame the page, and measures anew what lies above them."""
    total = root.chars
    order = list(nodes(root))
    for n in order:
        if n.tag == "form" and not n.drop:
            n.drop = not n.frame and not (n.prose >= FRAME_CHARS and 2 * n.prose >= total)
    for n in reversed(order):  # children come after their parents
        _measure(n, [c for c in n.children if isinstance(c, Node)])


def nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def text_below(root: Node, gone: frozenset | set) -> str:
    """Text of the blocks in page order; elements marked or in `gone` (unless they are the root) are left out."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n is not root and (n.drop or n.hash in gone):
            out.append(" " if n.tag in BLOCK else "")
            continue
        edge = [" "] if n.tag in BLOCK else []
        todo += [*edge, *reversed(n.children), *edge]
    return " ".join("".join(out).split())


def main_elements(root: Node) -> list[Node]:
    """The longest main element that no dropped one holds, else the articles outside others, else the longest element named so, else all."""
    mains, articles, named, todo = [], [], [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        if n.drop:
            continue
        a = n.attributes() if n.attrs.strip() else {}
        if n.tag == "main" or a.get("role") == "main":
            mains.append(n)
        if n.tag == "article" and not inside:
            articles.append(n)
        if n.tag in ("div", "section") and MAIN.search(f"{a.get('class', '')} {a.get('id', '')}"):
            named.append(n)
        todo += [(c, inside or n.tag == "article") for c in reversed(n.children) if isinstance(c, Node)]
    longest = lambda found: [max(found, key=lambda n: n.chars)]
    mains = [n for n in mains if n.chars]
    return longest(mains) if mains else articles or (longest(named) if named else [root])


def subtrees(page: str) -> tuple[int, list[int]]:
    """Hash of the article, and of every block with text whose deletion is in question."""
    root = parse(page)
    mark(root)
    mains = main_elements(root)
    # Headings and single words of the article are its own; sentences that other pages have too, and everything else, can be a template's.
    own = {id(n) for m in mains if m is not root for n in nodes(m) if n.tag in PROSE and not (n.tag in SENTENCES and words_in(n) >= SENTENCE)} | holders(root, mains)
    found = {n.hash for n in nodes(root) if n.tag in BLOCK and not n.drop and id(n) not in own and n.children}
    return signed(hash(tuple(m.hash for m in mains)) & MASK), sorted(map(signed, found))


MASK = (1 << 64) - 1
#: Elements of an article that are its prose; those of them that are a template's if a host repeats them and they are sentences.
PROSE, SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre br".split()), frozenset("p blockquote pre".split())


def words_in(n: Node) -> int:
    return len(text_below(n, frozenset()).split())


def holders(root: Node, mains: list[Node]) -> set[int]:
    """The ids of the main elements and of all that hold them."""
    parent = {id(c): n for n in nodes(root) for c in n.children if isinstance(c, Node)}
    out = {id(m) for m in mains}
    for n in mains:
        while id(n) in parent and id(parent[id(n)]) not in out:
            n = parent[id(n)]
            out.add(id(n))
    return out


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def main_text(page: str, gone: frozenset | set = frozenset()) -> str:
    root = parse(page)
    mark(root)
    gone = {h & MASK for h in gone}
    return " ".join(filter(None, (text_below(m, gone) for m in main_elements(root))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def page_key() -> Column:
    """Equal pages at one address share their key, and their result."""
    return F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """key, host, main, hash: a row for each different subtree of a page; hash 0 stands for the page itself."""

    def run(html):
        got = [subtrees(x) for x in html.to_pylist()]
        return None, [[m for m, _ in got], [[0, *h] for _, h in got]]

    out = with_python(pages, [page_key(), host(F.col("url"))], [text_of("html")], "main long, hash array<long>", run)
    return out.select(F.col("k0").alias("key"), F.col("k1").alias("host"), "main", F.explode("hash").alias("hash"))


def templates(trees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees on a large share of the different pages of their host, whatever its size."""
    counts = trees.select("host", "hash", "main").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min_pages)  # a host of fewer pages has no template
    total = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    return counts.filter("hash <> 0").join(total, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_deleted (template subtrees of the page) for every row of pages."""
    trees = cut(page_subtrees(pages))
    hits = cut(trees.join(templates(trees, min_pages, min_share), ["host", "hash"]).select("key", "hash").distinct().groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias("gone")))

    def run(html, gone):
        gone = gone.to_pylist()
        return None, [[main_text(h, set(g or ())) for h, g in zip(html.to_pylist(), gone)], [len(g or ()) for g in gone]]

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"), page_key().alias("key")).join(hits, "key", "left")
    out = with_python(src, [F.col("page_id"), F.col("url")], [F.col("html"), F.col("gone")], "text string, n_deleted long", run)
    return out.select(F.col("k0").alias("page_id"), F.col("k1").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"), "n_deleted")
