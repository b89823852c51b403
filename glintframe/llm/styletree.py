"""Main text of pages by a site style tree: branches that say the same all over a site go."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glintframe.llm.common import octets
from glintframe.session import materialize

LEAST_PAGES = 8  # occurrences of a node in a site below which it is not judged
THRESHOLD = 0.25  # importance below which a branch goes
CONTENT = 0.9  # share of the content's entropy in a node's importance, against that of its presentation

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption hr".split())
_GONE = frozenset("head nav footer aside button select option datalist template svg math canvas object audio video dialog menu search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar tablist toolbar".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_HINTS = _COMMENTS | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidenav rail footer foot masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing "
    "social related recommended recommendations widget widgets toolbar pagination pager copyright skip tags".split())
_HEADER = frozenset("header head".split())
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
              "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|\Z))""", re.I)
_STATE = re.compile(r"(?:^|[-_])(?:has|no|with|without|is|not)[-_]|[-_](?:enabled|disabled|active|open|closed|on|off)$", re.I)  # says how, not what, an element is
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An open element: its place in the tree of the site, whether it is out for certain, and what else it lies in.

    ``doubts`` are the elements around it, itself included, that a hint or a form speaks against.
    """

    tag: str
    path: str
    out: bool
    main: bool
    article: bool
    doubts: tuple[int, ...]
    children: list
    texts: list


@dataclass
class Block:
    text: str
    paths: tuple[str, ...]
    main: bool
    article: bool
    doubts: tuple[int, ...]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}


def _doubtful(tag: str, at: dict[str, str], article: bool) -> bool:
    """Whether a form or a word of class or id speaks against an element; names of states are no such words."""
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "form" or at.get("role", "").lower() == "form":
        return True
    names = [n for n in f"{at.get('class', '')} {at.get('id', '')}".split() if not _STATE.search(n)]
    words = {w.lower() for n in names for w in _TOKEN.findall(n)}
    return bool(words & _HINTS) or not article and bool(words & _HEADER)


def _is_out(tag: str, at: dict[str, str], article: bool) -> bool:
    """Parts that are no main text wherever they stand: by element, role or visibility, and reader comments."""
    if tag in _GONE or at.get("role", "").lower() in _ROLES:
        return True
    if tag in ("html", "body", "main") or not at:
        return tag == "header" and not article
    names = [c.lower() for c in f"{at.get('class', '')} {at.get('id', '')}".split()]
    if any(c in _COMMENTS or tag == "article" and c.startswith("comment") for c in names):
        return True
    if tag == "article":
        return False
    if "hidden" in at or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return True
    return tag == "header" and not article


def parse(page: str) -> tuple[list[Block], list[tuple[str, int, int]]]:
    """Blocks of text that are not out, in page order, and ``(path, style, content)`` of every element that is not.

    A path is the chain of elements with their classes; the style is a hash of the kinds of the children, the content
    one of all the text below. Unclosed, misnested and cut-off markup is read as browsers do in the main.
    """
    root = Node("", "", False, False, False, (), [], [])
    stack, blocks, nodes, text, number = [root], [], [], [], count()

    def flush():
        if text:
            got = " ".join(html.unescape("".join(text)).split())
            text.clear()
            top = stack[-1]
            if got and not top.out:
                blocks.append(Block(got, tuple(n.path for n in stack[1:]), top.main, top.article, top.doubts))
                top.texts.append(got)

    def close():
        node = stack.pop()
        if not node.out:
            stack[-1].texts.extend(node.texts)
            nodes.append((node.path, xxhash.xxh64_intdigest(" ".join(node.children)) >> 1, xxhash.xxh64_intdigest("\n".join(node.texts)) >> 1))

    def open_(tag, raw):
        parent, at = stack[-1], _attributes(raw)
        names = ".".join(sorted(set(re.sub(r"\d+", "", f"{at.get('class', '')} {at.get('id', '')}").split())))
        name = f"{tag}.{names}" if names else tag
        if not parent.children or parent.children[-1] != name:
            parent.children.append(name)
        inside = parent.main or parent.article
        out = parent.out or _is_out(tag, at, inside)
        doubts = (*parent.doubts, next(number)) if not out and _doubtful(tag, at, inside) else parent.doubts
        stack.append(Node(tag, f"{parent.path}/{name}", out, parent.main or tag == "main", parent.article or tag == "article", doubts, [], []))

    at, lower = 0, None
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        slash, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCK or tag in _GONE
        if tag == "br":
            text.append(" ")
        if block:
            flush()
        if slash:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if found:
                flush()
                while len(stack) > found:
                    close()
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            text.append(" ")
            continue
        if tag in _VOID:
            continue
        if block:
            if stack[-1].tag == "p":
                close()
            ends, scope = _CLOSED_BY.get(tag, ((), ()))
            while len(stack) > 1 and stack[-1].tag not in scope and any(n.tag in ends for n in stack[1:]) and \
                    next(n.tag for n in reversed(stack) if n.tag in ends or n.tag in scope or n is root) in ends:
                close()
            if tag not in ("html",) and not (tag == "body" and any(n.tag == "body" for n in stack)):
                if tag == "body":
                    while len(stack) > 1:
                        close()
                if not raw.rstrip().endswith("/") or tag in _BLOCK:
                    open_(tag, raw)
        elif raw and any(f(tag, _attributes(raw), stack[-1].main or stack[-1].article) for f in (_is_out, _doubtful)):
            flush()
            open_(tag, raw)
    if at < len(page):
        text.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    return blocks, nodes


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _without_doubtful(blocks: list[Block]) -> list[Block]:
    """Blocks outside doubtful elements. An element that holds most of the page's text is not doubted, unless an article or main element outside it holds a quarter as much."""
    total, held, named = _size(blocks), Counter(), Counter()
    marked = _size([b for b in blocks if b.main or b.article])
    for b in blocks:
        for d in b.doubts:
            held[d] += len(b.text)
            named[d] += len(b.text) if b.main or b.article else 0
    cleared = {d for d, n in held.items() if 2 * n > total and 4 * (marked - named[d]) < n}
    return [b for b in blocks if cleared.issuperset(b.doubts)]


def _larger(blocks: list[Block], inside: list[bool]) -> list[Block]:
    """The blocks inside, unless those outside have more than twice their text."""
    a, b = [x for x, y in zip(blocks, inside) if y], [x for x, y in zip(blocks, inside) if not y]
    return b if _size(b) > 2 * _size(a) else a


def main_blocks(page: str, low: frozenset[str] = frozenset()) -> list[str]:
    """Blocks outside the branches ``low`` and outside doubtful elements: those of main or else of the article, if these hold enough of the text."""
    blocks = [b for b in parse(page)[0] if not any(p in low for p in b.paths)]
    blocks = _without_doubtful(blocks)
    blocks = _larger(blocks, [b.main for b in blocks])
    return [b.text for b in _larger(blocks, [b.article for b in blocks])]


def host(url: Column) -> Column:
    """Host of a URL in lower case; null without one."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


_NODE = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("value", pa.int64()), ("page", pa.int64())])


def _nodes(batches):
    for batch in batches:
        rows = set()
        for site, page in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
            blocks, nodes = parse(page.decode())
            whole = xxhash.xxh64_intdigest("\n".join(b.text for b in blocks)) >> 1
            for path, style, content in nodes:
                rows.add((site, path, 0, style, whole))
                rows.add((site, path, 1, content, whole))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE)], schema=_NODE)


def style_tree(pages: DataFrame) -> DataFrame:
    """Importance of every node ``(host, path)`` of the merged pages of each host.

    Pages of one host with the same main text count once. The entropies of a node's presentations and of its
    contents, each over the logarithm of their number, are weighed into its importance: 0 for a node that is the
    same everywhere, 1 for one that always differs or was seen in fewer than ``LEAST_PAGES`` places. The counts are
    summed value by value, so a host with any share of the pages is spread over the tasks.
    """
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where(F.col("host").isNotNull())
    seen = rows.mapInArrow(_nodes, "host string, path string, kind int, value long, page long").distinct()
    n = F.col("n")
    size = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n")).groupBy("host", "path", "kind").agg(F.sum(n).alias("n"), F.sum(n * F.log(n)).alias("s"))
    entropy = F.when(n < LEAST_PAGES, F.lit(1.0)).otherwise((F.log(n) - F.col("s") / n) / F.log(n))
    share = F.when(F.col("kind") == 1, F.lit(CONTENT)).otherwise(F.lit(1 - CONTENT))
    return size.groupBy("host", "path").agg(F.max("n").alias("n"), F.sum(entropy * share).alias("importance"))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(batches):
    for batch in batches:
        low = [frozenset(x or ()) for x in batch.column(3).to_pylist()]
        texts = ["\n\n".join(main_blocks(x.decode(), y)) for x, y in zip(octets(batch.column(2)), low)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=_TEXT)


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every page: its blocks without the branches of low importance on its host.

    What is no main text by its element or role goes in any case, and so do reader comments. What a form, a class or an
    id speaks against goes unless it holds most of the page's text. Main elements and articles count alone unless the
    rest has more than twice their text. The low branches of a host are those that at least ``LEAST_PAGES`` places share, one row a host.

    Null and empty pages have an empty text; pages without a host are judged by themselves; repeated pages give
    repeated rows; further columns are ignored; no rows give no rows.
    """
    low = style_tree(pages).where((F.col("importance") < THRESHOLD) & F.col("path").rlike("/(?!(html|body|main|article)(\\.[^/]*)?$)[^/]*$"))
    per_host = materialize(low.groupBy(F.col("host").alias("site")).agg(F.sort_array(F.collect_list("path")).alias("low")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = rows.join(per_host, host(F.col("url")) == F.col("site"), "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")
