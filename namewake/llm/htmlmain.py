"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed to a tree of block elements; runs of siblings with the same tag and class are one node, so pages of
one design have nearly the same tree. Per host the distinct trees are aligned by simple tree matching and merged into a
wrapper. A wrapper node whose text is the same on every page is template; nodes whose text varies are content. What a page
says about itself is used as well: navigation, forms, adverts, comments and the like are named by tag, role or class, weighed
against the text that they hold.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved

# A quote opens a value only after an equals sign; a tag whose quote never closes ends at the first ``>``.
ATTRIBUTES = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+"""
OPENING = re.compile(r"<(?:!--|!\[CDATA\[|/?[a-zA-Z]|[!?/])")
TAG = re.compile(rf"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>{ATTRIBUTES})>", re.S)
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TOLD = frozenset("class id role hidden aria-hidden style".split())
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# Elements of HTML by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas audio video select noframes".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption legend summary".split())
DROPPED = frozenset("nav footer aside form dialog menu button search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words in class and id names that mark what is not the article.
UNWANTED = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup sitemap social sponsor sponsored sponsors subscribe subscription toolbar".split()
)
WANTED = frozenset("article articles body content entry main post posts story text".split())
NOT_AN_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related reply replies sponsored teaser".split())
SELF_CLOSING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "thead tbody tr td th"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "tbody": "table", "tfoot": "table"}


class Node:
    """An element: ``hidden`` is out in any case, ``doubt`` is 0 for none, 1 for a doubtful name beside a wanted one, 2 for what its tag or name says is no article."""

    __slots__ = ("tag", "key", "up", "hidden", "doubt", "mass", "kept", "inside", "children", "slot")

    def __init__(self, tag: str, key: str, up: Node | None, hidden: bool, doubt: int) -> None:
        self.tag, self.key, self.up, self.hidden, self.doubt = tag, key, up, hidden, doubt
        self.mass, self.kept, self.inside, self.children, self.slot = 0, True, False, [], -1


def _names(attributes: str) -> tuple[str, frozenset[str], bool, bool]:
    """Of a tag: its class as written, the words in its class and id, whether its role is no article's, and whether it is hidden."""
    css, parts, role, hidden = "", set(), False, False
    for name, value in ATTRIBUTE.findall(attributes):
        if (name := name.lower()) not in TOLD:
            continue
        value = html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            css = value if name == "class" else css
            parts.update(p.lower() for p in NAME_PARTS.findall(value))
        elif name == "role":
            role |= value.lower() in ROLES
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden = True
    return css, frozenset(parts), role, hidden


class Scanner:
    """Finds markup from left to right, in time linear in the page: what can't end is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.pattern = page, TAG
        self.last_end, self.last_data = page.rfind(">"), page.rfind("]]>")

    def after(self, at: int) -> tuple[int, int, re.Match | None, bool] | None:
        """Start and end of the next markup from ``at`` on, its match if it is a tag, and whether it is a CDATA section."""
        page = self.page
        while m := OPENING.search(page, at):
            start = m.start()
            if m[0] == "<!--":
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), None, False
            if start > self.last_end:  # only a comment needs no end
                if (at := page.find("<!--", start)) < 0:
                    return None
                continue
            if m[0] == "<![CDATA[" and start < self.last_data:
                return start, page.find("]]>", start) + 3, None, True
            if m[0][-1].isalpha():
                tag = self.pattern.match(page, start)
                if tag is None:  # every later > is in quotes: from here on quotes don't count
                    self.pattern = PLAIN_TAG
                    tag = PLAIN_TAG.match(page, start)
                return start, tag.end(), tag, False
            return start, page.find(">", start) + 1, None, False
        return None


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text in page order with their elements."""
    root = Node("", "", None, False, 0)
    nodes, stack, blocks, text = [root], [root], [], []
    open_at: dict[str, list[int]] = {}  # of each tag, the places in the stack
    at, length, in_link, plain = 0, len(page), False, 0
    scanner = Scanner(page)

    def add(part: str) -> None:
        nonlocal plain
        text.append(part)
        if not in_link:
            plain += len(part.strip())

    def flush() -> None:
        nonlocal plain
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append((stack[-1], joined))
                stack[-1].mass += plain
        plain = 0

    def innermost(tags: Iterable[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(*tags: str, until: str = "") -> None:
        place = innermost(tags)
        if place and place >= innermost(until.split()):
            flush()
            for node in stack[place:]:
                open_at[node.tag].pop()
            del stack[place:]

    while found := scanner.after(at):
        start, end, m, data = found
        if start > at:
            add(html.unescape(page[at:start]))
        at = end
        if m is None:
            if data:
                add(page[start + 9 : end - 3])
            continue
        tag, ends, attributes = m["tag"].lower(), m["end"], m["attributes"]
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                end = page.find(">", closing.end()) if closing else -1
                at = end + 1 if end >= 0 else length  # the search goes on behind it: nothing in it is markup
            continue
        if tag == "br":
            text.append(" ")
        if tag == "a":
            in_link = not ends
        if tag in VOID and tag != "hr" or tag not in BLOCKS and tag not in DROPPED:
            if tag in ("img", "input"):
                text.append(" ")
            continue
        if ends:
            close(tag, until="" if tag in ("article", "main", "body", "html") else "article main body")
            continue
        if tag in CLOSES_P:
            close("p", until="article section div td th body main li blockquote")
        if tag in SELF_CLOSING:
            close(*SELF_CLOSING[tag].split(), until=SCOPES[tag])
        elif tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit():
            close(stack[-1].tag)
        flush()
        if tag == "hr":
            continue
        up = stack[-1]
        css, parts, role, hidden = _names(attributes) if attributes else ("", frozenset(), False, False)
        if tag in ("html", "body", "main"):
            doubt = 0
        elif role or tag in DROPPED or tag == "header" and not innermost(("article", "main")):
            doubt = 2
        else:
            bad = parts & (NOT_AN_ARTICLE if tag == "article" else frozenset() if tag == "header" else UNWANTED)
            doubt = (1 if parts & WANTED else 2) if bad else 0
        node = Node(tag, f"{tag}.{css}" if css else tag, up, hidden, doubt)
        up.children.append(node)
        nodes.append(node)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
    if at < length:
        add(html.unescape(page[at:]))
    flush()
    _judge(nodes, blocks)
    return root, blocks


def _judge(nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Decide which nodes are kept. What a name or a tag says is weighed against the text outside links that a node holds.

    A doubtful name beside a wanted one (``social-post``) counts only for a node with under a fifth of the page's text. A form
    that holds four fifths of the page, with no article or main outside it, is the page's frame. If everything would go, the doubted nodes that hold at least half stay.
    """
    for node in reversed(nodes[1:]):  # children come after their parents
        node.up.mass += node.mass
    total = nodes[0].mass

    anchor = [n.tag in ("article", "main") and n.mass > 0 for n in nodes]
    place = {id(n): i for i, n in enumerate(nodes)}
    above, stop = [0] * len(nodes), list(range(1, len(nodes) + 1))  # anchors around a node; the end of what is in it, in page order
    for i, node in enumerate(nodes[1:], 1):
        up = place[id(node.up)]
        above[i] = above[up] + anchor[up]
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].up)]
        stop[up] = max(stop[up], stop[i])
    before = list(accumulate(anchor, initial=0))

    def framed(form: Node) -> bool:
        i = place[id(form)]
        return 5 * form.mass >= 4 * total and above[i] + before[stop[i]] - before[i] == before[-1]

    def decide(least: float) -> None:
        for node in nodes[1:]:
            if node.doubt == 1:
                out = 5 * node.mass < total
            else:
                out = node.doubt == 2 and node.mass < least * total and not (node.tag == "form" and framed(node))
            node.kept = node.up.kept and not node.hidden and not out
            node.inside = node.up.inside or node.tag in ("article", "main")

    decide(2.0)
    if total and not any(n.kept for n, _ in blocks):
        decide(0.5)


def collapse(root: Node, depth: int = 60) -> list:
    """The tree as nested [key, children], runs of like siblings merged; numbers the nodes in order (``slot``).

    What lies below ``depth`` levels is part of its ancestor there, which bounds the work on pages of any nesting."""
    count = 0

    def merged(group: list[Node], level: int) -> list:
        nonlocal count
        slot = count
        count += 1
        children: list[list[Node]] = []
        for node in group:
            node.slot = slot
            if level >= depth:
                below = list(node.children)
                while below:
                    one = below.pop()
                    one.slot = slot
                    below += one.children
                continue
            mine: list[list[Node]] = []
            for child in node.children:
                if mine and mine[-1][0].key == child.key:
                    mine[-1].append(child)
                else:
                    mine.append([child])
            children = _zip_runs(children, mine)
        return [group[0].key, [merged(g, level + 1) for g in children]]

    return merged([root], 0)


def _zip_runs(old: list[list[Node]], new: list[list[Node]]) -> list[list[Node]]:
    """Merge a sibling's runs of children into those gathered so far, in order, where keys agree."""
    if not old:
        return new
    out, i = list(old), 0
    for run in new:
        j = next((j for j in range(i, len(out)) if out[j][0].key == run[0].key), None)
        if j is None:
            out.insert(i, run)
            i += 1
        else:
            out[j] = out[j] + run
            i = j + 1
    return out


def matched(a: list, b: list, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal keys: size of the best match, and the pairs of children in it.

    ``known`` keeps the results for pairs of nodes during one alignment, so that each pair is matched once."""
    known = {} if known is None else known
    if (id(a), id(b)) in known:
        return known[id(a), id(b)]
    x, y = a[1], b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    gain = [[(1 + matched(p, q, known)[0] if p[0] == q[0] else 0) for q in y] for p in x]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j] if gain[i][j] else 0)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    known[id(a), id(b)] = best[len(x)][len(y)], pairs[::-1]
    return known[id(a), id(b)]


def absorb(wrapper: list, tree: list, known: dict | None = None) -> None:
    """Align ``tree`` with ``wrapper`` and add to the wrapper what it lacks, in order."""
    known = {} if known is None else known
    pairs = matched(wrapper, tree, known)[1]
    partner = {j: i for i, j in pairs}
    children, i = list(wrapper[1]), 0
    for j, child in enumerate(tree[1]):
        if j in partner:
            absorb(wrapper[1][partner[j]], child, known)
            i = next(k for k, c in enumerate(children) if c is wrapper[1][partner[j]]) + 1
        else:
            children.insert(i, json.loads(json.dumps(child)))
            i += 1
    wrapper[1] = children


def places(wrapper: list, tree: list) -> list[int]:
    """For each node of ``tree`` in order, the number of the wrapper's node that it aligns with, or -1."""
    numbers: dict[int, int] = {}
    known: dict = {}

    def number(node: list) -> None:
        numbers[id(node)] = len(numbers)
        for child in node[1]:
            number(child)

    def walk(a: list | None, b: list) -> list[int]:
        out = [numbers[id(a)] if a is not None else -1]
        partner = {j: i for i, j in matched(a, b, known)[1]} if a is not None else {}
        for j, child in enumerate(b[1]):
            out += walk(a[1][partner[j]] if j in partner else None, child)
        return out

    number(wrapper)
    return walk(wrapper, tree)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_slots(page: str) -> tuple[str, list[int], list[int]]:
    """Skeleton as JSON, the nodes with text of their own, and a digest of each one's text."""
    root, blocks = parse(page)
    tree = collapse(root)
    texts: dict[int, list[str]] = {}
    for node, text in blocks:
        texts.setdefault(node.slot, []).append(text)
    order = sorted(texts)
    return json.dumps(tree, separators=(",", ":")), order, [_digest("\n".join(texts[s])) for s in order]


def main_text(page: str, templates: dict[str, frozenset[int]] | None = None, template: frozenset[int] = frozenset()) -> str:
    """The article: kept blocks, within article or main where a page has one, without the template's nodes.

    ``templates`` gives these by the page's skeleton, ``template`` directly. A page that would be left with nothing has only
    been seen next to its own copies and stays whole.
    """
    root, blocks = parse(page)
    kept = [(n, t) for n, t in blocks if n.kept]
    kept = [(n, t) for n, t in kept if n.inside] or kept
    if templates or template:
        tree = collapse(root)
        constant = template or templates.get(json.dumps(tree, separators=(",", ":")), frozenset())
        kept = [(n, t) for n, t in kept if n.slot not in constant] or kept
    return "\n".join(t for _, t in kept)


def wrappers(slots: DataFrame, align: int = 64) -> DataFrame:
    """(host, skeleton, places): each distinct skeleton of a host aligned with the host's wrapper.

    Skeletons, not pages, are gathered by host, about ``align`` at a time: batches of a host become partial wrappers, batches of
    these are merged again, until one is left. No task holds more than some ``align`` trees of a host, however many it has.
    """
    distinct = slots.groupBy("host", "skeleton").agg(F.count("*").alias("n"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "skeleton"], ascending=[False, True])
        wrapper = json.loads(group["skeleton"].iloc[0])
        for skeleton in group["skeleton"].iloc[1:]:
            absorb(wrapper, json.loads(skeleton))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "skeleton": [json.dumps(wrapper, separators=(",", ":"))], "n": [int(group["n"].sum())]})

    shape = "host string, skeleton string, n long"
    partial = saved(distinct)
    while not (many := partial.groupBy("host").agg(F.count("*").alias("trees")).where("trees > 1")).isEmpty():
        sized = partial.join(many, "host", "left")
        shard = F.pmod(F.xxhash64("skeleton"), F.ceil(F.coalesce("trees", F.lit(1)) / align).cast("int"))
        partial = saved(sized.withColumn("shard", shard).groupBy("host", "shard").applyInPandas(build, shape))
    whole = partial.select("host", F.col("skeleton").alias("wrapper"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [places(json.loads(w), json.loads(s)) for w, s in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["host", "skeleton", "places"])

        return each

    return map_arrow(distinct.join(whole, "host").select("host", "skeleton", "wrapper"), make, "host string, skeleton string, places array<int>")


def extract(pages: DataFrame, *, min_pages: int = 8, max_templates: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html), from the whole html.

    A wrapper node is template if its text is the same on at least ``min_pages`` different pages of the host and on all
    that have it. A null or empty html gives the empty text. A page whose url is
    null or has no host is read by its own markup only. Broken markup is closed as browsers do. Repeated pages are repeated in the result
    and count once as evidence. An empty table gives no rows. Columns besides those three are not read.
    """
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))

    def slots():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [page_slots(h or "") for h in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", "skeleton", "slots", "digests"])

        return each

    parsed = map_arrow(rows.where("host <> ''").select("host", "html"), slots, "host string, skeleton string, slots array<int>, digests array<long>")
    parsed = saved(parsed.distinct())
    aligned = saved(wrappers(parsed))
    text = parsed.join(aligned, ["host", "skeleton"]).select("host", "places", F.explode(F.arrays_zip("slots", "digests")).alias("s"))
    nodes = text.select("host", F.get("places", F.col("s.slots")).alias("node"), F.col("s.digests").alias("digest"))
    constant = nodes.groupBy("host", "node").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    constant = constant.where((F.col("low") == F.col("high")) & (F.col("n") >= min_pages) & (F.col("node") >= 0)).select("host", "node")
    placed = aligned.select("host", "skeleton", F.posexplode("places").alias("slot", "node")).join(constant, ["host", "node"])
    templates = saved(placed.groupBy("host", "skeleton").agg(F.sort_array(F.collect_set("slot")).alias("template")))
    few = templates.limit(max_templates + 1).count() <= max_templates
    known: dict[str, dict[str, frozenset[int]]] = {}
    for r in templates.toLocalIterator() if few else ():
        known.setdefault(r.host, {})[r.skeleton] = frozenset(r.template)

    def texts():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            given = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows
            for page, at, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), given, strict=True):
                out.append(main_text(page or "", known.get(at), frozenset(template or ())))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

        return each

    if few:
        return map_arrow(rows, texts, "page_id long, url string, text string, n_chars long")
    with_skeleton = map_arrow(rows, _with_skeleton, "page_id long, url string, html string, host string, skeleton string")
    joined = with_skeleton.join(templates, ["host", "skeleton"], "left").select("page_id", "url", "html", "host", "template")
    return map_arrow(joined, texts, "page_id long, url string, text string, n_chars long")


def _with_skeleton():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        skeletons = [page_slots(h or "")[0] for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(skeletons)], names=["page_id", "url", "html", "host", "skeleton"])

    return each
