"""Main text of web pages by wrapper induction.

Pages of one host and layout (the labels right below the body) are aligned by simple tree matching
with the smallest page among them, node by node; aligned nodes are slots. A slot whose text most of these
pages share is constant, the others vary. Where most slots of a region that bear one label are constant, its
constant ones are template; what varies is content. Pages of equal bytes count once as evidence, and pages
of a layout with too few others have none. Elements that say what they are (menus, adverts, forms, comments,
notices; see DROPPED and WORDS) go whatever the evidence; where a page has an article or main element,
what lies outside goes; inside, only nodes with a class or an id can be template, since a passage that articles share stays.

Trees hold blocks; inline elements are part of their block's text. Tasks parse and align a page at a time
against its layout's page; texts of slots are told as hashes and counted by Spark, so no host meets in a task.

Odd input: null or empty html gives the empty text; broken markup is read as far as it can be (unclosed
elements end with their parents, unknown entities stay, an unclosed comment or script takes the rest);
elements more than DEPTH deep lie flat at that depth; a page all of whose slots are constant keeps them;
repeated rows and rows without a page_id are read each; null urls are one host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_side

#: Pages of a layout, of different bytes, from which on its constants are told, and the share of them that a constant text has.
LEAST_PAGES, CONSTANT = 3, 0.6
#: Share of constants among a region's slots of one label that makes them template.
TEMPLATE = 0.5
#: Share of a list's or region's characters that links hold, from which on it is no text, where no article is marked.
LINKS = 0.5
DEPTH = 60

# fixed values: element names of HTML and words that mark what is no main text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label output br img".split()
)
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
DROPPED = frozenset(
    "head nav footer aside form menu dialog button select fieldset object video audio canvas map datalist input script style textarea title noscript iframe noframes xmp template svg math".split()
)
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote table figure details address tr td".split())
CELLS = frozenset(("td", "th"))
WORDS = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer ad ads advert adverts advertisement advertising adsbygoogle adbox sponsor sponsored promo promoted "
    "promotion cookie cookies consent gdpr notice notices alert popup modal overlay banner newsletter subscribe subscription signup signin login comment comments respond reply replies disqus discussion "
    "share sharing social related recommended recommendations pagination pager skip search form toolbar masthead copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: An end tag or an implied end doesn't reach beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"td", "th", "div", "article", "section", "main", "body", "li", "blockquote"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"


class Page:
    """Blocks of a page, parents before children. Leaves are runs of text of one block."""

    def __init__(self) -> None:
        self.label: list[str] = []
        self.parent: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []  # characters of a leaf inside links
        self.dropped: list[bool] = []  # says itself that it is no main text
        self.inside: list[bool] = []  # lies in an article or main element

    def add(self, label: str, parent: int, text: str = "", linked: int = 0, dropped: bool = False, inside: bool = False) -> int:
        for column, x in ((self.label, label), (self.parent, parent), (self.text, text), (self.linked, linked), (self.dropped, dropped), (self.inside, inside)):
            column.append(x)
        return len(self.label) - 1


def _marked(tag: str, given: dict[str, str], inside: bool) -> bool:
    """Whether an element says that it is no main text."""
    if tag in DROPPED or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES:
        return True
    if "display:none" in re.sub(r"\s", "", given.get("style", "").lower()):
        return True
    if tag in ("html", "body", "main") or tag == "header" and inside:
        return False
    if tag == "header":
        return True
    words = {w.lower() for w in _PIECES.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    return bool(words & WORDS) or "header" in words and not inside


def parse(text: str) -> Page:
    page = Page()
    root = page.add("html", -1)
    open_: list[tuple[str, int]] = [("html", root)]  # tags with their nodes; inline ones share their block's
    run: list[str] = []
    linked = 0
    links = 0  # a elements that are open
    raw = None

    def ended() -> None:
        """What was read of the block at hand is a leaf."""
        nonlocal linked
        words = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if words:
            node = open_[-1][1]
            page.add("#", node, "" if page.dropped[node] else words, linked, page.dropped[node], page.inside[node])
        run.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in open_[to:]):
            ended()
        links -= sum(t == "a" for t, _ in open_[to:])
        del open_[to:]

    def lowest(tags: set[str], scope: set[str] | frozenset = frozenset()) -> int:
        """Place of the innermost open element of these tags, 0 if there is none within scope."""
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in tags:
                return i
            if open_[i][0] in scope:
                return 0
        return 0

    for m in _TOKEN.finditer(text):
        got = m.group()
        if raw is not None:
            if m.group(1) is None or m.group(1).lower() != raw:
                continue
            raw = None
            continue
        if got[0] != "<" or len(got) == 1:
            run.append(got)
            linked += len(got) * bool(links)
            continue
        tag = m.group(1)
        if tag is not None:
            tag = tag.lower()
            if tag in INLINE:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] == tag:
                        links -= sum(t == "a" for t, _ in open_[i:])
                        del open_[i:]
                        break
                    if open_[i][0] not in INLINE:
                        break
            elif (i := lowest({tag}, SCOPES.get(tag, frozenset()))) > 0:
                close(i)
            continue
        tag = m.group(2) or m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                open_.append((tag, open_[-1][1]))
                links += tag == "a"
            continue
        given = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTRIBUTE.finditer(m.group(3) or m.group(5) or "")}
        if tag in RAW:  # parts no block
            if not got.endswith("/>"):
                raw = tag
            continue
        ended()
        if tag in VOID:
            continue
        if tag in ("html", "body") and lowest({tag}) + (tag == "html") > 0:
            continue
        if tag in CLOSES_P and (i := lowest({"p"}, {"td", "th", "button"})) > 0:
            close(i)
        while tag in CLOSED_BY and (i := lowest(CLOSED_BY[tag], SCOPES[tag])) > 0:
            close(i)
        if tag in CELLS:
            tag = "td"
        while open_[-1][0] in INLINE:  # a block ends the inline elements left open
            links -= open_.pop()[0] == "a"
        node = open_[-1][1]
        if len(open_) <= DEPTH:
            inside = page.inside[node] or tag in MAIN or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() == "articlebody"
            own = "." + re.sub(r"\d+", "0", f"{given.get('class', '')}#{given.get('id', '')}") if given.get("class") or given.get("id") else ""
            node = page.add(tag + own, node, "", 0, page.dropped[node] or _marked(tag, given, page.inside[node]), inside)
        open_.append((tag, node))
    ended()
    return page


class Tree:
    """Children of each node, and a hash of each node's shape."""

    def __init__(self, label: list[str], parent: list[int]) -> None:
        self.label = label
        self.children: list[list[int]] = [[] for _ in label]
        for i, p in enumerate(parent):
            if p >= 0:
                self.children[p].append(i)
        self.shape: list[int] = [0] * len(label)
        self.size: list[int] = [1] * len(label)
        for i in range(len(label) - 1, -1, -1):  # children follow their parents
            self.shape[i] = hash((label[i], *[self.shape[c] for c in self.children[i]]))
            self.size[i] += sum(self.size[c] for c in self.children[i])


def match(a: Tree, b: Tree) -> list[int]:
    """Simple tree matching: for each node of a its partner in b, or -1; partners' parents are partners, order is kept, and as many nodes as can be have one."""
    partner = [-1] * len(a.label)
    known: dict[tuple[int, int], int] = {}

    def ends(x: list[int], y: list[int]) -> tuple[int, int]:
        """Equal shapes at the head and tail of two lists of children match in some best matching."""
        n = min(len(x), len(y))
        head = 0
        while head < n and a.shape[x[head]] == b.shape[y[head]]:
            head += 1
        tail = 0
        while tail < n - head and a.shape[x[-1 - tail]] == b.shape[y[-1 - tail]]:
            tail += 1
        return head, tail

    def table(x: list[int], y: list[int]) -> list[list[int]]:
        best = [[0] * (len(y) + 1)]
        for i in x:
            row, above = [0], best[-1]
            for k, j in enumerate(y):
                w = weight(i, j)
                row.append(max(row[-1], above[k + 1], above[k] + w if w else 0))
            best.append(row)
        return best

    def weight(i: int, j: int) -> int:
        if a.label[i] != b.label[j]:
            return 0
        if a.shape[i] == b.shape[j]:
            return a.size[i]
        if (w := known.get((a.shape[i], b.shape[j]))) is None:
            x, y = a.children[i], b.children[j]
            head, tail = ends(x, y)
            w = 1 + sum(a.size[c] for c in (*x[:head], *x[len(x) - tail :]))
            w += table(x[head : len(x) - tail], y[head : len(y) - tail])[-1][-1]
            known[a.shape[i], b.shape[j]] = w
        return w

    def pair(i: int, j: int) -> None:
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            partner[i] = j
            x, y = a.children[i], b.children[j]
            head, tail = ends(x, y)
            todo += zip(x[:head], y[:head])
            todo += zip(x[len(x) - tail :], y[len(y) - tail :])
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            best = table(x, y)
            m, n = len(x), len(y)
            while m and n:
                if best[m][n] == best[m - 1][n]:
                    m -= 1
                elif best[m][n] == best[m][n - 1]:
                    n -= 1
                else:
                    m, n = m - 1, n - 1
                    todo.append((x[m], y[n]))

    if a.label and b.label and a.label[0] == b.label[0]:
        pair(0, 0)
    return partner


def layout(page: Page) -> str:
    """The labels right below the body, and below that of one child: containers as often as they occur, blocks of text once each."""
    below: dict[int, list[int]] = {}
    for i, p in enumerate(page.parent):
        below.setdefault(p, []).append(i)
    at = 0
    while len(below.get(at, [])) == 1 and page.label[below[at][0]] != "#":
        at = below[at][0]
    labels = [page.label[i] for i in below.get(at, [])]
    return " ".join(sorted({x for x in labels if x in BLOCKS}) + sorted(x for x in labels if x not in BLOCKS))


_TREE = [("label", pa.list_(pa.string())), ("parent", pa.list_(pa.int32())), ("text", pa.list_(pa.string())), ("linked", pa.list_(pa.int32())), ("dropped", pa.list_(pa.bool_())), ("inside", pa.list_(pa.bool_()))]
_TREE_DDL = "label array<string>, parent array<int>, text array<string>, linked array<int>, dropped array<boolean>, inside array<boolean>"


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, host, print) -> (layout, nodes, host, print): what the smallest page of a layout is chosen by."""
    for batch in slices(batches):
        pages = [parse(x or "") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([layout(p) for p in pages], pa.string()), pa.array([len(p.label) for p in pages], pa.int32()), *batch.columns[1:]],
            ["layout", "nodes", "host", "print"],
        )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, ...) -> (layout, the tree, ...)."""
    for batch in slices(batches):
        pages = [parse(x or "") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([layout(p) for p in pages], pa.string())]
            + [pa.array([getattr(p, name) for p in pages], kind) for name, kind in _TREE]
            + batch.columns[1:],
            ["layout", *[name for name, _ in _TREE], *batch.schema.names[1:]],
        )


def _blocks(label: list[str], parent: list[int], text: list[str], linked: list[int], dropped: list[bool], inside: list[bool], wrapper: Tree | None) -> list[dict]:
    """The leaves that may be main text, with their slots and regions in the layout's page."""
    partner = match(Tree(label, parent), wrapper) if wrapper else [-1] * len(label)
    leaves = [i for i, x in enumerate(label) if x == "#" and not dropped[i]]
    if any(inside[i] for i in leaves):
        leaves = [i for i in leaves if inside[i]]
    else:
        total: dict[int, list[int]] = {}
        region = {}
        for i in leaves:
            at = parent[i]
            while label[at].split(".")[0] in ("li", "p", "h1", "h2", "h3", "h4", "h5", "h6") and parent[at] >= 0:
                at = parent[at]
            region[i] = at
            sums = total.setdefault(at, [0, 0])
            sums[0] += len(text[i])
            sums[1] += linked[i]
        leaves = [i for i in leaves if total[region[i]][1] <= LINKS * total[region[i]][0]]
    out = []
    for i in leaves:
        at = parent[i]
        told = "." in label[at]
        slot = partner[i] if told or not inside[i] else -1
        up = parent[at] if parent[at] >= 0 else at
        out.append({"text": text[i], "slot": slot, "region": partner[up] if slot >= 0 else -1, "label": label[at] if slot >= 0 else "", "hash": xxhash.xxh64_intdigest(text[i].encode("utf-8", "surrogatepass")) - (1 << 63) if slot >= 0 else 0})
    return out


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("slot", pa.int32()), ("region", pa.int32()), ("label", pa.string()), ("hash", pa.int64())]))
_BLOCKS_DDL = "array<struct<text string, slot int, region int, label string, hash long>>"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wrapper's label and parent, the page's tree, the rest) -> (blocks, the rest)."""
    at = 2 + len(_TREE)
    last: tuple = ()
    wrapper = None
    for batch in slices(batches):
        found = []
        for own_label, own_parent, *tree in zip(*(c.to_pylist() for c in batch.columns[:at]), strict=True):
            if (own_label, own_parent) != last:
                last, wrapper = (own_label, own_parent), own_label and Tree(own_label, own_parent)
            found.append(_blocks(*tree, wrapper))
        yield pa.RecordBatch.from_arrays([pa.array(found, _BLOCKS), *batch.columns[at:]], ["blocks", *batch.schema.names[at:]])


def main_texts(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", tag: str = "") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, its blocks parted by an empty line."""
    rows = pages.select(
        F.col(f"`{html}`").cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`").cast("string"), _HOST, 1), F.lit(""))).alias("host"),
        F.xxhash64(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))).alias("print"),
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
    )
    # the smallest page of each layout stands for it; of pages of equal bytes one counts
    sized = rows.select("html", "host", "print").mapInArrow(_sized, "layout string, nodes int, host string, print long")
    chosen = (
        sized.groupBy("host", "layout", "print")
        .agg(F.min("nodes").alias("nodes"))
        .groupBy("host", "layout")
        .agg(F.min(F.struct("nodes", "print")).alias("least"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_PAGES)
        .select("host", "layout", F.col("least.print").alias("print"))
    )
    kept = [c for c, _ in _TREE]
    kinds = dict(rows.dtypes) | {"layout": "string"}
    tree = lambda df: df.mapInArrow(_parsed, f"layout string, {_TREE_DDL}, " + ", ".join(f"{c} {kinds[c]}" for c in df.columns[1:]))
    few = small_side(materialize(chosen.select("host", "print").distinct(), "chosen", tag))
    wrappers = tree(rows.join(few, ["host", "print"], "left_semi").select("html", "host")).groupBy("host", "layout").agg(F.min(F.struct("label", "parent")).alias("w"))
    wrappers = small_side(materialize(wrappers.select("host", "layout", F.col("w.label").alias("own_label"), F.col("w.parent").alias("own_parent")), "wrappers", tag))
    aligned = tree(rows.select("html", "host", "print", "page_id", "url")).join(wrappers, ["host", "layout"], "left").select("own_label", "own_parent", *kept, "host", "layout", "print", "page_id", "url")
    blocks = materialize(
        aligned.mapInArrow(_aligned, f"blocks {_BLOCKS_DDL}, " + ", ".join(f"{c} {kinds[c]}" for c in ("host", "layout", "print", "page_id", "url"))), "blocks", tag
    )
    template = _template(blocks)
    found = blocks.join(small_side(materialize(template, "template", tag)), ["host", "layout"], "left")
    stay = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["slot"]), F.lit(False)))
    stay = F.when(F.size(stay) > 0, stay).otherwise(F.col("blocks"))
    return found.select("page_id", "url", F.concat_ws("\n\n", F.transform(stay, lambda b: b["text"])).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _template(blocks: DataFrame) -> DataFrame:
    """host, layout, template: the slots that are template."""
    slots = F.transform(F.filter("blocks", lambda b: b["slot"] >= 0), lambda b: F.struct(b["slot"].alias("slot"), b["region"].alias("region"), b["label"].alias("label"), b["hash"].alias("hash")))
    once = blocks.select("host", "layout", "print", slots.alias("slots")).filter(F.size("slots") > 0).dropDuplicates(["host", "layout", "print"])
    values = once.select("host", "layout", F.explode("slots").alias("s")).groupBy("host", "layout", "s.slot", "s.region", "s.label", "s.hash").agg(F.count(F.lit(1)).alias("n"))
    by_slot = values.groupBy("host", "layout", "slot", "region", "label").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    constant = (F.col("n") >= LEAST_PAGES) & (F.col("most") >= CONSTANT * F.col("n"))
    by_label = by_slot.groupBy("host", "layout", "region", "label").agg(F.avg(constant.cast("int")).alias("share"), F.collect_list(F.when(constant, F.col("slot"))).alias("slots"))
    return by_label.filter(F.col("share") > TEMPLATE).groupBy("host", "layout").agg(F.flatten(F.collect_list("slots")).alias("template"))
