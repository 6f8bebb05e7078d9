"""HTML extraction by wrapper induction.

Every page is parsed into a tree of regions (structural elements labelled by tag, class and id); text blocks inside a region are
summed into it, and neighbouring regions of one shape are merged. Pages of one host are aligned in three steps that never gather
a host in one place: pages are reduced to statistics per (host, tree shape, region) by an aggregate; the most frequent shape of
a host is its reference tree; each other shape is aligned to it by simple tree matching, and the statistics of matched regions
are summed per reference region. Regions whose text is the same on all of a host's (differing) pages are template, the others
are slots. The wrapper of a host is its reference tree with the region that holds its varying text, chosen without navigation, forms,
adverts and the like (known by tag, by words of class, id and role, or by link share), and the template regions to leave out.

extract() aligns each page with the reference tree of its host by the same matching; a page without a node for the content region
falls back to the same choice within the page. Inside the chosen region all text blocks stay, recurring ones and lists of links
too; only aligned nodes that never change and regions known as furniture go.

Pages are read forward once, whatever their length: tags whose quotes never close end at the next bracket, what is nested deeper
than DEPTH stands in its ancestor on that level, and implied end tags look up through REACH elements.

Character references are decoded, white space in a block becomes one space, blocks (block elements, and lines ended by br) are joined by one
line feed. Nulls and empty pages give empty text; a null url has the empty host; repeated pages are extracted each; broken markup is closed as
browsers do for paragraphs, list items and table cells; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf

# HTML elements by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
                   "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
REGION = frozenset("html body header nav main article section aside footer div form ul ol dl table figure details dialog menu fieldset".split())
CLOSES_P = BLOCK - frozenset("br body html option optgroup td th tr tbody thead tfoot legend summary".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Elements and words of class, id and role that mark page furniture; words count in full, stems as beginnings.
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu button select".split())
FURNITURE_WORDS = frozenset(("ad ads adv nav navbar menu footer sidebar aside banner notice notices popup modal toolbar search login signup register share sharing "
                             "skip pager legal copyright alert gdpr outbrain taboola disqus reply replies respond discussion feedback navigation complementary "
                             "contentinfo").split())
FURNITURE_STEMS = ("advert", "comment", "sidebar", "breadcrumb", "newsletter", "cookie", "consent", "subscri", "sponsor", "promo", "related", "recommend",
                   "social", "pagination", "teaser", "widget", "masthead")
HEAD_WORDS = frozenset(("header", "head", "top", "topbar"))
CONTENT_WORDS = frozenset(("article", "content", "post", "entry", "main", "story", "text", "body"))
#: share of link text from which a slot is navigation; share of a region's good text that a child must hold to be chosen instead
LINKS, HOLDS = 0.5, 0.8
#: pages from which a text that never changes is template
CONSTANT_PAGES = 3

#: levels of the element tree; what is nested deeper stands in its ancestor on the last one
DEPTH = 150
#: elements that an implied end tag looks up through; quotes of unclosed tags passed on a page before quotes are ignored on it
REACH, PATIENCE = 512, 1_000_000
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
DELIMITER = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """items are child nodes, texts, and None for a line break; sink is where its content goes: its own items, or those of an ancestor at DEPTH."""

    __slots__ = ("tag", "label", "names", "hidden", "parent", "items", "depth", "sink")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.parent, self.items = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.sink = self.items
        self.names, self.hidden, self.label = frozenset(), False, tag
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "hidden" in attributes or "style" in attributes):
            values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            self.hidden = "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower()
            self.names = frozenset(x.lower() for k in ("class", "id", "role") for x in NAME_PART.findall(values.get(k, "")))
            # numbers of posts vary from page to page, numbers of styles do not
            self.label = tag + "." + re.sub(r"[0-9]{3,}", "", " ".join(values.get("class", "").split()[:1])) + "#" + re.sub(r"[0-9]+", "", values.get("id", ""))


class Scanner:
    """Where tags end. It only moves forward, so that a page of any length is read once, whatever its quotes and brackets."""

    def __init__(self, text: str):
        self.text, self.spent = text, 0
        self.last = {c: text.rfind(c) for c in (">", '"', "'", "]]>")}

    def tag_end(self, at: int) -> int:
        """Position of the > that ends the tag whose attributes start at at; the next one of all if quotes never close; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        here, steps = at, 0
        while self.spent < PATIENCE:
            steps += 1
            m = DELIMITER.search(self.text, here)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            if m.start() >= self.last[m.group()]:
                break
            here = self.text.find(m.group(), m.end()) + 1
        self.spent += steps
        return self.text.find(">", at)


def parse(text: str) -> Node:
    """The element tree; items are child nodes, texts (decoded), and None for a line break."""
    root = Node("#root", "", None)
    at, here, size = 0, root, len(text)
    scan, opened, begun = Scanner(text), Counter(), 0

    def close(upto: Node | None) -> Node:
        """Close the open elements from here to upto's child."""
        node = here
        while node is not upto:
            opened[node.tag] -= 1
            if node.sink is not node.items and node.tag in BLOCK:
                node.sink.append(None)
            node = node.parent
        return node

    def above(wanted, fence) -> Node | None:
        """The topmost open element of wanted below the first one of the fence."""
        node, found, steps = here, None, 0
        while node is not root and node.tag not in fence and steps < REACH:
            if node.tag in wanted:
                found = node
            node, steps = node.parent, steps + 1
        return found if node is root or node.tag in fence or steps == REACH else None

    while at < size:
        start = text.find("<", at)
        if start < 0:
            break
        at = start + 1
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            stop, tag = (end + 3 if end >= 0 else size), None
        elif text.startswith("<![CDATA[", start) and start < scan.last["]]>"]:
            stop, tag = text.find("]]>", start) + 3, None
        elif text[at:at + 1] in ("!", "?"):
            end = text.find(">", at) if at <= scan.last[">"] else -1
            if end < 0:
                continue
            stop, tag = end + 1, None
        else:
            m = OPENING.match(text, start)
            end = scan.tag_end(m.end()) if m else -1
            if end < 0:
                continue                                            # a sign, not a tag
            stop, tag, attributes = end + 1, m.group(2).lower(), text[m.end():end]
        if start > begun:
            here.sink.append(entities.unescape(text[begun:start]))
        at = begun = stop
        if tag is None:
            continue
        if m.group(1):
            if opened[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node.parent)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                at = begun = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                here.sink.append(None)
            continue
        if tag in CLOSES_P and opened["p"]:
            node, steps = here, 0
            while node is not root and node.tag != "p" and node.tag not in REGION and steps < REACH:
                node, steps = node.parent, steps + 1
            if node.tag == "p":
                here = close(node.parent)
        if tag in SAME:
            last = above(SAME[tag], FENCE[tag])
            if last is not None:
                here = close(last.parent)
        if tag in ("html", "body") and opened[tag]:
            continue                                                # repeated or late: continue in the open one
        child = Node(tag, attributes, here)
        if child.depth <= DEPTH:
            here.items.append(child)
        else:
            child.sink = [] if furniture(child, True) or here.depth > DEPTH and here.sink is here.items else here.sink
            if tag in BLOCK:
                child.sink.append(None)
        if not attributes.endswith("/"):
            here = child
            opened[tag] += 1
    if begun < size:
        here.sink.append(entities.unescape(text[begun:]))
    return root


def furniture(node: Node, inside: bool) -> bool:
    """Whether a node is known to be no content; inside: within the chosen region, where headings have headers of their own."""
    if node.hidden or node.tag in FURNITURE_TAGS:
        return True
    if node.names & FURNITURE_WORDS or any(x.startswith(s) for x in node.names for s in FURNITURE_STEMS):
        return node.tag not in ("html", "body")
    if node.tag == "header" or node.names & HEAD_WORDS:
        return not inside and not node.names & CONTENT_WORDS and node.tag not in ("html", "body", "article", "main")
    return False


class Region:
    """A region with its own text (outside child regions) and merged repeats."""

    __slots__ = ("label", "furniture", "text", "link", "hash", "children", "kind", "nodes")

    def __init__(self, label: str, is_furniture: bool, kind: str, node: Node):
        self.label, self.furniture, self.kind, self.nodes = label, is_furniture, kind, [node]
        self.text = self.link = self.hash = 0
        self.children: list[Region] = []


def regions(node: Node, inside: bool = False) -> Region:
    known = furniture(node, inside)
    region = Region(node.label, known, "article" if node.tag == "article" else "main" if node.tag == "main" or "main" in node.names and node.tag in REGION else "", node)
    _fill(node, region, inside or node.tag in ("article", "main"), False)
    merged: list[Region] = []
    for child in region.children:
        if merged and _shape(merged[-1]) == _shape(child):
            _merge(merged[-1], child)
        else:
            merged.append(child)
    region.children = merged
    return region


def _fill(node: Node, region: Region, inside: bool, linked: bool) -> None:
    for item in node.items:
        if item is None:
            continue
        if isinstance(item, str):
            size = len("".join(item.split()))
            if size:
                region.text += size
                region.link += size if linked else 0
                region.hash = crc32(item.strip().encode("utf-8", "replace"), region.hash)
        elif item.tag in REGION or item.names and furniture(item, inside):
            region.children.append(regions(item, inside))
        else:
            _fill(item, region, inside, linked or item.tag == "a")


def _shape(region: Region) -> str:
    return region.label + "(" + ",".join(_shape(c) for c in region.children) + ")"


def _merge(a: Region, b: Region) -> None:
    a.kind = a.kind or "many"
    a.nodes += b.nodes
    a.text, a.link, a.hash = a.text + b.text, a.link + b.link, crc32(b.hash.to_bytes(4, "little"), a.hash)
    for x, y in zip(a.children, b.children):
        _merge(x, y)


def flat(region: Region) -> list[tuple[int, Region]]:
    """(depth, region) in preorder."""
    out, todo = [], [(0, region)]
    while todo:
        depth, r = todo.pop()
        out.append((depth, r))
        todo += [(depth + 1, c) for c in reversed(r.children)]
    return out


# statistics: one row per (host, shape, region)
STATS = "host string, shape string, node int, label string, depth int, kind string, furniture boolean, pages long, text long, link long, low long, high long, page_low long, page_high long"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _statistics(batches):
    for batch in batches:
        total: dict[tuple, list] = {}
        hosts, pages = batch.column("host"), batch.column("html")
        for i in range(len(batch)):
            nodes = flat(regions(parse(pages[i].as_py() or "")))
            shape = f"{crc32(chr(10).join(f'{d} {r.label}' for d, r in nodes).encode()):08x}{len(nodes):x}"
            whole = crc32(repr([r.hash for _, r in nodes]).encode())
            host = hosts[i].as_py()
            for j, (depth, r) in enumerate(nodes):
                old = total.get((host, shape, j))
                if old is None:
                    total[host, shape, j] = [r.label, depth, r.kind, r.furniture, 1, r.text, r.link, r.hash, r.hash, whole, whole]
                else:
                    old[2], old[3] = max(old[2], r.kind), max(old[3], r.furniture)
                    old[4] += 1
                    old[5] += r.text
                    old[6] += r.link
                    old[7], old[8], old[9], old[10] = min(old[7], r.hash), max(old[8], r.hash), min(old[9], whole), max(old[10], whole)
        rows = [(*k, *v) for k, v in total.items()]
        for i in range(0, len(rows), 20_000):
            yield _arrow(rows[i:i + 20_000], STATS)


def match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
    """Simple tree matching of two preorder lists (depth, label): node of a -> node of b. Roots with different labels match nothing."""
    kids = []
    for tree in (a, b):
        children: list[list[int]] = [[] for _ in tree]
        path: list[int] = []
        for i, (depth, _) in enumerate(tree):
            del path[depth:]
            if path:
                children[path[-1]].append(i)
            path.append(i)
        kids.append(children)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def pair(i: int, j: int) -> tuple[int, list]:
        """(matched nodes, matched child pairs) of two subtrees with equal root labels."""
        if a[i][1] != b[j][1]:
            return 0, []
        if (i, j) not in memo:
            x, y = kids[0][i], kids[1][j]
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p, u in enumerate(x, 1):
                for q, v in enumerate(y, 1):
                    best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + pair(u, v)[0])
            chosen, p, q = [], len(x), len(y)
            while p and q:
                if best[p][q] == best[p - 1][q]:
                    p -= 1
                elif best[p][q] == best[p][q - 1]:
                    q -= 1
                else:
                    chosen.append((x[p - 1], y[q - 1]))
                    p, q = p - 1, q - 1
            memo[i, j] = (best[-1][-1] + 1, chosen)
        return memo[i, j]
    out: dict[int, int] = {}
    todo = [(0, 0)] if a and b and pair(0, 0)[0] else []
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += pair(i, j)[1]
    return out


ALIGNED = "host string, node int, label string, depth int, kind string, furniture boolean, pages long, text long, link long, low long, high long, page_low long, page_high long"


def _align(batches):
    """host, nodes (of a shape), reference (labels) -> statistics per reference region."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own = sorted(r["nodes"], key=lambda n: n["node"])
            reference = [(n["depth"], n["label"]) for n in sorted(r["reference"], key=lambda n: n["node"])]
            for i, j in match([(n["depth"], n["label"]) for n in own], reference).items():
                n = own[i]
                rows.append((r["host"], j, n["label"], n["depth"], n["kind"], n["furniture"], *(n[c] for c in ("pages", "text", "link", "low", "high", "page_low", "page_high"))))
        yield _arrow(rows, ALIGNED)


def choose(nodes: list[dict]) -> tuple[int, list[int]]:
    """(content region, template regions in it) by position, from all regions in preorder with statistics."""
    path: list[int] = []
    parent, good, bad, constant = [], [], [], []
    for i, n in enumerate(nodes):
        del path[n["depth"]:]
        parent.append(path[-1] if path else -1)
        path.append(i)
        constant.append(n["pages"] >= CONSTANT_PAGES and n["low"] == n["high"] and n["page_low"] != n["page_high"] and n["text"] > 0)
        furnished = n["furniture"] or (parent[i] >= 0 and bad[parent[i]] == 2)
        bad.append(2 if furnished else 1 if constant[i] or n["link"] > LINKS * n["text"] else 0)
        good.append(0 if bad[i] else n["text"] - n["link"])
    under = list(good)
    for i in range(len(nodes) - 1, 0, -1):
        under[parent[i]] += under[i]
    at = -1
    for kind in ("article", "main"):
        named = [i for i, n in enumerate(nodes) if n["kind"] == kind and bad[i] != 2 and under[i] > 0]
        # an article that holds a small part of the text is a teaser
        named = [i for i in named if under[i] * 2 >= under[0] or kind == "article" and under[i] * 4 >= under[0]]
        if named:
            at = max(named, key=lambda i: under[i])
            break
    if at < 0:
        at = 0
        while True:
            # repeated regions are the blocks of their parent, and text beside the largest region is its heading
            inner = [i for i in range(len(nodes)) if parent[i] == at and nodes[i]["kind"] != "many" and under[i] >= HOLDS * max(under[at], 1)]
            if not inner or good[at] > 0 and nodes[at]["label"].split(".")[0] not in ("#root", "html", "body"):
                break
            at = inner[0]

    above, i = set(), at
    while i >= 0:
        above.add(i)
        i = parent[i]
    # in the article only what never changes goes; a list of links that varies stays, and so does what holds a varying region
    varies = [not constant[i] and n["text"] > 0 and not n["furniture"] for i, n in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        varies[parent[i]] = varies[parent[i]] or varies[i]
    return at, [i for i in range(len(nodes)) if constant[i] and i not in above and not varies[i]]


def _induce(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            nodes = sorted(r["nodes"], key=lambda n: n["node"])
            at, template = choose(nodes)
            rows.append((r["host"], json.dumps([[[n["depth"], n["label"]] for n in nodes], at, template], ensure_ascii=False)))
        yield _arrow(rows, "host string, wrapper string")


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def induce(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """host, wrapper of every host."""
    summed = [F.sum(c).alias(c) for c in ("pages", "text", "link")] + [F.min(c).alias(c) for c in ("low", "page_low")] + [F.max(c).alias(c) for c in ("high", "page_high")]
    rest = ["label", "depth", "kind", "furniture", "pages", "text", "link", "low", "high", "page_low", "page_high"]
    stats = shelf.put(pages.select(_host().alias("host"), "html").mapInArrow(_statistics, STATS).groupBy("host", "shape", "node", "label", "depth")
                      .agg(F.max("kind").alias("kind"), F.max("furniture").alias("furniture"), *summed), "statistics")
    shapes = stats.groupBy("host", "shape").agg(F.collect_list(F.struct("node", *rest)).alias("nodes"), F.max("pages").alias("n"))
    reference = shelf.put(shapes.groupBy("host").agg(F.max_by("nodes", F.struct("n", "shape")).alias("reference")), "references")
    aligned = shapes.join(reference, "host").select("host", "nodes", "reference").mapInArrow(_align, ALIGNED)
    merged = aligned.groupBy("host", "node", "label", "depth").agg(F.max("kind").alias("kind"), F.max("furniture").alias("furniture"), *summed)
    return shelf.put(merged.groupBy("host").agg(F.collect_list(F.struct("node", *rest)).alias("nodes")).mapInArrow(_induce, "host string, wrapper string"), "wrappers")


def _blocks(node: Node, template: set, out: list[list[str]]) -> None:
    """Append the text blocks under a content node, without template nodes (by identity); out[-1] is the open block."""
    for item in node.items:
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        else:
            if furniture(item, True) or id(item) in template:
                out.append([])
                continue
            if item.tag in BLOCK:
                out.append([])
            _blocks(item, template, out)
            if item.tag in BLOCK:
                out.append([])


class Wrapper:
    """The reference tree of a host with its content region and template regions; alignments of tree shapes are kept."""

    def __init__(self, text: str):
        reference, self.at, template = json.loads(text)
        self.reference, self.template, self.known = [tuple(x) for x in reference], set(template), {}

    def align(self, own: list[tuple[int, str]]) -> dict[int, int]:
        if own == self.reference:
            return {i: i for i in range(len(own))}
        key = tuple(own)
        if key not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            self.known[key] = match(own, self.reference)
        return self.known[key]


def text_of(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page by a wrapper, or by the page alone where it has no region like the wrapper's, or an empty one."""
    root = parse(page)
    own = flat(regions(root))
    for attempt in (wrapper, None):
        if attempt is None:
            at, template = choose([{"node": i, "depth": d, "label": r.label, "kind": r.kind, "furniture": r.furniture, "pages": 1, "text": r.text, "link": r.link,
                                    "low": r.hash, "high": r.hash, "page_low": 0, "page_high": 0} for i, (d, r) in enumerate(own)])
            content, gone = [at], template
        else:
            places = attempt.align([(d, r.label) for d, r in own])
            content = [i for i, j in places.items() if j == attempt.at]
            gone = [i for i, j in places.items() if j in attempt.template]
        out: list[list[str]] = [[]]
        skipped = {id(node) for i in gone for node in own[i][1].nodes}
        for i in content:
            for node in own[i][1].nodes:
                out.append([])
                _blocks(node, skipped, out)
        text = "\n".join(x for x in (" ".join("".join(b).split()) for b in out) if x)
        if text:
            return text
    return ""


def _extract(batches):
    known: dict[str, Wrapper] = {}
    for batch in batches:
        ids, urls, pages, wrappers = (batch.column(c) for c in ("page_id", "url", "html", "wrapper"))
        texts_: list[str] = []
        start, held = 0, 0
        for i in range(len(batch)):
            w = wrappers[i].as_py()
            if w is not None and w not in known:
                if len(known) > 200:
                    known.clear()
                known[w] = Wrapper(w)
            texts_.append(text_of(pages[i].as_py() or "", known.get(w)))
            held += len(texts_[-1])
            if held > 1 << 22 or i == len(batch) - 1:
                n = i + 1 - start
                yield pa.RecordBatch.from_arrays([ids.slice(start, n).cast(pa.int64()), urls.slice(start, n), pa.array(texts_, pa.string()),
                                                  pa.array([len(t) for t in texts_], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                texts_, start, held = [], i + 1, 0


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shelf = Shelf(pages.sparkSession, "wrappers")
    wrappers = induce(pages, shelf)
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    # a written table has a known size: Spark broadcasts it while small and shuffles beyond
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")


@query("op4_wrapper_induction")
def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
