"""Main text of web pages by wrapper induction: trees of a host's pages are aligned, and the slots that align are classed by what they hold over all pages."""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import hot_counts, hot_keys, salted_join
from .common import bound_batches, rows, staged

#: Elements that make no block of their own, whose content is no markup, that hold no shown text, and that HTML itself sets apart from the article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSHOWN = frozenset("noscript template svg math object select button canvas audio video".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog fieldset".split())
VOID = frozenset("br hr meta link base col embed param track area img input source wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
WHOLE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words that names of furniture consist of, and words that stand beside them in such names; they only break ties.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs share sharing social related recommended comment comments commentlist disqus respond replies footer header masthead popup modal overlay pagination pager widget toc skip".split()
)
BESIDE_NAMES = frozenset("area bar block bottom box buttons container form inner item left links list main outer panel right section site slot top unit wrap wrapper".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_NESTED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Different pages of a host that must hold an aligned node before its sameness or its recurrence says anything.
LEAST_PAGES = 3
#: Stands for all hosts with fewer such pages: their pages are aligned with each other.
POOL = ""
#: Share of an element's text that a child must hold to be looked into for the article, and that makes two sisters tie for it.
MOST, TIE = 0.5, 0.25
#: Share of characters in links from which on a recurring element is a list of links; share of pages that makes an element recur.
LINKED, RECURS = 0.5, 0.6
#: What the text of a slot that never varies weighs beside text that does: pages of a host may be copies of each other.
CONSTANT_WEIGHT = 0.1
#: Wrappers up to this size go to the executors whole; beyond it they are joined by page.
WRAPPER_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[\s/][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)?)>"
    r"|</?[a-zA-Z][^>]*(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW | UNSHOWN}


@dataclass
class Node:
    """Sister elements of one label under one parent are one node; ``texts`` are the blocks that lie in it directly.

    A label is a flag, the tag and the first class. The flag is ``-`` in what HTML itself
    sets apart from the article, ``!`` where names call the element furniture, ``+`` elsewhere.
    """

    label: str
    tag: str
    dropped: bool
    inside: bool
    children: dict[str, Node] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    linked: int = 0
    named: bool = False


@dataclass
class Page:
    root: Node
    blocks: list[tuple[Node, str]]

    def nodes(self) -> list[Node]:
        """All nodes, parents first, sisters as they appear."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(reversed(list(node.children.values())))
        return out

    def skeleton(self) -> str:
        def walk(node: Node) -> list:
            return [node.label, *[walk(c) for c in node.children.values()]]

        return json.dumps(walk(self.root), separators=(",", ":"), ensure_ascii=False)


def _furniture_name(names: str) -> bool:
    """Whether some name is made of furniture words alone, as ``ad-box``, but not ``social-history``."""
    return any((words := _NAME.findall(name)) and NAMES.intersection(words) and NAMES.union(BESIDE_NAMES).issuperset(words) for name in names.split())


@functools.lru_cache(maxsize=4096)
def _attributes(attrs: str) -> tuple[str, bool, bool]:
    """The first class, whether names call the element furniture, and whether its role or being hidden sets it apart."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attrs)}
    apart = found.get("role", "") in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    named = _furniture_name(found.get("class", "")) or _furniture_name(found.get("id", ""))
    return (found.get("class", "").split() or [""])[0], named, apart


#: In the labelled tree, deeper elements are laid side by side, so that no page makes a deep tree; the stack of open elements is never cut.
DEEPEST = 60


def parse(source: str) -> Page:
    """Blocks of text in page order and the tree that they lie in; tolerant of missing ends and cut pages."""
    root = Node("+", "", False, False)
    stack = [root]
    # Where each tag's open elements stand in the stack, innermost last.
    open_at: dict[str, list[int]] = defaultdict(list)
    blocks: list[tuple[Node, str]] = []
    buffer: list[str] = []
    # The stack's height where a link began, or 0; characters of the buffer that lie in links.
    link_at = linked = 0
    # Where the next end of an unshown or raw element is, by its tag, so that none is looked for twice.
    ends: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            stack[-1].texts.append(text)
            stack[-1].linked += min(linked, len(text))
            blocks.append((stack[-1], text))
        linked = 0

    def close(size: int) -> None:
        nonlocal link_at
        for node in stack[size:]:
            open_at[node.tag].pop()
        del stack[size:]
        if size < link_at:
            link_at = 0

    at = 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            buffer.append(source[at : m.start()])
            if link_at:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW or tag in UNSHOWN:
            if m["close"] or (m["attrs"].endswith("/") and tag in UNSHOWN):
                continue
            if 0 <= ends.get(tag, 0) < at:
                found = _END[tag].search(source, at)
                ends[tag] = found.start() if found else -1
            end = ends[tag]
            if end >= 0:
                stop = source.find(">", end)
                at = len(source) if stop < 0 else stop + 1
            elif tag in RAW:
                at = len(source)
            buffer.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link_at = 0 if m["close"] else len(stack)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        flush()
        if m["close"]:
            if open_at[tag]:
                close(open_at[tag][-1])
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SELF_NESTED and open_at[tag] and open_at[tag][-1] > max((open_at[t][-1] for t in SELF_NESTED[tag] if open_at[t]), default=0):
            close(open_at[tag][-1])
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        up = stack[-1]
        name, named, apart = _attributes(m["attrs"])
        main = tag in ("article", "main")
        dropped = up.dropped or tag in BOILERPLATE or (apart and not main and tag not in ("html", "body"))
        inside = up.inside or main
        named = named or (tag == "header" and not inside)
        named = named and not main and tag not in ("html", "body")
        flat = len(stack) > DEEPEST
        label = ("-" if dropped else "!" if named or (flat and up.named) else "+") + (f"{tag}.{name}" if name else tag)
        named = named or up.named
        if flat:
            # Sisters here come from different parents: what they took over from them is part of the label.
            up, label = stack[DEEPEST - 1], f"{label} {dropped:d}{inside:d}"
        node = up.children.get(label)
        if node is None:
            node = up.children[label] = Node(label, tag, dropped, inside, named=named)
        open_at[tag].append(len(stack))
        stack.append(node)
    buffer.append(source[at:])
    flush()
    return Page(root, blocks)


def simple_tree_matching(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of preorder positions of a largest order-keeping match of two labelled trees, whose roots match if their labels do."""
    sizes: dict[int, int] = {}

    def size(tree: list) -> int:
        if id(tree) not in sizes:
            sizes[id(tree)] = 1 + sum(size(c) for c in tree[1:])
        return sizes[id(tree)]

    def match(a: list, b: list, at: int, bt: int) -> tuple[int, list[tuple[int, int]]]:
        if a[0] != b[0]:
            return 0, []
        xs, ys = a[1:], b[1:]
        x_at, y_at = [at + 1], [bt + 1]
        for c in xs:
            x_at.append(x_at[-1] + size(c))
        for c in ys:
            y_at.append(y_at[-1] + size(c))
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        pairs = {}
        for i in range(1, len(xs) + 1):
            for j in range(1, len(ys) + 1):
                got = pairs[i, j] = match(xs[i - 1], ys[j - 1], x_at[i - 1], y_at[j - 1])
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + got[0])
        i, j, found = len(xs), len(ys), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                found += pairs[i, j][1]
                i, j = i - 1, j - 1
        return 1 + best[-1][-1], [(at, bt), *found]

    return sorted(match(left, right, 0, 0)[1])


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url or "").hostname or "").lower() or None
    except ValueError:
        return None


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Slot:
    """What the nodes that align hold over a host's different pages."""

    pages: int = 0
    constant: bool = False
    chars: int = 0
    linked: int = 0


KEEP, OUTSIDE = 0, 1


def _preorder(tree: list) -> tuple[list[str], list[int]]:
    """Labels and parents of a labelled tree's nodes."""
    labels, parents, todo = [], [], [(tree, -1)]
    while todo:
        node, up = todo.pop()
        parents.append(up)
        todo.extend((c, len(labels)) for c in reversed(node[1:]))
        labels.append(node[0])
    return labels, parents


def classify(labels: list[str], parents: list[int], slots: list[Slot], pages: int) -> list[int] | None:
    """KEEP for each node of a tree whose text is the article's, OUTSIDE for the others; none where the tree holds no text.

    Text that varies and lies in no link weighs what it is long, text that is the same on
    all pages a tenth. From the root on, the child that holds most of the weight is looked
    into, unless that leaves headings or paragraphs behind and it holds no article element; where sisters tie, one without
    a furniture name, then an article element, then the heavier one is taken. What lies
    beside that way is outside. Below its end, lists of links that recur on most pages,
    elements that never vary (if they are the smaller part) and, as a tie, smaller elements
    with a furniture name are outside, each with all that it holds.
    """
    n = len(labels)
    tags = [x[1:].split(" ")[0].split(".")[0] for x in labels]
    sure = pages >= LEAST_PAGES
    plain = [max(0, s.chars - s.linked) if x[0] != "-" else 0 for s, x in zip(slots, labels)]
    weight = [w * (CONSTANT_WEIGHT if sure and s.constant and s.pages >= LEAST_PAGES else 1.0) for w, s in zip(plain, slots)]
    total, varying = list(weight), [float(w) if w == p else 0.0 for w, p in zip(weight, plain)]
    chars, linked, most = [s.chars for s in slots], [s.linked for s in slots], [s.pages for s in slots]
    article = [w if t in ("article", "main") else 0.0 for w, t in zip(weight, tags)]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        up = parents[i]
        children[up].append(i)
        total[up] += total[i]
        article[up] += total[i] if tags[up] in ("article", "main") else article[i]
        varying[up] += varying[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        most[up] = max(most[up], most[i])
    if not total[0]:
        return None
    at = 0
    while True:
        below = [c for c in children[at] if tags[c] not in WHOLE and tags[c] not in PROSE and labels[c][0] != "-"]
        tied = [c for c in below if total[c] >= TIE * total[at]]
        if not tied or sum(total[c] for c in tied) < MOST * total[at] or weight[at] > TIE * total[at]:
            break
        best = max(tied, key=lambda c: (labels[c][0] != "!", tags[c] in ("article", "main"), total[c]))
        if total[best] < MOST * total[at] and tags[best] not in ("article", "main") and not any(labels[c][0] == "!" for c in tied if c != best):
            break
        if article[best] < MOST * total[at] and any(varying[c] for c in children[at] if c != best and tags[c] in WHOLE and labels[c][0] != "-"):
            break
        at = best
    region = total[at]
    out = [OUTSIDE] * n
    out[at] = KEEP
    for i in range(at + 1, n):
        up = parents[i]
        if up < at or out[up] == OUTSIDE:
            continue
        recurs = sure and most[i] >= LEAST_PAGES and most[i] >= RECURS * pages
        links = recurs and tags[i] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and linked[i] >= LINKED * chars[i] > 0
        same = sure and chars[i] and not varying[i] and most[i] >= LEAST_PAGES and varying[at] > (region - varying[at]) / CONSTANT_WEIGHT
        named = labels[i][0] == "!" and total[i] < MOST * region
        out[i] = OUTSIDE if labels[i][0] == "-" or links or same or named else KEEP
    return out


def _inherit(classes: list[int], slots: list[int], labels: list[str], parents: list[int]) -> list[int]:
    """The classes of a page's nodes from those of the slots they align with; others are what their parents are, where HTML does not set them apart."""
    out: list[int] = []
    for slot, label, up in zip(slots, labels, parents):
        out.append(classes[slot] if slot >= 0 else OUTSIDE if label[0] == "-" or up < 0 else out[up])
    return out


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, skeleton, and of each node the key, length and linked length of its text."""
    for urls, sources in rows(batches, "url", "html"):
        out: list[list] = [[], [], [], [], []]
        for url, source in zip(urls, sources):
            host = host_of(url)
            if host is None:
                continue
            page = parse(source or "")
            nodes = page.nodes()
            found = (host, page.skeleton(), [_key("\n".join(n.texts)) if n.texts else None for n in nodes], [sum(map(len, n.texts)) for n in nodes], [n.linked for n in nodes])
            for column, value in zip(out, found):
                column.append(value)
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "skeleton", "keys", "chars", "linked"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hosts, skeletons, references, counts in rows(batches, "host", "skeleton", "reference", "rows"):
        slots = []
        for skeleton, reference in zip(skeletons, references):
            tree = json.loads(skeleton)
            found = [-1] * len(_preorder(tree)[0])
            for a, b in simple_tree_matching(tree, json.loads(reference)):
                found[a] = b
            slots.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(skeletons, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.int64())], ["host", "skeleton", "slots", "rows"])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hosts, references, pages, stats in rows(batches, "host", "reference", "pages", "stats"):
        classes = []
        for reference, n, found in zip(references, pages, stats):
            labels, parents = _preorder(json.loads(reference))
            slots = [Slot() for _ in labels]
            for s in found:
                slots[s["slot"]] = Slot(s["n"], s["low"] == s["high"], s["chars"], s["linked"])
            classes.append(classify(labels, parents, slots, n) if n >= LEAST_PAGES else None)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(classes, pa.list_(pa.int32()))], ["host", "classes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hosts, skeletons, slots, classes, counts in rows(batches, "host", "skeleton", "slots", "classes", "rows"):
        kept = []
        for skeleton, found, known in zip(skeletons, slots, classes):
            nodes = _inherit(known, found, *_preorder(json.loads(skeleton)))
            kept.append([i for i, c in enumerate(nodes) if c == KEEP])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(skeletons, pa.string()), pa.array(kept, pa.list_(pa.int32())), pa.array(counts, pa.int64())], ["host", "skeleton", "kept", "rows"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, skeleton, kept, rows): the nodes of each shape of page that hold its article, and how many pages have it.

    Hosts with fewer than LEAST_PAGES different pages are one host, POOL, for this. Equal pages of a host count once, and those of one skeleton are added up, before
    anything moves. The commonest skeleton is the host's reference; each other one is
    aligned with it by simple tree matching, and nodes that align share a slot. Slots are
    classed by what they hold on all pages; a node that aligns with none is what its
    parent is.
    """
    shapes = pages.select("url", "html").mapInArrow(_shapes, "host string, skeleton string, keys array<long>, chars array<long>, linked array<long>")
    shapes = staged(shapes.groupBy("host", "skeleton", "keys").agg(F.first("chars").alias("chars"), F.first("linked").alias("linked"), F.count(F.lit(1)).alias("copies")), "html-shapes")
    counted = staged(shapes.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")), "html-counts")
    sites = counted.groupBy("host").agg(F.sum("n").alias("n")).select("host", F.when(F.col("n") < LEAST_PAGES, POOL).otherwise(F.col("host")).alias("site"))
    # From here on rows are shapes of pages, not pages; a host of very many shapes is dealt to several tasks.
    many = hot_keys(counted, "host", counted.count())
    by_host = lambda rows, other: salted_join(rows, other, "host", many, F.col("skeleton"))
    nodes = shapes.select("host", "skeleton", F.posexplode(F.arrays_zip("keys", "chars", "linked")).alias("node", "at")).where("at.keys is not null")
    nodes = nodes.groupBy("host", "skeleton", "node").agg(F.count(F.lit(1)).alias("n"), F.min("at.keys").alias("low"), F.max("at.keys").alias("high"), F.sum("at.chars").alias("chars"), F.sum("at.linked").alias("linked"))
    added = lambda rows, keys: rows.groupBy(F.col("site").alias("host"), *keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    nodes = added(by_host(nodes, sites), ["skeleton", "node"])
    counted = staged(by_host(counted, sites).groupBy(F.col("site").alias("host"), "skeleton").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")), "html-sites")
    hosts = counted.groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("top"), F.sum("n").alias("pages")).select("host", F.col("top.skeleton").alias("reference"), "pages")
    aligned = staged(by_host(counted, hosts).select("host", "skeleton", "reference", "rows").mapInArrow(_aligned, "host string, skeleton string, slots array<int>, rows long"), "html-aligned")
    slots = nodes.join(aligned, ["host", "skeleton"]).withColumn("slot", F.element_at("slots", F.col("node") + 1)).where("slot >= 0").withColumn("site", F.col("host"))
    # One row a host: as long as its reference, which is one page's.
    stats = added(slots, ["slot"]).groupBy("host").agg(F.collect_list(F.struct("slot", "n", "low", "high", "chars", "linked")).alias("stats"))
    classed = hosts.join(stats, "host").mapInArrow(_classed, "host string, classes array<int>").where("classes is not null")
    return by_host(aligned, classed).mapInArrow(_kept, "host string, skeleton string, kept array<int>, rows long")


def shown(page: Page) -> frozenset[int]:
    """The nodes of a page that HTML does not set apart: all that can be said without a wrapper."""
    return frozenset(i for i, n in enumerate(page.nodes()) if not n.dropped)


def own_region(page: Page) -> frozenset[int]:
    """The article's nodes of a page none of whose nodes lies in its wrapper's article, from its tree alone."""
    nodes = page.nodes()
    labels, parents = _preorder(json.loads(page.skeleton()))
    found = classify(labels, parents, [Slot(1, False, sum(map(len, n.texts)), n.linked) for n in nodes], 1)
    return frozenset(i for i, c in enumerate(found or ()) if c == KEEP)


def main_text(page: Page, kept: frozenset[int] | None = None) -> str:
    """Blocks of the article in page order, joined by empty lines; ``kept`` are its nodes by the host's wrapper.

    Without a wrapper all that HTML does not set apart is kept; a page none of whose nodes
    lies in the wrapper's article is classed by its own tree.
    """
    kept = shown(page) if kept is None else kept or own_region(page)
    at = {id(n): i for i, n in enumerate(page.nodes())}
    return "\n\n".join(text for node, text in page.blocks if at[id(node)] in kept)


def _extract(known: dict[tuple[str, str], frozenset[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in rows(batches, "page_id", "url", "html", *([] if known is not None else ["kept"])):
            texts = []
            for i, source in enumerate(found[2]):
                page = parse(source or "")
                if known is None:
                    kept = None if found[3][i] is None else frozenset(found[3][i])
                else:
                    host = host_of(found[1][i])
                    kept = host and known.get((host if host in known_hosts else POOL, page.skeleton()))
                texts.append(main_text(page, kept))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    known_hosts = {h for h, _ in known or ()}
    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, urls, sources in rows(batches, "page_id", "url", "html"):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(sources, pa.string()), pa.array([host_of(u) for u in urls], pa.string()), pa.array([parse(s or "").skeleton() for s in sources], pa.string())],
            ["page_id", "url", "html", "host", "skeleton"],
        )


EXTRACTED_SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, wrapper_bytes: int = WRAPPER_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html, ...)``.

    Null html counts as empty and gives the empty text. A page whose URL has no host has
    no wrapper; one whose host has fewer than LEAST_PAGES different pages goes by that of
    all such hosts' pages; rows that repeat count once for it and come out each; an empty
    table gives no rows. Wrappers go along with the code where they take ``wrapper_bytes``
    at most, else pages are joined with theirs by host and skeleton.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    pages = pages.select("page_id", "url", "html")
    found = staged(wrappers(pages), "html-wrappers")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("skeleton") + 8 * F.size("kept"))).first()[0] or 0
    if size <= wrapper_bytes:
        known = {(r["host"], r["skeleton"]): frozenset(r["kept"]) for r in found.collect()}
        return pages.mapInArrow(_extract(known), EXTRACTED_SCHEMA)
    keyed = pages.mapInArrow(_keyed, "page_id long, url string, html string, host string, skeleton string")
    # Shapes that very many pages have are dealt to several tasks.
    keyed, total = keyed.withColumn("shape", F.concat_ws("\n", "host", "skeleton")), found.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    whole = found.where(F.col("host") != POOL).select(F.concat_ws("\n", "host", "skeleton").alias("shape"), "kept", "rows")
    pooled = found.where(F.col("host") == POOL).select("skeleton", F.col("kept").alias("pooled"), "rows")
    own = salted_join(keyed, whole.drop("rows"), "shape", hot_counts(whole, "shape", "rows", total), F.col("page_id"), "left")
    own = salted_join(own, pooled.drop("rows"), "skeleton", hot_counts(pooled, "skeleton", "rows", total), F.col("page_id"), "left")
    return own.select("page_id", "url", "html", F.coalesce("kept", F.when(F.col("host").isNotNull(), F.col("pooled"))).alias("kept")).mapInArrow(_extract(None), EXTRACTED_SCHEMA)
