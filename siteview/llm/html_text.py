"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per path, text length and punctuation are summed over its nodes and
divided by their number; the ratios are smoothed over the paths in page order and fused; paths above a threshold
are content. Links do not count towards a path, and a furniture name among its classes lowers its ratios. The
element that holds nearly all content text is the article; its blocks on content paths are the result, with a repair:
headings, items and short paragraphs among them, and the rest of an article that the page declares, unless links or
furniture names mark them. Tags and roles that mean furniture are left out before. Comments are told by structure:
an article inside an article, articles without a heading beside the one that has it, and siblings on one path that each
begin with a name and a date. Such blocks, and minor ones with a furniture name, are no part of the result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title xmp noembed noframes canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("head nav footer aside form select button menu dialog fieldset legend optgroup option datalist audio video applet".split())
PROSE = frozenset("p li dt dd td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of class tokens and ids that say furniture, and words that only say a box. A token means furniture if all its words
#: are of these and one of the first; it marks only what holds neither an article, the title nor most of the text.
_NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter subscribe signup share sharing social related popup modal comments comment commentlist responses response respond replies reply disqus".split())
_BOX = frozenset("area banner bar block body box card container content feed footer form group header holder inner item items links list main message meta panel section slot sticky text thread top bottom unit user users reader readers view widget widgets wrap wrapper".split())
_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: A line above a comment: a name, then when or that it was written.
_STAMP = re.compile(r"[^\W\d_].*?(?:\b(?:ago|says|wrote|replied|commented|posted)\b|\d{1,2}:\d\d|\d{4}-\d\d?-\d\d?|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d|\d\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))", re.I)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tr td th article section div main body html aside nav footer header form blockquote".split())
_HOLDERS = frozenset("html body main article section div td table tbody tr center blockquote root".split())
_LISTS = frozenset("ul ol dl table tbody thead tr li dt dd td th".split())
_MARKS = re.compile(r"[.,;:!?…。，、]")
#: What a furniture name leaves of the ratios of the paths below it.
NAMED_SHARE = 0.1


class Node:
    """An open or closed element. ``ends`` has, for the tags that a later start tag can close, the innermost open one."""

    __slots__ = ("tag", "parent", "path", "off", "body", "declared", "named", "ends", "weight", "size", "heading", "title", "holds", "inside", "first", "blocks")

    def __init__(self, tag: str, parent: Node | None, path: int):
        self.tag, self.parent, self.path = tag, parent, path
        self.off = self.body = self.declared = self.named = self.heading = self.title = self.holds = self.inside = False
        self.ends: dict[str, Node] = {}
        self.weight = self.size = 0.0
        self.first, self.blocks = -1, 0


def _is_furniture(token: str) -> bool:
    words = {w.lower() for w in _WORDS.split(token)}
    return not _NAMED.isdisjoint(words) and words <= _NAMED | _BOX


def _read_attributes(node: Node, attrs: str) -> str:
    """Mark the node by its attributes; returns what its class and id add to the path."""
    label = ""
    if attrs and not attrs.isspace():
        for name, *values in _NAMES.findall(attrs):
            name, given = name.lower(), "".join(values).strip()
            value = given.lower()
            if name in ("class", "id"):
                label += "." + value if name == "class" else ""
                node.named = node.named or any(map(_is_furniture, given.split()))
            elif name == "role":
                node.off, node.body = node.off or value in _ROLES, node.body or value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true" and node.tag not in INLINE):
                node.off = True
            elif name == "style":
                node.off = node.off or "display:none" in value.replace(" ", "")
            elif name == "itemprop":
                node.body = node.body or value == "articlebody"
    return label


def parse(page: str) -> tuple[list[Node], list[tuple[int, Node, bool, str]]]:
    """The elements, parents first, and the text pieces outside furniture: (block number, element, in a link, text).

    A path is the number of (path of the parent, tag and classes), so it costs the same at every depth; inline
    elements have the path of the block they stand in.
    """
    root = node = Node("root", None, 0)
    nodes, paths = [root], {("", 0): 0}
    open_tags: dict[str, int] = {}
    pieces, block, at, n, links = [], 0, 0, len(page), 0

    def close(to: Node) -> None:
        nonlocal node, links
        while True:
            open_tags[node.tag] -= 1
            links -= node.tag == "a"
            done, node = node is to, node.parent
            if done:
                return

    while at < n:
        lt = page.find("<", at)
        m = None
        while lt >= 0 and not (m := _TAG.match(page, lt)):
            lt = page.find("<", lt + 1)
        end = lt if m else n
        if end > at and not node.off:
            pieces.append((block, node, links > 0, page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE:
            block += 1
        if closing:
            if tag == "p":
                if "p" in node.ends:
                    close(node.ends["p"])
            elif open_tags.get(tag, 0):
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up)
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else n
            continue
        if tag not in INLINE and tag not in VOID and "p" in node.ends:  # a block ends the paragraph it stands in
            close(node.ends["p"])
        for last in _ENDS.get(tag, ()):
            if last in node.ends:
                close(node.ends[last])
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        child = Node(tag, node, node.path)
        child.off = tag in FURNITURE or (tag == "header" and not node.declared)
        child.body = tag in ("article", "main")
        label = _read_attributes(child, attrs)
        child.off = child.off or node.off
        child.declared = node.declared or child.body
        child.heading, child.title = tag in ("h1", "h2"), tag == "h1"
        if tag not in INLINE:
            child.path = paths.setdefault((tag + label, node.path), len(paths))
        if tag in ("ul", "ol", "dl", "table"):
            child.ends = {}
        elif tag in _ENDS or tag in _SCOPE:
            child.ends = {k: v for k, v in node.ends.items() if k != "p"}
        else:
            child.ends = node.ends
        if tag == "p" or tag in _ENDS:
            child.ends = child.ends | {tag: child}
        nodes.append(child)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
        node = child
    return nodes, pieces


def _content(paths: list[int], texts: list[str], shares: list[float]) -> tuple[set[int], dict[int, float]]:
    """Paths whose smoothed and fused ratios of text length and punctuation reach the threshold, and the ratios. ``shares``
    is the part of each text that counts: links do not, furniture names leave NAMED_SHARE."""
    order = {p: k for k, p in enumerate(dict.fromkeys(paths))}
    sums = np.zeros((4, len(order)))
    for p, t, share in zip(paths, texts, shares, strict=True):
        sums[:, order[p]] += (len(t), len(_MARKS.findall(t)), 1, share * len(t))
    ratios = sums[:2] / sums[2]
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2 / 0.4**2)
    smooth = np.array([np.convolve(np.pad(r, 1, "edge"), kernel / kernel.sum(), "valid") for r in ratios])
    fused = (smooth[0] * np.log1p(smooth[1]) + 0.01 * smooth[0]) * sums[3] / sums[0]
    share = fused * sums[0] / max(1.0, sums[0].sum())
    limit = min(fused.std(), fused[share.argmax()])
    return {p for p, k in order.items() if fused[k] >= limit and fused[k] > 0}, {p: float(fused[k]) for p, k in order.items()}


def _replies(nodes: list[Node], texts: list[str]) -> set[int]:
    """The elements that are comments of readers by their structure."""
    found: set[int] = set()
    groups: dict[tuple[int, int], list[Node]] = {}
    articles: list[Node] = []
    within: set[int] = set()
    for node in nodes[1:]:
        if id(node.parent) in within:
            within.add(id(node))
        if node.tag == "article" and not node.off and node.first >= 0:
            if id(node) in within:
                if node.size <= 0.5 * nodes[0].size:
                    found.add(id(node))
            else:
                articles.append(node)
            within.add(id(node))
        elif node.tag in ("div", "li", "section") and node.blocks > 1:
            groups.setdefault((id(node.parent), node.path), []).append(node)
    titled = [x for x in articles if x.heading]
    if len(titled) == 1:
        found.update(id(x) for x in articles if x is not titled[0])
    for same in groups.values():
        if len(same) > 1 and all(len(texts[x.first]) <= 80 and _STAMP.match(texts[x.first]) for x in same):
            found.update(map(id, same))
    return found


def main_text(page: str | None) -> str:
    """The article's blocks, one a line, references decoded and white space collapsed; empty if there are none."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    blocks: dict[int, list] = {}
    for block, node, link, text in pieces:
        blocks.setdefault(block, []).append((node, link, text))
    rows = []
    for parts in blocks.values():
        text = " ".join(html.unescape("".join(t for _, _, t in parts)).split())
        if text:
            own = parts[0][0]
            while own.tag in INLINE:
                own = own.parent
            linked = sum(len(t.strip()) for _, link, t in parts if link) / max(1, sum(len(t.strip()) for _, _, t in parts))
            rows.append((own, 1 - min(1.0, linked), text))
    if not rows:
        return ""
    for k, (node, _, text) in enumerate(rows):
        node.size += len(text)
        node.blocks += 1
        node.first = k if node.first < 0 else node.first
    for node in reversed(nodes[1:]):
        up = node.parent
        up.size, up.blocks = up.size + node.size, up.blocks + node.blocks
        up.holds = up.holds or node.holds or (node.body and not node.off)
        up.heading, up.title = up.heading or node.heading, up.title or node.title
        if node.first >= 0 and (up.first < 0 or node.first < up.first):
            up.first = node.first
    replies = _replies(nodes, [t for _, _, t in rows])
    for node in nodes[1:]:  # a name never marks what holds an article, the title or most of the text
        node.named = node.parent.named or id(node) in replies or (node.named and not (node.body or node.holds or node.title or node.size > 0.5 * nodes[0].size))
    shares = [share * (NAMED_SHARE if node.named else 1) for node, share, _ in rows]
    content, fused = _content([node.path for node, _, _ in rows], [t for _, _, t in rows], shares)
    for node, _, text in rows:
        node.weight += len(text) if node.path in content else 0
    children: dict[int, list[Node]] = {}
    for node in reversed(nodes[1:]):
        node.parent.weight += node.weight
        children.setdefault(id(node.parent), []).append(node)
    at = nodes[0]
    while not at.body:
        inner = [c for c in reversed(children.get(id(at), [])) if not c.off and (c.body or c.tag in _HOLDERS)]
        declared = [c for c in inner if c.body and not c.named and c.weight >= 0.25 * at.weight]
        best = max(declared if len(declared) == 1 else inner, key=lambda c: (c.weight, c.body), default=None)
        if best is None or best.weight < (0.25 if len(declared) == 1 else 0.75) * at.weight or (not best.body and at.heading and not best.heading):
            break
        at = best
    at.inside = True
    for node in nodes:
        node.inside = node.inside or (node.parent is not None and node.parent.inside)
    rows = [r for r in rows if r[0].inside]
    if any(node.path in content and not node.named for node, _, _ in rows):
        kept = [node.path in content and not node.named for node, _, _ in rows]
    else:  # all is furniture by name: the ratios alone decide
        kept = [node.path in content for node, _, _ in rows]
    chosen = [k for k, x in enumerate(kept) if x]
    beside = {id(rows[k][0].parent) for k in chosen} | {id(rows[k][0]) for k in chosen}
    above, up = set(), rows[chosen[0]][0].parent if chosen else None
    while up is not None:
        above.add(id(up))
        up = up.parent

    def repaired(k: int, node: Node, share: float) -> bool:
        """Whether a block below the threshold belongs to the chosen ones: part of an article that the page declares, or
        prose among or right beside them."""
        if node.named or share < 0.5 or not chosen:
            return False
        if at.body:
            return True
        if node.tag in ("h1", "h2") and k < chosen[0] and id(node.parent) in above:  # the title over the first block
            return True
        up = node
        while up.tag in _LISTS and up.parent is not None:
            up = up.parent
        home = up if up is not node else node.parent
        return node.tag in PROSE and (chosen[0] < k < chosen[-1] or id(home) in beside)

    return "\n".join(t for k, (node, share, t) in enumerate(rows) if kept[k] or repaired(k, node, share))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row. Null and empty pages, and pages without text outside
    furniture, give an empty text; broken and unclosed markup is closed where a browser would; null ids and urls
    pass through; repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
