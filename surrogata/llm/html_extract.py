"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a skeleton: its block elements with repeated siblings folded into one slot.  The
most frequent skeleton of a host is its reference; the others are aligned with it by simple tree
matching, and for every slot of the reference the least and greatest fingerprint of its text over
all pages tell whether it is constant (template) or varies (content).  A page is then read with its
host's template: constant slots go, classed or not, and the slots that vary stay.  Tags and names
only choose among these: boilerplate roles go, and an article or main element with most of the
varying text is preferred to the page around it.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from operator import add
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, cut, fresh

DEEPEST = 200              # nesting beyond this is read as if it were at this depth
LEAST_PAGES = 3            # pages that make a constant slot a template
WIDEST = 400               # children beyond which siblings are matched by label and order alone

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp svg math canvas object "
                "audio video".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu head fieldset "
                        "datalist".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 "
                     "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead select menu".split())
HINTS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|"
    r"side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|comment-?list|"
    r"respond|reply|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|"
    r"sign-?up|login|pop-?up|modal|overlay|widget|toolbar|pagination|pager|skip-?link|hidden|"
    r"contentinfo|complementary|search|dialog)(?:[^a-z]|$)")
PAGE_HEADER = re.compile(r"(?:^|[^a-z])header(?:[^a-z]|$)")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
                  r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HOST = re.compile(r"//(?:[^/?#@]*@)?([^/?#]+)")


class Page:
    """Elements (parent, tag, label) in page order and text pieces (element, text, opens a block)."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.label = [-1], ["#"], ["#"]
        self.texts: list[tuple[int, str, bool]] = []
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack, at, apart = [0], 0, True
        while True:
            m = _TAG.search(html, at)
            if text := html[at:m.start() if m else len(html)]:
                self.texts.append((stack[-1], text, apart))
                apart = False
            if not m:
                return
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag not in INLINE or tag == "br":
                apart = True
            if m[1]:
                if any(self.tag[e] == tag for e in stack[1:]):
                    while self.tag[stack.pop()] != tag:
                        pass
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in CLOSES_P:
                self._close(stack, {"p"}, CLOSES_P - {"p"})
            if tag in CLOSES:
                self._close(stack, CLOSES[tag], LISTS)
            label = tag
            if m[3] and (names := self._names(m[3])):
                label = f"{tag}.{names}"
            if tag in VOID or (tag in INLINE and not self._hinted(label)):
                continue
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.label.append(label)
            if len(stack) < DEEPEST:
                stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], tags: set, until: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in tags:
                del stack[k:]
                return
            if self.tag[stack[k]] in until:
                return

    @staticmethod
    def _names(attributes: str) -> str:
        out = []
        for m in _NAMES.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() in ("hidden", "aria-hidden"):
                value = "" if value.lower() == "false" else "hidden"
            out += re.sub(r"\d+", "0", value.lower()).split()
        return ".".join(re.sub(r"[^a-z0_-]", "_", v) for v in sorted(set(out)))[:120]

    @staticmethod
    def _hinted(label: str) -> bool:
        return "." in label and bool(HINTS.search(label.partition(".")[2].replace("_", "-")))

    def skeleton(self) -> tuple[str, list[int]]:
        """The folded tree as text, and the slot of every element."""
        kids: list[list[int]] = [[] for _ in self.tag]
        for e in range(1, len(self.tag)):
            kids[self.parent[e]].append(e)
        shape: list[str] = [""] * len(self.tag)
        for e in range(len(self.tag) - 1, -1, -1):
            own = list(dict.fromkeys(shape[k] for k in kids[e]))
            shape[e] = f"{self.label[e]}({' '.join(own)})" if own else self.label[e]
        slot, tree = [0] * len(self.tag), tree_of(shape[0])
        for e in range(1, len(self.tag)):
            slot[e] = tree.by_shape[slot[self.parent[e]]][shape[e]]
        return shape[0], slot


class Tree:
    """A skeleton: label, parent and children of every slot in preorder."""

    def __init__(self, text: str):
        self.label, self.parent, self.children, self.shape = [], [], [], []
        stack: list[int] = []
        opened: list[int] = []
        start = 0
        for m in re.finditer(r"[^() ]+|[()]", text):
            if m[0] == "(":
                stack.append(len(self.label) - 1)
            elif m[0] == ")":
                k = stack.pop()
                self.shape[k] = text[opened[k]:m.end()]
            else:
                self.label.append(m[0])
                self.parent.append(stack[-1] if stack else -1)
                self.children.append([])
                self.shape.append(m[0])
                opened.append(m.start())
                if stack:
                    self.children[stack[-1]].append(len(self.label) - 1)
        self.by_shape = [{self.shape[c]: c for c in kids} for kids in self.children]


@lru_cache(maxsize=4096)
def tree_of(text: str) -> Tree:
    return Tree(text)


@lru_cache(maxsize=4096)
def align(one: str, other: str) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving match of equal labels, top down."""
    a, b = tree_of(one), tree_of(other)
    if one == other:
        return {k: k for k in range(len(a.label))}
    size: dict[tuple[int, int], int] = {}
    choice: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def match(x: int, y: int) -> int:
        if a.label[x] != b.label[y]:
            return 0
        if (x, y) in size:
            return size[x, y]
        xs, ys = a.children[x], b.children[y]
        if len(xs) * len(ys) > WIDEST ** 2:
            places = {}
            for k in ys:
                places.setdefault(b.label[k], []).append(k)
            pairs = [(k, places[a.label[k]].pop(0)) for k in xs if places.get(a.label[k])]
            size[x, y], choice[x, y] = 1 + sum(match(*p) for p in pairs), pairs
            return size[x, y]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, k in enumerate(xs):
            for j, n in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(k, n))
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        size[x, y], choice[x, y] = 1 + best[-1][-1], pairs
        return size[x, y]

    out, todo = {}, [(0, 0)] if match(0, 0) else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += choice.get((x, y), [])
    return out


@lru_cache(maxsize=4096)
def by_tags(skeleton: str) -> tuple[frozenset[int], tuple[frozenset[int], ...]]:
    """Slots without a boilerplate role, and those below the article and main elements among them:
    a set for each parent and tag of such elements, articles first."""
    t = tree_of(skeleton)
    n = len(t.label)
    tags = [x.partition(".")[0] for x in t.label]
    inside, bad = [False] * n, [False] * n
    for k in range(n):
        up = t.parent[k]
        inside[k] = up >= 0 and (inside[up] or tags[up] in ("article", "main"))
        plain = tags[k] in ("#", "html", "body", "article", "main")
        role = tags[k] in BOILERPLATE and not (tags[k] == "header" and inside[k])
        hint = not plain and Page._hinted(t.label[k])
        top = not plain and not inside[k] and PAGE_HEADER.search(t.label[k].partition(".")[2].replace("_", "-"))
        bad[k] = (up >= 0 and bad[up]) or role or hint or bool(top)
    roots: dict[tuple[str, int], set[int]] = {}
    for k in range(n):
        if tags[k] in ("article", "main") and not bad[k]:
            roots.setdefault((tags[k], t.parent[k]), set()).add(k)
    for own in roots.values():
        for k in range(min(own) + 1, n):
            if t.parent[k] in own and not bad[k]:
                own.add(k)
    return frozenset(k for k in range(n) if not bad[k]), tuple(frozenset(roots[r]) for r in sorted(roots))


@lru_cache(maxsize=4096)
def content_slots(skeleton: str, constant: frozenset[int], amount: tuple[int, ...], known: bool) -> frozenset[int]:
    """Slots whose own text is the page's main text: the varying ones without a boilerplate role.

    ``amount`` is the text of every slot over the host; ``known`` tells whether the host has pages
    enough to say what varies.  Article and main elements narrow the choice as long as they hold half
    of the varying text; where nothing is known they alone are chosen from.  Where nothing varies
    (all pages of a host equal) the slots stay that the tags choose.
    """
    free, roots = by_tags(skeleton)
    varying = free - constant
    if not any(amount[k] for k in varying):
        varying = free

    def text(own: frozenset[int]) -> int:
        return sum(amount[k] for k in own & varying)

    chosen = free if known and varying is not free or not roots else max(roots, key=text)
    while inner := [r for r in roots if r < chosen and 2 * text(r) >= text(chosen)]:
        chosen = max(inner, key=text)
    return chosen & varying


def main_text(page: Page, slot: list[int], keep: frozenset[int]) -> str:
    parts = []
    for element, text, apart in page.texts:
        if slot[element] in keep:
            text = entities.unescape(text)
            parts.append(" " + text if apart else text)
        else:
            parts.append(" ")
    return " ".join("".join(parts).split())


def host_of(url: str | None) -> str:
    m = _HOST.search(url or "")
    return m[1].lower() if m else ""


def _page_stats(batches):
    """(url, html) -> (host, skeleton, n, low, high, chars, kinds): pages, least and greatest
    fingerprint and length of the text of every slot, and the LEAST_PAGES least fingerprints of what
    the tags alone take for the main text, summed up per batch."""
    for x in batches:
        seen: dict[tuple[str, str], list] = {}
        for url, html in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
            page = Page(html)
            skeleton, slot = page.skeleton()
            prints = [0] * len(tree_of(skeleton).label)
            chars = [0] * len(prints)
            for element, text, _ in page.texts:
                if not text.isspace():
                    prints[slot[element]] = crc32(text.encode("utf-8", "surrogatepass"),
                                                  prints[slot[element]] + 1)
                    chars[slot[element]] += len(text)
            free, roots = by_tags(skeleton)
            read = sorted(frozenset().union(*roots) or free)
            kind = hash((*(prints[k] for k in read), *(chars[k] for k in read)))
            own = seen.setdefault((host_of(url), skeleton), [0, prints, prints, [0] * len(prints), set()])
            seen[host_of(url), skeleton] = [own[0] + 1, list(map(min, own[1], prints)),
                                            list(map(max, own[2], prints)), list(map(add, own[3], chars)),
                                            set(sorted(own[4] | {kind})[:LEAST_PAGES])]
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([seen[k][0] for k in keys], pa.int64()),
             *[pa.array([list(seen[k][i]) for k in keys], pa.list_(pa.int64())) for i in range(1, 5)]],
            ["host", "skeleton", "n", "low", "high", "chars", "kinds"])


def _aligned(batches):
    """(host, skeleton, reference, kinds, low, high, chars) -> (host, slot of the reference, kinds,
    low, high, chars)"""
    for x in batches:
        out = []
        for host, skeleton, reference, kinds, *sums in zip(*(c.to_pylist() for c in x.columns)):
            out += [(host, r, kinds, *(v and v[k] for v in sums)) for k, r in align(skeleton, reference).items()]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
             *[pa.array(c, pa.int64()) for c in cols[2:]]], ["host", "slot", "kinds", "low", "high", "chars"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, reference, constant, amount, known): a row a host, with the reference's slots whose
    text is the same on all pages that have them, LEAST_PAGES different ones at least, the length of
    every slot's text, and whether the host has so many pages.  Copies of a main text count once.
    All sums are per slot, so a host with a third of all pages is summed up before it is shuffled."""
    p = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    stats = cut(p.mapInArrow(_page_stats, "host string, skeleton string, n long, low array<long>, "
                                          "high array<long>, chars array<long>, kinds array<long>"), "wrapper")
    reference = cut(stats.groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
                    .groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("m"))
                    .select(F.col("host").alias("h"), F.col("m.skeleton").alias("reference")), "wrapper")
    kinds = stats.select("host", "skeleton", F.explode("kinds").alias("kind")).distinct() \
        .groupBy("host", "skeleton").agg(F.count("*").alias("kinds"))
    nothing = F.lit(None).cast("array<long>")
    rows = stats.select("host", "skeleton", F.lit(0).cast("long").alias("kinds"), "low", "high", "chars") \
        .unionByName(kinds.select("*", *[nothing.alias(c) for c in ("low", "high", "chars")]))
    slots = rows.join(reference, F.col("host") == F.col("h")) \
        .select("host", "skeleton", "reference", "kinds", "low", "high", "chars") \
        .mapInArrow(_aligned, "host string, slot int, kinds long, low long, high long, chars long") \
        .groupBy("host", "slot").agg(F.sum("kinds").alias("kinds"), F.min("low").alias("low"),
                                     F.max("high").alias("high"), F.sum("chars").alias("chars"))
    fixed = (F.col("kinds") >= LEAST_PAGES) & (F.col("low") == F.col("high"))
    found = slots.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(fixed, F.col("slot")))).alias("constant"),
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "chars"))), lambda s: s["chars"]).alias("amount"),
        F.max(F.when(F.col("slot") == 0, F.col("kinds") >= LEAST_PAGES)).alias("known"))
    return cut(found.join(reference, F.col("h") == F.col("host"))
               .select("host", "reference", "constant", "amount", "known"), "wrapper")


def _extract(html, reference, constant, amount, known):
    out = []
    for h, r, c, n, w in zip(*(x.to_pylist() for x in (html, reference, constant, amount, known))):
        page = Page(h)
        skeleton, slot = page.skeleton()
        here = align(skeleton, r) if r else {}
        fixed = set(c or ())
        own = [0] * len(tree_of(skeleton).label)
        for element, text, _ in page.texts:
            own[slot[element]] += 0 if slot[element] in here or text.isspace() else len(text)
        for k, v in here.items():
            own[k] = n[v]
        keep = content_slots(skeleton, frozenset(k for k, v in here.items() if v in fixed), tuple(own), bool(w))
        out.append(main_text(page, slot, keep))
    return [out]


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """The pages with a struct column (its name comes second) that holds ``text``, the main text.

    Null or empty html gives an empty text; pages without a host in their url share one template;
    repeated pages of a host are read alike, and if all its pages are equal the article stays;
    on hosts of less than LEAST_PAGES different pages tags and names decide alone;
    markup that ends early is read as far as it goes; all columns pass through; an empty table
    stays empty.
    """
    [host, *own] = fresh(pages, "_host", "_reference", "_constant", "_amount", "_known")
    t = templates(pages, url_col, html_col).toDF("_h", *own)
    match = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), _HOST.pattern, 1))
    joined = pages.withColumn(host, match).join(t, F.col(host) == F.col("_h"), "left")
    columns = [F.col(f"`{c}`") for c in pages.columns]
    out, f = annotate(joined.select(*columns, *own), [html_col, *own], _extract, "text string")
    return out.select(*columns, f), f


def page_texts(pages: DataFrame) -> DataFrame:
    out, f = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(f"{f}.text").alias("text"),
                      F.length(f"{f}.text").cast("long").alias("n_chars"))
