"""HTML extraction by wrapper induction.

1. Every page is parsed once into a small tree of its block elements. Runs of like leaves (the
   paragraphs of an article, the items of a list) are one node. Only texts outside menus,
   headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments travel on,
   compressed.
2. Pages of one host meet in rows of ``BATCH``, in the order of a hash; a last row that is too short
   to tell joins the row before it. Each page is aligned with the next ``PARTNERS`` pages of its row by
   simple tree matching (the largest order-keeping match of equal labels). A node whose text is
   the same in ``PARTNERS`` alignments, or in all where a page has fewer, and varies in none is
   template; a node whose text varies is a content slot.
   Pairs of pages with one and the same main text say nothing; the next page with another takes their place.
3. The text is that of the content slots below the page's article or main element (the body
   where there is none), in page order.

A host with many pages is dealt out by a salt (the hosts above a thousandth of all pages, under
1,000, are known to all tasks); the pages of a task stream through in batches, so no host is held whole.

Defined cases: null or empty html gives an empty text; a url without host is a host of its own;
a page alone with its host, or beside copies of its main text only, is judged by its own labels; broken markup is read as browsers do in
the common cases (unclosed p, li and table cells; open comments and scripts run to the end); pages
of any depth and width are aligned (no recursion, memory by their width). A class, id or role marks a part by the first
or last word of a whole token: ``has-sidebar`` or ``no-comments`` describe a layout and mark nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

BATCH, PARTNERS, HOT_HOSTS = 64, 3, 1_000
#: Fewer pages than these are no row of their own: each page meets PARTNERS before and after it.
SHORT = 2 * PARTNERS + 1

#: Elements that begin and end a block, elements without content, elements that
#: never hold main text, and words of class, id and role that mark such parts.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
 footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
 summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe template svg math object canvas select button xmp noembed noframes".split())
SKIPPED = frozenset("head title nav header footer aside form menu dialog search fieldset".split())
MARKED = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
 notices notification alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar
 widget widgets footer comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter
 subscribe subscription signup login search form complementary contentinfo toolbar masthead topbar""".split())
MARKED_OUTSIDE = frozenset(["header", "heading"])
ROOTS = frozenset(["article", "main"])
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
             "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_tag = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_attribute = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_word = re.compile(r"[a-z]+")
#: A token that begins with one of these describes the layout of a part, not the part itself;
#: words that mark a part as a whole token only, and words that mark it only as the last of a token.
LAYOUT = frozenset("has no with without hide show is not".split())
ALONE = frozenset("widget widgets".split())
LAST = frozenset("related form search share sharing menu notice notices banner login modal".split())


def marked(token: str, inside: bool) -> bool:
    """Whether a class, id or role token names a part without main text: by its first or its last word."""
    words = _word.findall(token)
    if not words or words[0] in LAYOUT:
        return False
    says = lambda w: w in MARKED or (w in MARKED_OUTSIDE and not inside)
    if len(words) == 1:
        return says(words[0])
    first, last = words[0], words[-1]
    return (says(last) and last not in ALONE) or (says(first) and first not in ALONE | LAST)


class Page:
    """Block nodes of one page: parent, label, kind; and the texts of its main parts, in order."""

    def __init__(self, html: str) -> None:
        self.parent, self.label, self.skip, self.root = [-1], ["html"], [False], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, names, held, at = [0], ["html"], [], 0

        def close() -> None:
            if held:
                text = " ".join(unescape("".join(held)).split())
                held.clear()
                if text:
                    self.texts.append((stack[-1], text))

        while True:
            m = _tag.search(html, at)
            if not self.skip[stack[-1]]:
                held.append(html[at : m.start() if m else len(html)])
            if m is None:
                break
            at = m.end()
            name = m[2].lower() if m[2] else None
            if name is None:
                continue
            if not m[1] and name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if name == "br":
                if not self.skip[stack[-1]]:
                    held.append(" ")
                continue
            if name not in BLOCKS:
                continue
            close()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if names[depth] == name:
                        del stack[depth:], names[depth:]
                        break
                continue
            if names[-1] == "p":  # a block ends an open paragraph
                stack.pop()
                names.pop()
            if name in CLOSED_BY:
                ends, stops = CLOSED_BY[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if names[depth] in stops:
                        break
                    if names[depth] in ends.split():
                        del stack[depth:], names[depth:]
                        break
            if name in ("html", "body") and name in names:
                continue
            stack.append(self._open(stack[-1], name, m[3] or ""))
            names.append(name)
            if name in VOID:
                stack.pop()
                names.pop()
        close()

    def _open(self, parent: int, name: str, attributes: str) -> int:
        label, skip = name, self.skip[parent] or name in SKIPPED
        if attributes.strip():
            words: list[str] = []
            for key, a, b, c in _attribute.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id", "role"):
                    words += value.lower().split()
                    if key == "class":
                        label = f"{name}.{value}"
                skip = skip or key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
            inside = name in ROOTS or self.root[parent]
            # the page's own article is no part of another, whatever its class says
            skip = skip or (name not in ("html", "body", "article", "main") and any(marked(w, inside) for w in words))
        self.parent.append(parent)
        self.label.append(label)
        self.skip.append(skip)
        self.root.append((name in ROOTS or self.root[parent]) and not skip)
        return len(self.parent) - 1

    def pack(self) -> bytes:
        return C.pack(np.frombuffer(json.dumps([self.parent, self.label, self.skip, self.root, self.texts], ensure_ascii=False).encode(), np.uint8))


class Tree:
    """A packed page as a tree with runs of like leaves joined, for alignment."""

    def __init__(self, blob: bytes) -> None:
        parent, label, skip, root, self.texts = json.loads(C.unpack(blob))
        n = len(parent)
        child: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            child[parent[i]].append(i)
        self.of, self.label, self.child, self.skip, self.root = [0] * n, [], [], [], []
        self.shape: list[int] | None = None

        def add(i: int) -> int:
            k = len(self.label)
            self.label.append(label[i])
            self.child.append([])
            self.skip.append(skip[i])
            self.root.append(root[i])
            self.of[i] = k
            return k

        order = [(0, add(0))]
        while order:
            i, k = order.pop()
            last = None
            for j in child[i]:
                leaf = not child[j]
                if leaf and last is not None and self.label[last[0]] == label[j] and last[1]:
                    self.of[j] = last[0]
                    continue
                m = add(j)
                self.child[k].append(m)
                last = (m, leaf)
                if child[j] and not skip[j]:
                    order.append((j, m))
                elif child[j]:
                    stack = list(child[j])
                    while stack:  # a skipped part is one node
                        x = stack.pop()
                        self.of[x] = m
                        stack += child[x]
        self.text: dict[int, list[str]] = {}
        for i, text in self.texts:
            self.text.setdefault(self.of[i], []).append(text)
        chosen = any(self.root)
        self.main = {k for k in self.text if not self.skip[k] and (self.root[k] or not chosen)}
        self.main_text = [t for k in sorted(self.main) for t in self.text[k]]


class Matcher:
    """Simple tree matching of the pages of one host.

    The size of the largest order-keeping match of two trees depends on their shapes only, so equal shapes of all
    pages share one number and every pair of shapes is scored once. No recursion: a page may be of any depth.
    """

    CELLS = 1 << 22  #: larger score tables are halved, so that memory grows with the width of a page, not its square

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.shapes: list[tuple] = []  # (label, shapes of the children, nodes)
        self.scores: dict[tuple[int, int], int] = {}

    def shapes_of(self, tree: Tree) -> list[int]:
        """Shape number of every node; a node stands before its children in the tree."""
        if tree.shape is None:
            shape = [0] * len(tree.label)
            for k in range(len(shape) - 1, -1, -1):
                key = (tree.label[k], tuple(shape[c] for c in tree.child[k]))
                if key not in self.number:
                    self.number[key] = len(self.shapes)
                    self.shapes.append((*key, 1 + sum(self.shapes[c][2] for c in key[1])))
                shape[k] = self.number[key]
            tree.shape = shape
        return tree.shape

    def _known(self, a: int, b: int) -> int | None:
        if self.shapes[a][0] != self.shapes[b][0]:
            return 0
        if a == b:
            return self.shapes[a][2]
        if not self.shapes[a][1] or not self.shapes[b][1]:
            return 1
        return self.scores.get((a, b))

    def score(self, a: int, b: int) -> int:
        """Nodes in the largest match of two shapes."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if self._known(x, y) is not None:
                stack.pop()
                continue
            xs, ys = self.shapes[x][1], self.shapes[y][1]
            open_ = [(s, t) for s in set(xs) for t in set(ys) if self._known(s, t) is None]
            if open_:
                stack += open_
                continue
            self.scores[x, y] = 1 + int(self._last_row(xs, ys)[-1])
            stack.pop()
        return self._known(a, b)

    def _rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[np.ndarray]:
        """Best sums of the first children of one side with the first t of the other, child by child."""
        kinds, at = np.unique(np.array(ys, np.int64), return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        for x in xs:
            if x not in weights:
                weights[x] = np.array([self._known(x, int(y)) for y in kinds], np.int64)
            fresh = np.maximum(row[1:], row[:-1] + weights[x][at])
            row = np.concatenate([[0], np.maximum.accumulate(fresh)])
            yield row

    def _last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        row = np.zeros(len(ys) + 1, np.int64)
        for row in self._rows(xs, ys):
            pass
        return row

    def children(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the children that a largest match pairs."""
        if xs == ys:
            return [(i, i) for i in range(len(xs))]
        out, parts = [], [(0, len(xs), 0, len(ys))]
        while parts:
            x0, x1, y0, y1 = parts.pop()
            if x0 == x1 or y0 == y1:
                continue
            if (x1 - x0) * (y1 - y0) > self.CELLS and x1 - x0 > 1:
                mid = (x0 + x1) // 2
                head = self._last_row(xs[x0:mid], ys[y0:y1])
                tail = self._last_row(xs[mid:x1][::-1], ys[y0:y1][::-1])[::-1]
                cut = y0 + int(np.argmax(head + tail))
                parts += [(x0, mid, y0, cut), (mid, x1, cut, y1)]
                continue
            table = np.array(list(self._rows(xs[x0:x1], ys[y0:y1])))
            s, t = x1 - x0, y1 - y0
            while s and t:
                if table[s, t] == table[s - 1, t]:
                    s -= 1
                elif table[s, t] == table[s, t - 1]:
                    t -= 1
                else:
                    s, t = s - 1, t - 1
                    out.append((x0 + s, y0 + t))
        return out

    def align(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Node pairs of the largest order-keeping match of two trees; none where the root labels differ."""
        p, q = self.shapes_of(a), self.shapes_of(b)
        if not self.score(p[0], q[0]):
            return []
        out, stack = [], [(0, 0)]
        while stack:
            i, j = stack.pop()
            out.append((i, j))
            x, y = a.child[i], b.child[j]
            stack += [(x[s], y[t]) for s, t in self.children(tuple(p[c] for c in x), tuple(q[c] for c in y))]
        return out


def partners(texts: list[list[str]]) -> list[tuple[int, int]]:
    """Each page with the next PARTNERS pages, in a circle, that have another main text; every pair once."""
    number: dict[tuple[str, ...], int] = {}
    kind = [number.setdefault(tuple(t), len(number)) for t in texts]
    pairs = {}
    for i in range(len(kind)):
        circle = (j % len(kind) for j in range(i + 1, i + len(kind)))
        for j in islice((j for j in circle if kind[j] != kind[i]), PARTNERS):
            pairs[min(i, j), max(i, j)] = None
    return list(pairs)


def induce(pages: list[Tree]) -> list[list[str]]:
    """The content blocks of each page of one host."""
    same = [dict.fromkeys(p.main, 0) for p in pages]
    varied: list[set[int]] = [set() for _ in pages]
    met = [0] * len(pages)
    matcher = Matcher()
    for i, j in partners([p.main_text for p in pages]):
        a, b = pages[i], pages[j]
        met[i] += 1
        met[j] += 1
        for m, n in matcher.align(a, b):
            if m in a.main and n in b.main:
                if a.text[m] == b.text[n]:
                    same[i][m] += 1
                    same[j][n] += 1
                else:
                    varied[i].add(m)
                    varied[j].add(n)
    out = []
    for i, page in enumerate(pages):
        template = {k for k, n in same[i].items() if n >= max(1, min(PARTNERS, met[i])) and k not in varied[i]}
        out.append([t for node, t in page.texts if page.of[node] in page.main and page.of[node] not in template])
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: html to the packed tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            blobs = [Page(x or "").pack() for x in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("n"), some.column("host"), some.column("salt"), pa.array(blobs, pa.binary()),
                                              *[some.column(c) for c in some.schema.names if c.startswith("c")]],
                                             ["n", "host", "salt", "blob", *[c for c in some.schema.names if c.startswith("c")]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BATCH pages across the bounds of Arrow batches; a short last one joins the one before."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < BATCH + SHORT:
            continue
        whole, at = pa.concat_batches(held), 0
        while n >= BATCH + SHORT:
            yield whole.slice(at, BATCH)
            at, n = at + BATCH, n - BATCH
        held = [whole.slice(at)]
    if n:
        yield pa.concat_batches(held)


def _extracted(names: list[str]):
    """applyInArrow on the pages of one host and salt, slice after slice."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            texts = ["\n\n".join(x) for x in induce([Tree(b) for b in some.column("blob").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*names, "_text", "_n_chars"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows and columns but the html, plus ``_text`` and ``_n_chars``."""
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    keep = [c for c in pages.columns if c != html_col]
    sizes = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("m"))
    unit = max(BATCH, pages.count() // HOT_HOSTS)
    # hosts above a HOT_HOSTS-th of all pages: there are fewer than HOT_HOSTS of them
    hot = {r["host"]: -(-r["m"] // unit) for r in sizes.where(F.col("m") > unit).collect()}
    salts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]) if hot else None
    mixed = F.xxhash64(F.col(f"`{id_col}`").cast("string"), url, F.col(f"`{html_col}`").cast("string"))
    salt = F.pmod(mixed, F.coalesce(salts[host], F.lit(1))).cast("int") if hot else F.lit(0)
    side = pages.select(mixed.alias("n"), host.alias("host"), salt.alias("salt"), F.col(f"`{html_col}`").cast("string").alias("html"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    names = [f"c{i}" for i in range(len(keep))]
    kinds = "".join(f", {c} {t}" for c, t in side.dtypes if c in names)
    parsed = side.mapInArrow(_parsed, f"n long, host string, salt int, blob binary{kinds}")
    # in the order of n the rows of a group do not depend on how its pages came in
    sorted_pages = parsed.repartition("host", "salt").sortWithinPartitions("host", "salt", "n")
    out = sorted_pages.groupBy("host", "salt").applyInArrow(_extracted(names), f"{kinds[2:] + ', ' if kinds else ''}_text string, _n_chars long")
    return out.select(*[F.col(c).alias(k) for c, k in zip(names, keep, strict=True)], "_text", "_n_chars")


def op6_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))
