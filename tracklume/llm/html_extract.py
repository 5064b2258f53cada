"""Main text of web pages by wrapper induction.

A page is parsed into a tree of block elements; inline elements belong to their
block.  Per host a few reference pages are chosen (those of least hash, one in
each slot: a bounded sample that each task folds before the shuffle), and every
page is aligned with them by simple tree matching: the matching of two trees'
children, in order, that pairs most nodes of equal tags; runs of kids of one structure are matched one by one.  Pages of
any size are matched in this one way (:class:`Matching`); two parents' work is the product of their runs.  A node whose text stands at the
aligned place of two or more references is template and goes; the other nodes are slots
that vary.  That holds inside an ``article`` too, but there a reference that says mostly the same
as the page is a copy of it and has no say, and a constant block of running text without attributes (a heading, a
sentence) stays where a neighbour under the same parent varies.  The content root is the innermost element that holds most of the
varying text outside of elements that say what they are (menus, footers, adverts, forms and
so on); elements named ``article`` or ``main`` are preferred, so a page without companions on its
host works too.

What an element is comes from its tag or role, or (blocks only) from a class or id all of whose
words name such a part: ``related-posts`` does, ``related-work`` does not.

Defined results: a null html or one without text gives the empty string; a null
url is a host of its own (the empty one); equal rows get equal results; unclosed
or badly nested tags are closed where HTML closes them; a tag without an end is text; elements may nest to any
depth; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A

#: Reference pages of a host.
SLOTS = 4
#: A host with more pages than this share of the table, and than ``FEW``, is dealt over several tasks.
HOT, FEW = 2000, 256
#: References in which a node recurs at the aligned place; least share of a page's text that recurs in a copy.
RECURS, COPY = 2, 0.6
#: Pairs of kids' runs whose totals are held at once, parts that a larger matching is cut into, missing sizes that are
#: worked off at once, pairs from which on totals are taken in arrays: they bound memory and time and do not change a result.
HELD, PARTS, MISSING, FEW_PAIRS = 40_000, 16, 10_000, 200

# Element names of HTML and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg annotation annotation-xml iframe object canvas select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split())
APART = frozenset("nav footer aside form dialog menu head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table body article section main div".split())
#: Blocks of running text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th td pre blockquote figcaption caption summary".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter "
    "notice notification pagination popup promo promoted promotion reader-comments related recommended share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Words that may stand beside them in a class or id.
BESIDE = frozenset("area bar block bottom box container footer global header inner item items left link links list main module page panel post posts right row section side site slot story stories top unit wrap wrapper zone".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile("[\"'>]")
#: Blocks whose class or id may set them apart.
HOLDERS = frozenset("div section ul ol dl table td span figure header details fieldset center".split())


class Node:
    __slots__ = ("tag", "apart", "plain", "kids", "sign", "shape", "size")

    def __init__(self, tag: str, apart: bool, plain: bool = False):
        self.tag, self.apart, self.plain, self.kids = tag, apart, plain, []


def _says(value: str) -> bool:
    """Whether a class or id names a part of a page: a word of NAMES, and no other words but those of BESIDE."""
    for word in value.split():
        if word in NAMES:
            return True
        parts = _PART.findall(word)
        if any(p in NAMES for p in parts) and all(p in NAMES or p in BESIDE for p in parts):
            return True
    return False


def _apart(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag in HOLDERS and _says(value):
            return True
    return False


class _Tags:
    """The tags of a page in order, each place of the text read a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.ends = {q: html.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place of the > that ends the tag at ``at`` (quotes may hold one), or -1."""
        if at > self.last:
            return -1
        k = at
        while m := _STOP.search(self.html, k):
            if m[0] == ">":
                return m.start()
            k = m.start() + 1
            if k <= self.ends[m[0]] and (close := self.html.find(m[0], k)) < self.last:
                k = close + 1
            else:
                break
        return self.html.find(">", at)

    def __iter__(self):
        """(start, end, closing, name, attributes); comments and declarations have no name."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = len(html) if end < 0 else end + 3
                yield start, at, False, "", ""
                continue
            if start > self.last:
                return  # no tag ends behind this place
            closing = html.startswith("/", start + 1)
            m = _NAME.match(html, start + 1 + closing)
            if m is None and html[start + 1 : start + 2] not in ("!", "?"):
                at = start + 1
                continue
            end = self.end(m.end() if m else start + 1)
            if end < 0:
                at = start + 1
                continue
            at = end + 1
            at = yield (start, at, closing, m[0].lower(), html[m.end() : end]) if m else (start, at, False, "", "")
            if at is None:
                at = end + 1


def parse(html: str) -> Node:
    """Tree of block nodes; a kid is a node or a text (str, white space as it is)."""
    root = Node("#", False)
    stack, text = [root], []
    opened: Counter = Counter()
    at, lower = 0, None

    def flush():
        if text:
            stack[-1].kids.append("".join(text))
            text.clear()

    def push(tag: str, apart: bool, plain: bool = False):
        node = Node(tag, apart, plain)
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1

    def close(names: set, stops: frozenset = frozenset()):
        """Pop up to the innermost element of these names, unless one of the stops comes first."""
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    opened[stack.pop().tag] -= 1
                return
            if stack[k].tag in stops:
                return

    tags = iter(_Tags(html))
    found = next(tags, None)
    while found is not None:
        start, end, closing, tag, attrs = found
        if start > at:
            text.append(html[at:start])
        at = end
        skip = None
        article = opened["article"] + opened["main"] > 0
        if not tag:
            pass
        elif tag in INLINE:
            if not closing and attrs and _apart(tag, attrs, article):
                flush()
                push(tag, True)
            elif closing and stack[-1].tag == tag:
                flush()
                opened[stack.pop().tag] -= 1
        elif tag == "br":
            text.append("\n")
        elif closing:
            if opened[tag]:
                flush()
                close({tag})
        elif tag in RAW and not attrs.endswith("/"):
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else "".join(c if len(c.lower()) != 1 else c.lower() for c in html)
            stop = lower.find(f"</{tag}", at)
            at = skip = len(html) if stop < 0 else (html.find(">", stop) + 1 or len(html))
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            if tag in CLOSES_P:
                close({"p"}, STOPS)
            elif tag in SAME:
                close(SAME[tag], STOPS)
            push(tag, _apart(tag, attrs, article), tag in FLOW and not attrs.strip("/ \t\n\r\f"))
        try:
            found = tags.send(skip) if skip is not None else next(tags)
        except StopIteration:
            found = None
    text.append(html[at:])
    flush()
    return root


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _signed(root: Node) -> None:
    """Structure of each subtree (tags alone; its shape counts repeated kids, its sign does not) and its number of nodes."""
    for node in reversed(_preorder(root)):
        runs, shapes, last = [], [], None
        node.size = 1
        for k in node.kids:
            if isinstance(k, Node):
                node.size += k.size
                shapes.append(k.shape)
                if k.sign != last:
                    runs.append(k.sign)
                    last = k.sign
        node.sign = hash((node.tag, tuple(runs)))
        node.shape = hash((node.tag, tuple(shapes)))


def _runs(node: Node) -> list[list[Node]]:
    """Kids in runs of one structure: neighbours of a run match one by one."""
    out: list[list[Node]] = []
    for k in node.kids:
        if isinstance(k, Node):
            if out and out[-1][0].sign == k.sign:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def _trimmed(x: list, y: list) -> tuple[int, int]:
    """Runs of equal structure at both ends: they match one another."""
    head = 0
    while head < min(len(x), len(y)) and x[head][0].sign == y[head][0].sign:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail][0].sign == y[-1 - tail][0].sign:
        tail += 1
    return head, tail


class _InOrder:
    """The heaviest matching, in order, of n and m runs.  A pair weighs ``sizes`` of its runs' kinds times the shorter run's length.

    Totals are worked off row by row.  Of a matching beyond ``HELD`` pairs of runs only the totals on ``PARTS`` lines each way are
    held, and the parts that the way back meets are worked off again, so memory grows with n + m.
    """

    def __init__(self, sizes: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]):
        self.sizes, (self.x, self.x_len), (self.y, self.y_len) = sizes, x, y
        most = int((sizes.max(axis=1)[self.x] * self.x_len).sum())
        self.kind = np.int32 if most < 1 << 31 else np.int64

    def _rows(self, i0: int, i1: int, j0: int, j1: int, top: np.ndarray, left: np.ndarray):
        """Totals of columns j0 + 1 to j1 after each row from i0 + 1 to i1, from those above and to the left.

        Column c stands at [c % deep, c // deep], so that most of the running maximum is taken of whole lines.
        """
        m = j1 - j0
        deep = min(12, 1 + m // 2048)
        wide = -(-m // deep)

        def laid(a: np.ndarray) -> np.ndarray:
            if deep == 1:
                return a.astype(self.kind).reshape(1, m)
            return np.ascontiguousarray(np.pad(a, (0, deep * wide - m), "edge").reshape(wide, deep).T.astype(self.kind))

        kinds, lens, known = self.y[j0:j1], self.y_len[j0:j1], {}
        row, new = laid(top[1:]), np.empty((deep, wide), self.kind)
        for i in range(i0, i1):
            at = (self.x[i], self.x_len[i])
            if at not in known:
                if len(known) >= 64:
                    known.clear()
                known[at] = laid(self.sizes[at[0]][kinds] * np.minimum(at[1], lens))
            w = known[at]
            np.add(row[:-1], w[1:], out=new[1:])
            np.add(row[-1, :-1], w[0, 1:], out=new[0, 1:])
            new[0, 0] = max(left[i - i0] + w[0, 0], left[i - i0 + 1])
            np.maximum(new, row, out=new)
            for k in range(1, deep):
                np.maximum(new[k], new[k - 1], out=new[k])
            last = np.maximum.accumulate(new[-1])
            if deep > 1:
                np.maximum(new[:, 1:], last[:-1], out=new[:, 1:])
            else:
                new[0] = last
            yield new
            row, new = new, row

    def total(self) -> int:
        n, m = len(self.x), len(self.y)
        for row in self._rows(0, n, 0, m, np.zeros(m + 1, self.kind), np.zeros(n + 1, self.kind)):
            pass
        return int(row[-1, -1])  # the last column is repeated up to the end

    def pairs(self) -> list[tuple[int, int]]:
        n, m = len(self.x), len(self.y)
        out: list[tuple[int, int]] = []
        self._back(0, n, 0, m, np.zeros(m + 1, self.kind), np.zeros(n + 1, self.kind), out)
        return out

    def _back(self, i0: int, i1: int, j0: int, j1: int, top: np.ndarray, left: np.ndarray, out: list) -> tuple[int, int]:
        """Append the pairs on the way back from (i1, j1); where it meets row i0 or column j0."""
        n, m, i, j = i1 - i0, j1 - j0, i1, j1
        if n * m <= HELD or max(n, m) <= PARTS:
            rows = [top.tolist()]
            for k, row in enumerate(self._rows(i0, i1, j0, j1, top, left), 1):
                rows.append([int(left[k]), *row.T.ravel()[:m].tolist()])
            while i > i0 and j > j0:
                here = rows[i - i0][j - j0]
                if here == rows[i - i0 - 1][j - j0]:
                    i -= 1
                elif here == rows[i - i0][j - j0 - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
            return i, j
        tall, wide = -(-n // PARTS), -(-m // PARTS)
        at = np.arange(wide, m, wide) - 1  # columns of the lines, as the rows count them
        lines, sides = [top], np.empty((n + 1, 1 + len(at)), self.kind)
        sides[:, 0], sides[0, 1:] = left, top[at + 1]
        for k, row in enumerate(self._rows(i0, i1, j0, j1, top, left), 1):
            sides[k, 1:] = row[at % len(row), at // len(row)]
            if k % tall == 0:
                lines.append(np.concatenate([left[k : k + 1], row.T.ravel()[:m]]))
        while i > i0 and j > j0:
            a, b = (i - 1 - i0) // tall, (j - 1 - j0) // wide
            i, j = self._back(i0 + a * tall, i, j0 + b * wide, j, lines[a][b * wide : j - j0 + 1], sides[a * tall : i - i0 + 1, b], out)
        return i, j


class Matching:
    """Simple tree matching of a page and a reference: sizes of the largest matchings of node pairs, and its pairs.

    Runs of one structure are matched one by one, all others by :class:`_InOrder`.  A size depends on the two shapes alone
    and is worked out once for them; ``table`` holds it by shape and by the other shape's number.
    """

    def __init__(self):
        self.number: dict[int, int] = {}
        self.table: dict[int, array] = {}
        self.runs: dict[int, list] = {}

    def _known(self, p: Node, q: Node) -> int:
        """Nodes in the matching of two trees of equal tags, 0 if not known yet."""
        if p.size == 1 or q.size == 1:
            return 1
        if p.shape == q.shape:
            return p.size
        row, j = self.table.get(p.shape, ()), self.number.get(q.shape, len(self.number))
        return row[j] if j < len(row) else 0

    def _learn(self, p: Node, q: Node, size: int) -> None:
        row, j = self.table.setdefault(p.shape, array("q")), self.number.setdefault(q.shape, len(self.number))
        if j >= len(row):
            row.extend([0] * (len(self.number) - len(row)))
        row[j] = size

    def _like(self, node: Node) -> list[list[Node]]:
        """Runs of some node of that shape: enough for sizes."""
        if node.shape not in self.runs:
            self.runs[node.shape] = _runs(node)
        return self.runs[node.shape]

    @staticmethod
    def _middle(x: list, y: list):
        """Pairs of runs at both ends, and the runs between them that have one of their tag on the other side."""
        head, tail = _trimmed(x, y)
        ends = [(x[i], y[i]) for i in range(head)] + [(x[-1 - i], y[-1 - i]) for i in range(tail)]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if not x or not y:
            return ends, [], []
        tags = {r[0].tag for r in x} & {t[0].tag for t in y}
        return ends, [r for r in x if r[0].tag in tags], [t for t in y if t[0].tag in tags]

    def _missing(self, ends: list, x: list, y: list) -> list[tuple[Node, Node]]:
        """Some of the pairs whose sizes are needed and not known; none if all are known."""
        out = [(r[0], t[0]) for r, t in ends if not self._known(r[0], t[0])]
        kinds = {t[0].shape: t[0] for t in y}
        for p in {r[0].shape: r[0] for r in x}.values():
            out += [(p, q) for q in kinds.values() if p.tag == q.tag and not self._known(p, q)]
            if len(out) >= MISSING:
                break
        return out

    def _in_order(self, x: list, y: list) -> _InOrder:
        def numbered(runs: list):
            first = {r[0].shape: r[0] for r in runs}
            number = {s: k for k, s in enumerate(first)}
            return list(first.values()), (np.array([number[r[0].shape] for r in runs]), np.array([len(r) for r in runs]))

        (p, kx), (q, ky) = numbered(x), numbered(y)
        sizes = np.zeros((len(p), len(q)), np.int64)
        for i, a in enumerate(p):
            sizes[i] = [self._known(a, b) if a.tag == b.tag else 0 for b in q]
        return _InOrder(sizes, kx, ky)

    def _total(self, x: list, y: list) -> int:
        if len(x) * len(y) > FEW_PAIRS:
            return self._in_order(x, y).total()
        row = [0] * (len(y) + 1)
        for r in x:
            p, n, new = r[0], len(r), [0]
            for j, t in enumerate(y):
                w = min(n, len(t)) * self._known(p, t[0]) if p.tag == t[0].tag else 0
                new.append(max(row[j] + w, row[j + 1], new[j]))
            row = new
        return row[-1]

    def size(self, a: Node, b: Node) -> int:
        """Nodes in the matching of two trees; pairs below are worked off from a stack."""
        if a.tag != b.tag:
            return 0
        todo = [(a, b)]
        while todo:
            p, q = todo[-1]
            if self._known(p, q):
                todo.pop()
                continue
            ends, x, y = self._middle(self._like(p), self._like(q))
            if need := self._missing(ends, x, y):
                todo += need
                continue
            self._learn(p, q, 1 + sum(min(len(r), len(t)) * self._known(r[0], t[0]) for r, t in ends) + self._total(x, y))
        return self._known(a, b)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of that matching."""
        pairs, todo = [], [(a, b)]
        while todo:
            p, q = todo.pop()
            pairs.append((p, q))
            if p.size == 1 or q.size == 1:
                continue
            both, x, y = self._middle(_runs(p), _runs(q))
            if len(x) == len(y) == 1:
                both += zip(x, y)
            elif x:
                while need := self._missing([], x, y):
                    for r, t in need:
                        self.size(r, t)
                both += [(x[i], y[j]) for i, j in self._in_order(x, y).pairs()]
            todo += [pair for r, t in both for pair in zip(r, t)]
        return pairs


def _matched(a: Node, b: Node) -> int:
    return Matching().size(a, b)


def _aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    return Matching().pairs(a, b)


def _own(node: Node) -> str:
    return _SPACE.sub(" ", " ".join(k for k in node.kids if isinstance(k, str))).strip()


def template_nodes(page: Node, references: list[Node]) -> tuple[set[int], set[int]]:
    """ids of the page's nodes whose own text is the same at the aligned place of two references or more: of all, and of those that are no copies of the page."""
    if len(references) < RECURS:
        return set(), set()
    every: Counter = Counter()
    others: Counter = Counter()
    whole = sum(len(_own(n)) for n in _preorder(page) if not n.apart)
    for ref in references:
        equal = [(id(p), len(t)) for p, q in _aligned(page, ref) if (t := _own(p)) and t == _own(q)]
        every.update(k for k, _ in equal)
        if sum(n for _, n in equal) <= COPY * whole:
            others.update(k for k, _ in equal)
    return {k for k, n in every.items() if n >= RECURS}, {k for k, n in others.items() if n >= RECURS}


def _weigh(page: Node, template: set[int]) -> dict[int, int]:
    """Characters of varying text in each subtree, none in parts set apart."""
    weights: dict[int, int] = {}
    for node in reversed(_preorder(page)):
        n = 0
        if not node.apart:
            vary = id(node) not in template
            for k in node.kids:
                n += weights[id(k)] if isinstance(k, Node) else len(k.strip()) if vary else 0
        weights[id(node)] = n
    return weights


def _named(node: Node) -> list[Node]:
    """Outermost article and main elements below a node, outside of parts set apart."""
    found, todo = [], [k for k in reversed(node.kids) if isinstance(k, Node)]
    while todo:
        k = todo.pop()
        if k.apart:
            continue
        if k.tag in ("article", "main"):
            found.append(k)
        else:
            todo.extend(x for x in reversed(k.kids) if isinstance(x, Node))
    return found


def content_roots(page: Node, template: set[int]) -> list[Node]:
    weights = _weigh(page, template)
    found = []
    for k in _named(page):  # an article inside of main is narrower
        inner = _named(k) if k.tag == "main" else []
        found += inner if inner and sum(weights[id(x)] for x in inner) >= 0.5 * weights[id(k)] else [k]
    if found and (weights[id(page)] == 0 or sum(weights[id(k)] for k in found) > 0):
        return found
    node = page
    while True:
        kids = [k for k in node.kids if isinstance(k, Node) and not k.apart]
        best = max(kids, key=lambda k: weights[id(k)], default=None)
        if best is None or best.tag in ("p", "pre", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") or weights[id(best)] < 0.7 * max(1, weights[id(node)]):
            return [node]
        node = best


def _blocks(root: Node, skip: set[int]) -> list[str]:
    out, todo = [], [(root, k) for k in reversed(root.kids)] if not root.apart else []
    while todo:
        parent, k = todo.pop()
        if isinstance(k, Node):
            if not k.apart:
                todo += [(k, x) for x in reversed(k.kids)]
        elif id(parent) not in skip and (t := _SPACE.sub(" ", entities.unescape(k)).strip()):
            out.append(t)
    return out


def _in_flow(page: Node, template: set[int]) -> set[int]:
    """Template nodes that are blocks of running text without attributes beside a block that varies: constant headings and sentences of a text."""
    weights = _weigh(page, template)
    out = set()
    for node in _preorder(page):
        kids = [k for k in node.kids if isinstance(k, Node) and not k.apart]
        if any(k.plain and id(k) in template for k in kids) and any(weights[id(k)] for k in kids):
            out.update(id(k) for k in kids if k.plain)
    return out


def main_text(page: Node, references: list[Node]) -> str:
    template, inside = template_nodes(page, references)
    roots = content_roots(page, template)
    # what an author marked as the article is template only by pages that are not copies of it, and not where a text runs on around it
    inside = inside - _in_flow(page, inside)
    return "\n".join(t for root in roots for t in _blocks(root, inside if root.tag in ("article", "main") else template))


def _tree(html: str | None) -> Node:
    root = parse(html or "")
    _signed(root)
    return root


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(arrow):
    known: dict[str, Node] = {}
    for b in arrow:
        out = []
        for page_id, url, html, *refs in zip(*(c.to_pylist() for c in b.columns)):
            trees = []
            for r in refs:
                if r is not None and r != html:
                    if r not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[r] = _tree(r)
                    trees.append(known[r])
            text = main_text(_tree(html), trees)
            out.append((page_id, url, text, len(text)))
        yield A.pack_batch(out, _SCHEMA)


def extract(pages: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Pages (page_id, url, html) -> (page_id, url, text, n_chars).

    References are joined by host; a hot host's pages are dealt over several tasks, each with the host's references.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    slot = F.pmod(F.xxhash64("html"), F.lit(slots))
    least = lambda k: F.min(F.when(slot == k, F.struct(F.xxhash64("html").alias("h"), F.col("html").alias("html"))))["html"].alias(f"r{k}")
    references = rows.where(F.length("html") > 0).groupBy("host").agg(*[least(k) for k in range(slots)])
    total = rows.count()
    # at most HOT hosts hold more than a HOT-th of the pages, so this table has a bounded size
    deals = F.ceil(F.col("n") / F.lit(max(FEW, total // HOT))).cast("int")
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(FEW, total // HOT)).select("host", deals.alias("deals"))
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("deal", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("deals", F.lit(1))))
    references = references.join(F.broadcast(hot), "host", "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)).cast("long") - 1)))
    both = dealt.drop("deals").join(references.drop("deals"), ["host", "deal"], "left").select("page_id", "url", "html", *[f"r{k}" for k in range(slots)])
    return both.mapInArrow(A.in_pieces(_extracted, 8 << 20, 200), "page_id long, url string, text string, n_chars long")
