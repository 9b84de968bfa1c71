"""Main text of web pages by wrapper induction.

Pages of a host are laid out by few templates. Pages whose blocks have the same classes are one layout; each layout of
a host is learnt by aligning the DOM trees of its pages with the tree of one of them (the non-empty page of the least
hashed id) by simple tree matching: the largest set of node pairs of equal label that keeps order and ancestry. Pages
of rare layouts are aligned with the host's commonest. A text node of the reference tree that finds the same text nearly
everywhere is constant, so template; the others are varying slots, so content. What alignment does not reach is counted
over all pages of the host: a text that stands on nearly all pages that have a text at its label path is constant too.

A page's text is what is left of its own tree, in page order: constant nodes go, inside articles as outside; and blocks
under chrome (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, comments) go by tag and class,
as adverts and comments vary as much as content does. Articles that are constant for the most part are copies and stay.

The pages of one host may be a third of all: nothing gathers a host's pages. Pages meet the reference of their layout in
a join (broadcast if counted small, else shuffled and split where skewed), the tasks count, and only counts are
shuffled. Trees are walked with explicit stacks, as broken pages nest thousands of elements.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, small

#: A reference text is constant if this share of the pages that reach it agree, over at least so many pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5
#: Bits that tell whether two subtrees may have a text in common.
WORD_BITS = 1021
#: Reference rows that may be broadcast.
BROADCAST_ROWS = 20_000

#: How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style template iframe textarea select option button title".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption "
    "address hr details summary nav header footer aside form fieldset menu dialog hgroup center".split()
)
#: Elements that end an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: What an opening element ends, and what it cannot reach past.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Words in a class, id or role that mark chrome: alone, last in a compound, or first with words of place and form only.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside rail widget widgets related recommended share sharing social follow subscribe newsletter signup login search "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay toolbar pager pagination copyright "
    "complementary contentinfo alert skip legal disclaimer tags taglist outbrain taboola".split()
)
#: Those of them that mark chrome inside an article, too: menus, sidebars, footers, notices, adverts, forms, comments.
ARTICLE_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar aside widget widgets footer newsletter signup login subscribe comment comments disqus reply replies respond "
    "cookie cookies consent gdpr notice notices popup modal complementary contentinfo outbrain taboola".split()
)
#: Words of place and form.
FORM_WORDS = frozenset("left right top bottom main site page global primary secondary area list link links item items box bar block section wrap wrapper container inner outer row col column posts buttons icons slot unit panel body text".split())
#: Words of a compound that speaks of chrome without being any, and of what only a page's own header may be named after.
SPEAKING_WORDS = frozenset("has have with without no not for of to on off open show hide".split())
PAGE_WORDS = frozenset("site page main top global".split())
#: Words in the class, id or role of an article that is a comment.
COMMENT_WORDS = frozenset("comment reply".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\f\r\v   \u0085  -   　]+")


class Node:
    __slots__ = ("label", "tag", "kids", "text", "chrome", "inner", "hidden", "_hash", "_solid")

    def __init__(self, tag: str, label: str, text: str = "") -> None:
        self.tag, self.label, self.text = tag, label, text
        self.kids: list[Node] = []
        self.chrome = self.inner = self.hidden = False
        self._hash = self._solid = None

    def hash(self) -> str:
        if self._hash is None:
            self._hash = hash_text(self.text)
        return self._hash

    def solid(self) -> list[Node]:
        """The children that are aligned: without blanks, hidden elements and chrome."""
        if self._solid is None:
            self._solid = [k for k in self.kids if not k.hidden and not k.chrome and (k.tag != "#text" or not k.text.isspace())]
        return self._solid


def _marks(token: list[str], chrome: frozenset) -> bool:
    """Whether the words of one class, id or role mark chrome: ``sidebar`` and ``left-sidebar`` do, ``has-sidebar``,
    ``share-price`` and ``post-header`` do not."""
    if not token or SPEAKING_WORDS & set(token):
        return False
    if token[-1] == "header":
        return "header" in chrome and set(token[:-1]) <= PAGE_WORDS
    return token[-1] in chrome or token[0] in chrome and all(w in FORM_WORDS or w in chrome for w in token[1:])


@lru_cache(maxsize=4096)
def _traits(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label, chrome, chrome inside an article, and hidden."""
    names = ""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            names += " " + (m[2] or m[3] or m[4] or "")
    tokens = [_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", t).lower()) for t in names.split()]
    named = tag not in ("html", "body", "article", "main")
    comment = tag == "article" and any(_marks(t, COMMENT_WORDS) for t in tokens)
    chrome = tag in CHROME or named and any(_marks(t, CHROME_WORDS) for t in tokens) or comment
    inner = tag in CHROME and tag != "header" or named and any(_marks(t, ARTICLE_CHROME_WORDS) for t in tokens) or comment
    return tag + names.lower(), chrome, inner, tag in HIDDEN


def _element(tag: str, attributes: str, inside: bool) -> Node:
    """An element; inside articles fewer words mark chrome."""
    label, chrome, inner, hidden = _traits(tag, attributes if not attributes.isspace() else "")
    node = Node(tag, label)
    node.chrome, node.inner, node.hidden = inner if inside else chrome, inside or tag == "article", hidden
    return node


def parse(html: str) -> Node:
    """The DOM tree of a page: elements and non-blank texts (decoded), with the closing rules that pages rely on."""
    root = Node("#root", "#root")
    stack = [root]
    at, end = 0, len(html)

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            stack[-1].kids.append(Node("#text", "#text", unescape(raw)))
        elif raw and stack[-1].kids:
            stack[-1].kids.append(Node("#text", "#text", " "))

    def close(names: frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            close(frozenset((tag,)), frozenset(("#root",)) if tag in ("body", "html", "article", "main", "div", "section", "table", "nav", "footer", "header", "aside", "form") else frozenset("#root td th table article main section div body".split()) - {tag})
            continue
        if tag in ("html", "head", "body") and any(n.tag == tag for n in stack):
            continue
        if tag == "body":
            close(frozenset(("head",)), frozenset(("#root",)))
        if tag in ENDS_P:
            close(frozenset(("p",)), frozenset("#root td th table article main section div button li blockquote body".split()))
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in RAW:
            n = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            stop = n.start() if n else end
            node = _element(tag, m[3], stack[-1].inner)
            if tag in ("title", "textarea"):
                node.kids.append(Node("#text", "#text", unescape(html[at:stop])))
            stack[-1].kids.append(node)
            at = n.end() if n else end
            continue
        node = _element(tag, m[3], stack[-1].inner)
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    _uncover(root)
    return root


def _uncover(root: Node) -> None:
    """Unmark chrome that all of the page's content lies in, from the outside in: a wrapper or a page-wide form is none.

    Content are articles and main elements but comments; on a page without any, more than half of the page's text, if
    less than half of that is in links and it does not stand in an element that is chrome by tag, a form left aside.
    """
    while True:
        covers, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.chrome:
                covers.append(node)
            elif node.tag in ("article", "main"):
                return
            else:
                stack.extend(node.kids)
        holding = [n for n in covers if any(k.tag in ("article", "main") and not k.chrome for k in _below(n))]
        if not holding:
            whole = _sizes(root)[0]
            holding = [n for n in covers if n.tag not in CHROME or n.tag in ("form", "fieldset") for size, linked in [_sizes(n)] if 2 * size > whole and 2 * linked < size]
        if not holding:
            return
        for node in holding:
            node.chrome = False


def _below(node: Node) -> Iterator[Node]:
    stack = list(node.kids)
    while stack:
        n = stack.pop()
        yield n
        stack.extend(n.kids)


def _sizes(node: Node) -> tuple[int, int]:
    """Characters of the shown text of an element, and of those the ones in links."""
    size = linked = 0
    stack = [(k, False) for k in node.kids]
    while stack:
        n, link = stack.pop()
        if n.tag == "#text":
            size, linked = size + len(n.text), linked + link * len(n.text)
        elif not n.hidden:
            stack.extend((k, link or n.tag == "a") for k in n.kids)
    return size, linked


class _Classes:
    """Subtrees of a reference and of a page, numbered so that equal ones share a number; children have smaller numbers
    than what holds them. Texts that only one of the two trees has are all alike here, as they equal nothing there.

    ``shape`` is the class with all texts left out, ``words`` bits of its texts: where two classes have no bit in common,
    no text of theirs is equal, and their shapes score the same.
    """

    def __init__(self, tree: list, root: Node) -> None:
        self.nodes, self.kids = [root], []
        for node in self.nodes:  # grows while it is read: parents stand before their children
            below = node.solid() if node.tag != "#text" else []
            self.kids.append(range(len(self.nodes), len(self.nodes) + len(below)))
            self.nodes.extend(below)
        common = {n.hash() for n in self.nodes if n.tag == "#text"} & {digest for _, digest, _, number in tree if number >= 0}
        self.known: dict[tuple, int] = {}
        self.label, self.below, self.shape, self.words = [], [], [], []
        self.scores: dict[tuple[int, int], int] = {}
        self.mine, self.theirs = [0] * len(self.nodes), [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            label, digest, kids, number = tree[i]
            self.theirs[i] = self._of(label, digest if number >= 0 and digest in common else "", tuple(map(self.theirs.__getitem__, kids)))
        for i in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[i]
            digest = node.hash() if node.tag == "#text" and node.hash() in common else ""
            self.mine[i] = self._of(node.label, digest, tuple(self.mine[k] for k in self.kids[i]))

    def _of(self, label: str, digest: str, below: tuple[int, ...]) -> int:
        got = self.known.get((label, digest, below))
        if got is None:
            words = 1 << int(digest, 16) % WORD_BITS if digest else 0
            for k in below:
                words |= self.words[k]
            shape = self._of(label, "", tuple(self.shape[k] for k in below)) if words else len(self.label)
            got = self.known[label, digest, below] = len(self.label)
            self.label.append(label)
            self.below.append(below)
            self.shape.append(shape)
            self.words.append(words)
        return got

    def pair(self, p: int, q: int) -> tuple[int, int]:
        return (p, q) if self.words[p] & self.words[q] else (self.shape[p], self.shape[q])

    def score(self, p: int, q: int) -> int:
        """The size of the largest matching of two classes of one label."""
        found = {self.pair(p, q)}
        todo = list(found)
        for p_, q_ in todo:  # grows while it is read
            x, y = self.below[p_], self.below[q_]
            a, b = _ends(x, y)
            xs, ys = set(x[a : len(x) - b]), tuple(set(y[a : len(y) - b]))
            shared = self.by_bit(ys)
            pairs = [(u, v) for u in {self.shape[u] for u in xs} for v in {self.shape[v] for v in ys} if self.label[u] == self.label[v]]
            pairs += [(u, ys[j]) for u in xs for j in self.alike(u, ys, shared)]
            pairs += [(u, u) for u in {*x[:a], *x[len(x) - b :]}]
            for key in pairs:
                if key not in found and key not in self.scores:
                    found.add(key)
                    todo.append(key)
        for u, v in sorted(found):
            if self.label[u] == "#text":
                self.scores[u, v] = 3 if u == v and self.words[u] else 2
                continue
            x, y = self.below[u], self.below[v]
            a, b = _ends(x, y)
            total = 2 + sum(self.scores[k, k] for k in x[:a]) + sum(self.scores[k, k] for k in x[len(x) - b :])
            for last in _grid(self, x[a : len(x) - b], y[a : len(y) - b]):
                pass
            self.scores[u, v] = total + int(last[-1])
        return self.scores[self.pair(p, q)]

    def by_bit(self, y: tuple[int, ...]) -> dict[int, list[int]]:
        """Places in a list of the classes that have a bit of their words."""
        out: dict[int, list[int]] = {}
        for j, q in enumerate(y):
            for bit in _bits(self.words[q]):
                out.setdefault(bit, []).append(j)
        return out

    def alike(self, p: int, y: tuple[int, ...], by_bit: dict[int, list[int]]) -> set[int]:
        """Places of classes of the same label that may have a text in common with a class."""
        return {j for bit in _bits(self.words[p]) for j in by_bit.get(bit, ()) if self.label[y[j]] == self.label[p]}

    def weights(self, p: int, y: tuple[int, ...], by_bit: dict[int, list[int]], plain: dict[int, np.ndarray]) -> np.ndarray:
        """The score of a class with each of some others, -1 for other labels; ``plain`` holds those of shapes."""
        shape = self.shape[p]
        if shape not in plain:
            plain[shape] = np.array([self.scores[shape, self.shape[q]] if self.label[q] == self.label[p] else -1 for q in y], np.int64)
        near = self.alike(p, y, by_bit)
        if not near:
            return plain[shape]
        out = plain[shape].copy()
        for j in near:
            out[j] = self.scores[p, y[j]]
        return out


def _bits(words: int) -> Iterator[int]:
    while words:
        low = words & -words
        yield low
        words ^= low


def _ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
    """How many first and how many last children are of equal classes, which nothing can match better than their like."""
    most, a, b = min(len(x), len(y)), 0, 0
    while b < most and x[-1 - b] == y[-1 - b]:
        b += 1
    while a < most - b and x[a] == y[a]:
        a += 1
    return a, b


def _grid(classes: _Classes, x: tuple[int, ...], y: tuple[int, ...], first: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Rows of the best scores of the first children in x with the first ones in y, from the row ``first`` on."""
    above = np.zeros(len(y) + 1, np.int64) if first is None else first
    yield above
    by_bit, plain = classes.by_bit(y), {}
    for p in x:
        w = classes.weights(p, y, by_bit, plain)
        now = np.zeros(len(y) + 1, np.int64)
        np.maximum.accumulate(np.maximum(np.where(w >= 0, above[:-1] + w, 0), above[1:]), out=now[1:])
        yield now
        above = now


def _aligned(classes: _Classes, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """Places of the children that are matched with each other. About the root of the rows is held at a time: some rows
    are kept, and those between two of them are made again."""
    a, b = _ends(x, y)
    yield from ((i, i) for i in range(a))
    yield from ((len(x) - 1 - i, len(y) - 1 - i) for i in range(b))
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not x or not y:
        return
    step = isqrt(len(x)) + 1
    kept = [row for i, row in enumerate(_grid(classes, x, y)) if i % step == 0]
    i, j, low, rows = len(x), len(y), len(x) + 1, []
    while i and j:
        if i - 1 < low:
            low = (i - 1) // step * step
            rows = list(_grid(classes, x[low:i], y, kept[low // step]))
        now, above = rows[i - low], rows[i - 1 - low]
        p, q = x[i - 1], y[j - 1]
        if classes.label[p] == classes.label[q] and now[j] == above[j - 1] + classes.scores[classes.pair(p, q)]:
            i, j = i - 1, j - 1
            yield a + i, a + j
        elif now[j] == above[j]:
            i -= 1
        else:
            j -= 1


def match(tree: list, root: Node, pairs: list | None = None) -> int:
    """Simple tree matching of a reference (a skeleton) with a page's node: the size of the matching.

    With ``pairs``, the matched text nodes are added to it as (number in the reference, page's node). Equal texts count
    a little more than different ones, so that a constant text finds its like. The matching is a largest one for lists
    of children of any length: equal subtrees are scored once, and the time for what is different grows with the product
    of the lengths, the memory with their root.
    """
    if tree[0][0] != root.label:
        return 0
    classes = _Classes(tree, root)
    total = classes.score(classes.theirs[0], classes.mine[0])
    todo = [(0, 0)] if pairs is not None else []
    while todo:
        r, s = todo.pop()
        if tree[r][3] >= 0:
            pairs.append((tree[r][3], classes.nodes[s]))
            continue
        kids, below = tree[r][2], classes.kids[s]
        if kids and below:
            p, q = classes.theirs[r], classes.mine[s]
            todo.extend((kids[i], below[j]) for i, j in _aligned(classes, classes.below[p], classes.below[q]))
    return total


def hash_text(text: str) -> str:
    return hashlib.blake2b(_SPACE.sub(" ", text).strip().encode("utf-8", "replace"), digest_size=8).hexdigest()


def skeleton(root: Node) -> list:
    """A page's tree as a flat list of nodes (label, hash of the text, places of the kids, number of the text node)."""
    out: list = []
    number = 0
    stack: list[tuple[Node, int]] = [(root, -1)]
    while stack:
        node, parent = stack.pop()
        if parent >= 0:
            out[parent][2].append(len(out))
        if node.tag == "#text":
            out.append([node.label, node.hash(), [], number])
            number += 1
        else:
            stack.extend((k, len(out)) for k in reversed(node.solid()))
            out.append([node.label, "", [], -1])
    return out


@lru_cache(maxsize=1 << 16)
def _step(path: int, label: str) -> int:
    """The hash of a label path; digits are left out, as ids of posts are."""
    return _long(hashlib.blake2b(f"{path} {_DIGITS.sub('', label)}".encode("utf-8", "replace"), digest_size=8).hexdigest())


_DIGITS = re.compile(r"\d+")


def _long(digest: str) -> int:
    return int(digest, 16) - (1 << 63)


def leaves(root: Node) -> Iterator[tuple[Node, int, int]]:
    """Texts outside chrome and articles: (node, hash of its label path, hash of its text)."""
    stack = [(root, 0)]
    while stack:
        node, path = stack.pop()
        if node.tag == "#text":
            yield node, path, _long(node.hash())
        else:
            below = _step(path, node.label)
            stack.extend((k, below) for k in node.solid() if k.tag != "article")


def _template_inside(root: Node, constant: set[int]) -> set[int]:
    """The constant text nodes without those of articles that are constant for the most part: copies of one article, in
    which what they repeat is their content."""
    held: list[list] = []
    stack: list[tuple[Node, list | None]] = [(root, None)]
    while stack:
        node, article = stack.pop()
        if node.tag == "#text":
            if article is not None:
                size = len(node.text.strip())
                article[0] += size
                if id(node) in constant:
                    article[1] += size
                    article[2].append(id(node))
            continue
        if node.tag == "article" and article is None:
            article = [0, 0, []]
            held.append(article)
        stack.extend((k, article) for k in node.solid())
    return constant - {i for size, fixed, ids in held if 2 * fixed > size for i in ids}


def main_text(root: Node, constant: set[int]) -> str:
    """The page's main text; constant: identities of its text nodes that belong to the template."""
    blocks: list[str] = []
    line: list[str] = []
    constant = _template_inside(root, constant) if constant else constant

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip(" ")
            if text:
                blocks.append(text)
            line.clear()

    stack: list[Node | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif node.tag == "#text":
            if id(node) not in constant:
                line.append(node.text)
        elif node.hidden or node.chrome:
            continue
        elif node.tag == "br":
            line.append(" ")
        else:
            if node.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(node.kids))
    flush()
    return "\n".join(blocks)


def _parsed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pages. Columns of batches: host, html, layout, reference.

    Per reference text node (number >= 0): the pages that reach it (seen), those that agree (same). Per label path
    (number -1) the pages that have a text there, per path and text (number -2) the pages with that text there. ``kinds``
    has a bit set for each page by its hash, so it has at most as many bits as there are different pages.
    """
    trees: dict[str, list] = {}
    for batch in batches:
        seen: dict[tuple, list[int]] = {}

        def add(key: tuple, same: int, bit: int) -> None:
            got = seen.setdefault(key, [0, 0, 0])  # noqa: B023
            got[0] += 1
            got[1] += same
            got[2] |= bit

        for host, html, layout, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text not in trees:
                trees = trees if len(trees) < 2000 else {}
                trees[text] = json.loads(text)
            tree, root, pairs = trees[text], parse(html or ""), []
            bit = 1 << zlib.crc32((html or "").encode("utf-8", "replace")) % 63
            match(tree, root, pairs)
            hashes = _hashes(tree)
            for number, node in pairs:
                add((host, layout, number, 0, 0), hashes[number] == node.hash(), bit)
            found = {(path, digest) for _, path, digest in leaves(root)}
            for path in {p for p, _ in found}:
                add((host, None, -1, path, 0), 0, bit)
            for path, digest in found:
                add((host, None, -2, path, digest), 0, bit)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*((*k, *v) for k, v in seen.items()), strict=True) if seen else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "layout", "number", "path", "digest", "seen", "same", "kinds"])


def _hashes(tree: list) -> dict[int, str]:
    return {number: digest for _, digest, _, number in tree if number >= 0}


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps(skeleton(parse(h or ""))) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["host", "layout", "reference"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: page id, url, html, reference, constant numbers, constant texts by path."""
    trees: dict[str, list] = {}
    for batch in batches:
        ids_, texts = batch.column(0), []
        for html, text, fixed, lines in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            root = parse(html or "")
            constant: set[int] = set()
            if fixed:
                if text not in trees:
                    trees = trees if len(trees) < 2000 else {}
                    trees[text] = json.loads(text)
                pairs: list = []
                match(trees[text], root, pairs)
                wanted, numbers = _hashes(trees[text]), set(fixed)
                constant = {id(node) for number, node in pairs if number in numbers and wanted[number] == node.hash()}
            if lines:
                known = {(x["path"], x["digest"]) for x in lines}
                constant |= {id(node) for node, path, digest in leaves(root) if (path, digest) in known}
            texts.append(main_text(root, constant))
        yield pa.RecordBatch.from_arrays([ids_, batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def layout_of(html: Column) -> Column:
    """A hash of the classes that a page's blocks have, digits left out."""
    classes = F.regexp_extract_all(html, F.lit(r"(?i)<(?:div|section|main|article|table|ul|ol|h[1-6])\s[^>]*?\bclass\s*=\s*[\"']?([^\"'>]*)"), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(classes, lambda c: F.regexp_replace(c, r"\d+", "")))))


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without port and credentials; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Pages without a host are one host. Repeated rows give repeated results; a
    row with a null id is extracted too. A host of fewer than CONSTANT_PAGES different pages teaches no template: there only
    tags and classes tell chrome. Broken markup is read as far as it goes: comments, tags and raw elements that
    do not end run to the end of the page. An empty table gives an empty table. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("layout", layout_of(F.col("html")))
    # One page a layout, of layouts and hosts with enough pages; rare layouts take the host's commonest one.
    usable = rows.filter("page_id is not null and trim(html) <> ''")
    found = usable.groupBy("host", "layout").agg(F.min_by("page_id", F.struct(F.xxhash64("page_id"), "page_id")).alias("page_id"), F.count("*").alias("pages"))
    most = Window.partitionBy("host").orderBy(F.desc("pages"), "layout")
    found = found.withColumn("main", F.row_number().over(most) == 1)
    chosen = keep(found.filter(F.col("main") | (F.col("pages") >= CONSTANT_PAGES)), "wrapper-pages")
    first = rows.join(small(chosen.select("host", "layout", "page_id"), BROADCAST_ROWS), ["host", "layout", "page_id"], "left_semi").select("host", "layout", "html")
    made = first.mapInArrow(_skeletons, "host string, layout long, reference string").groupBy("host", "layout").agg(F.min("reference").alias("reference"))
    references = keep(made.join(chosen.select("host", "layout", "main"), ["host", "layout"]), "wrappers")
    own = small(references.select("host", "layout", F.lit(True).alias("own")), BROADCAST_ROWS)
    mains = small(references.filter("main").select("host", F.col("layout").alias("main_layout")), BROADCAST_ROWS)
    rows = rows.join(own, ["host", "layout"], "left").join(mains, "host", "left")
    rows = rows.withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.col("main_layout"))).drop("own", "main_layout")
    counted = rows.join(small(references.drop("main"), BROADCAST_ROWS), ["host", "layout"]).select("host", "html", "layout", "reference")
    counts = counted.mapInArrow(_parsed_counts, "host string, layout long, number int, path long, digest long, seen long, same long, kinds long")
    counts = counts.groupBy("host", "layout", "number", "path", "digest").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"), F.bit_or("kinds").alias("kinds"))
    counts = keep(counts.filter((F.col("seen") >= CONSTANT_PAGES) & (F.bit_count("kinds") >= CONSTANT_PAGES)), "wrapper-counts")
    fixed = counts.filter((F.col("number") >= 0) & (F.col("same") >= CONSTANT_SHARE * F.col("seen"))).groupBy("host", "layout").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    at_path = counts.filter("number = -1").select("host", "path", F.col("seen").alias("all"))
    lines = counts.filter("number = -2").join(at_path, ["host", "path"]).filter(F.col("seen") >= CONSTANT_SHARE * F.col("all"))
    lines = keep(lines.groupBy("host").agg(F.collect_list(F.struct("path", "digest")).alias("lines")), "wrapper-lines")
    wrappers = keep(references.drop("main").join(fixed, ["host", "layout"]), "wrappers")
    forget(chosen, counts)
    joined = rows.join(small(wrappers, BROADCAST_ROWS), ["host", "layout"], "left").join(small(lines, BROADCAST_ROWS), "host", "left")
    joined = joined.select("page_id", "url", "html", "reference", "numbers", "lines")
    kind = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(_texts, kind).withColumn("n_chars", F.length("text").cast("long"))
