"""Main text of web pages by wrapper induction (operator 2).

A page becomes a tree of its block elements; runs of like leaves (the paragraphs of an article,
the entries of a menu) become one repeated node.  Pages of one host with the same tree share a
*form*; forms are found by a count with partial sums, so a host
with a third of all pages is one list of forms like any other.  Trees are arrays (the parent and the label of each
node), so that no character in a class name and no depth means anything.  Simple tree matching (the
largest order-preserving matching of equally labelled nodes, by dynamic programming over the
children; equal subtrees at either end of two lists of children are matched first, which loses nothing) aligns each form with the host's most frequent one, which gives every node of
every page a slot of the host's wrapper.  Its time grows with the product of the kinds of children that differ, its memory doesn't.

A text that stands in one slot on half of the host's pages or more (three at least) is constant: template;
the other texts of the slot aren't.  Counts are summed over all forms after they are aligned; a text that is on under three pages
of its host, wherever it stands there, can't be constant and needn't be placed.  Pages with the same article count as one, so that copies of an
article don't make it template.  What varies is content, unless it is a menu, header, footer, sidebar, notice, advert,
form or reader comments by its tags and attributes, which vary from page to page too: a name counts only if all its words do (``site-header``,
not ``side-effects``), and never if names alone would hide a page's whole text.  Articles named as comments, and articles in a row inside or after another, aren't the main text.  The
main text is what varies below the article or main element; without one, in the
part of the tree that holds most of the varying text.  If a page would be left without
text so (a host with one text on all pages), the constant texts of the same part count.

Character references are decoded; white space inside a block becomes one space; blocks are
joined by one space in page order.  Tags may be unclosed or wrongly nested, to any depth.

Null html is the empty page, its text empty; a null or unreadable url belongs to the host "".
Repeated rows are pages each; an empty table gives an empty result; columns beside id, url and html don't matter.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import written

SHARE, LEAST_PAGES = 0.5, 3
#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea title select canvas audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose mmultiscripts mprescripts semantics".split())
SKIPPED = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
#: Elements that no class name makes a sidebar or an advert: the page's frame, and pictures and tables with their text.
NEVER = frozenset("html body figure figcaption table tbody tr td th blockquote pre".split())
#: Elements that end where the key begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role of what isn't the article, and words that stand beside them in one name (``site-header``).
ROLES = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor banner promo cookie cookies consent notice alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies reply respond footer header masthead toolbar share sharing social related recommended newsletter subscribe signup login search pagination pager widget widgets complementary contentinfo hidden".split())
BESIDE = frozenset("site page main top bottom left right upper lower inner outer primary secondary global mobile desktop sticky fixed bar box list wrapper wrap container section area block panel slot unit item items link links button buttons form icons icon media post posts article articles entry story stories user reader my the thread group row col column content text body title toggle".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Names of articles beside the article.
ASIDE = frozenset("ad ads advert advertisement comment comments disqus promo recommended related replies reply respond sponsored widget".split())
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: Weights of pairs of subtrees, and cells of rows of weights, that an alignment remembers; others it works out again.
HELD, CELLS = 1 << 20, 1 << 22
#: Cells up to which a table of best weights is held whole; of a larger one some rows are, the result is the same.
EXACT_CELLS = 1 << 14


@lru_cache(4096)
def role_of(words: str) -> bool:
    """Whether a class, id or role says that the block isn't the article: a name of role words only, or of role words and ``BESIDE``."""
    for name in words.split():
        parts = [p.rstrip("0123456789").lower() for p in PARTS.split(name)]
        parts = [p for p in parts if p]
        if any(p in ROLES for p in parts) and all(p in ROLES or p in BESIDE for p in parts):
            return True
    return False


@dataclass
class Page:
    """The blocks of a page in page order: label, parent (-1: none), whether it is skipped by its element, whether by its names, whether it
    is the main part; the texts with their block."""

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    skipped: list[bool] = field(default_factory=list)
    named: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)

    def add(self, label: str, parent: int, skipped: bool = False, named: bool = False, main: bool = False) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.skipped.append(skipped)
        self.named.append(named)
        self.main.append(main)
        return len(self.labels) - 1

    def within(self, own: list[bool]) -> list[bool]:
        """Of each block whether it or a block around it is one of ``own``."""
        out: list[bool] = []
        for i, p in enumerate(self.parents):
            out.append(own[i] or p >= 0 and out[p])
        return out

    def hidden(self) -> list[bool]:
        """Of each block whether it or a block around it is skipped.

        Names count unless they would hide all that elements leave.  An article named as comments are is skipped beside or
        inside another; so are articles in a row inside an article that has text of its own."""
        listed = self.listed()
        by_element = self.within([s or x for s, x in zip(self.skipped, listed)])
        out = self.within([s or n or x for s, n, x in zip(self.skipped, self.named, listed)])
        if all(out[n] for n, _ in self.texts) and not all(by_element[n] for n, _ in self.texts):
            return by_element
        return out

    def listed(self) -> list[bool]:
        """Of each main part whether it is one of several alike in a row, inside another one with text of its own or after one that isn't in a row."""
        out = [False] * len(self.labels)
        if sum(self.main) < 3:
            return out
        around = [-1] * len(self.labels)  # the innermost main part around a block
        for i, p in enumerate(self.parents):
            if p >= 0:
                around[i] = p if self.main[p] else around[p]
        own = {n if self.main[n] else around[n] for n, _ in self.texts}
        rows: dict[tuple[int, str], int] = {}
        mains = [i for i, m in enumerate(self.main) if m]
        for i in mains:
            row = self.parents[i], self.labels[i]
            rows[row] = rows.get(row, 0) + 1
        alone = False  # whether a part with text that isn't in a row came before
        for i in mains:
            if rows[self.parents[i], self.labels[i]] > 1:
                out[i] = alone or around[i] in own
            else:
                alone = alone or i in own
        return out

    def ends(self) -> list[int]:
        """Of each block the first block behind it that isn't inside it."""
        out = [i + 1 for i in range(len(self.parents))]
        for i in range(len(out) - 1, 0, -1):
            p = self.parents[i]
            out[p] = max(out[p], out[i])
        return out

    def sums(self, own: list[int]) -> list[int]:
        """The numbers of each block and of all inside it."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out


def parse(page: str | None) -> Page:
    """The tree of blocks.  Text stands in the blocks, in runs between others."""
    out = Page()
    stack, names = [out.add("#", -1)], ["#"]
    is_open: dict[str, int] = {}
    pieces: list[str] = []
    page = page or ""

    def end_block() -> None:
        if pieces:
            text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.texts.append((stack[-1], text))

    def leave() -> str:
        stack.pop()
        name = names.pop()
        is_open[name] -= 1
        return name

    position, size = 0, len(page)
    while position < size:
        m = TOKEN.search(page, position)
        if not m:
            pieces.append(page[position:])
            break
        if m.start() > position:
            pieces.append(page[position : m.start()])
        position = m.end()
        close, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)  # the latter with a quote left open
        if not name:
            continue
        name = name.lower()
        if close:
            if name in INLINE:
                continue
            if is_open.get(name):
                end_block()
                while leave() != name:
                    pass
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>|$" if name != "head" else r"</head\s*>|(?=<body)|$", re.I).search(page, position)
                position = end.end()
            continue
        if name in INLINE:
            continue
        end_block()
        if name in VOID:
            continue
        if names[-1] == "p":  # a block ends a paragraph
            leave()
        if ends := CLOSES.get(name):
            while names[-1] in ends:
                leave()
        label, skipped, named, main = name, name in SKIPPED, False, name in MAIN
        inside = any(is_open.get(n) for n in MAIN)
        if len(attributes) > 3:
            told = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
            words = " ".join(told.get(k, "") for k in ("class", "id", "role"))
            if words:
                label += "." + ".".join(sorted(set(words.split())))
                main = main or told.get("role") == "main"
                role = words.replace("header", "") if inside else words  # an article's own headline
                named = role_of(role) and name not in NEVER
                if main and named:  # an article is hidden only by names of comments and teasers
                    named = name == "article" and not ASIDE.isdisjoint(role.lower().replace("-", " ").replace("_", " ").split())
                    main = not named
            skipped = skipped or "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "")
        if name == "header" and inside:
            skipped = False
        stack.append(out.add(label, stack[-1], skipped and not main, named, main))
        names.append(name)
        is_open[name] = is_open.get(name, 0) + 1
    end_block()
    return out


def hash_text(text: str) -> int:
    """Signed 64-bit hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


hash_label = lru_cache(4096)(hash_text)


#: A form: parents and label hashes of its nodes, in page order.
Form = tuple[list[int], list[int]]


def form(page: Page) -> tuple[list[int], Form]:
    """The node of the form that each block is, and the form: runs of leaves with the same label are one node."""
    n = len(page.labels)
    leaf = [True] * n
    for p in page.parents[1:]:
        leaf[p] = False
    node, before = [0] * n, [-1] * n
    parents, labels = [-1], [hash_label(page.labels[0])]
    for i in range(1, n):
        p = page.parents[i]
        b = before[p]
        before[p] = i
        if b >= 0 and leaf[i] and leaf[b] and page.labels[i] == page.labels[b]:
            node[i] = node[b]
        else:
            node[i] = len(parents)
            parents.append(node[p])
            labels.append(hash_label(page.labels[i]))
    return node, (parents, labels)


def packed(f: Form) -> bytes:
    return np.array(f[0], "<i4").tobytes() + np.array(f[1], "<i8").tobytes()


def unpacked(b: bytes) -> Form:
    n = len(b) // 12
    return np.frombuffer(b, "<i4", n).tolist(), np.frombuffer(b, "<i8", n, 4 * n).tolist()


class Tree:
    """Of each node its label, children, size and kind (equal subtrees have the same)."""

    def __init__(self, f: Form, kinds: dict[tuple, int]):
        parents, self.labels = f
        n = len(parents)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.size, self.kind = [1] * n, [0] * n
        for i in range(1, n):
            self.children[parents[i]].append(i)
        for i in range(n - 1, -1, -1):
            key = (self.labels[i], *(self.kind[c] for c in self.children[i]))
            self.kind[i] = kinds.setdefault(key, len(kinds))
            if i:
                self.size[parents[i]] += self.size[i]


class Matching:
    """Largest order-preserving matchings of subtrees of a with subtrees of b.  Their weights turn on the subtrees' kinds alone; ``HELD`` of them are
    remembered and others worked out again, so that memory doesn't grow with the number of pairs."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.held = a, b, {}

    def known(self, i: int, j: int) -> int | None:
        a, b = self.a, self.b
        if a.labels[i] != b.labels[j]:
            return 0
        if a.kind[i] == b.kind[j]:
            return a.size[i]
        return self.held.get((a.kind[i], b.kind[j])) if a.children[i] and b.children[j] else 1

    def trimmed(self, i: int, j: int) -> tuple[list[int], list[int], int, int]:
        """Children between equal subtrees at either end, and the numbers of these."""
        a, b, xs, ys = self.a, self.b, self.a.children[i], self.b.children[j]
        most, head, tail = min(len(xs), len(ys)), 0, 0
        while head < most and a.kind[xs[head]] == b.kind[ys[head]]:
            head += 1
        while tail < most - head and a.kind[xs[-1 - tail]] == b.kind[ys[-1 - tail]]:
            tail += 1
        return xs[head : len(xs) - tail], ys[head : len(ys) - tail], head, tail

    def weights(self, xs: list[int], ys: list[int]) -> Generator:
        """Yields pairs whose weight it needs, as (False, pair), and (True, weights of x with all ys) for each x."""
        a, b = self.a, self.b
        places: dict[int, list[int]] = {}
        labelled: dict[int, list[int]] = {}
        for k, y in enumerate(ys):
            places.setdefault(b.kind[y], []).append(k)
            labelled.setdefault(b.labels[y], []).append(k)
        alike: dict[tuple[int, int], list[int]] = {}  # kinds by their label and one of a child; pairs without children of the same label weigh 1
        for kind, at in places.items():
            y = ys[at[0]]
            for label in {b.labels[c] for c in b.children[y]}:
                alike.setdefault((b.labels[y], label), []).append(kind)
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            kind = a.kind[x]
            if (row := rows.get(kind)) is None:
                row = np.zeros(len(ys), np.int32)
                row[labelled.get(a.labels[x], [])] = 1
                for other in {k for c in {a.labels[c] for c in a.children[x]} for k in alike.get((a.labels[x], c), ())}:
                    at = places[other]
                    w = self.known(x, ys[at[0]])
                    row[at] = (yield False, (x, ys[at[0]])) if w is None else w
                if (len(rows) + 1) * len(ys) <= CELLS:
                    rows[kind] = row
            yield True, row

    def weigh(self, i: int, j: int) -> Generator:
        """The weight of a pair, by a generator that yields the pairs below whose weight it needs."""
        xs, ys, head, tail = self.trimmed(i, j)
        own = self.a.children[i]
        total = 1 + sum(self.a.size[x] for x in own[:head] + own[len(own) - tail :])
        if xs and ys:
            best, told, asked = np.zeros(len(ys) + 1, np.int32), None, self.weights(xs, ys)
            while True:
                try:
                    whole, x = asked.send(told)
                except StopIteration:
                    break
                told = None if whole else (yield x)
                if whole:
                    best = following(best, x)
            total += int(best[-1])
        return total

    def weight(self, i: int, j: int) -> int:
        """By a list of what is under way instead of recursion: pages may be nested deeply."""
        if (w := self.known(i, j)) is not None:
            return w
        stack, told = [((i, j), self.weigh(i, j))], None
        while stack:
            try:
                pair = stack[-1][1].send(told)
                told = self.known(*pair)
                if told is None:
                    stack.append((pair, self.weigh(*pair)))
            except StopIteration as end:
                (x, y), told = stack.pop()[0], end.value
                if len(self.held) >= HELD:
                    self.held.clear()
                self.held[self.a.kind[x], self.b.kind[y]] = told
        return told

    def below(self, i: int, j: int) -> list[tuple[int, int]]:
        """Children of two nodes that are matched: a table of best weights, of which every so many rows are kept and the others made again."""
        xs, ys, head, tail = self.trimmed(i, j)
        own, other = self.a.children[i], self.b.children[j]
        out = [*zip(own[:head], other[:head]), *zip(own[len(own) - tail :], other[len(other) - tail :])]
        if not xs or not ys:
            return out
        step = 1 if len(xs) * len(ys) <= EXACT_CELLS else isqrt(len(xs)) + 1

        def rows(first: int, last: int, best: np.ndarray) -> Iterator[np.ndarray]:
            """Rows after those of xs[first:last]."""
            told, asked = None, self.weights(xs[first:last], ys)
            while True:
                try:
                    whole, x = asked.send(told)
                except StopIteration:
                    return
                told = None if whole else self.weight(*x)
                if whole:
                    yield (best := following(best, x))

        kept = [np.zeros(len(ys) + 1, np.int32)]
        for n, row in enumerate(rows(0, len(xs), kept[0]), 1):
            if n % step == 0:
                kept.append(row)
        k, m = len(xs), len(ys)
        while k and m:
            first = (k - 1) // step * step
            table = kept[first : first + 2] if step == 1 else [kept[first // step], *rows(first, k, kept[first // step])]
            while k > first and m:
                here, above = table[k - first], table[k - first - 1]
                if here[m] == above[m]:
                    k -= 1
                elif here[m] == here[m - 1]:
                    m -= 1
                else:
                    k, m = k - 1, m - 1
                    out.append((xs[k], ys[m]))
        return out


def following(best: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the table of best weights."""
    out = np.zeros_like(best)
    np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights), out=out[1:])
    return out


def align(form_a: Form, form_b: Form) -> list[int]:
    """Simple tree matching: for each node of form_a the node of form_b that it is matched with in a largest matching, or -1."""
    kinds: dict[tuple, int] = {}
    a, b = Tree(form_a, kinds), Tree(form_b, kinds)
    out = [-1] * len(a.labels)
    if a.labels[0] != b.labels[0]:
        return out
    matching, todo = Matching(a, b), [(0, 0)]
    matching.weight(0, 0)
    while todo:
        i, j = todo.pop()
        if a.kind[i] == b.kind[j]:
            out[i : i + a.size[i]] = range(j, j + b.size[j])
            continue
        out[i] = j
        todo += matching.below(i, j)
    return out


def mains(page: Page, hidden: list[bool]) -> list[int]:
    """The innermost article and main elements with text."""
    if not any(page.main):
        return []
    own = [0] * len(page.labels)
    for n, _ in page.texts:
        own[n] += not hidden[n]
    full = page.sums(own)
    is_main = [int(m and not h and f > 0) for m, h, f in zip(page.main, hidden, full)]
    inside = page.sums(is_main)
    return [i for i, m in enumerate(is_main) if m and inside[i] == 1]


def page_text(page: Page) -> int:
    """Hash of the article's text, or of all text where none is marked, template included: the same for copies of one article."""
    hidden, ends = page.hidden(), page.ends()
    tops = [range(m, ends[m]) for m in mains(page, hidden) or [0]]
    return hash_text("\n".join(t for n, t in page.texts if not hidden[n] and any(n in r for r in tops)))


def main_text(page: Page, constant: dict[int, set[int]] | None = None, node: list[int] | None = None) -> str:
    """Text of the article without what is template; constant: hashes of texts by node of the form, node: that of each block."""
    hidden, ends = page.hidden(), page.ends()
    tops = mains(page, hidden)
    shown = [(n, t) for n, t in page.texts if not hidden[n]]
    kept = [(n, t) for n, t in shown if hash_text(t) not in constant.get(node[n], ())] if constant and node else shown
    for left in (kept, shown):
        if tops:
            found = [t for n, t in left if any(m <= n < ends[m] for m in tops)]
        else:
            own = [0] * len(page.labels)
            for n, t in left:
                own[n] += len(t)
            size = page.sums(own)
            best = {}  # the child with the most text, the first of equal ones
            for i in range(len(size) - 1, 0, -1):
                p = page.parents[i]
                if p not in best or size[i] >= size[best[p]]:
                    best[p] = i
            at = 0
            while at in best and best[at] in best and size[best[at]] >= 0.8 * size[0]:  # down to the smallest part with nearly all of the text
                at = best[at]
            found = [t for n, t in left if at <= n < ends[at]]
        if found:
            return " ".join(found)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text: the main text of each page, empty if none."""
    id_sql = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(html.as_py())
                node, tree = form(page)
                tree, whole = packed(tree), page_text(page)
                key = form_key(tree)
                out += [(h, key, i, s, whole, None) for i, s in {(node[n], hash_text(t)) for n, t in page.texts}]
                out.append((h, key, -1, 0, whole, tree))
            types = [("host", pa.string()), ("form", pa.binary()), ("node", pa.int32()), ("said", pa.int64()), ("whole", pa.int64()), ("tree", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])

    seen = plain.select("host", "html").mapInArrow(forms_of, "host string, form binary, node int, said long, whole long, tree binary").distinct()
    counts = written(seen.groupBy("host", "form", "node", "said", "tree").agg(F.count("*").alias("n")), "forms")
    forms = counts.where("node < 0").select("host", "form", "tree", "n")
    pivots = forms.groupBy("host").agg(F.max(F.struct("n", "form", "tree"))["tree"].alias("pivot"), F.sum("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [align(unpacked(f), unpacked(p)) for f, p in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(slots, pa.list_(pa.int32()))], ["host", "form", "pivot", "pages", "slots"])

    wrapper = forms.join(pivots, "host").select("host", "form", "pivot", "pages", "tree").mapInArrow(aligned, "host string, form binary, pivot binary, pages long, slots array<int>")
    placed = counts.where("node >= 0")
    often = placed.groupBy("host", "said").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "said")
    placed = placed.join(often, ["host", "said"], "left_semi").join(wrapper.drop("pivot"), ["host", "form"]).withColumn("slot", F.col("slots")[F.col("node")]).where("slot >= 0")
    constant = placed.groupBy("host", "slot", "pages", "said").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("pages")))
    constant = constant.groupBy("host").agg(F.collect_set(F.struct("slot", "said")).alias("constant"))  # of the pivot's nodes, two texts each at most
    by_host = written(constant.join(pivots, "host").select("host", "pivot", "constant"), "template")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bytes], list[int]] = {}
        said: dict[str, dict[int, set[int]]] = {}  # of a host, the constant texts of a slot
        for batch in batches:
            out = []
            for html, pivot, host, constant in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5)):
                page, fixed, node = parse(html.as_py()), {}, []
                if pivot.is_valid:
                    node, tree = form(page)
                    key = host, form_key(packed(tree))
                    if key not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[key] = align(tree, unpacked(pivot.as_py()))
                    if host not in said:
                        if len(said) > 10_000:
                            said.clear()
                        said[host] = {}
                        for c in constant.as_py():
                            said[host].setdefault(c["slot"], set()).add(c["said"])
                    fixed = {i: said[host][s] for i, s in enumerate(known[key]) if s in said[host]}
                out.append(main_text(page, fixed, node))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    every = plain.join(by_host, "host", "left").select("id", "url", "html", "pivot", "host", "constant")
    return every.mapInArrow(texts_of, f"id {id_sql}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def form_key(tree: bytes) -> bytes:
    return hashlib.blake2b(tree, digest_size=16).digest()
