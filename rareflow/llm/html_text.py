"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores one, less what speaks against it, down to nothing: of the
elements around it the one with the most evidence against content. A tag costs something. One linear scan finds the
contiguous run with the largest sum, which is the content region; words in it that score nothing (adverts, forms,
reader comments inside the region) are left out, as they are no content by the same weights.

The weights are learned from labelled pages, those that mark their content themselves (article or main): log odds
of the words under a tag name, or under a word of a class, id or role, to stand inside the mark, and of each tag.
They come from a sample of about ``TRAIN_PAGES`` pages chosen by a hash of their id. Names whose meaning is widely
fixed start from a prior worth ``PRIOR_WORDS`` words of evidence, which data overrules. An element is judged by its
tag and by the mean of its class, id and role words, so one word among several rarely decides.

The region becomes blocks. White space in a block, after character references are decoded, becomes one space;
blocks are joined by a line feed. Inline tags separate nothing, ``br`` is a space.

Cases: a null or empty page, or one without a word of content, gives the empty text. Unclosed tags, comments
and scripts end with the page. Rows with null or repeated ids are pages like any other; an empty table gives an
empty result; other columns are ignored. Pages are parsed and scanned once, in time linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 2000
#: A name must be seen on so many sample pages to get a weight.
SEEN = 5
SMOOTH = 5.0
#: What the list of names that mark no article says of each, and how many words of evidence that is worth.
AGAINST_PRIOR = -2.0
PRIOR_WORDS = 200
#: A name for elements that are not shown, and what it says.
HIDDEN = " hidden"
HIDDEN_WEIGHT = -8.0
#: Passing into or out of an article costs at least so much.
MARK_COST = 4.0

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = "script style noscript template textarea title iframe svg math select option button object audio video canvas head".split()
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul"
    " script style noscript template textarea title iframe svg math object".split()
)
#: These end an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "head"}
#: Says nothing about content; costs little.
PLAIN = set("html body div span section font center table tbody thead tfoot tr td th b i em strong u small sub sup code br wbr img hr".split())
# Names that mark what is not the article, as a prior.
AGAINST = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer aside sidebar form ad ads adv advert adverts"
    " advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " notification alert comment comments disqus respond replies reply discussion related recommended recommendations share"
    " sharing social newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar widget"
    " copyright masthead skip search dialog menuitem contentinfo complementary".split()
)
#: Marks a page's head outside the article and an article's head inside it.
HEADS = {"header", "head", "top"}
FOR = set("article main p h1 h2 h3 h4 h5 h6 blockquote pre articlebody".split())
MARKS = {"article", "main"}
#: Mostly menus, but articles have links and lists too: they speak against words only with something else.
LISTS = {"a", "ul", "ol", "li"}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)"
    r"|<[!?/][^>]*+>?",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Element:
    """An open element: what its names and those around it say, worked out once."""

    __slots__ = ("tag", "names", "parent", "against", "marked", "soft", "lists")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None, weights: Weights | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.marked = tag in MARKS or (parent is not None and parent.marked)
        self.soft = tag in FOR or (parent is not None and parent.soft)
        #: The nearest list or list item, itself included.
        self.lists = tag if tag in ("li", "ul", "ol", "menu") else parent.lists if parent else ""
        own = weights.element(names, parent is not None and parent.marked) if weights else 0.0
        self.against = min(own, parent.against if parent else 0.0)


@dataclass
class Node:
    """A run of text, or a tag without ``words``; ``inside`` is the innermost element around it."""

    tag: str = ""
    text: str = ""
    words: int = 0
    inside: Element | None = None

    @property
    def marked(self) -> bool:
        return self.inside is not None and self.inside.marked


@dataclass
class Weights:
    """Log odds of names (positive for content) with the words seen, and what tags cost."""

    names: dict[str, tuple[float, int]] = field(default_factory=dict)
    costs: dict[str, float] = field(default_factory=dict)

    def name(self, name: str, marked: bool) -> float:
        if name in PLAIN:
            return 0.0
        prior = 1.0 if name in FOR else 0.0
        if name in AGAINST or (name in HEADS and not marked):
            prior = AGAINST_PRIOR
        odds, seen = self.names.get(name, (0.0, 0))
        value = (odds * seen + prior * PRIOR_WORDS) / (seen + PRIOR_WORDS)
        if name in HEADS and marked:
            return max(value, 0.0)
        return max(value, -0.5) if name in LISTS else value

    def element(self, names: tuple[str, ...], marked: bool) -> float:
        """What an element's tag says, or the mean of its other names if that is less."""
        tag, *others = names
        if tag == "head" or HIDDEN in others:
            return HIDDEN_WEIGHT
        said = [self.name(n, marked) for n in others]
        return min(self.name(tag, marked), sum(said) / len(said) if said else 0.0)

    def cost(self, node: Node) -> float:
        """Inside a paragraph or a mark any tag is cheap; there it does not divide content."""
        learned = self.costs.get(node.tag, 0.25)
        if node.tag in MARKS:
            return max(learned, MARK_COST)
        cheap = node.tag in PLAIN or node.tag in FOR or (node.inside is not None and (node.inside.soft or node.inside.marked))
        return min(learned, 0.05) if cheap else learned


def _names(tag: str, rest: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role."""
    found = [tag]
    if "=" in rest or "hidden" in rest:
        for key, value in ATTRIBUTE.findall(rest):
            if key.lower() == "hidden":
                found.append(HIDDEN)
            else:
                found += [w.lower() for w in PARTS.findall(value)]
    return tuple(dict.fromkeys(found))


def parse(page: str, weights: Weights | None = None) -> list[Node]:
    """Tags and runs of text of a page in order."""
    out: list[Node] = []
    stack: list[Element] = []
    is_open: Counter[str] = Counter()
    at = 0

    def top() -> Element | None:
        return stack[-1] if stack else None

    def text(upto: int) -> None:
        if upto > at:
            decoded = html.unescape(page[at:upto])
            out.append(Node(text=decoded, words=len(decoded.split()), inside=top()))

    def close(tag: str) -> None:
        """Down to the last open element of this name; each element is closed once."""
        while stack:
            gone = stack.pop()
            is_open[gone.tag] -= 1
            if gone.tag == tag:
                break

    while at < len(page):
        hit = TOKEN.search(page, at)
        if hit is None:
            break
        text(hit.start())
        at = hit.end()
        name = hit["name"]
        if name is None:
            continue
        name = name.lower()
        if hit["end"]:
            if is_open[name]:
                close(name)
            out.append(Node(tag=name, inside=top()))
            continue
        if name in RAW_END and name != "head":
            if not hit["rest"].endswith("/>"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            out.append(Node(tag=name, inside=top()))
            continue
        if name in ENDS_P and is_open["p"]:
            close("p")
        if name == "li" and stack and stack[-1].lists == "li":
            close("li")
        out.append(Node(tag=name, inside=top()))
        if name not in VOID and not hit["rest"].endswith("/>"):
            stack.append(Element(name, _names(name, hit["rest"]), top(), weights))
            is_open[name] += 1
    text(len(page))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end (exclusive) of the contiguous run with the largest positive sum; the first, and its longest."""
    best, best_sum = (0, 0), 0.0
    start, run = 0, 0.0
    for i, value in enumerate(scores):
        run += value
        if run <= 0:
            start, run = i + 1, 0.0
        elif run > best_sum or (run == best_sum and start == best[0]):
            best, best_sum = (start, i + 1), run
    return best


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best run, joined by line feeds."""
    nodes = parse(page or "", weights)
    # A run of text scores as many times what one of its words does.
    each = [0.0 if n.tag else max(0.0, 1.0 + (n.inside.against if n.inside else 0.0)) for n in nodes]
    begin, end = best_run([-weights.cost(n) if n.tag else e * n.words for n, e in zip(nodes, each, strict=True)])
    blocks: list[str] = []
    parts: list[str] = []
    for i in range(begin, end):
        node = nodes[i]
        if not node.tag:
            parts.append(node.text if each[i] > 0 else " ")
        elif node.tag == "br" or node.tag in ("td", "th"):
            parts.append(" ")
        elif node.tag in BLOCKS:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def _evidence(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """(kind, name, inside, amount) of one page that marks its content."""
    nodes = parse(page)
    if not any(n.words and n.marked for n in nodes):
        return
    names: Counter[tuple[str, bool]] = Counter()
    tags: Counter[tuple[str, bool]] = Counter()
    words = [0, 0]
    held: dict[str, tuple[int, int, int]] = {}  # an open name: how often it is open, the words before it

    def enter(element: Element) -> None:
        for name in element.names:
            n, *before = held.get(name, (0, *words))
            held[name] = (n + 1, *before)

    def leave(element: Element) -> None:
        for name in element.names:
            n, *before = held[name]
            held[name] = (n - 1, *before)
            if n == 1:
                del held[name]
                for inside in (False, True):
                    if words[inside] > before[inside]:
                        names[name, inside] += words[inside] - before[inside]

    path: list[Element] = []
    open_now: set[int] = set()

    def move_to(element: Element | None) -> None:
        """Leave and enter elements until ``element`` is the innermost; each is entered and left once."""
        fresh = []
        while element is not None and id(element) not in open_now:
            fresh.append(element)
            element = element.parent
        while path and path[-1] is not element:
            gone = path.pop()
            open_now.discard(id(gone))
            leave(gone)
        for new in reversed(fresh):
            path.append(new)
            open_now.add(id(new))
            enter(new)

    for node in nodes:
        if node.tag:
            tags[node.tag, node.marked] += 1
        elif node.words:
            move_to(node.inside)
            words[node.marked] += node.words
    move_to(None)
    for inside in (False, True):
        if words[inside]:
            names["", inside] = words[inside]
    for (name, inside), n in names.items():
        yield "name", name, inside, n
    for (name, inside), n in tags.items():
        yield "tag", name, inside, n


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = TRAIN_PAGES) -> Weights:
    """Weights from the labelled pages of a bounded sample; only their counts reach the driver."""
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))
    every = max(1, slim.count() // sample)
    chosen = slim.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                rows = list(_evidence(page.as_py() or ""))
                if rows:
                    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "name", "inside", "n"])

    counts = (
        chosen.mapInArrow(run, "kind string, name string, inside boolean, n long")
        .groupBy("kind", "name", "inside")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seen"))
        .filter(F.col("seen") >= SEEN)
        .collect()
    )
    told = {(r.kind, r.name, r.inside): r.n for r in counts}
    total = {k: {i: sum(n for (kind, name, inside), n in told.items() if kind == k and inside == i and (k == "tag" or name == "")) for i in (True, False)} for k in ("name", "tag")}

    def odds(kind: str, name: str) -> float:
        rate = [(told.get((kind, name, i), 0) + SMOOTH) / (total[kind][i] + 2 * SMOOTH) for i in (True, False)]
        return math.log(rate[0] / rate[1])

    weights = Weights()
    for kind, name, _ in told:
        if kind == "name" and name:
            weights.names[name] = odds(kind, name), sum(told.get((kind, name, i), 0) for i in (True, False))
        elif kind == "tag":
            weights.costs[name] = min(4.0, max(0.02, -odds(kind, name)))
    return weights


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
