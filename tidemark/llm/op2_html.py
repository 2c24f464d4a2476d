"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and words. A linear scan finds the contiguous run of tokens with the
largest total score: tags score negative, and words by where they stand, positive where text of articles
stands. Scores are log ratios learned from labelled pages, which are the pages that mark their article
themselves (one outermost ``article`` or ``main`` element): how often words of blocks of a kind and length,
words of links, words under elements of a name or class, and tags occur inside it and outside. These two
elements aren't features themselves, so a page is read alike with and without them. TRAIN_PAGES are read for
that at most, long ones in a window; with fewer than MIN_PAGES the fixed scores below are used.

Names and classes that tell of menus, adverts, forms, comments and the like are features with a fixed score
that evidence moves; none is a veto. An element whose features count against it costs FLOOR at most in all,
so that an advert doesn't cut an article in two, and nothing if it holds most of the page or its only
heading. Within the run a block in such an element goes if its own score isn't positive, by the same scores;
everything else of the run stays. Where the learned scores find nothing on a page the fixed ones are used, and
where these find nothing every word is good.

Text: character references are decoded; white space within a block is one space; blocks are trimmed,
empty ones dropped, and joined by line feeds. A line break element is white space. Scripts, styles and other
raw elements hold no text. Defined results: null and empty pages have an empty text; pages without tags are
one block; unclosed elements end with their parent; repeated rows are extracted alike; a null page_id is a
page like any other; other columns are left alone; empty tables give empty results.
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

from .textscan import bounded_batches, chunks

#: Labelled pages that are read at most, fewest that scores are learned from, and characters of a window of a long one.
TRAIN_PAGES, MIN_PAGES, TRAIN_CHARS = 400, 20, 40_000
#: What an element whose features count against it costs a run at most; the share of a page's words that makes it the page.
FLOOR, MOST = 0.5, 0.8
#: Limits of scores: of words by their blocks, of words of links, of elements' features below and above, of tags.
WORD, LINK, AGAINST, FOR, TAG = 2.5, -1.0, -6.0, 2.0, (-0.5, -0.1)
#: Words (or tags) that weigh as much as a fixed score, and upper limits of the lengths of blocks.
EVIDENCE, LENGTHS = 20, (3, 9, 24)

# comments, declarations, raw elements with their text, tags; unclosed ones run to the end
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(script|style|noscript|template|iframe|textarea|select|object|svg|math|title|canvas|audio|video)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>?""", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:until-found))|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

# fixed values: elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
OTHER = frozenset("aside button dialog footer form head header menu nav search input label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th figcaption caption address details summary".split())
ARTICLE = frozenset(("article", "main"))
#: elements that an opening tag of the same group ends
CLOSES = {"p": BLOCKS - {"body", "html"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
# fixed values: words in a class, id or role that speak against the article
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs bottombar byline comment comments commentlist contentinfo cookie cookies consent complementary copyright dialog discuss disqus disclaimer feedback foot footer form gdpr head header login masthead menu menus meta "
    "modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert".split()
)
#: fixed scores: of such a name, of these that an article may have itself, of hidden elements, of the article's
AGAINST_NAME, AGAINST_HEADER, AGAINST_HIDDEN, FOR_ARTICLE = -5.0, -3.0, -6.0, 0.5


def _parts(names: str) -> set[str]:
    """The words of class names, also of those in camel case."""
    return {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", names)}


def _length(words: int) -> int:
    return sum(words > n for n in LENGTHS)


def fixed_feature(feature: str) -> float:
    """The score of a feature without evidence."""
    if feature == "hidden":
        return AGAINST_HIDDEN
    if feature in ("<header", ".header", ".head"):
        return AGAINST_HEADER
    if feature in ("<article", "<main"):
        return FOR_ARTICLE
    return AGAINST_NAME if (feature[0] == "<" and feature[1:] in OTHER) or (feature[0] == "." and feature[1:] in NAMES) else 0.0


def fixed_word(kind: str, length: int) -> float:
    """The score of a word without evidence: a short block that is no paragraph, heading or item is rather none of the article."""
    return 1.0 if kind in HEADINGS or length > 1 else -0.3


@dataclass
class Scores:
    """Scores of words by the kind and length of their block, of words of links, of elements' features, and of tags."""

    words: dict[tuple[str, int], float] = field(default_factory=dict)
    kinds: dict[str, float] = field(default_factory=dict)
    lengths: dict[int, float] = field(default_factory=dict)
    features: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    link: float = -0.3
    flat: bool = False

    def word(self, kind: str, length: int) -> float:
        if self.flat:
            return 1.0
        if (known := self.words.get((kind, length))) is not None:
            return known
        if not self.words:
            return fixed_word(kind, length)
        return max(-WORD, min(WORD, 0.5 * self.kinds.get(kind, 0.0) + self.lengths.get(length, 0.0)))

    def element(self, features: tuple[str, ...]) -> float:
        return max(AGAINST, sum(self.features[f] if f in self.features else fixed_feature(f) for f in features))


DEFAULT, FLAT = Scores(), Scores(flat=True)


@dataclass
class Element:
    name: str
    parent: int
    features: tuple[str, ...]
    #: words of it and below it outside links, and the headings and articles there
    words: int = 0
    marks: Counter = field(default_factory=Counter)


class Page:
    """The tokens of a page in order, (tag, element, block, text, in a link), with tag or text; its elements; its article's range."""

    __slots__ = ("articles", "elements", "kinds", "sizes", "tokens")

    def __init__(self, source: str):
        self.tokens: list[tuple[str, int, int, str, bool]] = []
        self.elements = [Element("", -1, ())]
        self.articles: list[list[int]] = []
        self.kinds: dict[int, str] = {}
        self.sizes: Counter = Counter()
        stack: list[tuple[str, int, int]] = [("", 0, -1)]  # name, element, article
        links = block = at = 0
        add = self.tokens.append

        def text(s: str) -> None:
            if not s:
                return
            e = stack[-1][1]
            add(("", e, block, s, links > 0))
            if links == 0 and (n := len(s.split())):
                self.sizes[block] += n
                self.elements[e].words += n
            if block not in self.kinds and not s.isspace():
                self.kinds[block] = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "")

        def close(k: int) -> None:
            nonlocal links, block
            while len(stack) > k:
                name, e, article = stack.pop()
                links -= name == "a"
                if article >= 0:
                    self.articles[article][1] = len(self.tokens)
                block += name in BLOCKS

        for m in _TOKEN.finditer(source):
            text(source[at : m.start()])
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            if m[2] or m[5]:
                add((f"/{name}", stack[-1][1], block, "", False))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                else:
                    block += name in BLOCKS
                continue
            if name == "br" or name == "wbr":
                add((name, stack[-1][1], block, " " if name == "br" else "", links > 0))
                continue
            if name in CLOSES.get(stack[-1][0], ()):
                close(len(stack) - 1)
            elif name in BLOCKS:
                # an inline element that was never closed doesn't hold the block's paragraph open
                k = len(stack)
                while k > 1 and stack[k - 1][0] not in BLOCKS:
                    k -= 1
                if k > 1 and stack[k - 1][0] == "p":
                    close(k - 1)
            block += name in BLOCKS
            attributes = (m[4] if m[3] else m[7]) or ""
            features = [f"<{name}"] if name in OTHER or name in ARTICLE else []
            if attributes:
                if names := " ".join(x for t in _NAMED.findall(attributes) for x in t):
                    features += sorted(f".{p}" for p in _parts(names))
                if _HIDDEN.search(attributes):
                    features.append("hidden")
            e = len(self.elements)
            self.elements.append(Element(name, stack[-1][1], tuple(features)))
            add((name, e, block, "", False))
            if name in VOID or attributes.endswith("/"):
                continue
            article = -1
            if name in ARTICLE:
                article = len(self.articles)
                self.articles.append([len(self.tokens), -1])
            stack.append((name, e, article))
            links += name == "a"
        text(source[at:])
        close(1)
        for e in reversed(self.elements[1:]):  # children come after their parents
            above = self.elements[e.parent]
            above.words += e.words
            above.marks += e.marks
            if e.name in ("h1", "main", "article"):
                above.marks[e.name] += 1

    def labelled(self) -> list[int] | None:
        """The range of the article that a page marks itself, if there is one."""
        outer = [a for a in self.articles if not any(b is not a and b[0] <= a[0] and a[1] <= b[1] for b in self.articles)]
        return outer[0] if len(outer) == 1 else None

    def weights(self, scores: Scores) -> tuple[list[float], list[int]]:
        """What each element's features and those around it add to its words, and the outermost element that counts against them."""
        total, against = [0.0], [0]
        whole = self.elements[0]
        for k, e in enumerate(self.elements[1:], 1):
            own = 0.0 if scores.flat or not e.features else scores.element(e.features)
            if own < 0 and (e.words > MOST * whole.words or any(whole.marks[m] == n for m, n in e.marks.items())):
                own = 0.0  # what holds the page, or its only heading or article, is no part beside it
            total.append(max(AGAINST, min(FOR, total[e.parent] + own)))
            against.append(against[e.parent] or (k if own < 0 else 0))
        return total, against


def learn(pages: list[str]) -> Scores:
    """Scores from pages that mark their article; the fixed ones if there are too few."""
    counts: dict[str, list[Counter]] = {k: [Counter(), Counter()] for k in ("words", "kinds", "lengths", "features", "tags", "link")}
    used = 0
    for source in pages:
        page = Page(source)
        if (own := page.labelled()) is None:
            continue
        used += 1
        above: list[tuple[str, ...]] = []
        for e in page.elements:
            above.append((above[e.parent] if e.parent >= 0 else ()) + tuple(f for f in e.features if f not in ("<article", "<main")))
        for k, (tag, e, block, text, link) in enumerate(page.tokens):
            side = 0 if own[0] <= k < own[1] else 1
            if tag:
                if tag.lstrip("/") not in ARTICLE:
                    counts["tags"][side][tag] += 1
            elif n := len(text.split()):
                counts["link"][side]["a" if link else ""] += n
                for f in above[e]:
                    counts["features"][side][f] += n
                if not link:
                    kind, length = page.kinds[block], _length(page.sizes[block])
                    kind = "" if kind in ARTICLE else kind
                    for name, key in (("words", (kind, length)), ("kinds", kind), ("lengths", length)):
                        counts[name][side][key] += n
    if used < MIN_PAGES:
        return DEFAULT

    def ratio(name: str, fixed) -> dict:
        (inside, outside), out = counts[name], {}
        words = "words" if name == "features" else name  # a feature's words are counted against all words
        total = [sum(c.values()) + 1 for c in counts[words]]
        for key in {*inside, *outside}:
            odds = math.log((inside[key] + 0.5) / total[0]) - math.log((outside[key] + 0.5) / total[1])
            n = inside[key] + outside[key]
            out[key] = (n * odds + EVIDENCE * fixed(key)) / (n + EVIDENCE)
        return out

    clip = lambda v, lo, hi: max(lo, min(hi, v))
    kinds, lengths = ratio("kinds", lambda k: 0.0), ratio("lengths", lambda k: 0.0)
    words = {k: clip(v, -WORD, WORD) for k, v in ratio("words", lambda k: fixed_word(*k)).items()}
    tags = {k: clip(v - 1, *TAG) for k, v in ratio("tags", lambda k: 0.0).items()}
    features = {k: clip(v, AGAINST, FOR) for k, v in ratio("features", fixed_feature).items()}
    return Scores(words, {k: clip(v, -WORD, WORD) for k, v in kinds.items()}, {k: clip(v, -WORD, WORD) for k, v in lengths.items()}, features, tags, clip(ratio("link", lambda k: 0.0).get("a", -0.3), LINK, 0.5))


def region(page: Page, scores: Scores) -> tuple[int, int, Counter]:
    """The run of tokens with the largest total score, by one scan; and for each block its score where its elements count against it."""
    total, against = page.weights(scores)
    spent: dict[int, float] = {}
    blocks: Counter = Counter()
    best = run = 0.0
    begin, found = 0, (0, 0)
    for k, (tag, e, block, text, link) in enumerate(page.tokens):
        if tag:
            score = max(scores.tags.get(tag, -0.2), TAG[0])
        elif n := len(text.split()):
            kind = page.kinds[block]
            score = n * (total[e] + (scores.link if link else scores.word("" if kind in ARTICLE else kind, _length(page.sizes[block]))))
            blocks[block] += score if against[e] else n
        else:
            continue
        if score < 0 and (a := against[e]):
            score = max(score, -FLOOR - spent.get(a, 0.0))
            spent[a] = spent.get(a, 0.0) + score
        run += score
        if run <= 0:
            run, begin = 0.0, k + 1
        elif run > best:
            best, found = run, (begin, k + 1)
    return *found, blocks


def extract(source: str | None, scores: Scores) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    for own in (scores, DEFAULT, FLAT):
        lo, hi, score = region(page, own)
        blocks: dict[int, list[str]] = {}
        for _, _, block, text, _ in page.tokens[lo:hi]:
            if text and score[block] > 0:
                blocks.setdefault(block, []).append(text)
        found = (" ".join(html.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
        if out := "\n".join(b for b in found if b):
            return out
    return ""


def fit(pages: DataFrame) -> Scores:
    """Scores from a bounded sample of the pages that mark their article, those with the lowest hash; of a long one a window."""
    marks = F.col("html").rlike("(?i)<(article|main)[\\s>]")
    ok = pages.filter(marks).select(F.xxhash64("page_id", "html").alias("_at"), "html")
    ids = [r[0] for r in ok.select("_at").distinct().orderBy("_at").limit(TRAIN_PAGES).collect()]
    if not ids:
        return DEFAULT
    chosen = F.broadcast(pages.sparkSession.createDataFrame([(i,) for i in ids], "_at long"))  # TRAIN_PAGES at most
    # the window begins before the article, so that it shows both sides of its edge
    begin = F.greatest(F.lit(1), F.regexp_instr(F.lower("html"), F.lit("<(article|main)[\\s>]")) - TRAIN_CHARS // 2)
    cut = F.when(F.length("html") > TRAIN_CHARS, F.col("html").substr(begin, F.lit(TRAIN_CHARS))).otherwise(F.col("html"))
    got = ok.join(chosen, "_at", "left_semi").groupBy("_at").agg(F.min(cut).alias("html")).collect()
    return learn([r.html for r in sorted(got, key=lambda r: r._at)])


def main_text(pages: DataFrame, scores: Scores | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    bounded_batches(pages.sparkSession)
    scores = scores or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            text = [extract(x, scores) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
