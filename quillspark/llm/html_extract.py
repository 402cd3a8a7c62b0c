"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of tokens: runs of words, which score their number of
words, and tags, which score negative weights. One linear scan finds the
contiguous region with the greatest sum, which is the article. Words of a container
that don't outweigh its own tags (an advert between two paragraphs) score
negative instead, and give no text if the region goes across them.

A tag's weight hangs on its classes, or on its name if it has none. Weights are
learned from labelled pages (those that mark their content with exactly one
<article> or <main>): they start as log-odds of a tag standing outside the
marked content, and a structured perceptron mends them: while the best region of a
page differs from the marked one, tags that only the best region holds get
dearer and those that only the marked one holds cheaper. Tags of running
text never weigh more than ``TEXT_TAG``, since lists and links stand in articles
too, whatever the labelled pages hold.

Only elements that can't hold readable text (``SILENT``) give none wherever they stand.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session

#: Labelled pages that the fit reads at most, their longest, and passes over them.
SAMPLE, SAMPLE_CHARS, PASSES = 300, 200_000, 8
# What HTML's elements are.
SILENT = frozenset("head title script style noscript template iframe svg canvas object button select option textarea".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements around content, not of it, by their meaning in HTML.
AROUND = frozenset("aside dialog footer form header menu nav".split())
CONTAINERS = AROUND | frozenset("center details div fieldset figure section table".split())
#: They hold the whole page or the whole content, and so say nothing.
NEUTRAL = frozenset("article body html main".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S
)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Weights before any page is seen, and the least one of tags of running text.
INLINE_TAG, BLOCK_TAG, AROUND_TAG, TEXT_TAG = -0.02, -0.2, -20.0, -1.5
#: The weight from which a container's class (or meaning) alone makes it a low one.
DECIDED = -10.0
#: What a word of a low container scores.
LOW_WORD = -0.25
NOTHING = -0.001


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, silent) in page order: kind "w" with text, or a tag's feature
    such as "<p" or "</div.ad" with its name; silent: gives no text."""
    out, stack, at, silent = [], [], 0, 0
    open_, blocks = Counter(), []  # names of open elements; places of blocks in the stack

    def close(i: int) -> None:
        nonlocal silent
        for tag, _, bad in stack[i:]:
            open_[tag] -= 1
            silent -= bad
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":  # else a comment, or a tag whose quotes don't end
                out.append(("w", m[0], silent > 0))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                feature, bad = stack[i][1:]
                close(i)
                out.append(("</" + feature, tag, silent > 0 or bad))
            continue
        if tag == "p" and blocks and stack[blocks[-1]][0] == "p":  # a new paragraph ends an open one
            close(blocks[-1])
        named = _CLASS.search(m[3]) if "=" in m[3] else None
        classes = (named[1] or named[2] or named[3] or "").lower().replace(".", " ").split() if named else []
        feature, bad = ".".join([tag, *classes]), tag in SILENT
        out.append(("<" + feature, tag, silent > 0 or bad))
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append((tag, feature, bad))
        open_[tag] += 1
        silent += bad
    return out


def parts(kind: str) -> list[str]:
    """What a tag's weight hangs on: its classes, whatever the tag, or else its name."""
    head, *classes = kind.split(".")
    mark = "</" if kind[1] == "/" else "<"
    return [f"{mark}.{c}" for c in classes] or [head]


def weight(kind: str, tag: str, weights: dict[str, float]) -> float:
    if tag in NEUTRAL:
        return NOTHING
    known = [weights[x] for x in parts(kind) if x in weights]
    if not known and kind.split(".")[0] in weights:  # classes not met in the fit
        known = [weights[kind.split(".")[0]]]
    got = min(known) if known else AROUND_TAG if tag in AROUND else BLOCK_TAG if tag in BLOCKS else INLINE_TAG
    return min(got if tag in CONTAINERS else max(got, TEXT_TAG), NOTHING)


def containers(page_tokens: list) -> list[tuple[int, int | None, list[int]]]:
    """(opening tag, closing tag or None, own words) of each element that holds others;
    own are words in no container inside it."""
    out, open_ = [], []

    for i, (kind, value, silent) in enumerate(page_tokens):
        if kind == "w":
            if open_ and not silent and value.strip():
                open_[-1][1].append(i)
        elif silent or value not in CONTAINERS and value not in NEUTRAL:
            continue
        elif kind[1] != "/":
            open_.append((i, []))
        else:
            while page_tokens[open_[-1][0]][0][1:] != kind[2:]:  # never closed itself
                out.append((open_[-1][0], None, open_.pop()[1]))
            out.append((open_[-1][0], i, open_.pop()[1]))
    return out + [(a, None, own) for a, own in open_]


def token_scores(page_tokens: list, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and which words stand in a low container.

    Words score positive, tags negative. A container is *low* if its own words don't
    outweigh its own tags, or if its class or meaning says so (``DECIDED``): then
    its words score negative (``LOW_WORD`` each), so that a region only goes across
    it for something.
    """
    scores, low = np.zeros(len(page_tokens)), np.zeros(len(page_tokens), bool)
    for i, (kind, value, silent) in enumerate(page_tokens):
        if kind != "w":
            scores[i] = NOTHING if silent else weight(kind, value, weights)
        elif not silent:  # silent ones give no text, so a region may as well go across them
            scores[i] = len(value.split())
    for a, b, own in containers(page_tokens):
        kind, tag, _ = page_tokens[a]
        tags = [a] if b is None else [a, b]
        decided = ("." in kind or tag in AROUND) and scores[a] <= DECIDED
        if own and (decided or scores[own].sum() + scores[tags].sum() < 0):
            low[own] = True
            scores[own] *= LOW_WORD
            scores[tags] = NOTHING
    return scores, low


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) with the greatest sum; the first and shortest of equals; (0, 0) if none is positive."""
    if not len(scores):
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total[:-1])
    gain = total[1:] - low
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end + 1


def region_text(page_tokens: list, low: np.ndarray, start: int, end: int) -> str:
    """Blocks of the region in page order, joined by blank lines, without low containers."""
    blocks, words = [], []
    for i in range(start, end):
        kind, value, silent = page_tokens[i]
        if kind == "w":
            if not silent and not low[i]:
                words.append(value)
        elif value in BLOCKS:
            blocks.append("".join(words))
            words = []
        elif value == "br":
            words.append(" ")
    blocks.append("".join(words))
    clean = (" ".join(_html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def _marked_region(page_tokens: list) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """First to last word of the only <article> or <main>, and all that is in it."""
    for tag in ("article", "main"):
        opens = [i for i, t in enumerate(page_tokens) if t[1] == tag and t[0].startswith("<" + tag)]
        closes = [i for i, t in enumerate(page_tokens) if t[1] == tag and t[0].startswith("</" + tag)]
        if len(opens) == len(closes) == 1:
            inner = [i for i in range(opens[0], closes[0]) if page_tokens[i][0] == "w" and page_tokens[i][1].strip() and not page_tokens[i][2]]
            return ((inner[0], inner[-1] + 1), (opens[0] + 1, closes[0])) if inner else None
    return None


def fit(pages: list[str]) -> dict[str, float]:
    """Tag weights under which the best region of each labelled page is the marked one."""
    weights: dict[str, float] = {}
    labelled, inside, outside, tag_of = [], Counter(), Counter(), {}  # of parts
    for page in pages:
        t = tokens(page)
        gold = _marked_region(t)
        if gold:
            labelled.append((t, gold[0]))
            frames = containers(t)
            mute = {x for a, b, own in frames if not own for x in (a, b)}  # a frame around others says nothing
            # and what is inside a menu or the like is explained by that
            around = [(a, b or a) for a, b, _ in frames if t[a][1] in AROUND or "." in t[a][0]]
            mute |= {i for a, b in around for i in range(a + 1, b) if t[i][1] not in CONTAINERS}
            for i, (kind, tag, silent) in enumerate(t):
                if kind != "w" and not silent and i not in mute:
                    for x in parts(kind):
                        (inside if gold[1][0] <= i < gold[1][1] else outside)[x] += 1
                        tag_of[x] = tag
    for feature in inside | outside:  # log-odds of standing outside, and at least a little
        odds = 4 * np.log((outside[feature] + 0.5) / (inside[feature] + 0.5))
        weights[feature] = min(weight(feature, tag_of[feature], {}), -float(odds)) if odds > 0 else INLINE_TAG
    for _ in range(PASSES):
        wrong = 0
        for t, gold in labelled:
            found = best_region(token_scores(t, weights)[0])
            if found == gold:
                continue
            wrong += 1
            step = 0.1 * max(1, abs(found[0] - gold[0]) + abs(found[1] - gold[1])) ** 0.5
            for (a, b), (other_a, other_b), change in ((found, gold, -step), (gold, found, step)):
                for i in range(a, b):
                    if not other_a <= i < other_b and t[i][0] != "w" and not t[i][2]:
                        for x in parts(t[i][0]):
                            weights[x] = min(NOTHING, weights.get(x, weight(*t[i][:2], weights)) + change)
        if not wrong:
            break
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    page_tokens = tokens(page or "")
    scores, low = token_scores(page_tokens, weights)
    return region_text(page_tokens, low, *best_region(scores))


def fit_on(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> dict[str, float]:
    """Fits on at most ``SAMPLE`` pages, of at most ``SAMPLE_CHARS`` characters, by a
    hash of their id.

    Pages without a mark, null pages and null ids aren't learned from; of rows that
    share an id the smallest page counts; other columns don't matter. Without any
    labelled page the weights before any page are used.
    """
    some = pages.select(F.col(page_id).alias("k"), F.col(html).alias("h"))
    some = some.where((F.length("h") <= SAMPLE_CHARS) & F.col("h").rlike("(?i)<(article|main)[ >]"))
    picked = some.select("k").where(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    # at most SAMPLE ids are broadcast, and as many pages come back
    rows = some.join(F.broadcast(picked), "k").groupBy("k").agg(F.min("h").alias("h")).collect()
    return fit([r["h"] for r in sorted(rows, key=lambda r: (r["k"], r["h"]))])


def extract_main_text(pages: DataFrame, weights: dict[str, float], html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in column ``name``.

    A null or empty page, or one without words, gives an empty text. Null and
    repeated ids don't matter; other columns pass through, one called ``name`` is
    replaced, and an empty table gives an empty result.
    """
    session(pages)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([extract(page.as_py(), weights) for page in column], pa.string())

    return pages.withColumn(name, run(F.col(html)))
