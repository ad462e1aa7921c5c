r"""Main text of web pages by the maximum-scoring subsequence (operator 9).

A page is a sequence of tokens: words, and tags as start or end. Words score positive and tags negative, with weights learned from labelled
pages: a page that marks its content with exactly one `article` element labels its own tokens as inside or outside. A word's kind is
the container it stands in (innermost of CONTAINERS), a tag's its name. A linear scan finds the contiguous region of the largest sum;
its blocks become text: character references are decoded, white space inside a block becomes one space, blocks are joined by one newline.

Boxes that aren't the article's are neutral: they score 0, so that an advert between two parts of an article does not part it, and none of
their text is kept. A box is known

- by its element (BOILERPLATE) or by class, id or role (MARKS with PLACES; COMMENTS also on articles);
- by what is learned: class tokens of the labelled pages under which at least LEAST words stand, next to none of them in an article;
- by its place: articles inside an article are comments on it; of several articles side by side the one with the most words is the page's, and where
  a page has one, what stands outside it is not the article's. A page without articles is judged in the same way by its `main` element.

On pages without either, blocks that are little but links score like boxes outside, so that lists of links end the region but don't part it.
Weights of tags are bounded by those of a word, so that lists, tables and headings with short texts stay.

Null html is empty; pages without words give the empty text and 0; repeated rows get equal answers; an unclosed element ends with
its page; other columns are not read. An attribute value that holds a `<` is read to its end up to 2,000 characters.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import lean

# every alternative ends at the next "<" or consumes what it has read, so that a page is read in one pass
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,2000}+\"|'[^']{0,2000}+')*+)>|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<[!?][^<>]*>|([^<]+|<)",
    re.S | re.I,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
#: Elements that only style a run of text; all others end a block. `br` is white space.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form head title menu dialog button select figure table ul ol dl p h1 h2 h3 h4 h5 h6 li td th blockquote pre".split())
BOILERPLATE = frozenset("nav footer aside form head title menu dialog button select header".split())
#: Parts of class names of reader comments, and of all boxes that hold no article; fixed values.
COMMENTS = frozenset("comment comments commentlist respond response responses reply replies disqus livefyre discussion reactions".split())
MARKS = COMMENTS | frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs ccpa consent cookie cookies footer gdpr header menu modal nav navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
#: Parts of class names that say where a box lies, not what it holds: a class is a mark if its parts are marks and such words alone.
PLACES = frozenset("area bar block body bottom box btn button buttons container content float footer global group header inner item items left line link links list main notice outer page panel policy post posts primary right section secondary site slot sticky text thread top unit widget wrap wrapper zone".split())
_ENDS_P = frozenset("p h1 h2 h3 h4 h5 h6 div ul ol dl table section article nav header footer aside form blockquote pre figure main".split())
LEAST, MOST_LINKS = 50, 0.7


class Token(NamedTuple):
    text: str | None  # of a run of words; None: a tag
    place: str  # a word's innermost container, a tag's name (with / if it ends)
    bad: bool
    block: int
    link: bool
    article: int  # number of the article, from 1, that is not inside another; 0 outside
    main: int


def tokens(page: str, outside: frozenset[str] = frozenset(), classes: Counter | None = None):
    """Text runs and tags in page order; `outside`: class tokens that are learned marks. classes: gets the words under each class token, (token, inside the article): n."""
    stack: list[tuple[str, bool, str, tuple[str, ...], tuple[int, int]]] = []  # name, bad, innermost container, class tokens, words so far
    opened: Counter = Counter()
    block = bad = articles = mains = article = main = 0
    words = [0, 0]  # outside and inside the article

    def close() -> str:
        nonlocal bad, article, main
        n, b, _, own, before = stack.pop()
        for x in own if classes is not None else ():
            for inside in (0, 1):
                classes[x, bool(inside)] += words[inside] - before[inside]
        opened[n] -= 1
        bad -= b
        article = article if opened["article"] else 0
        main = main if opened["main"] else 0
        return n

    for m in _TOKEN.finditer(page):
        if m[8] is not None:
            if classes is not None:
                words[article > 0] += len(m[8].split())
            yield Token(m[8], stack[-1][2] if stack else "body", bad > 0, block, opened["a"] > 0, article, main)
        elif m[3] or m[6]:
            name, closing, attributes = (m[3] or m[6]).lower(), bool(m[2] or m[5]), m[4] if m[3] else m[7]
            if name not in INLINE:
                block += 1
            if closing:
                if opened[name]:
                    while close() != name:
                        pass
            else:
                if name in _ENDS_P and stack and stack[-1][2] == "p":  # a block start ends an open paragraph
                    while close() != "p":
                        pass
                if name not in VOID and not attributes.endswith("/"):
                    where = stack[-1][2] if stack else "body"
                    own = tuple(x for y in _MARK.findall(attributes) for x in "".join(y).lower().split())
                    whole = name in ("body", "html", "article", "main")
                    # a heading group inside the article belongs to it; an article inside one is a comment on it
                    b = (name in BOILERPLATE and not (name == "header" and article)) or any(marked(x, COMMENTS if whole else MARKS) for x in own) or (name == "article" and article > 0) or (not whole and any(x in outside for x in own))
                    if name == "article" and not article and not b and not bad:
                        articles += 1
                        article = articles
                    if name == "main" and not main:
                        mains += 1
                        main = mains
                    stack.append((name, b, name if name in CONTAINERS else where, own, (words[0], words[1])))
                    opened[name] += 1
                    bad += b
            yield Token(None, ("/" if closing else "") + name, bad > 0, block, False, article, main)
    while stack:
        close()


def marked(token: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a class token names something that isn't the article: `ad`, `site-nav`, `cookie-notice`, not `comment-free`."""
    parts = _PART.findall(token)
    return any(p in marks for p in parts) and all(p in marks or p in PLACES for p in parts)


def _count(batches):
    seen: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            if not page or len(re.findall(r"<article\b", page, re.I)) != 1:
                continue
            classes: Counter = Counter()
            for t in tokens(page, classes=classes):
                n = len(t.text.split()) if t.text else t.text is None
                if n and not t.bad:
                    seen["tag" if t.text is None else "word", t.place, t.article > 0] += n
            for (x, inside), n in classes.items():
                seen["class", x, inside] += n
    rows = [(*k, v) for k, v in seen.items() if v]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "place", "inside", "n"])


class Model(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]
    outside: frozenset[str]


def train(pages: DataFrame, kinds: int = 100_000) -> Model:
    """Weights of words by container and tags by name, and class tokens that are marks, from all pages that label themselves.

    The size of the model is bounded by `kinds`: of more tag names, or more class tokens that are marks, the most frequent are learned. The others are
    judged like those that no labelled page has.
    """
    counts = pages.select("html").mapInArrow(lean(_count), "kind string, place string, inside boolean, n long").groupBy("kind", "place").agg(F.sum(F.expr("if(inside, n, 0)")).alias("a"), F.sum(F.expr("if(inside, 0, n)")).alias("b"))
    useful = counts.filter(f"kind <> 'class' or (b >= {LEAST} and a * 50 < b)")
    model = Model({}, {}, frozenset())
    outside = []
    for r in useful.orderBy(F.desc(F.col("a") + F.col("b")), "kind", "place").limit(kinds).collect():
        odds = log((r.a + 0.5) / (r.b + 0.5))
        if r.kind == "word":
            model.words[r.place] = max(0.2, min(odds, 2.0)) if odds > 0 else max(-2.0, odds)
        elif r.kind == "tag":
            model.tags[r.place] = max(-0.5, min(odds, -0.05))
        else:
            outside.append(r.place)
    return model._replace(outside=frozenset(outside))


def main_text(page: str, model: Model | None = None) -> str:
    model = model or Model({}, {}, frozenset())
    found = list(tokens(page, model.outside))
    chosen = next((x for x in (_largest(found, "article"), _largest(found, "main")) if x), None)
    size, linked = Counter(), Counter()
    for t in found:
        if t.text:
            size[t.block] += (n := len(t.text.split()))
            linked[t.block] += n * t.link
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    keep = [not t.bad and (chosen is None or getattr(t, chosen[0]) == chosen[1]) for t in found]
    for i, (t, good) in enumerate(zip(found, keep, strict=True)):
        if not good:
            continue  # neutral
        if t.text is None:
            score = model.tags.get(t.place, -0.2)
        elif chosen is None and linked[t.block] > MOST_LINKS * size[t.block]:
            score = -float(len(t.text.split()))
        else:
            weight = model.words.get(t.place, 1.0)
            score = len(t.text.split()) * (max(weight, 0.2) if chosen else weight)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > 0 and total >= best:
            best, best_at = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for t, good in zip(found[slice(*best_at)], keep[slice(*best_at)], strict=True):
        if good and t.text is not None:
            blocks.setdefault(t.block, []).append(t.text)
        elif t.place == "br" and t.block in blocks:
            blocks[t.block].append(" ")
    lines = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _largest(found: list[Token], kind: str) -> tuple[str, int] | None:
    """(kind, number) of the article or main element with the most words outside boxes, the first on ties; None if none has any."""
    words: Counter = Counter()
    for t in found:
        if t.text and not t.bad and (number := getattr(t, kind)):
            words[number] += len(t.text.split())
    most = max(words.values(), default=0)
    return (kind, min(k for k, n in words.items() if n == most)) if most else None


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages))

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", model.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
