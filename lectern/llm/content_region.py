"""Main text of web pages: the contiguous run of words and tags with the highest total score.

A page is a sequence of tags and stretches of text. Words add, tags take away: a word adds the
share of words in such a context that belong to articles, a tag takes ``scale`` times the share
of such tags that stand outside articles. Both shares and the scale are learned from labelled
pages, those whose markup names their content with one ``article`` or ``main`` element. One
linear scan finds the best run. Elements that never are content (scripts, menus, forms,
adverts, notices, comments) add nothing and cost as tags do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ready, slices, written

#: Pages the weights are learned from: those with the smallest hash of their id.
SAMPLE = 2000
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)|[^>]*>?)", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HINT = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
NEVER = RAW | frozenset("head nav footer aside form button select svg canvas object dialog menu audio video".split())
CONTENT = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that lay out running text; where no labelled page has one, it costs nothing.
PLAIN = (INLINE - {"a"}) | frozenset(
    "table caption colgroup col thead tbody tfoot tr td th pre blockquote figure figcaption dl dt dd".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class or id that mark what is not content …
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies"
    " consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup paywall sidebar"
    " rail widget nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar comment comments"
    " commentlist disqus reply replies respond share sharing social related recommended recommendations trending"
    " pagination pager login search hidden toolbar skip".split()
)
#: Of these the ones that mark a section of an article by its id; other ids there are names to link to.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: … unless the element also says that it is.
HOLDERS = frozenset("content main article post entry story body page wrapper wrap container layout has with no".split())


@dataclass(frozen=True)
class Weights:
    """Share of words by context, and of tags by name, that lie inside content."""

    words: dict[str, float]
    tags: dict[str, float]
    scale: float


DEFAULT = Weights({}, {}, 1.0)


def _boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not content; ``inside``: it stands in an article or main element.

    The id of a heading says nothing, that of a section inside only whether readers comment there.
    """
    if name in NEVER:
        return True
    if name in ("html", "body", *CONTENT):
        return False
    if name == "header" and not inside:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" and not m[2] or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id"):
            hints = {h.lower() for h in HINT.findall(value)}
            if inside:
                hints -= {"header"}
            if key == "id" and name in HEADINGS:
                continue
            if key == "id" and inside and name == "section":
                hints &= READERS
            if hints & HINTS and not hints & HOLDERS:
                return True
    return False


def pieces(page: str) -> list[tuple[str, str, str, int, bool]]:
    """(kind, name, text, block, inside) of a page in order.

    Tags: kind "tag", their name. Text: kind "text", the context (innermost block element, with
    "a" in links) as name; dropped text has kind "drop". ``block`` numbers the blocks of text,
    ``inside`` tells whether an article or main element is open.
    """
    out: list[tuple[str, str, str, int, bool]] = []
    # name, whether it is dropped, and the place of the innermost block element (-1: none)
    stack: list[tuple[str, bool, int]] = []
    opened: Counter[str] = Counter()
    dropping = content = block = at = 0

    def text(end: int) -> None:
        part = page[at:end]
        if part and not part.isspace():
            holder = stack[-1][2] if stack else -1
            context = stack[holder][0] if holder >= 0 else "body"
            if any(e[0] == "a" for e in stack[-4:]):
                context += " a"
            out.append(("drop" if dropping else "text", context, part, block, content > 0))
        elif part:
            out.append(("space", "", part, block, content > 0))

    def pop(size: int) -> None:
        nonlocal dropping, content
        for name, dropped, _ in stack[size:]:
            opened[name] -= 1
            dropping -= dropped
            content -= name in CONTENT
        del stack[size:]

    while m := TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
        elif name == "br":
            out.append(("space", "", " ", block, content > 0))
        if m[1]:
            out.append(("tag", name, "", block, content > 0))
            if opened[name]:  # what lies above it goes too, so the search costs what is removed
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name not in INLINE:  # a new block ends an open paragraph
            holder = stack[-1][2] if stack else -1
            if holder >= 0 and (stack[holder][0] == "p" or stack[holder][0] == name == "li"):
                pop(holder)
        attributes = m[3] or ""
        if name == "body":
            pop(0)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            out.append(("tag", name, "", block, content > 0))
            continue
        if name not in VOID and not attributes.endswith("/>"):
            dropped = _boilerplate(name, attributes, content > 0)
            holder = stack[-1][2] if stack else -1
            stack.append((name, dropped, holder if name in INLINE else len(stack)))
            opened[name] += 1
            dropping += dropped
            content += name in CONTENT
        out.append(("tag", name, "", block, content > 0))
    text(len(page))
    return out


def best_run(parts: list, weights: Weights) -> tuple[int, int]:
    """Start and end (exclusive) of the run of pieces with the highest positive sum.

    Of runs with equal sums the one that ends first counts, and of those the longest.
    """
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, (kind, name, text, _, _) in enumerate(parts):
        if kind == "text":
            total += len(text.split()) * weights.words.get(name, 0.5)
        elif kind == "tag":
            total -= weights.scale * (1 - weights.tags.get(name, 1.0 if name in PLAIN else 0.5))
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best run, joined by newlines; white space in a block is one space."""
    parts = pieces(page or "")
    start, end = best_run(parts, weights)
    blocks: dict[int, list[str]] = {}
    for kind, _, text, block, _ in parts[start:end]:
        if kind in ("text", "space"):
            blocks.setdefault(block, []).append(html.unescape(text) if "&" in text else text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _labelled(parts: list) -> bool:
    return any(p[4] for p in parts) and sum(p[0] == "tag" and p[1] in CONTENT and p[4] for p in parts) <= 2


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Learn from the labelled pages among the ``sample`` with the smallest hash of page_id.

    The ids are broadcast, at most ``sample``; what reaches the driver is one row a tag name or
    context. Without labelled pages words weigh 0.5 and tags cost half the scale of 1.
    """
    spark = ready(pages.sparkSession)
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = written(pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html"), "pages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            inside, outside = Counter(), Counter()
            for page in part.column("html").to_pylist():
                parts = pieces(page or "")
                if _labelled(parts):
                    for kind, name, text, _, within in parts:
                        if kind in ("text", "tag"):
                            known = name if kind == "text" or name.isalnum() else "other"
                            (inside if within else outside)[kind, known[:40]] += len(text.split()) if kind == "text" else 1
            keys = list(inside | outside)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
                + [pa.array([c[k] for k in keys], pa.int64()) for c in (inside, outside)],
                ["kind", "name", "inside", "outside"],
            )

    counts = rows.mapInArrow(count, "kind string, name string, inside bigint, outside bigint")
    sums = counts.groupBy("kind", "name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    share = {"text": {}, "tag": {}}
    for r in sums:
        share[r["kind"]][r["name"]] = (r["i"] + 1) / (r["i"] + r["o"] + 2)
    if not sums:
        return DEFAULT
    tried = [Weights(share["text"], share["tag"], s) for s in SCALES]

    def try_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            scores = [0.0] * len(tried)
            for page in part.column("html").to_pylist():
                parts = pieces(page or "")
                if not _labelled(parts):
                    continue
                words = [len(p[2].split()) if p[0] == "text" else 0 for p in parts]
                truth = sum(w for w, p in zip(words, parts) if p[4])
                for k, weights in enumerate(tried):
                    start, end = best_run(parts, weights)
                    hit = sum(w for w, p in zip(words[start:end], parts[start:end]) if p[4])
                    scores[k] += 2 * hit / max(1, truth + sum(words[start:end]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(tried)), pa.int32()), pa.array(scores, pa.float64())], ["k", "score"]
            )

    scored = rows.mapInArrow(try_out, "k int, score double").groupBy("k").agg(F.sum("score").alias("score")).collect()
    best = max(scored, key=lambda r: (round(r["score"], 6), -r["k"]))["k"]
    return tried[best]


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url and text of every row; null and empty pages, and pages without words, give "".

    Rows are neither merged nor dropped; other columns of ``pages`` are not read.
    """
    shared = ready(pages.sparkSession).sparkContext.broadcast(weights)
    rows = pages.select("page_id", "url", "html")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for part in slices(batches, "html"):
            texts = [main_text(p, weights) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return rows.mapInArrow(run, schema)
