"""HTML extraction by consensus host paths.

Each page's containers are scored; each page votes for the generalised tag-class path of its best one; the path with most
votes in a host wins; every page is then extracted again along its host's winning path.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import join_small, materialize, spare, table
from plumbline.llm.url_filter import host_of

# Element names of HTML.
SKIPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class, id and role names. A name marks what is not the article if it has a word of the first or second list
# and no other words than those and the companions: cookie-notice and left-sidebar-2 do, side-effects and form-factor do not.
SURE = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " masthead topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter"
    " comment comments commentlist disqus pagination pager complementary contentinfo".split()
)
#: Names of these count outside an article element, unless they name a part of it.
FRAME = frozenset("header footer".split())
#: Names of these count where the element is a form or mostly links: an article can have a part on any of them.
DOUBTFUL = frozenset("side rail alert signup login respond reply replies discussion related recommended recommendations share sharing social widget search form disclaimer".split())
COMPANIONS = frozenset("bar bars block blocks body bottom box boxes btn buttons center column container desktop extra fixed global group holder inner item items js left links list main message mobile outer page panel policy primary reader readers right row secondary section site slot small sticky the thread top unit user users wrap wrapper zone area content article post entry story".split())
PARTS = frozenset("article post entry story".split())
#: A tag that is not closed before the next < outside quotes is text; so each sign is looked at a few times only.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:[^><\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^><]*+>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)([^><]*+)>")
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Of a doubtful element's text, the share inside links from which it is no part of the article.
LINKED = 0.5
KEPT, SKIP, FRAMED, DOUBT, NAMED_ID = range(5)
#: In an article or main element an id of one word is often the slug of a heading; if it is none of these, it counts only where a doubtful name does.
PLAIN_IDS = frozenset("ad ads advert adverts advertisement advertisements adsense adslot sponsor sponsored cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter comment comments commentlist disqus".split())
#: Characters outside links that a page's own best container must have to be taken in the place of what stands at the host's path.
LEAST_OWN = 200
#: An element outside articles is the best container where it holds so many times what the best article does; so is a page's own best container against the host's path.
OUTWEIGHED = 4
#: Open elements of a page; deeper ones are parts of the last.
DEEPEST = 120


def _mark(name: str) -> int:
    """What a class, id or role name says of its element."""
    found = {w.lower() for w in WORD.findall(name)}
    if not found or found - SURE - FRAME - DOUBTFUL - COMPANIONS:
        return KEPT
    if found & SURE:
        return SKIP
    if found & FRAME:
        return KEPT if found & PARTS else FRAMED
    return DOUBT if found & DOUBTFUL else KEPT


@lru_cache(1 << 14)
def _step(name: str, attributes: str) -> tuple[str, int]:
    """An element's step in a generalised path (classes without digits), and what its names say of it."""
    if not attributes:
        return name, SKIP if name in SKIPPED else KEPT
    named = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)}
    marks = {_mark(w) for k in ("class", "role") for w in named.get(k, "").split()} if name not in ("html", "body", "article", "main") else set()
    by_id = {_mark(w) for w in named.get("id", "").split()} if name not in ("html", "body", "article", "main") else set()
    if SKIP in by_id and named["id"].isalpha() and len(WORD.findall(named["id"])) == 1 and named["id"].lower() not in PLAIN_IDS:
        by_id = (by_id - {SKIP}) | {NAMED_ID}
    marks |= by_id
    mark = SKIP if name in SKIPPED or SKIP in marks else NAMED_ID if NAMED_ID in marks else FRAMED if FRAMED in marks else DOUBT if DOUBT in marks else KEPT
    return name + "".join("." + w for w in sorted({re.sub(r"\d+", "", w).lower() for w in named.get("class", "").split()} - {""})), mark


def _blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Blocks of text outside skipped parts, in page order: (path of open containers, text, its characters inside links)."""
    found, doubts = [], []
    for path, text, linked, within in _all_blocks(page, doubts):
        found.append((path, text, linked, within))
        for k in within:
            doubts[k][0] += len(text)
            doubts[k][1] += linked
    gone = {k for k, (size, linked, form) in enumerate(doubts) if form or linked > LINKED * size}
    return ((path, text, linked) for path, text, linked, within in found if not gone.intersection(within))


def _all_blocks(page: str, doubts: list[list[int]]) -> Iterator[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """Blocks outside surely skipped parts, with the numbers of the doubtful elements around them; each of those gets an entry [0, 0, has a form] in doubts."""
    stack: list[tuple[str, str, bool, int | None]] = []  # element, path step, skipped, number of a doubtful one
    text: list[str] = []
    linked, in_link, skipped, at, size, deeper = 0, 0, 0, 0, len(page), 0

    around: list[tuple] = []  # of the stack as it stands, once made: the path and the doubtful elements

    def flush():
        nonlocal linked
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined and not around:
            around.append((tuple(step for name, step, _, _ in stack if name not in CLOSED_BY_BLOCK), tuple(k for _, _, _, k in stack if k is not None)))
        out = (around[0][0], joined, linked, around[0][1]) if joined else None
        text.clear()
        linked = 0
        return out

    def pop(to: int):
        nonlocal skipped
        around.clear()
        while len(stack) > to:
            skipped -= stack.pop()[2]

    while at < size:
        here = page.find("<", at)
        tag = None if here < 0 else TAG.match(page, here) or LOOSE_TAG.match(page, here)  # the second: quotes do not pair
        stop = tag.start() if tag else here + 1 if here >= 0 else size  # a lone < is text
        if stop > at and not skipped:
            text.append(page[at:stop])
            linked += (stop - at) * in_link
        if not tag:
            at = stop
            continue
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        closing = bool(tag.group(1))
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in ("form", "input", "textarea", "select") and not closing:
            for _, _, _, k in stack:
                if k is not None:
                    doubts[k][2] = 1
        if name == "button" and (closing and not any(n == name for n, _, _, _ in stack) or not closing and not skipped and "".join(text).strip()):
            continue  # inside a sentence
        if name in ("br", "hr") or name not in BLOCKS and name not in SKIPPED:
            if name in ("br", "hr", "img", "wbr") and not skipped:
                text.append(" ")
            continue
        if (block := None if skipped else flush()) is not None:
            yield block
        if closing and deeper and name not in CLOSED_BY_BLOCK:
            deeper -= 1
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS and name not in ("option",) and stack and stack[-1][0] in CLOSED_BY_BLOCK:
            pop(len(stack) - 1)
        if name in SAME_CLOSES and stack and stack[-1][0] in SAME_CLOSES[name]:
            pop(len(stack) - 1)
        if len(stack) >= DEEPEST and name not in SKIPPED:
            deeper += name not in CLOSED_BY_BLOCK
            continue
        step, mark = _step(name, tag.group(3))
        inside = mark in (FRAMED, NAMED_ID) or name == "header"
        inside = inside and any(n in ("article", "main") for n, _, _, _ in stack)
        framed = (mark in (FRAMED, NAMED_ID) or name == "header") and not inside
        skip, doubt = mark == SKIP or framed, None
        if mark in (DOUBT, NAMED_ID) and not skip:
            doubt = len(doubts)
            doubts.append([0, 0, 0])
        if not tag.group(3).endswith("/"):
            stack.append((name, step, skip, doubt))
            around.clear()
            skipped += skip
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else size
    if not skipped and (block := flush()) is not None:
        yield block


def best_path(page: str | None) -> str | None:
    """The path of the container with the highest score: characters outside links of its own blocks, and half those of its children."""
    return _best(_blocks(page or ""))


def _best(blocks: Iterable[tuple[tuple[str, ...], str, int]]) -> str | None:
    scores: dict[tuple[str, ...], float] = {}
    for path, text, linked in blocks:
        worth = max(0, len(text) - 2 * linked)
        for up, share in ((path, 1.0), (path[:-1], 0.5)):
            if up:
                scores[up] = scores.get(up, 0) + worth * share
    within = [p for p in scores if any(s.split(".")[0] in ("article", "main") for s in p)]
    if within and OUTWEIGHED * max(scores[p] for p in within) >= max(scores.values()):  # an article element outranks what surrounds it; its own container stands for its parts
        scores = {p: scores[p] for p in within}
    best = max(scores, key=lambda p: (scores[p], p), default=None)
    return None if best is None else ">".join(best)


def extract_text(page: str | None, path: str | None) -> str:
    """The blocks below path, else below the page's own best container, else all of them; in an article or main element the whole element counts.

    Where the own best container holds over LEAST_OWN characters and OUTWEIGHED times what stands below path, the page is not built as its host's others are, and its own counts."""
    found = list(_blocks(page or ""))

    def below(wanted: str | None) -> list[tuple[str, int]]:
        if not wanted:
            return []
        steps = tuple(wanted.split(">"))
        tops = [k for k, s in enumerate(steps) if s.split(".")[0] in ("article", "main")]
        steps = steps[: tops[0] + 1] if tops else steps
        return [(text, len(text) - linked) for at, text, linked in found if at[: len(steps)] == steps]

    voted, own = below(path), below(_best(found))
    if sum(n for _, n in own) > max(LEAST_OWN, OUTWEIGHED * sum(n for _, n in voted)):
        voted = own
    return "\n".join(text for text, _ in voted) or "\n".join(text for text, _ in own) or "\n".join(text for _, text, _ in found)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Adds text to pages(url, html): the main text of each whole page, along the winning path of its host.

    Null html gives an empty text. Pages with a null url share the empty host. Where no block stands under the winning path,
    the page's own best container counts. Ties between paths go to the greater path; repeated rows vote once each. Other
    columns stay; one named text is replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "html")]
    host, path = spare("_host", pages.columns), spare("_path", pages.columns)
    own = pages.select(*kept, "html", host_of(F.col("url")).alias(host))

    def vote(batches):
        for b in batches:
            found = [best_path(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["h", "p"])

    votes = own.select(host, "html").mapInArrow(vote, "h string, p string").where("p IS NOT NULL").groupBy("h", "p").count()
    winners = materialize(votes.groupBy("h").agg(F.max_by("p", F.struct("count", "p")).alias(path)).withColumnRenamed("h", host), "paths")
    joined = join_small(own, winners, host, "left").select(*kept, "html", path)
    schema = joined.select(*kept).schema.add("text", "string")

    def extract(batches):
        for b in batches:
            n = len(kept)
            texts = [extract_text(h, p) for h, p in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], names=[*kept, "text"])

    return joined.mapInArrow(extract, schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
