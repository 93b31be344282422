"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and
classes are one style node.  A node's importance joins the entropy of its
presentation (the sequences of child elements that pages show there) with that of
its content features (words of short texts, sentences of longer ones, link and
image targets): a feature that m of n pages share has the entropy log m / log n,
and what looks and reads the same on all pages of a host is worth little.
Branches of low importance go.

What the tree cannot know, as on hosts of few pages or in adverts that always
differ, markup tells as a second source: navigation, asides, forms and the like go
as well, and where article elements, or else a main element, hold a good part of a
page's text, only these count.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|title|textarea)(?=[\s/>])[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")
#: Elements whose content is text up to their end or, without one, the page's end.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea")}
#: Elements that stand in a line and hold no prose.  One that is never closed is empty.
EMBEDS = frozenset("svg math select button object iframe noscript template".split())
EMBED_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in EMBEDS}
FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
UNNESTED = frozenset("select button iframe noscript".split())
FOREIGN = frozenset(("svg", "math"))
HTML_WITHIN = frozenset("foreignobject desc annotation-xml".split())
#: Elements that no svg or math holds: they end an unclosed one.
BREAKOUT = frozenset("body blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 head hr img li menu nobr ol p pre ruby table ul".split())
IN_HEAD = frozenset("noscript template base link meta".split())
#: Elements without content, inline elements, and what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = EMBEDS | frozenset("head nav footer aside form dialog menu".split())
WORDS_NEVER = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement adsense sponsor sponsored promo"
    " banner cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social related recommended"
    " comment comments disqus reply replies pagination pager copyright widget complementary contentinfo search".split())
WORDS_OUTSIDE = frozenset("header masthead topbar toolbar".split())  # a header inside an article belongs to it
FRAME = frozenset("html body article main".split())
#: Elements whose branches entropy may remove; prose elements stay with their container.
BOXES = frozenset("div section ul ol dl table center fieldset figure header details nav footer aside form menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GAMMA, LOW, LEAST_PAGES = 0.9, 0.35, 5
MOST_ROWS = 200_000  # of a page's counts that are held at a time
SHORT = 12  # words of a text that are features each
MAIN_SHARE = 4  # articles, or main, count alone if they hold one part in so many of a page's text
TARGETS = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASSES = re.compile(r"""\b(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SENTENCE = re.compile(r"[^.!?]+")
PRESENT, LOOK, CONTENT = 0, 1, 2  # kinds of counts


class Node:
    __slots__ = ("tag", "path", "noise", "inside", "kids", "content", "box", "mute", "foreign")

    def __init__(self, tag, path, noise, inside, box, mute=False, foreign=False):
        self.tag, self.path, self.noise, self.inside, self.box = tag, path, noise, inside, box
        self.mute, self.foreign = mute, foreign  # within an embed; within svg or math
        self.kids, self.content = [], []


def features(text: str) -> list[str]:
    """Content features of a text: its words if these are few, else its sentences."""
    words = text.split()
    if len(words) <= SHORT:
        return words
    return [" ".join(s.split()) for s in SENTENCE.findall(text) if not s.isspace()]


def wraps_article(page: str, at: int, ends: list[int], known: dict[int, bool]) -> bool:
    """Whether the form that begins at ``at`` holds an article or main element or
    half of the page's paragraphs.  ``ends``: places of form ends, ascending; of
    forms with one end the first one, in ``known``, tells."""
    k = bisect.bisect_left(ends, at)
    end = ends[k] if k < len(ends) else len(page)
    if end not in known:
        inside = page.count("<p>", at, end)
        known[end] = (page.find("<article", at, end) >= 0 or page.find("<main", at, end) >= 0
                      or inside > 0 and 2 * inside >= page.count("<p>"))
    return known[end]


def walk(page: str, low: frozenset = frozenset(), watch: list | None = None) -> tuple[str, str, str]:
    """Text inside articles, inside main elements, and anywhere, without noise
    branches and those whose paths are in ``low``.  ``watch`` collects the boxes,
    with their child elements and content features."""
    top = Node("", 0, False, 0, None)
    stack, parts, opened = [top], ([], [], []), Counter()
    run: list[str] = []  # the text since the last block border

    def put(text: str) -> None:
        here = stack[-1]
        if here.mute:
            return
        if watch is not None:
            run.append(text)
        if here.noise:
            return
        parts[2].append(text)
        if here.inside & 2:
            parts[1].append(text)
        if here.inside & 1:
            parts[0].append(text)

    def border() -> None:
        """The text up to here belongs to the innermost box."""
        if run:
            if stack[-1].box is not None:
                stack[-1].box.content += features("".join(run))
            run.clear()

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def cut(k: int) -> None:
        while len(stack) > k:
            pop()

    def said(text: str) -> None:
        if stack[-1].tag == "head" and not text.isspace():  # text ends a head
            pop()
        put(entities.unescape(text) if "&" in text else text)

    limit, forms, known = page.rfind(">") + 1, None, {}  # behind it nothing is markup
    at, last = 0, {}
    while m := TOKEN.search(page, at, limit):
        if m.start() > at:
            said(page[at:m.start()])
        at = m.end()
        if at == limit and m.group(0).startswith("<!--") and not m.group(0).endswith(("-->", "--!>")):
            at = len(page)  # a comment without an end
            break
        raw = m.group(1)
        if raw and not stack[-1].foreign:
            end = RAW_END[raw.lower()].search(page, at)
            at = end.end() if end else len(page)
            continue
        tag = raw or m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        embed = tag in EMBEDS
        block = not embed and tag not in INLINE
        if block:
            put(" ")
            border()
        if m.group(2):
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if not block and not embed and stack[k].tag not in INLINE:
                        break  # a stray end of an inline element closes no block
            if block:
                put(" ")
            continue
        if stack[-1].foreign and tag in BREAKOUT:
            while stack[-1].foreign:
                pop()
        attributes = m.group(4) or ""
        if watch is not None and stack[-1].box is not None and "=" in attributes and not stack[-1].mute:
            stack[-1].box.content += [a or b or c for a, b, c in TARGETS.findall(attributes)]
        if tag in VOID:
            continue
        if tag == "body":  # a body ends an open head, and so does an element that no head holds
            if opened["head"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        cut(k)
                        break
        elif stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        closed = page[at - 2] == "/"
        if embed:
            if tag in UNNESTED and opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
            if tag not in last:
                last[tag] = max((e.start() for e in EMBED_END[tag].finditer(page, at)), default=-1)
            if closed or last[tag] < at:
                continue
        if block and tag not in FRAME and (opened["p"] or any(opened[t] for t in CLOSES.get(tag, ()))):  # a new block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == "p" or t in CLOSES.get(tag, ()):
                    cut(k)
                    break
                if t not in INLINE:
                    break
        up = stack[-1]
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if "=" in attributes else ""
        words = set(SPLIT.split(names)) if names else ()
        path = zlib.crc32(f"{tag}.{'.'.join(sorted(w for w in words if w))}".encode("utf-8", "replace"), up.path) | (len(stack) & 255) << 32
        noise = up.noise or tag in NEVER or path in low
        if tag == "form":
            if forms is None:
                forms = [e.start() for e in FORM_END.finditer(page)]
            noise = up.noise or path in low or not wraps_article(page, at, forms, known)
        if not noise and tag not in FRAME:
            told = words
            if words and up.inside:  # within an article only classes of containers tell
                told = set(SPLIT.split(" ".join(a or b or c for a, b, c in CLASSES.findall(attributes)).lower())) if tag in BOXES else ()
            outside = not up.inside
            noise = bool(told and not WORDS_NEVER.isdisjoint(told)) or outside and (
                tag == "header" or bool(told and not WORDS_OUTSIDE.isdisjoint(told)))
        inside = up.inside | (tag == "article") | 2 * (tag == "main" or "main" in words)
        mute = up.mute or embed
        node = Node(tag, path, noise, inside, up.box, mute, tag in FOREIGN or up.foreign and tag not in HTML_WITHIN)
        if watch is not None and up.box is not None and not embed:
            up.box.kids.append(tag)
        if watch is not None and not mute and tag in BOXES:
            node.box = Box(path, up.box)
            watch.append(node.box)
        if not closed or block and not up.foreign:
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        said(page[at:])
    border()
    return tuple(" ".join("".join(p).split()) for p in parts)


class Box:
    """A container of a page: its path, the box around it, the elements and content
    features that are in no inner box."""
    __slots__ = ("path", "up", "depth", "kids", "content")

    def __init__(self, path: int, up: Box | None):
        self.path, self.up, self.depth, self.kids, self.content = path, up, up.depth + 1 if up else 0, [], []


def chosen(article: str, main: str, anywhere: str) -> str:
    """A page's main text: its articles, or else its main elements, unless they are a small part."""
    for text in (article, main):
        if text and MAIN_SHARE * len(text) >= len(anywhere):
            return text
    return anywhere


def main_text(page: str | None, low: frozenset = frozenset()) -> str:
    return chosen(*walk(page, low)) if page else ""


def tallied(page: str | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A hash of a page's text; what it adds to its host's tree: paths, kinds, and
    hashes of values, each once, in pieces of about MOST_ROWS rows.

    A box's features are those of all boxes within it.  Boxes of a path stand at one
    depth, so depths are told one after the other, the innermost first, and each
    then hands its features on: only one depth's are held at a time."""
    boxes: list[Box] = []
    whole = signed(chosen(*walk(page or "", watch=boxes)))
    look: dict[int, list[str]] = {}
    levels: dict[int, list[Box]] = {}
    for b in boxes:
        look.setdefault(b.path, []).append(",".join(b.kids))
        levels.setdefault(b.depth, []).append(b)
    known: dict[str, int] = {}
    held, n = [(np.array([*look, *look], np.int64), np.repeat([PRESENT, LOOK], len(look)),
                np.array([0] * len(look) + [signed("|".join(x)) for x in look.values()], np.int64))], 2 * len(look)
    within: dict[int, set[int]] = {}  # by box, what inner boxes hand on
    for depth in sorted(levels, reverse=True):
        of_path: dict[int, list[set[int]]] = {}
        above: dict[int, set[int]] = {}
        sets_of = []
        for b in levels[depth]:
            own = within.pop(id(b), set())
            for w in b.content:
                if w not in known:
                    known[w] = signed(w)
                own.add(known[w])
            of_path.setdefault(b.path, []).append(own)
            sets_of.append(own)
        for path, sets in of_path.items():
            values = sets[0] if len(sets) == 1 else set().union(*sets)
            held.append((np.full(len(values), path, np.int64), np.full(len(values), CONTENT), np.fromiter(values, np.int64, len(values))))
            n += len(values)
            if n >= MOST_ROWS:
                yield whole, *map(np.concatenate, zip(*held))
                held, n = [], 0
        for b, own in zip(levels[depth], sets_of):
            if b.up is not None:
                small, large = sorted((own, above.get(id(b.up), set())), key=len)
                large |= small
                above[id(b.up)] = large
        within = above
    if held:
        yield whole, *map(np.concatenate, zip(*held))


def counted(page: str | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of ``tallied`` as one."""
    whole, *rows = zip(*tallied(page))
    return whole[0], *map(np.concatenate, rows)


def signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, n, importance`` of every box of every host, with ``n`` pages
    of different text.

    importance = (1 - g) * presentation + g * content, g = GAMMA ** (kinds of
    presentation).  presentation: entropy of the kinds over the pages, in units of
    log n.  content: 1 less the mean of log m / log n over the features of the
    branch, m being the pages with that feature.
    """
    def packed(batch, held) -> pa.RecordBatch:
        of, ends = pa.array([i for i, _ in held]), np.cumsum([0, *(len(p[1]) for _, p in held)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, np.concatenate([p[k] for _, p in held]).astype(np.int64)) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([batch["host"].take(of), batch["row"].take(of), pa.array([p[0] for _, p in held], pa.int64()), *lists],
                                          ["host", "row", "page", "paths", "kinds", "values"])

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for i, p in enumerate(batch["html"].to_pylist()):
                for piece in tallied(p):
                    held.append((i, piece))
                    n += len(piece[1])
                    if n >= MOST_ROWS:
                        yield packed(batch, held)
                        held, n = [], 0
            if held:
                yield packed(batch, held)

    seen = materialize(pages.select(host().alias("host"), F.monotonically_increasing_id().alias("row"), "html").mapInArrow(
        run, "host string, row long, page long, paths array<long>, kinds array<long>, values array<long>"))
    # copies of a page are no evidence of boilerplate: pages of equal text count once
    first = seen.groupBy("host", "page").agg(F.min("row").alias("row")).select("row")
    once = seen.join(first, "row", "left_semi")
    each = once.select("host", F.explode(F.arrays_zip("paths", "kinds", "values")).alias("x")).select("host", "x.paths", "x.kinds", "x.values")
    counts = each.groupBy("host", "paths", "kinds", "values").agg(F.count("*").alias("c"))  # combined before they meet
    of = lambda kind, value: F.sum(F.when(F.col("kinds") == kind, value))
    sums = counts.groupBy("host", "paths").agg(
        of(PRESENT, F.col("c")).alias("n"), of(LOOK, F.lit(1)).alias("looks"), of(LOOK, F.col("c") * F.log("c")).alias("look"),
        of(CONTENT, F.lit(1)).alias("features"), of(CONTENT, F.log("c")).alias("content"))
    unit, g = F.log("n"), F.pow(F.lit(GAMMA), F.col("looks"))
    presentation = 1 - F.col("look") / (F.col("n") * unit)
    content = F.coalesce(1 - F.col("content") / (F.col("features") * unit), F.lit(0.0))
    return sums.select("host", F.col("paths").alias("path"), "n", F.when(F.col("n") > 1, (1 - g) * presentation + g * content).otherwise(F.lit(1.0)).alias("importance"))


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES, small: int = 200_000) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Branches whose importance is under ``low`` on a host of at least
    ``least_pages`` pages of different text with them are removed from each page.  Null, empty and
    text-free pages have an empty text.  A null url, or one without a host,
    counts to the host "".  Inline markup adds no space, block elements and
    line breaks do; character references are decoded.  Repeated rows are
    extracted each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    poor = materialize(style_tree(pages).where((F.col("importance") < low) & (F.col("n") >= least_pages)).select("host", "path"))
    rules = poor.groupBy("host").agg(F.collect_set("path").alias("low"))  # styles of a host's templates, not its pages
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    rows = rows.join(F.broadcast(rules) if poor.count() <= small else rules, "host", "left").select("page_id", "url", "html", "low")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("page_id", "url").schema)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, frozenset(r or ())) for p, r in zip(batch["html"].to_pylist(), batch["low"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, kind + ", text string, n_chars long")
