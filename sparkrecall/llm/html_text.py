"""Main text of HTML pages, with a suffix array per host.

First, each page is cut into text blocks by its own markup. Blocks inside the article
landmark (``article``, ``main``, or a role, itemprop or class that says so) are sure;
blocks inside menus, headers, footers, sidebars, notices, adverts, forms, comments and
the like are boilerplate; all others are open. A form or a class name does not drop a
landmark inside it, but for comments, adverts and related articles; a form directly in
the body wraps the page and drops nothing. On a page with a landmark, what is open
lies outside it and goes too.

Then the host decides what is open. The token streams of a host's pages, all text outside
landmarks, are laid end to end, and a suffix array sorted to ``LEAST_TOKENS`` tokens finds
the substrings of that length (a short block counts whole) that repeat; longer repeats
are runs of them. Those found on ``LEAST_PAGES`` distinct pages of the host or more cover
boilerplate: covered tokens are removed from open blocks and the unique runs stay.

A host may hold a third of all pages, so its stream is dealt into shards of bounded
length by a hash of the page. Each shard's suffix array gives every distinct substring
once, with its number of pages and its places in open blocks; the shards' numbers are
added up by (host, substring), so the result is that of one array over the host.

White space inside a block becomes one space, blocks are joined by one newline, character
references are decoded. A null or empty page has empty text; a null url is a host of its
own. Repeated rows of a page are distinct pages. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import text_slices
from sparkrecall.session import cut_lineage

#: Tokens of a repeated substring, and distinct pages of the host that make it boilerplate.
LEAST_TOKENS, LEAST_PAGES = 8, 3
#: Tokens of one suffix array.
SHARD_TOKENS = 10_000

# Element and attribute names of HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rtc rp s samp small "
                   "span strike strong sub sup time tt u var wbr img input".split())
DROPPED = frozenset("nav header footer aside form button select option datalist dialog menu svg canvas object audio video map "
                    "head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset("article main".split())
LANDMARK_NAMES = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body "
                           "main-content page-content".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer bottombar copyright sidebar aside "
    "widget ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner notice notices cookie cookies consent "
    "gdpr alert popup modal overlay newsletter subscribe subscription signup signin login form search share sharing social related "
    "recommended recommendations pagination pager comment comments commentlist reply replies respond disqus toolbar skip hidden".split())
#: Areas that hold other people's or other pages' articles; a landmark in them, or named so, is boilerplate too.
FOREIGN_NAMES = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations "
                          "ad ads advert adverts advertisement adsense sponsor sponsored".split())
#: What the other parts of a compound name may be, and compound names with other parts.
COMPANIONS = frozenset(
    "site page main top bottom left right primary secondary global mobile desktop sticky fixed user list item items box bar block wrap "
    "wrapper container section area region zone slot unit inner outer content body links link buttons button btn icons icon panel "
    "message policy info text title label toggle dropdown trigger posts articles stories news thread count post entry".split())
DROPPED_COMPOUNDS = frozenset("article-footer skip-to-content back-to-top".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
#: One attribute: its whole name, and its value in double, single or no quotes.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMING = frozenset("class id role itemprop hidden aria-hidden".split())
#: Elements whose end is implied by the start of another block.
IMPLIED_END = frozenset("p li dt dd tr td th option".split())


def names_of(attributes: str, ids: bool = True) -> tuple[set[str], set[str], bool]:
    """Class and id names, roles, and whether the element is hidden."""
    names, roles, hidden = set(), set(), False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind = kind.lower()
        if kind not in NAMING:
            continue
        value = "".join(values).lower()
        if kind == "role":
            roles.update(value.split())
        elif kind == "hidden" or kind == "aria-hidden" and value == "true":
            hidden = True
        elif kind != "id" or ids:
            names.update(value.split())
    return names, roles, hidden


def drops(name: str) -> str:
    """'drop' for a class or id that names a foreign area, 'weak' for other boilerplate,
    else ''. Names count whole, or as compounds of known parts (site-header, comment-list,
    ad-2), so overflow-hidden, social-impact and header-image name nothing."""
    if name in DROPPED_NAMES:
        return "drop" if name in FOREIGN_NAMES else "weak"
    if name in DROPPED_COMPOUNDS:
        return "weak"
    parts = [p for p in re.split(r"[-_]+", name) if p and not re.fullmatch(r"\d+(x\d+)?", p)]
    named = {p for p in parts if p in DROPPED_NAMES and p != "hidden"}
    if name in LANDMARK_NAMES or not named or not all(p in named or p in COMPANIONS for p in parts):
        return ""
    return "drop" if named & FOREIGN_NAMES else "weak"


def element_kind(tag: str, attributes: str, top: bool = False) -> str:
    """'drop', 'weak' (boilerplate, but a landmark inside it is kept), 'keep' or '' for an
    element by its name and attributes; ``top``: only html and body are around it."""
    if tag in DROPPED and tag != "form":
        return "drop"
    names, roles, hidden = names_of(attributes, tag not in HEADINGS) if attributes.strip(" /") else (set(), set(), False)
    named = {drops(n) for n in names} if tag not in ("html", "body", "main") else set()
    if hidden or roles & DROPPED_ROLES or "drop" in named:
        return "drop"
    if tag in LANDMARKS or roles & LANDMARKS or names & LANDMARK_NAMES:
        return "keep"
    return "weak" if "weak" in named or tag == "form" and not top else ""


class _Open:
    """The open block elements, each with the state around it, and how many of each
    name there are, so no question walks the whole stack."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.named: Counter[str] = Counter()
        self.outer = 0            # open html and body elements
        self.kept_headers = 0     # headers in kept text

    def push(self, tag: str, state: str) -> None:
        self.stack.append((tag, state))
        self._count(tag, state, 1)

    def pop(self) -> tuple[str, str]:
        tag, state = self.stack.pop()
        self._count(tag, state, -1)
        return tag, state

    def _count(self, tag: str, state: str, by: int) -> None:
        self.named[tag] += by
        self.outer += by * (tag in ("html", "body"))
        self.kept_headers += by * (tag == "header" and state == "keep")

    def top(self) -> bool:
        return self.outer == len(self.stack)


def blocks(html: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's text blocks in order: 'keep', 'drop' or ''. Time grows
    with the page's length, however deep its elements."""
    out: list[tuple[str, str]] = []
    opened = _Open()
    state, parts, at, n = "", [], 0, len(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(("drop" if state == "weak" else state, text))
        parts.clear()

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at, tag = m.end(), m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if opened.named[tag]:
                flush()
                while opened.stack:
                    t, state = opened.pop()
                    if t == tag:
                        break
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        kind = "drop" if state == "drop" else element_kind(tag, m.group(3), opened.top())
        if state == "drop" and tag in HEADINGS and opened.kept_headers:
            kind = "keep"  # the article's own heading
        if tag in INLINE and kind not in ("drop", "weak"):
            continue
        flush()
        if tag in VOID:
            continue
        if tag not in INLINE and opened.stack and opened.stack[-1][0] in IMPLIED_END and opened.stack[-1][0] == tag:
            state = opened.pop()[1]
            kind = "drop" if state == "drop" else element_kind(tag, m.group(3))
        opened.push(tag, state)
        state = kind or state
    flush()
    return out


def host_of(url: str | None) -> str | None:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m.group(1).lower() if m else url


def parse_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Written table (uid, page_id, url, host, text, parts, outside): ``text`` where no
    block is open, else ``parts``, all kept and open blocks; ``outside``: the blocks
    outside landmarks, as the host's stream has them (open: their number in parts)."""
    part_type = "array<struct<sure:boolean,text:string>>"
    outside_type = "array<struct<part:int,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in text_slices(batch, "html"):
                texts, parts, outside = [], [], []
                for page in raw:
                    found = blocks(page.decode("utf-8", "replace"))
                    marked = any(k == "keep" for k, _ in found)
                    mine = [(k == "keep", t) for k, t in found if k == "keep" or not k and not marked]
                    is_open = not marked and bool(mine)
                    number = iter(range(len(mine)))
                    outside.append([{"part": next(number) if not k and not marked else -1, "text": t} for k, t in found if k != "keep"])
                    texts.append(None if is_open else "\n".join(t for _, t in mine))
                    parts.append([{"sure": s, "text": t} for s, t in mine] if is_open else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([host_of(u) for u in part.column(2).to_pylist()], pa.string()),
                     pa.array(texts, pa.string()),
                     pa.array(parts, pa.list_(pa.struct([("sure", pa.bool_()), ("text", pa.string())]))),
                     pa.array(outside, pa.list_(pa.struct([("part", pa.int32()), ("text", pa.string())])))],
                    names=["uid", "page_id", "url", "host", "text", "parts", "outside"])

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"),
                        pages[html].alias("html"))
    return cut_lineage(rows.mapInArrow(run, f"uid long, page_id long, url string, host string, text string, parts {part_type}, "
                                            f"outside {outside_type}"))


def repeated_prefixes(stream: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``stream`` sorted to its first ``least`` tokens, by prefix
    doubling, and for each position in that order the number of its class of equal
    prefixes. Shorter rests of the stream differ from all longer ones."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < least:
        step = min(depth, least - depth)  # ranks of `depth` tokens here and `step` tokens further on give depth + step
        ahead = np.zeros(n, np.int64)
        ahead[:n - step] = rank[step:]
        order = np.lexsort((ahead, rank))
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def substrings_of(pages: list[tuple[int, list]], least: int) -> list[tuple[bytes, int, list]]:
    """(digest, pages, places) of each distinct substring of ``least`` tokens (or short
    block) in a shard; places: (uid, part, first token, tokens) in open blocks."""
    from xxhash import xxh3_128_digest
    words: dict[str, int] = {}
    stream, owner, where, room = [], [], [], []
    for p, (uid, found) in enumerate(pages):
        for b in found:
            tokens = b["text"].split()
            pad = max(1, least - len(tokens))
            stream.extend(words.setdefault(t, len(words) + 1) for t in tokens)
            stream.extend([0] * pad)  # the end of a block
            owner.extend([p] * (len(tokens) + pad))
            where.extend((b["part"], i) for i in range(len(tokens) + pad))
            whole = len(tokens) < least
            room.extend([len(tokens) if whole and i == 0 else (least if len(tokens) - i >= least else 0) for i in range(len(tokens) + pad)])
    if not stream:
        return []
    order, group = repeated_prefixes(np.array(stream, np.int64), least)
    size, owners = np.array(room, np.int64), np.array(owner, np.int64)
    at = order[size[order] > 0]
    group = group[size[order] > 0]
    if not len(at):
        return []
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    names = list(words)
    out = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
        mine = at[a:b]
        first = int(mine[0])
        text = " ".join(names[stream[i] - 1] for i in range(first, first + int(size[first])))
        places = [(pages[owner[i]][0], where[i][0], where[i][1], int(size[i])) for i in mine.tolist() if where[i][0] >= 0]
        out.append((xxh3_128_digest(text.encode()), len(np.unique(owners[mine])), places))
    return out


def boilerplate_places(parsed: DataFrame, least_tokens: int, least_pages: int, shard_tokens: int) -> DataFrame:
    """(uid, places): the covered token runs of pages with open blocks."""
    streams = parsed.where(F.size("outside") > 0).select("uid", "host", "outside", F.expr(
        "aggregate(outside, 0L, (n, b) -> n + size(split(b.text, ' ')))").alias("n"))
    shards = streams.groupBy("host").agg(F.ceil(F.sum("n") / F.lit(shard_tokens)).alias("shards"))
    dealt = (streams.join(shards.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h", "n")
             .withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards"))))
    place = "struct<uid:long,part:int,first:int,n:int>"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pages = list(zip(table["uid"].to_pylist(), table["outside"].to_pylist(), strict=True))
        rows = substrings_of(pages, least_tokens)
        places = [[{"uid": u, "part": p, "first": f, "n": n} for u, p, f, n in r[2]] for r in rows]
        kind = pa.list_(pa.struct([("uid", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), ("n", pa.int32())]))
        return pa.table({"host": pa.array([key[0].as_py()] * len(rows), pa.string()), "digest": pa.array([r[0] for r in rows], pa.binary()),
                         "pages": pa.array([r[1] for r in rows], pa.int64()), "places": pa.array(places, kind)})

    found = dealt.groupBy("host", "shard").applyInArrow(run, f"host string, digest binary, pages long, places array<{place}>")
    found = cut_lineage(found)
    common = found.groupBy("host", "digest").agg(F.sum("pages").alias("on")).where(F.col("on") >= least_pages).toDF("h", "d", "on")
    return (found.where(F.size("places") > 0).join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("digest") == F.col("d")))
            .select(F.explode("places").alias("p")).groupBy(F.col("p.uid").alias("uid")).agg(F.collect_list("p").alias("places")))


def unique_runs(parts: list[dict], places: list[dict] | None) -> str:
    """The blocks without their covered tokens; blocks that are covered whole go."""
    covered: dict[int, set[int]] = {}
    for p in places or []:
        covered.setdefault(p["part"], set()).update(range(p["first"], p["first"] + p["n"]))
    out = []
    for i, b in enumerate(parts):
        gone = covered.get(i)
        text = " ".join(t for k, t in enumerate(b["text"].split(" ")) if k not in gone) if gone and not b["sure"] else b["text"]
        if text:
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_tokens: int = LEAST_TOKENS,
              least_pages: int = LEAST_PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    parsed = parse_pages(pages, page_id, url, html)
    places = boilerplate_places(parsed, least_tokens, least_pages, shard_tokens)
    judged = parsed.where("parts is not null").join(places, "uid", "left").select("page_id", "url", "parts", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unique_runs(p, q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    opened = judged.mapInArrow(run, "page_id long, url string, text string")
    return (parsed.where("parts is null").select("page_id", "url", "text").unionByName(opened)
            .withColumn("n_chars", F.char_length("text").cast("long")))
