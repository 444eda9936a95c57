"""Main text of web pages.

A page is cut into blocks of text by its markup. Where the markup says what a block is, it decides: blocks inside
menus, headers, footers, sidebars, adverts, notices, forms, comments are no content, and where a page marks its article
(``article``, ``main``, ``itemprop=articleBody``) only that is. Blocks of pages that mark none are undecided.

Undecided blocks are judged by the host's suffix array. The streams of a host are its pages' short blocks that no markup
names as main text, menus and footers of pages that do mark an article among them; a block of over ``LONG`` words is no
boilerplate and ends a stream. All streams of a host are concatenated and their suffixes sorted; neighbours that agree in
``REPEAT`` tokens and come from ``PAGES`` distinct pages mark repeated substrings, longer ones being covered by their
parts. A block all of whose tokens are covered is boilerplate; what stays are the unique runs' blocks, whole.

A host may have a third of all pages, so its array is cut into shards by suffix: a suffix is named by a hash of the host and of
its first ``REPEAT`` tokens, found by prefix doubling, which is the same in every task. Tasks sort the suffixes of
the pages that they hold, send each name with its number of pages, and Spark merges the shards by name. So a substring's
pages are counted over the whole host, however many pages it has and wherever they lie. Pages with equal
text are one page, which is settled before any suffix is sorted.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>\"']*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*+(?:>|\Z)|[^<]+|<", re.DOTALL)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([A-Za-z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
#: Elements whose content is no markup.
RAW = frozenset(("script", "style", "textarea", "noscript", "xmp", "iframe", "title"))
#: Elements whose content is not shown as text.
HIDDEN = RAW | {"head", "template", "svg", "object", "canvas", "audio", "video", "select"}
#: Elements that hold no main text.
SKIP = frozenset(("nav", "footer", "aside", "form", "script", "style", "noscript", "template", "select", "button", "iframe", "svg", "textarea", "head", "title", "menu", "dialog", "object", "canvas", "audio", "video", "xmp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: Elements that an opening tag of the same name ends.
CLOSING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: Words in a class, id or role that mark what is no main text.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN = frozenset(("article", "main"))
REPEAT = 8  # tokens of a repeated substring, at least
PAGES = 3  # distinct pages that share it, at least
LONG = 50  # words; a block of more is no boilerplate unless markup says so
CHUNK = 1 << 20  # suffixes that a task sorts at once
BETWEEN = "\n\n"  # joins blocks


#: With one of these words beside it, a mark tells of a page's arrangement, not of a part.
LAYOUT = frozenset("container content has layout main no page with without wrap wrapper".split())
#: Marks that hold for an article or main element too.
STRICT = frozenset("ad ads advert advertisement comment comments promo related sponsored".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _marked(tag: str, text: str, inside: bool) -> tuple[bool, bool]:
    """Whether an opening tag begins what is no main text, and whether it begins the main text."""
    if "=" not in text and " hidden" not in text:
        return tag in SKIP, tag in MAIN
    skip, main = tag in SKIP, tag in MAIN
    for key, value in ATTRIBUTE.findall(text):
        value = value.strip("\"'").lower()
        key = key.lower()
        if key in ("class", "id", "role", "aria-label"):
            parts = re.split(r"[^a-z0-9]+", value)
            marks = MARKS.intersection(parts)
            if tag in MAIN:
                marks &= STRICT
            elif inside:  # an article's own head belongs to it
                marks -= {"header", "masthead", "banner"}
            if marks and tag not in ("html", "body") and tag not in HEADINGS and not LAYOUT.intersection(parts):
                skip = True
            main |= key == "role" and value == "main"
        elif key == "itemprop":
            main |= value == "articlebody"
        elif key == "style" and "display:none" in value.replace(" ", ""):
            skip = True
    return skip, main


MARKED, OPEN, CORE = 0, 1, 2  # what markup says of a block: no main text, nothing, main text


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, what markup says of it) of a page's blocks, in page order."""
    out: list[tuple[str, int]] = []
    held: dict[int, list[str]] = {OPEN: [], MARKED: []}
    stack: list[tuple[str, int, bool]] = []  # name, skipped (2: not shown), main
    opened: Counter = Counter()
    skipped, main = 0, False
    text = page or ""

    def end() -> None:
        for kind, parts in held.items():
            if parts and (block := " ".join(html.unescape("".join(parts)).split())):
                out.append((block, CORE if main and kind else kind))
            parts.clear()

    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        piece = m.group()
        at = m.end()
        if piece[0] != "<" or piece == "<":
            if skipped < 2:
                held[MARKED if skipped else OPEN].append(piece)
            continue
        if piece[1] in "!?":
            continue
        if piece[-1] != ">":
            break  # a page cut inside a tag
        tag = NAME.match(piece).group(1).lower()
        if piece[1] == "/":
            if not opened[tag]:
                if tag not in INLINE:
                    end()
                continue
            if tag not in INLINE:
                end()
            while stack:
                name, was_skipped, was_main = stack.pop()
                opened[name] -= 1
                if name in INLINE or name == tag or tag not in INLINE:
                    skipped, main = was_skipped, was_main
                if name == tag:
                    break
            continue
        if tag not in INLINE:
            end()
        elif tag == "br" and skipped < 2:
            held[MARKED if skipped else OPEN].append(" ")
        if tag in VOID or piece.endswith("/>") and tag not in RAW:
            continue
        if tag in CLOSING and stack and stack[-1][0] == tag:
            name, skipped, main = stack.pop()
            opened[name] -= 1
        skip, core = _marked(tag, piece, main)
        if tag == "header" and not main:
            skip = True
        stack.append((tag, skipped, main))
        opened[tag] += 1
        main = main or (core and not skipped and not skip)
        skipped = max(skipped, 2 if tag in HIDDEN else int(skip))
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
            if tag == "title" or tag != "noscript" or close:
                at = close.start() if close else n
    end()
    return out


def streams_of(parts: list[tuple[str, int]]) -> list[list[str]]:
    """The runs of tokens of a page that may be boilerplate: short blocks beside each other that are not marked as main text."""
    out: list[list[str]] = [[]]
    for block, kind in parts:
        tokens = block.split()
        if kind == CORE or len(tokens) > LONG:
            out.append([])
        else:
            out[-1] += tokens
    return [s for s in out if len(s) >= REPEAT]


def encoded(runs: list[list[str]]) -> bytes:
    """Token hashes of a page's runs, each run followed by a zero."""
    return np.array([h for r in runs for h in (*(xxhash.xxh64_intdigest(t) | 1 for t in r), 0)], "<u8").tobytes()


def names(tokens: np.ndarray, length: int = REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) of the suffixes with ``length`` tokens before a run's end; equal names, equal first tokens.

    Prefix doubling: the name of 2k tokens comes from the names of the first k and of the k that follow; ``length`` is a power of two.
    """
    name = tokens.copy()
    whole = tokens != 0
    step = 1
    while step < length:
        later, fits = np.zeros_like(name), np.zeros_like(whole)
        later[:-step], fits[:-step] = name[step:], whole[step:]
        whole &= fits
        name = name * np.uint64(0x9E3779B97F4A7C15) + later
        name ^= name >> np.uint64(29)
        name *= np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    at = np.flatnonzero(whole)
    return at, name[at]


def of_host(name: np.ndarray, host: np.ndarray | int) -> np.ndarray:
    """Names told apart by host."""
    mixed = (name ^ np.asarray(host, np.int64).astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def shard(pages: list[tuple[int, bytes]], length: int = REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some pages, given as (hash of the host, ``encoded`` runs), by its runs of neighbours that agree in
    ``length`` tokens: (name, number of distinct pages)."""
    streams = [np.frombuffer(data, "<u8") for _, data in pages]
    owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    at, name = names(np.concatenate(streams) if streams else np.empty(0, np.uint64), length)
    owner = owner[at]
    name = of_host(name, np.array([h for h, _ in pages], np.int64)[owner])
    order = np.lexsort((owner, name))
    name, owner = name[order], owner[order]
    first = np.concatenate(([True], name[1:] != name[:-1]))[: len(name)]
    new = first | np.concatenate(([True], owner[1:] != owner[:-1]))[: len(name)]
    starts = np.flatnonzero(first)
    return name[starts], np.add.reduceat(new.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)


def kept(parts: list[tuple[str, int]], host: int, repeated: set[int], length: int = REPEAT) -> list[str]:
    """The undecided blocks of a page less those that repeated substrings cover wholly. ``repeated``: names."""
    out: list[str] = []
    run: list[tuple[str, int, int]] = []  # block, its first token's place, what markup says

    def end() -> None:
        tokens = [t for b, _, _ in run for t in b.split()]
        covered = np.zeros(len(tokens) + 1, np.int64)
        if len(tokens) >= length:
            at, name = names(np.frombuffer(encoded([tokens]), "<u8"), length)
            for i in at[np.fromiter((n in repeated for n in of_host(name, host).tolist()), bool, len(at))]:
                covered[i : i + length] = 1
        for block, first, kind in run:
            if kind == OPEN and not covered[first : first + len(block.split())].all():
                out.append(block)
        run.clear()

    place = 0
    for block, kind in parts:
        n = len(block.split())
        if kind == CORE or n > LONG:
            end()
            place = 0
            if kind == OPEN:
                out.append(block)
        else:
            run.append((block, place, kind))
            place += n
    end()
    return out


def host_repeats(streams: DataFrame, pages: int = PAGES) -> DataFrame:
    """(name) of the substrings that ``pages`` distinct pages of a host share. ``streams``: (host, page, runs), where ``page`` is the
    hash of a page's whole text and ``runs`` its encoded runs."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        n = 0
        for batch in slices(batches):
            for host, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((host, runs))
                n += len(runs) // 8
                if n >= CHUNK:
                    yield pa.record_batch(list(map(pa.array, shard(held))), names=["name", "n"])
                    held, n = [], 0
        if held:
            yield pa.record_batch(list(map(pa.array, shard(held))), names=["name", "n"])

    distinct = streams.where("length(runs) > 0").groupBy("host", "page").agg(F.min("runs").alias("runs"))
    return distinct.select("host", "runs").mapInArrow(sort, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= pages).select("name")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = PAGES) -> DataFrame:
    """One row a page: id, url, text (blocks joined by two newlines; empty if none), n_chars (its code points).

    A null or empty page has an empty text; null and empty urls are a host of their own. Repeated rows are extracted each; pages
    of equal text count as one page, so copies keep their text, and which of them is counted does not matter. No table's size and
    no order of rows matters to a page's text. An empty table gives no rows. Other columns are not read, whatever their
    names. Long pages are cut and judged whole. Pages that mark their main text need no other page; of the others
    the blocks are kept in the checkpoint folder until the host's array has judged them.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url_col, r"://([^/?#]*)", 1)), F.lit("")))
    shown = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("__html"))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(frames):
            texts, texts_open, kinds = [], [], []
            for page in f.column(3).to_pylist():
                found = blocks(page)
                core = [b for b, k in found if k == CORE]
                undecided = not core and any(k == OPEN for _, k in found)
                texts.append(None if undecided else BETWEEN.join(core))
                texts_open.append([b for b, _ in found] if undecided else None)
                kinds.append([k for _, k in found] if undecided else None)
            yield pa.record_batch([*f.columns[:3], pa.array(texts, pa.string()), pa.array(texts_open, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))], names=["__id", "url", "host", "text", "parts", "kinds"])

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(frames):
            found = [blocks(page) for page in f.column(3).to_pylist()]
            page = [xxhash.xxh3_64_intdigest("\n".join(b for b, _ in p)) - (1 << 63) for p in found]
            runs = [encoded(streams_of(p)) for p in found]
            yield pa.record_batch([f.column(2), pa.array(page, pa.int64()), pa.array(runs, pa.binary())], names=["host", "page", "runs"])

    def windows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(frames):
            held: dict[int, list[int]] = {}
            for place, host, parts, kinds in zip(*(c.to_pylist() for c in f.columns), strict=True):
                runs = np.frombuffer(encoded(streams_of(list(zip(parts, kinds, strict=True)))), "<u8")
                for name in np.unique(of_host(names(runs)[1], host)).tolist():
                    held.setdefault(name, []).append(place)
            yield pa.record_batch([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.list_(pa.int64()))], names=["name", "places"])

    def settle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(frames):
            texts = [BETWEEN.join(kept(list(zip(parts, kinds, strict=True)), host, set(own or ()))) for host, parts, kinds, own in zip(*(c.to_pylist() for c in f.columns[2:]), strict=True)]
            yield pa.record_batch([*f.columns[:2], pa.array(texts, pa.string())], names=["__id", "url", "text"])

    done = shown.mapInArrow(cut, f"__id {kind}, url string, host long, text string, parts array<string>, kinds array<int>")
    undecided = checkpointed(done.where("parts is not null").drop("text").withColumn("place", F.monotonically_increasing_id()))
    decided = done.where("parts is null").select("__id", "url", "text")
    repeated = host_repeats(shown.mapInArrow(gather, "host long, page long, runs binary"), at_least)
    # A name comes once a batch of pages with the places of all of them, so a menu of a large host is no large key.
    own = undecided.select("place", "host", "parts", "kinds").mapInArrow(windows, "name long, places array<long>").join(repeated, "name")
    own = own.select("name", F.explode("places").alias("place")).groupBy("place").agg(F.collect_list("name").alias("own"))
    judged = undecided.join(own, "place", "left").select("__id", "url", "host", "parts", "kinds", "own")
    every = decided.unionByName(judged.mapInArrow(settle, f"__id {kind}, url string, text string"))
    return every.select(F.col("__id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
