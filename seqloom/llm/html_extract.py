"""Main text of web pages: blocks from the markup, then repeated runs from suffix arrays of each host's token streams.

The markup says three things of a block of text: it is in a marked main part (article, main), it is in an element for
something else (menu, footer, form, advert, comments), or neither. What is outside the main parts is a page's token
stream. A host's streams are concatenated, each page ending in a token of its own, their suffixes put in order, and runs
of at least DEPTH tokens found that a share of the host's distinct pages have. What such runs cover is boilerplate; unique
runs stay, unless their element is for something else. A main part's text is the article, whoever repeats it.

A host too large for one suffix array is dealt into chunks of pages. A run that a share of all pages have is had by that
share of some chunk's pages, so the chunks' arrays find every candidate, and a count over all pages decides.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_saved, free_name, saved, with_row_number

#: Tokens that a repeated run has at least; the share of a host's distinct pages, and the pages, that have it at least; tokens in a chunk.
DEPTH, SHARE, PAGES, CHUNK = 8, 0.2, 3, 1 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
#: Elements whose content is never main text; RAW ones hold no markup. A header in a main part is the article's own.
DROPPED = frozenset("nav header footer aside form head title script style noscript template svg math button select textarea iframe object canvas audio video dialog menu".split())
UNSEEN = frozenset("head title script style noscript template svg math button select textarea iframe object canvas audio video".split())
RAW = "script|style|textarea|title|iframe|noscript|template"
#: Words that mark a class, id or role as not main text if nothing else is in it but words of layout.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus replies reply respond related share sharing social toolbar widget pagination".split()
)
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons bottoms card col column container content fixed form global google group holder icons inner item items js left links list lists main mobile outer page panel "
    "post posts primary reader readers region right row secondary section site slot sticky text thread top unit user users wrap wrapper articles stories".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN = frozenset(("article", "main"))

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)|<({RAW})(?=[\s/>])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
OWN_HEAD = frozenset(("header", "masthead"))


def _for_else(name: str, inside: bool) -> bool:
    """Whether a class or id says that an element is for something else than main text; inside: of a main part, whose head is its own."""
    words = set(re.findall("[a-z]+", name.lower()))
    marks = words & DROPPED_WORDS - (OWN_HEAD if inside else frozenset())
    return bool(marks) and all(len(w) == 1 or w in DROPPED_WORDS or w in LAYOUT_WORDS for w in words)


def _judge(tag: str, attrs: str, inside: bool) -> str:
    """unseen, else, main or nothing, from an element's name and attributes; inside: of a main part."""
    names, role = [], ""
    if attrs.strip():
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            value = (a or b or c).lower()
            name = name.lower()
            if name == "role":
                role = value
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "unseen"
            elif name in ("class", "id"):
                names += value.split()
    if tag in MAIN or role == "main":
        return "else" if any(_for_else(x, True) and "header" not in x for x in names) else "main"
    if tag in UNSEEN:
        return "unseen"
    if tag in DROPPED and not (inside and tag == "header") or role in DROPPED_ROLES:
        return "else"
    return "else" if tag not in ("html", "body") and any(_for_else(x, inside) for x in names) else ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of a page's blocks in order; place: m in a marked main part, e in an element for something else, l in neither."""
    stack: list[tuple[str, str]] = []
    open_tags: Counter = Counter()
    depth: Counter = Counter()
    out: list[tuple[str, str]] = []
    piece: list[str] = []

    def end_block() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append(("e" if depth["else"] else "m" if depth["main"] else "l", text))

    def pop() -> None:
        tag, kind = stack.pop()
        open_tags[tag] -= 1
        depth[kind] -= 1

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not depth["unseen"]:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            piece.append(" ")
            continue
        kind = "" if closing else _judge(tag, attrs, depth["main"] > 0)
        if tag in INLINE and not kind and not open_tags[tag]:
            continue
        end_block()
        if closing:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not attrs.endswith("/"):
            if stack and stack[-1][0] == "p" and tag not in INLINE or stack and stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                pop()
            stack.append((tag, kind))
            open_tags[tag] += 1
            depth[kind] += 1
    if at < len(page) and not depth["unseen"]:
        piece.append(page[at:])
    end_block()
    return out


def run_key(tokens: list[str]) -> bytes:
    """128 bits that stand for a run of tokens."""
    return hashlib.blake2b("\x1f".join(tokens).encode(), digest_size=16).digest()


def suffix_classes(streams: list[list[str]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the concatenated streams, to a depth: positions in order, the page of each, and where the prefix of depth tokens changes.

    Each stream ends in a token of its own, so that no prefix of a class runs into the next page; suffixes shorter than
    depth are left out.
    """
    n = np.array([len(s) for s in streams], np.int64)
    number: dict[str, int] = {}
    a = np.empty(int(n.sum()) + len(n), np.int64)
    page = np.repeat(np.arange(len(n)), n + 1)
    at = 0
    for i, s in enumerate(streams):
        a[at : at + len(s)] = [number.setdefault(t, len(number)) for t in s]
        a[at + len(s)] = -1 - i
        at += len(s) + 1
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < depth:  # ranks of h tokens, then of up to twice as many
        step = min(h, depth - h)
        after = np.zeros(len(a), np.int64)
        after[: max(0, len(a) - step)] = rank[step:] + 1
        rank = np.unique(rank * (len(a) + 2) + after, return_inverse=True)[1].astype(np.int64)
        h += step
    order = np.argsort(rank, kind="stable")
    stop = np.repeat(np.cumsum(n + 1) - 1, n + 1)
    order = order[stop[order] - order >= depth]
    r = rank[order]
    return order, page[order], np.flatnonzero(np.diff(r, prepend=-1))


def candidate_runs(streams: list[list[str]], least: int, depth: int = DEPTH) -> list[bytes]:
    """Keys of the runs of depth tokens that at least least of the streams have."""
    order, page, first = suffix_classes(streams, depth)
    if not len(order):
        return []
    starts = np.cumsum([0] + [len(s) + 1 for s in streams])
    # order is stable, so a class's pages rise: each new one counts
    new = np.diff(page, prepend=-1) != 0
    new[first] = True
    pages = np.add.reduceat(new.astype(np.int64), first)
    out = []
    for i in first[pages >= least].tolist():
        at = int(order[i] - starts[page[i]])
        out.append(run_key(streams[page[i]][at : at + depth]))
    return out


def covered(tokens: list[str], keys: set[bytes], depth: int = DEPTH) -> np.ndarray:
    """Which tokens lie in a run of depth tokens whose key is among keys: the union is all that longer repeats cover."""
    edge = np.zeros(len(tokens) + depth + 1, np.int64)
    for i in range(len(tokens) - depth + 1) if keys else ():
        if run_key(tokens[i : i + depth]) in keys:
            edge[i] += 1
            edge[i + depth] -= 1
    return np.cumsum(edge)[: len(tokens)] > 0


def stream_tokens(stream: str) -> list[str]:
    return stream.replace("\n", " ").split(" ") if stream else []


def split_keys(keys: bytes | None) -> set[bytes]:
    return {keys[i : i + 16] for i in range(0, len(keys), 16)} if keys else set()


def repeated_runs(parsed: DataFrame, depth: int = DEPTH, share: float = SHARE, least: int = PAGES, chunk: int = CHUNK) -> DataFrame:
    """host, keys (one after another): runs of depth tokens that enough of a host's distinct streams have. parsed: row, host, stream.

    Enough: at least least pages and that share of the host's. Equal streams are one page.
    """
    own = parsed.where("stream <> ''").select("row", "host", F.md5(F.encode("stream", "UTF-8")).alias("digest"), (F.length("stream") / 6 + 1).cast("long").alias("size"))
    first = saved(own.groupBy("host", "digest").agg(F.min("row").alias("r"), F.min("size").alias("size")))
    need = F.greatest(F.lit(least), F.ceil(F.lit(float(share)) * F.col("pages"))).cast("long")
    hosts = saved(first.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("tokens")).select(F.col("host").alias("h"), "pages", need.alias("need"), F.ceil(F.col("tokens") / chunk).alias("chunks")).where("pages >= need"))
    few = broadcast_if_small(hosts)
    streams = parsed.select("row", "host", "stream").join(first.select("r"), F.col("row") == F.col("r"), "left_semi").join(few, F.col("host") == F.col("h"))
    dealt = streams.withColumn("part", F.pmod(F.xxhash64("row"), "chunks")).groupBy("host", "part").agg(F.collect_list("stream").alias("streams"), F.first("need").alias("need"), F.first("pages").alias("pages"))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for host, texts, need, pages in zip(b["host"], b["streams"], b["need"], b["pages"], strict=True):
                lists = [stream_tokens(x) for x in texts]
                keys = candidate_runs(lists, -(-int(need) * len(lists) // int(pages)), depth)
                yield pd.DataFrame({"host": host, "key": keys}, columns=["host", "key"])

    found = saved(dealt.select("host", "streams", "need", "pages").mapInPandas(candidates, "host string, key binary"))
    of_host = F.array_join(F.collect_set(F.hex("key")), "")
    joined = lambda df: df.groupBy("host").agg(F.unhex(of_host).alias("keys")).withColumnRenamed("host", "kh")
    some = broadcast_if_small(saved(joined(found)))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, stream, keys in zip(b["host"], b["stream"], b["keys"], strict=True):
                tokens, sought = stream_tokens(stream), split_keys(keys)
                rows += [(host, k) for k in {run_key(tokens[i : i + depth]) for i in range(len(tokens) - depth + 1)} & sought]
            yield pd.DataFrame(rows, columns=["host", "key"])

    hits = streams.join(some, F.col("host") == F.col("kh")).select("host", "stream", "keys").mapInPandas(counted, "host string, key binary").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    enough = hits.join(few, F.col("host") == F.col("h")).where("n >= need").select("host", "key")
    out = saved(joined(enough))
    drop_saved(first, hosts, found)
    return out


def assemble(text: str, stream: str, places: str, keys: set[bytes], depth: int = DEPTH) -> str:
    """A page's text without what repeated runs cover outside its main parts."""
    if "l" not in places:
        return text
    gone = covered(stream_tokens(stream), keys, depth)
    kept, at, out = iter(text.split("\n")), 0, []
    outside = iter(stream.split("\n"))
    for place in places:
        tokens = next(outside).split(" ") if place != "m" else []
        if place == "l":
            next(kept)
            part = " ".join(t for t, g in zip(tokens, gone[at : at + len(tokens)], strict=True) if not g)
            out += [part] if part else []
        elif place == "m":
            out.append(next(kept))
        at += len(tokens)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = DEPTH, share: float = SHARE, least: int = PAGES, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of pages: page_id, url, text (blocks joined by \\n; empty if none), n_chars, marked.

    marked: the page marks a main part. A null page is empty; a null or broken URL belongs to the host ''. Ids may be
    null or repeat: rows are told apart by number, and rows whose text outside main parts is equal count as one page of
    their host. Long pages are read whole. Other columns are ignored, whatever their names. An empty table gives an empty
    table.
    """
    row = free_name(pages, "html_row")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)", 1))
    d = with_row_number(pages, row).select(F.col(row).alias("row"), F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    d = d.select("row", "page_id", "url", host.alias("host"), "html")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [blocks(x) if x else [] for x in b.pop("html")]
            b["text"] = ["\n".join([t for place, t in x if place != "e"]) for x in found]
            b["stream"] = ["\n".join([t for place, t in x if place != "m"]) for x in found]
            b["places"] = ["".join([place for place, _ in x]) for x in found]
            yield b

    parsed = saved(d.mapInPandas(parse, "row long, page_id string, url string, host string, text string, stream string, places string"))
    runs = broadcast_if_small(repeated_runs(parsed, depth, share, least, chunk))
    whole = F.instr("places", "l") == 0
    columns = ["page_id", "url", "text", F.contains("places", F.lit("m")).alias("marked")]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [assemble(text, stream, places, split_keys(keys), depth) for text, stream, places, keys in zip(b["text"], b.pop("stream"), b["places"], b.pop("keys"), strict=True)]
            yield b

    loose = parsed.where(~whole).join(runs, F.col("host") == F.col("kh"), "left").select("page_id", "url", "text", "stream", "places", "keys").mapInPandas(clean, "page_id string, url string, text string, places string")
    out = parsed.where(whole).select(*columns).unionByName(loose.select(*columns))
    return out.select(F.col("page_id").cast(pages.schema[id_col].dataType).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "marked")
