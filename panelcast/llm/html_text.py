"""Main text of web pages: declared articles, and a suffix array per host for what is not declared.

A page's markup gives its blocks of text. Blocks in menus, footers, adverts and the like never belong to
the main text; blocks of an article or main element may. The text of a host's pages forms one suffix
array: its suffixes are sorted across the cluster by host and first tokens, and neighbours that begin alike
in different places are repeats. Text outside declared articles is one token stream per page, with a suffix
at every token; what ``min_pages`` pages share is the host's boilerplate, and pages without a declared article
lose its tokens. A declared article is one stream however many pages copy it, with a suffix at every block;
blocks that ``min_pages`` and more than half of the host's different articles share are boilerplate of the
articles, which lose them. For every page the number of its boilerplate tokens is given.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_IDS, hashed_words, mix, signed, text_slices
from panelcast.session import cut_lineage

RUN = 8
MIN_PAGES = 3

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "template", "xmp", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNWANTED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "audio", "video", "canvas", "head", "fieldset"}
LEVELS = {"main": 1, "article": 2}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "form", "header", "footer", "blockquote", "details", "figure"}
BLOCKS = HOLDERS | UNWANTED | {
    "address", "caption", "center", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "p", "pre", "search",
    "summary", "tbody", "td", "tfoot", "th", "thead", "tr",
}
NO_NAMES = {"html", "body", "main"}
COMMENT_NAMES = {"comment", "comments"}
# class names that say what a page has or lacks beside the element
LAYOUT = re.compile(r"(?:^|\s)(?:no|not|has|have|with|without)[-_][^\s]*")
SOFT = {"form", "fieldset"}
UNWANTED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "related", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}


def _unwanted(name: str, attributes: str, in_main: bool) -> int:
    """2 if an element never belongs to the main text, 1 if a main element in it may, else 0."""
    if name in UNWANTED and name not in SOFT and not (name == "header" and in_main):
        return 2
    found = 1 if name in SOFT else 0
    if not attributes or name in NO_NAMES:
        return found
    names = COMMENT_NAMES if name == "article" else UNWANTED_NAMES
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return 2
        if key in ("class", "id", "role"):
            own = names.intersection(NAME.findall(LAYOUT.sub(" ", value.lower())))
            if own:
                found = 2 if own & COMMENT_NAMES else 1
                if found == 2:
                    return 2
    return found


def blocks(html: str) -> tuple[list[tuple[str, int, bool]], int]:
    """Blocks of a page in order as (text, level, whether in an unwanted element), and the page's level.

    A block's level is 1 in a main element, plus 2 in an article; elements inside unwanted ones do not
    count. The page's level is 2 if it has an article and 1 if it has a main element only, or one with
    more text outside articles than the articles have. White space in a block is one space; character
    references are decoded. Tags that a page leaves open end with what is around them; a tag or comment
    that the page's end cuts off is left out, and so is text in an unwanted element inside a line.

    Where a page has no main element but some in forms or in elements with an unwanted class name, and
    those hold more text than lies outside all unwanted ones, what is around them does not make them unwanted.
    """
    out, declared, wrapped = _blocks(html, False)
    if declared == 0 and wrapped:
        again, level, _ = _blocks(html, True)
        if sum(len(t) for t, at, bad in again if at & level and not bad) > sum(len(t) for t, _, bad in out if not bad):
            return again, level
    return out, declared


def _blocks(html: str, pardon: bool) -> tuple[list[tuple[str, int, bool]], int, bool]:
    """Blocks, level, and whether a main element lies in elements that ``pardon`` would overlook."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, how unwanted it is, its level, unwanted ones it overlooks
    count: dict[str, int] = {}
    inside = [0, 0, 0]  # open elements by level
    soft = hard = inline = declared = 0
    wrapped = False

    def flush() -> None:
        nonlocal text
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, 2 * (inside[2] > 0) + (inside[1] > 0), soft + hard > 0))
            text = []

    def pop(depth: int) -> None:
        nonlocal soft, hard, inline
        while len(stack) > depth:
            name, bad, level, overlooked = stack.pop()
            count[name] -= 1
            soft += overlooked - (bad == 1)
            hard -= bad == 2
            inline -= bad > 0 and name not in BLOCKS
            inside[level] -= 1

    def close_open(names: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                pop(i)
                return
            if stack[i][0] in HOLDERS:
                return

    lower = None
    at, size = 0, len(html)
    while at < size:
        tag = html.find("<", at)
        if tag < 0:
            tag = size
        if tag > at and not inline:
            run = html[at:tag]
            text.append(unescape(run) if "&" in run else run)
        if tag == size:
            break
        following = html[tag + 1:tag + 2]
        if following in ("!", "?"):
            close = "-->" if html.startswith("<!--", tag) else ">"
            end = html.find(close, tag + 1)
            at = end + len(close) if end >= 0 else size
            continue
        if not (following.isascii() and following.isalpha()) and not (following == "/" and html[tag + 2:tag + 3].isascii() and html[tag + 2:tag + 3].isalpha()):
            text.append("<")
            at = tag + 1
            continue
        m = TAG.match(html, tag)
        if m is None:  # a quote left open: up to the next end of a tag
            end = html.find(">", tag)
            if end < 0:
                break
            m = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>").match(html, tag)
        at = m.end()
        name, attributes = m[1].lower(), m[2]
        if following == "/":
            if name in BLOCKS:
                flush()
            if count.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop(i)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not attributes.endswith("/"):
            lower = lower if lower is not None else html.lower() if html.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            end = html.find(">", end)
            at = end + 1 if end >= 0 else size
            continue
        if name in BLOCKS:
            flush()
            if count.get("p"):
                close_open({"p"})
        if name in CLOSES:
            close_open(CLOSES[name])
        if name in VOID:
            continue
        bad, level = _unwanted(name, attributes, inside[1] + inside[2] > 0), LEVELS.get(name, 0)
        overlooked = 0
        if level and soft and not (bad or hard or inline or inside[1] or inside[2]):
            wrapped = True
            overlooked = soft if pardon else 0
        soft -= overlooked
        if bad or soft or hard:
            level = 0
        stack.append((name, bad, level, overlooked))
        count[name] = count.get(name, 0) + 1
        soft += bad == 1
        hard += bad == 2
        inline += bad > 0 and name not in BLOCKS
        inside[level] += 1
        declared |= level
    flush()
    if declared == 3:
        text_of = lambda wanted: sum(len(t) for t, at, bad in out if wanted(at) and not bad)
        declared = 1 if text_of(lambda at: at == 1) > text_of(lambda at: at & 2) else 2
    return out, declared, wrapped


def _article(found: list[tuple[str, int, bool]], level: int) -> str:
    return "\n".join(t for t, at, unwanted in found if at & level and not unwanted)


def _parsed(html: str | None) -> tuple[list[tuple[str, int, bool]], int]:
    return blocks(html) if html else ([], 2)


def _schema(pages: DataFrame, rest: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in ("page_id", "url", "row")) + ", " + rest


def _declared(pages: DataFrame) -> DataFrame:
    """page_id, url, row and text of the pages with a declared main element (or without any html)."""

    def run(batches):
        for batch in batches:
            texts = []
            for html in batch.column(3):
                found, declared = _parsed(html.as_py())
                texts.append(_article(found, declared) if declared else None)
            keep = pa.array([t is not None for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["page_id", "url", "row", "text"]).filter(keep)

    return pages.mapInArrow(run, _schema(pages, "text string"))


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _block_runs(blocks_of: list[str], run_length: int) -> tuple[list[int], list[int | None], list[int]]:
    """Tokens of each block; and per block how its run begins, the fewest whole blocks from it on that hold
    ``run_length`` tokens, as a hash (null at the end, where too few are left), and the number of those blocks."""
    sizes = [t.count(" ") + 1 for t in blocks_of]
    heads, reach = [], []
    for i in range(len(sizes)):
        tokens, end = 0, i
        while end < len(sizes) and tokens < run_length:
            tokens += sizes[end]
            end += 1
        heads.append(_digest("\n".join(blocks_of[i:end]).lower()) if tokens >= run_length else None)
        reach.append(end - i)
    return sizes, heads, reach


def _streams(pages: DataFrame, run_length: int) -> DataFrame:
    """Per page the text outside declared main elements, its blocks and whether one is unwanted by its markup;
    and the declared article as a hash, with the runs that begin at its blocks."""
    kinds = [pa.string(), pa.list_(pa.bool_()), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["page_id", "url", "row", "outside", "unwanted", "declared", "article", "sizes", "heads", "reach"]

    def run(batches):
        for batch in batches:
            rows = []
            for html in batch.column(3):
                found, declared = _parsed(html.as_py())
                outside = [(t, bad) for t, level, bad in found if not level & declared]
                article = [t for t, level, bad in found if level & declared and not bad]
                rows.append(("\n".join(t for t, _ in outside), [bad for _, bad in outside], declared > 0, _digest("\n".join(article)) if article else None, *_block_runs(article, run_length)))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], names=names)

    return pages.mapInArrow(run, _schema(pages, "outside string, unwanted array<boolean>, declared boolean, article long, sizes array<int>, heads array<long>, reach array<int>"))


def _suffixes(streams: DataFrame, run_length: int) -> DataFrame:
    """Hash of host and first tokens, page and position of every suffix long enough."""
    weights = mix(np.arange(1, run_length + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            host, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets in text_slices(batch.column(2)):
                words, ends = hashed_words(data, offsets)
                n = len(words) - run_length + 1
                if n <= 0:
                    continue
                head = np.zeros(n, dtype=np.uint64)
                for j in range(run_length):
                    head += mix(words[j:j + n] * weights[j])
                at = np.arange(n)
                page = np.searchsorted(ends, at, side="right") - 1
                keep = at + run_length <= ends[page + 1]
                at, page = at[keep], page[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(mix(mix(head[at]) ^ host[first + page].view(np.uint64)))), pa.array(row[first + page]), pa.array((at - ends[page]).astype(np.int32))],
                    names=["head", "row", "at"],
                )

    return streams.select("host", "row", "outside").mapInArrow(run, "head long, row long, at int")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """Suffixes that begin like a neighbour on another page; the ends of a batch stay in any case."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            head, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            last = np.r_[first[1:], len(head)] - 1
            keep = row[first] != row[last]
            keep[[0, -1]] = True
            yield batch.filter(pa.array(np.repeat(keep, last - first + 1)))

    return ordered.mapInArrow(run, ordered.schema)


def _article_suffixes(articles: DataFrame, min_pages: int) -> DataFrame:
    """Suffixes at the blocks of a host's different articles, and on how many of them a run must be."""
    hosts = articles.groupBy("host").agg(F.count("*").alias("articles")).where(F.col("articles") >= min_pages)
    least = F.greatest(F.lit(min_pages), F.floor(F.col("articles") / 2) + 1).cast("long")
    runs = articles.join(hosts, "host").select("host", F.col("article").alias("row"), least.alias("least"), F.posexplode("heads").alias("at", "run")).where("run is not null")
    return runs.select(F.xxhash64("host", "run", F.lit("article")).alias("head"), "row", "at", "least", F.lit(True).alias("inside"))


def _boilerplate(suffixes: DataFrame) -> DataFrame:
    """row, whether it is an article, and where a run begins that as many rows of its host have as ``least`` says."""
    suffixes = cut_lineage(suffixes)
    ordered = suffixes.repartitionByRange("head", "row", "at").sortWithinPartitions("head", "row", "at")
    alike = cut_lineage(_neighbours(ordered))
    pages = alike.groupBy("head", "row").agg(F.first("least").alias("least")).groupBy("head").agg(F.count("*").alias("pages"), F.first("least").alias("least"))
    repeated = pages.where("pages >= least").select("head")
    return alike.join(repeated, "head").groupBy("row", "inside").agg(F.collect_set("at").alias("places"))


def _left_out(articles: DataFrame) -> DataFrame:
    """article, places of its boilerplate blocks and their tokens, of articles (article, sizes, reach, places).

    An article that is boilerplate for more than half is an edited copy of others, and stays whole.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for article, sizes, reach, places in zip(*(c.to_pylist() for c in batch.columns)):
                cut = sorted({p + i for p in places for i in range(reach[p])})
                tokens = sum(sizes[p] for p in cut)
                if 2 * tokens <= sum(sizes):
                    rows.append((article, cut, tokens))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.int64()))], names=["article", "cut", "tokens"])

    return articles.select("article", "sizes", "reach", "places").mapInArrow(run, "article long, cut array<int>, tokens long")


def _unique_runs(rows: DataFrame, run_length: int) -> DataFrame:
    """page_id, url, row and text of pages without a declared article: blocks without their covered tokens."""

    def run(batches):
        for batch in batches:
            texts = []
            for outside, unwanted, places in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                covered = {p + j for p in places or () for j in range(run_length)}
                kept, n = [], 0
                for block, bad in zip(outside.split("\n") if outside else (), unwanted):
                    tokens = block.split(" ")
                    if not bad:
                        left = " ".join(t for j, t in enumerate(tokens, n) if j not in covered)
                        if left:
                            kept.append(left)
                    n += len(tokens)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["page_id", "url", "row", "text"])

    return rows.mapInArrow(run, _schema(rows, "text string"))


def _covered(places, run_length: int):
    """Number of tokens in runs of ``run_length`` that begin at the positions ``places``."""
    ordered = F.array_sort(places)
    first = F.slice(ordered, 1, F.size(ordered) - 1)
    steps = F.zip_with(first, F.slice(ordered, 2, F.size(ordered) - 1), lambda a, b: F.least(b - a, F.lit(run_length)))
    return F.aggregate(steps, F.lit(run_length), lambda total, step: total + step).cast("long")


def main_text(pages: DataFrame, run_length: int = RUN, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate for every row of ``pages``.

    The text is that of the page's article or main elements without unwanted elements and without blocks
    that the host repeats: runs of whole blocks, of ``run_length`` tokens or more, that ``min_pages`` and more
    than half of its different articles share (copies of an article count once; an article that would lose
    more than half stays whole). In pages that declare none, it is that of all blocks without unwanted
    elements and without runs of ``run_length`` tokens or more that ``min_pages`` pages of the host share.
    ``n_boilerplate`` counts the tokens of such runs outside declared elements, and of the blocks left out
    of articles. Null and empty html give an empty text. Pages without url share one host. Rows that repeat
    an id stay; rows alike in all three columns count as one page. Other columns of ``pages`` are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(id_col, url_col, html_col).alias("row"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    streams = _streams(rows, run_length).withColumn("host", F.xxhash64(host))
    # an article is known by its host and text: pages that copy it are one
    streams = cut_lineage(streams.withColumn("article", F.when(F.col("article").isNotNull(), F.xxhash64("host", "article"))))
    articles = streams.where("article is not null").select("host", "article", "sizes", "heads", "reach").dropDuplicates(["article"])
    suffixes = _suffixes(streams, run_length).withColumns({"least": F.lit(min_pages).cast("long"), "inside": F.lit(False)})
    found = cut_lineage(_boilerplate(suffixes.unionByName(_article_suffixes(articles, min_pages))))
    places = found.where("not inside").select("row", "places")
    out = _declared(rows)
    open_pages = streams.where("not declared")
    if not open_pages.isEmpty():
        out = out.union(_unique_runs(open_pages.join(places, "row", "left").select("page_id", "url", "row", "outside", "unwanted", "places"), run_length))
    cuts = _left_out(articles.join(found.where("inside").select(F.col("row").alias("article"), "places"), "article"))
    cuts = streams.where("article is not null").select("row", "article").join(cuts, "article").select("row", F.lit(None).cast("long").alias("covered"), "tokens", "cut")
    outside = places.select("row", _covered(F.col("places"), run_length).alias("covered"), F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("array<int>").alias("cut"))
    counts = outside.unionByName(cuts).groupBy("row").agg(F.max("covered").alias("covered"), F.max("tokens").alias("tokens"), F.first("cut", ignorenulls=True).alias("cut"))
    counts = cut_lineage(counts.select("row", (F.coalesce("covered", F.lit(0)) + F.coalesce("tokens", F.lit(0))).alias("n_boilerplate"), "cut"))
    # a number per page with boilerplate: sent along up to a counted bound, so that texts are not shuffled
    texts = out.join(F.broadcast(counts) if counts.count() <= BROADCAST_IDS else counts, "row", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("cut", i))
    texts = texts.withColumn("text", F.when(F.col("cut").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.coalesce("n_boilerplate", F.lit(0)).alias("n_boilerplate"))
