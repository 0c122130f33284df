"""Main text of HTML pages, with nearest-URL page differencing.

A page becomes lines, one for each block, that know whether they lie in the marked-up
article, in an element that is no article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments), or in neither. An element within an article whose compound name begins
or ends with a word for such an element (`comments-list`, `cookie-notice`) is doubtful. Every page is paired with its
nearest neighbours of other text by URL path within its host, among the pages that mark up an
article or among those that do not, their lines are aligned by longest common subsequence,
and shared lines are deleted where they stand, doubtful ones included. Markup is the check on that: any
other line of a marked article stays, as text that two articles share is text of both, and a line in an element
beside the article goes.
"""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm.common import map_arrow, partitions, payload, texts_of, written

#: A tag without quotes; the name of any tag, and what may end it.
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)([^<>\"']*)>")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements whose content is no markup, is never article text, stands alone, or
#: begins a new block.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "head", "svg", "button", "select", "option", "dialog", "menu", "object", "canvas", "map", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Words in class, id or role, as whole ones, that name an element beside the article.
WORDS = (
    r"(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|topbar|toolbar|comment|comments|"
    r"commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommended|widget|pagination|pager|contentinfo|complementary|search)"
)
NAMES = re.compile(rf"(?:^|\s){WORDS}(?=\s|$)", re.I)
#: Compound names that begin or end with one of the words; `has-sidebar` and the like speak of another element.
COMPOUND = re.compile(rf"(?:^|\s)(?:{WORDS}[-_]\S*|(?!(?:has|no|with|without)[-_])\S*[-_]{WORDS})(?=\s|$)", re.I)
CONTAINERS = {"div", "section", "ul", "ol", "dl", "center", "details", "li"}
DOUBTFUL, NAMED, ARTICLE, FREE, OTHER = 4, 3, 2, 1, 0
#: The share of a page's characters above which a neighbour that shares them is a version of it.
VERSION = 0.9
#: Cells of an alignment that is traced back at once (a bit each); larger ones are halved first.
CELLS = 1 << 22
#: Pages that lose lines whose keys may go to every task: under 20 MB. More are joined by a shuffle.
BROADCAST = 100_000


def pieces(page: str):
    """The page's texts, decoded, as (None, text, "") and its tags as (name, attributes, slash
    if it closes), in order, without comments and the content of raw elements.

    Linear in the page: a quote that never closes is a character like any other, and from a tag
    that never ends on all is text.
    """
    at, end, known = 0, len(page), "\"'"

    def skipped(word: str) -> int:
        close = re.compile(rf"</{word}\s*+>", re.I).search(page, at)
        return close.end() if close else end

    while at < end:
        found = page.find("<", at)
        if found < 0:
            found = end
        if found > at:
            text = page[at:found]
            yield None, html.unescape(text) if "&" in text else text, ""
        if found == end:
            return
        at = found
        plain = PLAIN.match(page, at)
        if plain:
            slash, word, data = plain.groups()
            word, at = word.lower(), plain.end()
            yield word, data, slash
            if word in RAW and not slash:
                at = skipped(word)
            continue
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            close = page.find(mark, at + 2)
            at = end if close < 0 else close + len(mark)
            continue
        name = NAME.match(page, at + 1)
        if name is None:
            yield None, "<", ""
            at += 1
            continue
        stop = STOP.search(page, name.end())
        while stop and stop[0] != ">":
            close = page.find(stop[0], stop.end()) if stop[0] in known else -1
            if close < 0:
                known = known.replace(stop[0], "")
            stop = STOP.search(page, stop.end() if close < 0 else close + 1)
        if stop is None:
            yield None, html.unescape(page[at:]), ""
            return
        word = name[0].lower()
        slash, word = ("/", word[1:]) if word[0] == "/" else ("", word)
        at = stop.end()
        yield word, page[name.end() : stop.start()], slash
        if word in RAW and not slash:
            at = skipped(word)


def marked(kinds) -> bool:
    """Whether lines of these kinds are of a page that marks up an article."""
    return any(kind in (ARTICLE, DOUBTFUL) for kind in kinds)


def lines_of(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order, white space as one space, with their kind.

    A name counts neither round an article nor, without one, round most of the text. A header
    in an article is its headline.
    """
    out: list[tuple[int, str]] = []
    words: list[str] = []
    # Open elements: name, whether the element began outside text (1), an article (2), a named (3) or
    # a doubtful element (4), and the named ones open round it.
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    outside = inside = named = doubtful = 0
    kind = FREE

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((kind, text))
            words.clear()

    def close() -> str:
        nonlocal outside, inside, named, doubtful
        name, what, named = stack.pop()
        opened[name] -= 1
        outside -= what == 1
        inside -= what == 2
        doubtful -= what == 4
        return name

    for name, data, slash in pieces(page):
        if name is None:
            words.append(data)
            continue
        if name in BLOCK:
            flush()
        elif name in ("td", "th") or name == "br" and not slash:
            words.append(" ")
        if slash:
            if opened.get(name):
                while close() != name:
                    pass
        elif name not in RAW and name not in VOID and not data.endswith("/"):
            what = 0
            if name in OUTSIDE and not (name == "header" and inside):
                what = 1
            elif data and name in CONTAINERS and (names := [v.strip("\"'") for _, v in ATTRIBUTE.findall(data)]):
                if any(NAMES.search(v) for v in names):
                    what = 3
                elif inside and any(COMPOUND.search(v) for v in names):
                    what = 4
            elif name in ("article", "main"):
                what = 2
            # A paragraph or item ends where the next one begins.
            if name in ("p", "li") and stack and stack[-1][0] == name:
                close()
            stack.append((name, what, named))
            opened[name] = opened.get(name, 0) + 1
            outside += what == 1
            inside += what == 2
            doubtful += what == 4
            named = 0 if what == 2 else named + (what == 3)
        kind = OTHER if outside else NAMED if named else (DOUBTFUL if doubtful else ARTICLE) if inside else FREE
    flush()
    text = sum(len(x) for k, x in out if k != OTHER)
    whole = not marked(k for k, _ in out) and 2 * sum(len(x) for k, x in out if k == NAMED) > text
    return [((FREE if whole else OTHER) if k == NAMED else k, x) for k, x in out]


def _rows(a: list[int], b: list[int]):
    """For each prefix of a the bits of b's places that do not lengthen the longest common
    subsequence of the two prefixes (bit-parallel: a few operations on len(b) bits a row)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """The lengths of a longest common subsequence of a and each prefix of b."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence, in order.

    Exact for any lists; memory is in proportion to them beyond CELLS bits, since a longer
    alignment is split where the two halves of a share most with b's parts.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [(i, i) for i in range(head)]
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    waiting = [(head, len(a) - tail, head, len(b) - tail)]
    while waiting:
        i0, i1, j0, j1 = waiting.pop()
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) > CELLS and i1 - i0 > 1:
            middle = (i0 + i1) // 2
            left = _last_row(a[i0:middle], b[j0:j1])
            right = _last_row(a[middle:i1][::-1], b[j0:j1][::-1])[::-1]
            cut = j0 + int(np.argmax(left + right))
            waiting += [(middle, i1, cut, j1), (i0, middle, j0, cut)]
            continue
        rows = list(_rows(a[i0:i1], b[j0:j1]))
        part, i, j = [], i1 - i0, j1 - j0
        while i and j:
            if rows[i] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> j - 1 & 1:
                    j -= 1
                    part.append((i0 + i, j0 + j))
        found += part[::-1]
    return found + ends


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


def _lines(batch):
    found = [lines_of(t) for t in texts_of(batch, "t")]
    return {
        **{c: batch.column(c) for c in ("k1", "k2", "host", "path")},
        "marked": [marked(kind for kind, _ in lines) for lines in found],
        "lines": [[_hash(x) for _, x in lines] for lines in found],
        "sizes": [[len(x) for _, x in lines] for lines in found],
        "kinds": [[kind for kind, _ in lines] for lines in found],
    }


def gone(own: dict, others: list[dict | None]) -> list[int]:
    """Places of the free and doubtful lines that go, being shared with one of the other pages. Pages are
    given by their lines, sizes and kinds.

    A page with nearly all of the text is a version of it and tells nothing. Where no page tells
    anything, the free lines beside a marked article go and its doubtful ones stay, as markup is all
    there is.
    """
    kinds, sizes = own["kinds"], own["sizes"]
    text = sum(n for n, kind in zip(sizes, kinds) if kind != OTHER)
    found, alone = set(), True
    for other in others:
        shared = [i for i, _ in common(own["lines"], other["lines"]) if kinds[i] != OTHER] if other else []
        if other and sum(sizes[i] for i in shared) <= VERSION * text:
            alone = False
            found.update(i for i in shared if kinds[i] in (FREE, DOUBTFUL))
    if alone and marked(kinds):
        found = {i for i, kind in enumerate(kinds) if kind == FREE}
    return sorted(found)


def _shared(pages: DataFrame) -> DataFrame:
    """k1, k2 and shared, the places of the lines to delete, for each page that loses any.

    Pages of a host with the same lines are one, so that the neighbours are of other text. Only
    keys and hashes of lines are sorted, by site and path, in ranges; a range's first page of a
    site looks up the last one of the ranges before, of which there is one a range.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("k1", "k2", _host(url).alias("host"), _path(url).alias("path"), "t")
    schema = "k1 long, k2 long, host string, path string, marked boolean, lines array<long>, sizes array<int>, kinds array<int>"
    page = F.struct("lines", "sizes", "kinds")
    copy = [F.xxhash64("host", "lines", "sizes", "kinds").alias("c1"), F.xxhash64(F.lit("copy"), "kinds", "lines", "sizes", "host").alias("c2")]
    copies = written(map_arrow(rows, _lines, schema).select("k1", "k2", "host", "marked", "path", *copy, page.alias("page")), "page-copies")
    site, place = ["host", "marked"], ["path", "c1", "c2"]
    rows = copies.groupBy("c1", "c2", *site).agg(F.min("path").alias("path"), F.any_value("page").alias("page"))
    ranged = rows.repartitionByRange(partitions(spark), *site, *place).sortWithinPartitions(*site, *place)
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "page-lines")
    order = W.partitionBy("range", *site).orderBy(*place)
    near = ranged.withColumns({"previous": F.lag("page").over(order), "following": F.lead("page").over(order)})
    # One row for each range and site that it holds; a site that spans ranges has few here.
    ends = ranged.groupBy(*site, "range").agg(F.max_by("page", F.struct(*place)).alias("last"), F.min_by("page", F.struct(*place)).alias("first"))
    by_range = W.partitionBy(*site).orderBy("range")
    edges = ends.select(*site, "range", F.lag("last").over(by_range).alias("carried"), F.lead("first").over(by_range).alias("next"))
    paired = near.join(edges, [*site, "range"]).select("c1", "c2", "page", F.coalesce("previous", "carried").alias("previous"), F.coalesce("following", "next").alias("following"))

    def align(batch):
        shared = [gone(own, others) for own, *others in zip(*(batch.column(c).to_pylist() for c in ("page", "previous", "following")))]
        return {"c1": batch.column("c1"), "c2": batch.column("c2"), "shared": shared}

    aligned = map_arrow(paired, align, "c1 long, c2 long, shared array<int>")
    return copies.select("k1", "k2", "c1", "c2").join(aligned.where("size(shared) > 0"), ["c1", "c2"]).select("k1", "k2", "shared").distinct()


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of df: the main text of the whole html.

    Null or empty html has the empty text. Rows that repeat url and html count as one page for
    the pairing. Pages without a host (or url) are paired among themselves. A page that is
    alone on its host keeps its marked article, or without one all lines that no element marks
    as other than text. Other columns
    are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("t"))
    of = [F.coalesce("url", F.lit("")), payload(F.col("t"))]
    rows = rows.withColumns({"k1": F.xxhash64(*of), "k2": F.xxhash64(F.lit("page"), *of[::-1])})
    types = dict(rows.dtypes)
    shared = written(_shared(rows), "page-deletions")
    joined = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST else shared, ["k1", "k2"], "left")

    def run(batch):
        texts = []
        for page, places in zip(texts_of(batch, "t"), batch.column("shared").to_pylist()):
            lines, less = lines_of(page), set(places or ())
            texts.append("\n".join(x for n, (kind, x) in enumerate(lines) if kind != OTHER and n not in less))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": np.array([len(t) for t in texts])}

    return map_arrow(joined.select("page_id", "url", "t", "shared"), run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
