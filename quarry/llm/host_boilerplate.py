"""Main text of web pages by what repeats on their host.

A page is cut into blocks of text with the path of its markup, and the words
of all visible blocks of a part of the pages become one token stream.  Its
suffix array, sorted by host and then by words, has equal runs of
``min_words`` words (or whole shorter blocks) beside each other; each group of
suffixes with such a common prefix counts the distinct pages it is on.  Every
run is compared with those of all other parts: first the leading bits of the
runs, packed, meet in slices, and each part gets back those that another part
has too (equal bits of different runs only send a run on for nothing).  Then the
groups of these runs, and of runs on several pages of a part, meet whole, packed
and in slices again, and each part gets back those on several pages and on how
many, to compare with the pages of the host.

A block is repeated if more than half of its runs are, all of them counted.  Markup is one more
witness: blocks that it names chrome (menus, headers, footers, notices, ...)
go.  A marked article (``article``, ``main``) rules the page if it holds at
least half of the words that are neither chrome nor repeated; then the page is
its article less what more than half of the host's pages have, as a paragraph
that some other article has too is still its text.  Any other page is its
blocks that aren't repeated.  A page of which more words are repeated on few
pages than are its own is a copy of another (a print version, say) and keeps
them.

Cases: a null or empty page, or one of markup only, has the empty text; a
broken page is read as far as it goes (an unclosed element ends with its
parent, a tag or comment that never ends swallows the rest); character references are decoded once, unknown ones stay; a null or
odd url counts as the host ""; repeated rows count as one page for the search
and each get their row; other columns are not read.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import flat, mix, slices, tidied, tidied_groups, words
from .shared import shared_folder

# Element names of HTML by what they do to the text.
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup
option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("""head title script style template noscript iframe object svg math canvas audio video select
textarea button datalist""".split())
_CHROME = frozenset("nav header footer aside form menu dialog search".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_ARTICLE = frozenset("article main".split())
_PAGE = frozenset("html body".split())
#: Words in class, id and role attributes that name something else than the article's text; not on html, body, main
#: and article, nor on an element around an article.
_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment
comments consent cookie cookies disclaimer footer header login masthead menu menus modal nav navbar navigation
newsletter notice notices pager pagination popup promo promoted related share sharing sidebar sidebars signup social
sponsor sponsored subscribe toolbar widget widgets disqus complementary contentinfo replies""".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or begins a quoted value in it.
_END = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^\W_]+")
_NO_DISPLAY = re.compile(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: An element that ends where one of these begins, if it is open in the same parent.
_CLOSES = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"},
           "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

ARTICLE, CHROME, OTHER = 0, 1, 2


def tags(page: str):
    """(start, end, closing, name, attributes) of the tags and comments (without a name) of a page,
    each character looked at a bounded number of times."""
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
            yield at, end, False, "", ""
        else:
            name, end = _NAME.match(page, at), at + 1
            if name:
                end = name.end()
                while True:
                    mark = _END.search(page, end)
                    if mark is None or mark[0] == ">":
                        end = mark.end() if mark else len(page) + 1
                        break
                    end = page.find(mark[0][-1], mark.end()) + 1
                    if not end:  # a value that never ends
                        end = len(page) + 1
                        break
                end = (yield at, min(end, len(page)), bool(name[1]), name[2].lower(), page[name.end():end - 1]) or end
        at = page.find("<", end)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the visible blocks in page order; white space within a block is one space."""
    found: list[tuple[str, int]] = []
    if not page:
        return found
    parts: list[str] = []
    # open elements: name, whether hidden, chrome, inside an article, number of the innermost tag that names it chrome
    stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, -1)]
    open_: Counter[str] = Counter()
    parents: list[int] = []  # of naming tags: the naming tag around each
    around: set[int] = set()  # naming tags of elements that hold an article
    naming: list[int] = []  # of the found blocks

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, _, chrome, article, names = stack[-1]
                found.append((text, CHROME if chrome else ARTICLE if article else OTHER))
                naming.append(names)
            parts.clear()

    def close(depth: int) -> None:
        open_.subtract(e[0] for e in stack[depth:])
        del stack[depth:]

    at, reader = 0, tags(page)
    tag = next(reader, None)
    while tag:
        start, end, closing, name, attributes = tag
        if not stack[-1][1]:
            parts.append(page[at:start])
        at, jump = end, None
        if closing:
            if open_[name] > 0:
                depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name)
                if name in _BLOCK or any(e[0] in _BLOCK for e in stack[depth:]):
                    flush()
                close(depth)
        elif name == "br":
            parts.append(" ")
        elif name:
            if name in _BLOCK:
                flush()
                if any(open_[k] > 0 and name in ends for k, ends in _CLOSES.items()):
                    ended = _ended(stack, name)
                    if ended:
                        close(ended)
            if not (name in _VOID or attributes.endswith("/") and name not in _BLOCK):
                _, hidden, chrome, article, names = stack[-1]
                hidden = hidden or name in _HIDDEN or bool(_NO_DISPLAY.search(attributes))
                if not chrome:
                    # the head of an article is the article's
                    chrome = name in _CHROME and not (name == "header" and article)
                if name in _ARTICLE and not article:
                    above = names
                    while above >= 0 and above not in around:
                        around.add(above)
                        above = parents[above]
                elif name not in _ARTICLE and name not in _PAGE and _named(attributes):
                    parents.append(names)
                    names = len(parents) - 1
                if hidden and not stack[-1][1]:
                    flush()
                stack.append((name, hidden, chrome, article or name in _ARTICLE, names))
                open_[name] += 1
                if name in _RAW:
                    raw = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, end)
                    at = jump = raw.start() if raw else len(page)
        tag = _next(reader, jump)
    if not stack[-1][1]:
        parts.append(page[at:])
    flush()
    named = [False]  # whether a naming tag, or one around it, makes its blocks chrome
    for i, parent in enumerate(parents):
        named.append(i not in around or named[parent + 1])
    return [(text, CHROME if named[n + 1] else kind) for (text, kind), n in zip(found, naming, strict=True)]


def _next(reader, jump: int | None):
    """The next tag, from ``jump`` on if it is given."""
    try:
        return next(reader) if jump is None else reader.send(jump)
    except StopIteration:
        return None


def _ended(stack: list[tuple[str, bool, bool, bool, int]], name: str) -> int:
    """Place in the stack of the element that the start of ``name`` ends, or 0."""
    for depth in range(len(stack) - 1, 0, -1):
        open_name = stack[depth][0]
        if name in _CLOSES.get(open_name, ()):
            return depth
        if open_name in _BLOCK:
            return 0
    return 0


def _named(attributes: str) -> bool:
    """Whether a whole word of class, id or role is a name of chrome, or joins such names only (cookie-notice)."""
    if "=" not in attributes:
        return False
    return any(_NAMES.issuperset(_PARTS.findall(word)) for m in _ATTRIBUTE.finditer(attributes)
               for word in m[m.lastindex].lower().split() if _PARTS.search(word))


def suffix_array(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes by their first ``width`` codes, or a few more, by prefix
    doubling or tripling; suffixes that are equal so far share a rank."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank, done, order = rank.astype(np.int64), 1, None
    while done < width:
        bits = (int(rank.max(initial=0)) + 1).bit_length()
        key, reach = rank + 1, done
        while reach < width and (reach == done or (reach // done + 1) * bits < 64):  # as many ranks as a key holds
            step = min(reach, width - done)  # the last one may overlap
            key, reach = key << bits, step + done
            key[:max(n - step, 0)] += rank[step:] + 1
        order = np.argsort(key)
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) > 0)
        done = reach
    return np.argsort(rank) if order is None else order, rank


class Stream:
    """The words of all blocks of some pages as one stream of codes that host and word decide."""

    def __init__(self, table: pa.Table | pa.RecordBatch, min_words: int) -> None:
        pages = _whole(table.column("blocks"))
        self.page = np.repeat(np.arange(len(pages)), pages.value_lengths().to_numpy())  # of each block
        self.words, self.block = words(*flat(pages.flatten()))
        self.host = _whole(table.column("host_code")).to_numpy().view(np.uint64)[self.page[self.block]]
        self.page_code = _whole(table.column("page_code")).to_numpy()[self.page[self.block]]
        n = len(self.words)
        self.per_block = np.bincount(self.block, minlength=len(self.page))
        first = np.concatenate([[0], np.cumsum(self.per_block)])[:-1]
        place = np.arange(n) - first[self.block]
        #: words of the run that starts at each word; 0 where a block is too near its end
        self.length = np.where(place <= np.maximum(self.per_block[self.block] - min_words, 0),
                               np.minimum(self.per_block[self.block], min_words), 0)
        code = mix(self.words + mix(self.host))
        # one odd factor for each place in a run
        factor = mix(np.arange(1, min_words + 1, dtype=np.uint64)) | np.uint64(1)
        run = np.zeros(n, np.uint64)
        for k in range(min_words):
            run[:max(n - k, 0)] += code[k:] * factor[k]
        short = np.flatnonzero((self.length > 0) & (self.length < min_words))  # whole blocks
        run[short] = 0
        for k in range(min_words):
            inside = short[k < self.length[short]]
            run[inside] += code[inside + k] * factor[k]
        self.run, self.code = np.where(self.length > 0, mix(run + self.length.astype(np.uint64)), np.uint64(0)), code

    @cached_property
    def chosen(self) -> np.ndarray:
        """Whether a run is the least of the next ``SAMPLE`` runs of its block, from some place on:
        a sketch that equal stretches share. The extraction looks at all runs."""
        n = len(self.run)
        starts = np.flatnonzero(self.length > 0)
        chosen = np.zeros(n, bool)
        if not len(starts):
            return chosen
        value, block = self.run[starts], self.block[starts]
        best = np.arange(len(starts))
        for k in range(1, SAMPLE):
            other = np.minimum(np.arange(len(starts)) + k, len(starts) - 1)
            better = (block[other] == block) & (value[other] < value[best])
            best = np.where(better, other, best)
        # a window that reaches over the end of its block chooses only in blocks shorter than a window
        n_runs = np.bincount(block, minlength=len(self.page))
        first = np.searchsorted(block, block)
        whole = np.arange(len(starts)) - first <= np.maximum(n_runs[block] - SAMPLE, 0)
        chosen[starts[np.unique(best[whole])]] = True
        return chosen

    def groups(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, host, least page, distinct pages) of each group of equal runs, from the suffix array."""
        # a code of its own after each block keeps runs inside blocks
        n = len(self.words)
        at = np.arange(n) + self.block
        stream = np.zeros(n + len(self.page), np.uint64)
        gaps = np.ones(len(stream), bool)
        gaps[at] = False
        stream[at] = self.code
        stream[gaps] = mix(np.flatnonzero(gaps).astype(np.uint64) + np.uint64(1 << 62))
        order, rank = suffix_array(stream, min_words)
        place = np.full(len(stream), -1, np.int64)
        place[at] = np.arange(n)
        word = place[order]
        order, word = order[word >= 0], word[word >= 0]
        use = self.length[word] > 0
        order, word = order[use], word[use]
        if not len(word):
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z.astype(np.uint64), z, z
        group = rank[order]
        # shorter blocks are runs by themselves; their suffixes end at a gap
        short = self.length[word] < min_words
        group[short] = len(stream) + np.unique(self.run[word[short]], return_inverse=True)[1]
        one = np.zeros(group.max() + 1, np.int64)
        one[group] = word
        pages, page = np.unique(self.page_code[word], return_inverse=True)
        pairs = distinct(group * len(pages) + page)
        group = pairs // len(pages)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        one = one[group[first]]
        return self.run[one], self.host[one], pages[pairs[first] % len(pages)], np.diff(first, append=len(pairs))

    def counts(self, runs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each word the ``n`` of the run that starts there, 0 if it isn't among ``runs`` or none starts."""
        found = np.zeros(len(self.run), np.int64)
        if len(runs):
            at = np.flatnonzero(self.length > 0)
            at, order = at[np.argsort(self.run[at])], np.argsort(runs)
            runs, n = runs[order], n[order]
            place = np.minimum(np.searchsorted(runs, self.run[at]), len(runs) - 1)
            found[at] = np.where(runs[place] == self.run[at], n[place], 0)
        return found

    def mostly(self, hit: np.ndarray) -> np.ndarray:
        """For each block whether more than half of its runs start at a word that is ``hit``."""
        at = np.flatnonzero(self.length > 0)
        hits = np.bincount(self.block[at], weights=hit[at], minlength=len(self.page))
        return 2 * hits > np.bincount(self.block[at], minlength=len(self.page))


def distinct(codes: np.ndarray) -> np.ndarray:
    """The values, sorted."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some sorted codes are among others that are sorted too."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def main_text(found: list[tuple[str, int]], repeated: list[bool], wide: list[bool]) -> str:
    """The text of a page from its blocks, those that are repeated and those that most of the host's pages have."""
    size = [len(text.split()) for text, _ in found]
    body = [k for k, (_, kind) in enumerate(found) if kind != CHROME]
    own = sum(size[k] for k in body if not repeated[k])
    copied = sum(size[k] for k in body if repeated[k] and not wide[k])
    article = [k for k in body if found[k][1] == ARTICLE]
    beside = sum(size[k] for k in body if found[k][1] == OTHER and not repeated[k])
    if article and sum(size[k] for k in article) >= beside:
        kept = [k for k in article if not wide[k]] or article
    else:
        kept = [k for k in body if not repeated[k] or copied > own and not wide[k]]
    return "\n".join(found[k][0] for k in kept)


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                          T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())])
PARSED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("host_code", T.LongType()), T.StructField("page_code", T.LongType()),
                       T.StructField("blocks", T.ArrayType(T.StringType())),
                       T.StructField("kinds", T.ArrayType(T.ByteType())), T.StructField("part", T.LongType())])

RUNS = [("slice", pa.int64()), ("of", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()),
        ("n_pages", pa.int64()), ("pages", pa.binary()), ("page", pa.binary())]

#: Bytes of raw pages, and pages, that are searched together, about.
PART = 1 << 23
PART_PAGES = 1 << 13
#: Of so many neighbouring runs of a block ``Stream.chosen`` has one at least.
SAMPLE = 32
#: Leading bits of a run that stand for it first: so many, and as many more as the number of parts has.
LEADING = 26
#: Slices of the runs by their leading bits, at least; and parts for each slice, so that one slice has the runs of so many.
SLICES, PARTS_PER_SLICE = 64, 4
#: A block is on most pages of its host if more than half of them, and no fewer than these, have it.
WIDE_PAGES = 5


def parsed_pages(rows: DataFrame) -> DataFrame:
    """The blocks of all pages, each row in a part, written in buckets by part: what
    meets the pages by part comes to them."""
    def run(batches):
        part, size, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            _, offsets = flat(batch.column("html"))
            for a, b in slices(offsets):
                if size >= PART or n >= PART_PAGES:
                    part, size, n = part + 1, 0, 0
                size, n = size + int(offsets[b] - offsets[a]), n + b - a
                some = batch.slice(a, b - a)
                found = [blocks(page) for page in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in ("page_id", "url", "host_code", "page_code")],
                     pa.array([[text for text, _ in f] for f in found], pa.list_(pa.string())),
                     pa.array([[kind for _, kind in f] for f in found], pa.list_(pa.int8())),
                     pa.array(np.full(b - a, part))], names=PARSED.names)

    spark = rows.sparkSession
    name = f"host_pages_{uuid.uuid4().hex}"
    (rows.mapInArrow(tidied(run), PARSED).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
     .option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as their differences, byte plane by byte plane."""
    planes = np.ascontiguousarray(np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` codes of ``packed``."""
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def compact(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.itemsize]) + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def uncompact(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``compact``."""
    return np.frombuffer(pa.decompress(data[1:], data[0] * n, codec="zstd", asbytes=True), f"u{data[0]}").astype(np.int64)


def _unpacked_all(table: pa.Table) -> list[np.ndarray]:
    return [unpacked(data, n) for data, n in zip(table.column("codes").to_pylist(), table.column("n").to_pylist(), strict=True)]


def _sliced(codes: np.ndarray, width: int, depth: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of sorted codes of ``width`` bits by their first ``depth`` bits."""
    bounds = np.arange(1 << depth, dtype=np.uint64) << np.uint64(width - depth)
    cuts = np.append(np.searchsorted(codes, bounds), len(codes)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def shared_codes(pages: DataFrame, min_words: int, width: int, depth: int) -> DataFrame:
    """(of, n, codes): for each part the leading ``width`` bits of those of its runs whose bits
    another part has too, in up to 2 ^ ``depth`` rows."""
    def run(table: pa.Table) -> pa.Table:
        stream = Stream(table, min_words)
        codes = distinct(stream.run[stream.length > 0] >> np.uint64(64 - width))
        rows = [(k, codes[a:b]) for k, a, b in _sliced(codes, width, depth)]
        return pa.table([pa.array([k for k, _ in rows], pa.int64()),
                         pa.array([table.column("part")[0].as_py()] * len(rows), pa.int64()),
                         pa.array([len(c) for _, c in rows], pa.int64()),
                         pa.array([packed(c) for _, c in rows], pa.binary())], names=["slice", "of", "n", "codes"])

    def meet(table: pa.Table) -> pa.Table:
        each = _unpacked_all(table)
        codes = np.sort(np.concatenate(each))
        several = distinct(codes[1:][codes[1:] == codes[:-1]])
        each = [c[among(c, several)] for c in each]
        return pa.table([table.column("of"), pa.array([len(c) for c in each], pa.int64()),
                         pa.array([packed(c) for c in each], pa.binary())], names=["of", "n", "codes"])

    return (pages.select("part", "host_code", "page_code", "blocks").groupBy("part")
            .applyInArrow(tidied_groups(run), "slice long, of long, n long, codes binary")
            .groupBy("slice").applyInArrow(tidied_groups(meet), "of long, n long, codes binary"))


def page_runs(pages: DataFrame, min_words: int) -> DataFrame:
    """(slice, of, n, codes, counts, n_pages, pages, page): the runs of each part that are on several pages there or
    that another part may have too, how many pages have each, and the page if it is one (a place among ``pages``)."""
    parts = pages.select("part").distinct().count()
    width = min(LEADING + parts.bit_length(), 63)
    depth = (max(SLICES, parts // PARTS_PER_SLICE) - 1).bit_length()

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        code, _, page, n = Stream(table, min_words).groups(min_words)
        order = np.argsort(code)
        code, page, n = code[order], page[order], n[order]
        also = np.sort(np.concatenate([np.zeros(0, np.uint64), *_unpacked_all(shared)]))
        on = (n > 1) | among(code >> np.uint64(64 - width), also)
        code, page, n = code[on], page[on], n[on]
        part = table.column("part")[0].as_py() if table.num_rows else 0
        rows = []
        for k, a, b in _sliced(code, 64, depth):
            known, place = np.unique(page[a:b][n[a:b] == 1].view(np.uint64), return_inverse=True)
            rows.append((k, part, b - a, packed(code[a:b]), compact(n[a:b]), len(known), packed(known), compact(place)))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(RUNS)], [name for name, _ in RUNS])

    return (pages.select("part", "host_code", "page_code", "blocks").groupBy("part")
            .cogroup(shared_codes(pages, min_words, width, depth).groupBy("of"))
            .applyInArrow(tidied_groups(run), "slice long, of long, n long, codes binary, counts binary, n_pages long, pages binary, page binary"))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(of, n, codes, counts): for each part those of its runs that are on several pages, and on how many."""
    def meet(table: pa.Table) -> pa.Table:
        each = _unpacked_all(table)
        counts, pages = [], []
        for row in table.select(["n", "counts", "n_pages", "pages", "page"]).to_pylist():
            n = uncompact(row["counts"], row["n"])
            page = np.zeros(len(n), np.uint64)
            single = n == 1
            page[single] = unpacked(row["pages"], row["n_pages"])[uncompact(row["page"], int(single.sum()))]
            counts.append(n)
            pages.append(page)
        code, n, page = np.concatenate(each), np.concatenate(counts), np.concatenate(pages)
        order = np.argsort(code)
        group = np.cumsum(np.append(False, np.diff(code[order]) > 0))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        n, page = n[order], page[order]
        several = ((np.maximum.reduceat(n, first) > 1) | (np.minimum.reduceat(page, first) < np.maximum.reduceat(page, first)))
        found = np.zeros(len(code), np.int64)
        found[order] = np.where(several, np.add.reduceat(n, first), 0)[group]
        rows = []
        for of, codes, total in zip(table.column("of").to_pylist(), each, np.split(found, np.cumsum([len(c) for c in each])[:-1]), strict=True):
            on = total > 0
            if on.any():
                rows.append((of, int(on.sum()), packed(codes[on]), compact(total[on])))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["of", "n", "codes", "counts"])

    return runs.groupBy("slice").applyInArrow(tidied_groups(meet), "of long, n long, codes binary, counts binary")


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_words: int = 6) -> DataFrame:
    """(page_id, url, text, n_dropped): the main text and the number of blocks left out."""
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = rows.withColumn("host_code", F.xxhash64(host)).withColumn("page_code", F.xxhash64("page_id"))
    pages = parsed_pages(rows)
    back = repeated_runs(page_runs(pages, min_words))
    # pages of each host over all parts, for the parts that have some
    hosts = pages.select("host_code", "page_code").distinct().groupBy("host_code").agg(F.count(F.lit(1)).alias("n_host"))
    hosts = pages.select(F.col("part").alias("of"), "host_code").distinct().join(hosts, "host_code")
    back = back.unionByName(hosts, allowMissingColumns=True)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        stream = Stream(table, min_words)
        is_host = known.column("host_code").is_valid()
        hosts, runs = known.filter(is_host), known.filter(pc.invert(is_host))
        n = stream.counts(np.concatenate([np.zeros(0, np.uint64), *_unpacked_all(runs)]),
                          np.concatenate([np.zeros(0, np.int64), *(uncompact(data, n) for data, n in zip(
                              runs.column("counts").to_pylist(), runs.column("n").to_pylist(), strict=True))]))
        host, of_host = hosts.column("host_code").to_numpy().view(np.uint64), hosts.column("n_host").to_numpy()
        order = np.argsort(host)
        of_host = of_host[order][np.searchsorted(host[order], stream.host)]
        wide = (n >= WIDE_PAGES) & (2 * n > of_host)
        flags = iter(zip(stream.mostly(n > 0).tolist(), stream.mostly(wide).tolist(), strict=True))
        texts, left_out = [], []
        for page, kinds in zip(table.column("blocks").to_pylist(), table.column("kinds").to_pylist(), strict=True):
            found = list(zip(page, kinds, strict=True))
            marks = [next(flags) for _ in found]
            text = main_text(found, [again for again, _ in marks], [most for _, most in marks])
            texts.append(text)
            left_out.append(len(found) - (text.count("\n") + 1 if text else 0))
        return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string()),
                         pa.array(left_out, pa.int64())], names=EXTRACTED.names)

    return pages.groupBy("part").cogroup(back.groupBy("of")).applyInArrow(tidied_groups(run), EXTRACTED)
