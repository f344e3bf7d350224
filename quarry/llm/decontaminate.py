"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items build one generalised suffix automaton.
A document is streamed through it; the automaton keeps the length of the
longest suffix of the words read so far that occurs in some item, and every
place where that length reaches a window (``window`` words, or a whole shorter
item) marks the window's words as hit.

Only words that occur in an item can move the automaton, so a document is
first cut into runs of such words; runs shorter than the shortest window are
skipped without losing a match.

Size: an automaton is compiled per block of items of at most ``BLOCK_WORDS``
words and broadcast; a larger set of items is read in several blocks against
all documents, and the hits of the blocks are merged per document.

Cases: a null or empty text has no words and is not hit; an item without words
is ignored, a null item id counts as the empty id; equal items both count; repeated rows each get their own result;
an empty item table hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import append_columns, spans, tidied
from .shared import checkpointed

#: Words of items in one automaton (a state takes some hundred bytes).
BLOCK_WORDS = 200_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, words of digits, letters and all characters from U+0080."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    ``mark[state]`` lists (length, items): the windows whose string belongs to
    the state and the items that hold them; ``up[state]`` is the nearest state
    on the suffix path, the state itself excluded, with marks.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        coded = []
        for name, sequence in items:
            if not sequence:
                continue
            self.shortest = min(self.shortest, len(sequence))
            coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence]))
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        marks: list[dict[int, set[str]]] = [{} for _ in self.next]
        for name, sequence in coded:
            size = min(window, len(sequence))
            state = length = 0
            for word in sequence:
                state, length = self.next[state][word], length + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                if length >= size:
                    length = min(length, self.length[state])
                    marks[state].setdefault(size, set()).add(name)
        self.mark = [sorted((n, frozenset(s)) for n, s in m.items()) for m in marks]
        self.up = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            link = self.link[state]
            self.up[state] = link if self.mark[link] else self.up[link]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new = self._state(self.length[last] + 1, {})
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state == -1:
            self.link[new] = 0
        else:
            old = self.next[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._split(state, word, old)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        copy = self._state(self.length[state] + 1, dict(self.next[old]))
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while state != -1 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def runs(self, sequence: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place, word numbers) of the runs that can hold a window."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in sequence), np.int64, len(sequence))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).view(np.int8), [0]])))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                yield start, codes[start:end].tolist()

    def match(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges of a document (sorted, they may overlap) and the items found."""
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        edges, link, size, mark, up = self.next, self.link, self.length, self.mark, self.up
        for start, codes in self.runs(sequence):
            state = length = 0
            for at, word in enumerate(codes, start + 1):
                while state and word not in edges[state]:
                    state = link[state]
                    length = size[state]
                if word in edges[state]:
                    state = edges[state][word]
                    length += 1
                else:
                    length = 0
                if length >= self.shortest:
                    at_state, longest = state, 0
                    while at_state > 0:
                        for n, names in mark[at_state]:
                            if n <= length:
                                longest = max(longest, n)
                                found |= names
                        at_state = up[at_state]
                    if longest:
                        hits.append((at - longest, at))
        return hits, found


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, read through the driver one block of bounded size at a time."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                        F.col(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        sequence = normal_words(row["t"])
        if not sequence:
            continue
        if block and size + len(sequence) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], sequence))
        size += len(sequence)
    if block:
        yield block


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_ranges", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _merge(ranges: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint ranges, flattened to [start, end, start, end, ...]."""
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def find_leaks(df: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``hit_ranges`` (flat word ranges) and ``items`` (found item ids, sorted)."""
    out = None
    for block in item_blocks(items, item_col, item_text_col, block_words):
        # with more than one block, each pass holds one automaton only
        out = _one_block(df, block, window, text_col) if out is None else \
            _one_block(checkpointed(out), block, window, text_col, merge=True)
    return _one_block(df, [], window, text_col) if out is None else out


def _one_block(df: DataFrame, block, window: int, text_col: str, merge: bool = False) -> DataFrame:
    automaton = df.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
    source = df.withColumnsRenamed({f.name: f"__{f.name}" for f in HITS}) if merge else df

    def run(column: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
        match = automaton.value.match
        counts, ranges, names = [], [], []
        for text in column:
            sequence = normal_words(text.as_py())
            hits, found = match(sequence)
            counts.append(len(sequence))
            ranges.append(_merge(hits))
            names.append(sorted(found))
        if merge:
            for i, (r, n) in enumerate(zip(batch.column("__hit_ranges").to_pylist(),
                                           batch.column("__items").to_pylist(), strict=True)):
                ranges[i] = _merge([*zip(r[::2], r[1::2], strict=True),
                                    *zip(ranges[i][::2], ranges[i][1::2], strict=True)])
                names[i] = sorted({*n, *names[i]})
        return [pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int64())),
                pa.array(names, pa.list_(pa.string()))]

    return append_columns(source, text_col, HITS.fields, run).drop(*[f"__{f.name}" for f in HITS])


def hit_count(ranges: Column) -> Column:
    """Words inside flat ``hit_ranges``."""
    signed = F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def remove_leaks(df: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = 0.5,
                 window: int = 10, **options) -> DataFrame:
    """``df`` with the hit spans cut out of the texts; rows covered above ``max_coverage`` go.

    Clean rows keep their text byte for byte.  A span is cut from the first
    byte of its first word to the last byte of its last word.
    """
    columns = df.columns
    marked = find_leaks(df.select("*", F.col(text_col).alias("__whole")), items, text_col="__whole", window=window,
                        **options)
    covered = hit_count(F.col("hit_ranges")) > F.col("n_words") * F.lit(max_coverage)
    marked = marked.where(~((F.size("hit_ranges") > 0) & covered))
    fields = [f for f in marked.schema.fields if f.name in columns]

    def cut(batches):
        for batch in batches:
            texts = []
            column = batch.column(batch.schema.get_field_index(text_col))
            hits = batch.column(batch.schema.get_field_index("hit_ranges"))
            for text, ranges in zip(column, hits, strict=True):
                ranges = ranges.as_py()
                texts.append(_without(text.as_py(), ranges) if ranges else text.as_py())
            arrays = [pa.array(texts, pa.string()) if c == text_col
                      else batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return marked.mapInArrow(tidied(cut), T.StructType([next(f for f in fields if f.name == c) for c in columns]))


def _without(text: str, ranges: list[int]) -> str:
    data = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    starts, ends, _ = spans(word, np.array([0, len(data)]))
    kept, at = [], 0
    for first, last in zip(ranges[::2], ranges[1::2], strict=True):
        kept.append(data[at:starts[first]])
        at = ends[last - 1]
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
