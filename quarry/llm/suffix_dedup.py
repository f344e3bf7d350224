"""Exact removal of repeated byte strings by a sampled, range-partitioned suffix sort.

Every byte that a string of ``MATCH`` bytes covers goes if that string also
starts earlier: in a smaller key, or before it in the same text.  Strings are
compared on the input and never cross texts.

Sorting every suffix of the corpus would move each byte many times over, so
the suffixes that are sorted start at content-defined anchors.  The least hash
of the ``ANCHOR``-byte strings inside a window of ``MATCH`` bytes depends on
the window's bytes only; equal windows have equal anchors.  Consecutive
windows with the same anchor form a run (about 35 windows), which stands for
the suffix at the anchor with its left context.

1. Splitters sampled from the anchors' leading codes range-partition the runs;
   an anchor that fills several ranges is dealt over them by key.  A bucket is
   sorted by multikey quicksort: by anchor, ties by the hash of the run's
   bytes, then by key and place.  A run equal to an earlier one is repeated as
   a whole, a run alone with its anchor is not.  What is left open are the
   first runs of anchors with different bytes around them, runs that hold
   their anchor twice, and the first runs of anchors whose group may go on in
   the next bucket.
2. The windows of open runs are compared as 100-byte suffixes: their leading
   eight bytes and the hash of the rest, range-partitioned by sampled
   splitters after each task has kept the first of equal windows; the first of
   each group stays, the others are repeated.
3. Repeated windows are merged per text and cut out.

Equality is by two independent 64-bit codes.

Cases: a null text is empty; a text shorter than ``MATCH`` bytes is kept
whole; rows without a key come last, in one text's place; rows that share a
key are one text: equal strings at the same place in both are the same
occurrence, and each row gets the result for its own bytes; an empty table
gives no rows; other columns are read only to be carried along.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import let_go

from .buffers import BYTE64, flat, mix, range_hash, slices, tidied
from .shared import checkpointed

MATCH = 100
ANCHOR = 32
WINDOWS = MATCH - ANCHOR + 1
#: Longest run; longer ones (periodic text) are cut.
RUN = 256
#: Rows of a bucket that one task sorts, about.
BUCKET = 400_000
NO_KEY = (1 << 63) - 1
#: Bytes of text cut into runs at once; an array operation holds about a hundred bytes for each.
PART = 1 << 18

_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                 0xFF51AFD7ED558CCD)]


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> np.ndarray:
    """Code of the ``ANCHOR`` bytes from each place."""
    code, width = BYTE64[data], 1
    for step in _STEPS:
        code = code[:-width] * step + code[width:]
        width *= 2
    return mix(code)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor code, hash of the bytes, whether the anchor comes twice)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < MATCH:
        return none
    code = anchors(data)
    least = _slide(code, WINDOWS, np.minimum)  # one for each place that has MATCH bytes after it
    places = np.arange(len(least))
    edge = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= MATCH)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - MATCH + 1, -1)
    valid = np.cumsum(edge[:len(least)]) > 0
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[long]] = True
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | starts_text[1:len(least)] | ~valid[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    last_valid = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~new[1:], [False]]))
    size = last_valid - first + 1
    if (size > RUN).any():
        pieces = -(-size // RUN)
        begin = np.repeat(first, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(np.repeat(first + size, pieces) - begin, RUN)
        first = begin
    # places that are the least of some valid window, to find anchors that come twice in a run
    shown = np.where(valid, least, 0)
    greatest = _slide(np.concatenate([np.zeros(WINDOWS - 1, np.uint64), shown, np.zeros(WINDOWS - 1, np.uint64)]),
                      WINDOWS, np.maximum)
    hit = np.flatnonzero(code == greatest[:len(code)])
    low, high = np.searchsorted(hit, first), np.searchsorted(hit, first + size - 1 + WINDOWS)
    many = high - low
    of = np.repeat(np.arange(len(first)), many)
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = np.bincount(of, weights=code[hit[at]] == least[first[of]], minlength=len(first))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, size, least[first], range_hash(data)(first, first + size + MATCH - 1), found > 1


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys: quicksort by the first, then, within its ties only, by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    if len(keys) == 1 or len(order) < 2:
        return order
    lead = keys[0][order]
    tie = lead[1:] == lead[:-1]
    tied = np.concatenate([tie, [False]]) | np.concatenate([[False], tie])
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        group = np.cumsum(~np.concatenate([[False], lead[at][1:] == lead[at][:-1]]))
        order[at] = rows[np.lexsort([*[k[rows] for k in keys[:0:-1]], group])]
    return order


# A run in a shuffled block: anchor, hash, key, first window, windows (plus _TWICE if it holds its anchor twice).
_RUN = np.dtype([("anchor", "<i8"), ("hash", "<i8"), ("key", "<i8"), ("first", "<i8"), ("size", "<i2")])
_TWICE = 1 << 10
#: A place holds the first window and the number of windows.
_PLACE = 512


class Ranges:
    """Buckets by sampled splitters; a code that fills several ranges is dealt over them."""

    def __init__(self, splitters: list[int]) -> None:
        self.splitters = np.array(splitters, np.int64)
        self.n = len(splitters) + 1

    def spread(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bucket, number of buckets) of each code."""
        low = np.searchsorted(self.splitters, code, side="left")
        return low, np.maximum(np.searchsorted(self.splitters, code, side="right") - low, 1)

    def bucket(self, code: np.ndarray, key: np.ndarray) -> np.ndarray:
        low, width = self.spread(code)
        return low + (mix(key.astype(np.uint64)) % width.astype(np.uint64)).astype(np.int64)


def _sampled_ranges(codes: DataFrame, share: float, bucket_rows: int) -> Ranges:
    """Splitters from a column ``code`` that holds ``share`` of all rows."""
    n = max(1, round(codes.count() / share / bucket_rows))
    if n == 1:
        return Ranges([])
    return Ranges(codes.agg(F.percentile_approx("code", [i / n for i in range(1, n)], 100 * n)).first()[0])


def _batch_runs(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = flat(batch.column("text"))
    key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [np.zeros(0, _RUN)]
    for a, b in slices(offsets, PART):
        row, first, size, anchor, code, twice = runs(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        part = np.empty(len(row), _RUN)
        part["anchor"], part["hash"], part["key"] = anchor.view(np.int64), code.view(np.int64), key[a + row]
        part["first"], part["size"] = first - (offsets[a + row] - offsets[a]), size + np.where(twice, _TWICE, 0)
        parts.append(part)
    return np.concatenate(parts)


def _blocks(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the packed rows that go there."""
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    rows = rows[order]
    ends = [*start[1:].tolist(), len(rows)][:len(start)]
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(start.tolist(), ends, strict=True)],
                                               pa.binary())], names=["bucket", "block"])


def _sort_runs(rows: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """(repeated runs, open runs) of a bucket."""
    rows = rows[multikey_order([rows["anchor"], rows["hash"], rows["key"], rows["first"]])]
    anchor, code = rows["anchor"], rows["hash"]
    new_anchor, new_run = np.ones(len(rows), bool), np.ones(len(rows), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_run[1:] = new_anchor[1:] | (code[1:] != code[:-1])
    head = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]  # the earliest equal run
    later = (rows["key"] != rows["key"][head]) | (rows["first"] != rows["first"][head])
    kinds = np.bincount(np.cumsum(new_anchor) - 1, weights=new_run)[np.cumsum(new_anchor) - 1]
    goes_on = ranges.spread(anchor)[1] > 1  # equal anchors lie in other buckets, too
    return rows[later], rows[new_run & ((kinds > 1) | (rows["size"] >= _TWICE) | goes_on)]


def _places(rows: np.ndarray) -> np.ndarray:
    return rows["first"] * _PLACE + (rows["size"] & (_TWICE - 1))


def _text_rows(df: DataFrame, id_col: str, text_col: str, carried: Column | None = None) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias("key"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     *([] if carried is None else [carried.alias("carried")]))


def _found_runs(texts: DataFrame, sample: int) -> DataFrame:
    """(key, place, anchor): repeated runs with a null anchor, open runs with theirs."""
    def codes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_batch_runs(batch)["anchor"], pa.int64())], names=["code"])

    sampled = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(sample)) == 0)
    ranges = _sampled_ranges(checkpointed(sampled.mapInArrow(tidied(codes), "code long")), 1 / sample, BUCKET)

    def deal(batches):
        for batch in batches:
            rows = _batch_runs(batch)
            yield _blocks(ranges.bucket(rows["anchor"], rows["key"]), rows)

    def sort(batches):
        rows = [np.frombuffer(block.as_py(), _RUN) for batch in batches for block in batch.column("block")]
        if rows:
            again, open_ = _sort_runs(np.concatenate(rows), ranges)
            both = np.concatenate([again, open_])
            anchor = pa.array(both["anchor"], pa.int64(), mask=np.arange(len(both)) < len(again))
            yield pa.RecordBatch.from_arrays([pa.array(both["key"]), pa.array(_places(both)), anchor],
                                             names=["key", "place", "anchor"])

    dealt = texts.mapInArrow(tidied(deal), "bucket int, block binary").repartitionById(ranges.n, F.col("bucket"))
    return checkpointed(dealt.mapInArrow(tidied(sort), "key long, place long, anchor long"))


_CONTEXT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("group", T.LongType()),
                         T.StructField("key", T.LongType()), T.StructField("first", T.LongType()),
                         T.StructField("size", T.IntegerType()), T.StructField("bytes", T.BinaryType())])


def _contexts(texts: DataFrame, found: DataFrame, ranges: Ranges) -> DataFrame:
    """Open runs with their bytes (size > 0), and windows that are already known to be repeated (size < 0).

    Windows of an anchor that fills several ranges go by their own hash, the
    first of equal ones in a batch only.
    """
    open_ = (found.where(F.col("anchor").isNotNull()).groupBy("key")
             .agg(F.collect_list(F.struct("place", "anchor")).alias("runs")))

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            lists = batch.column("runs")
            pairs = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place, group = pairs.field("place").to_numpy(), pairs.field("anchor").to_numpy()
            key = batch.column("key").to_numpy()[row]
            first, size = place // _PLACE, place % _PLACE
            inside = first + size + MATCH - 1 <= np.diff(offsets)[row]  # rows that share a key may differ
            row, group, key, first, size = row[inside], group[inside], key[inside], first[inside], size[inside]
            low, width = ranges.spread(group)
            wide = width > 1
            known_key, known_first = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if wide.any():
                many = size[wide]
                one = np.repeat(first[wide], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                one_row, one_key = np.repeat(row[wide], many), np.repeat(key[wide], many)
                at = offsets[one_row] + one
                code = range_hash(data)(at, at + MATCH).view(np.int64)
                order = multikey_order([code, one_key, one])
                head = np.ones(len(order), bool)
                head[1:] = code[order][1:] != code[order][:-1]
                earliest = np.flatnonzero(head)[np.cumsum(head) - 1]
                later = (one_key[order] != one_key[order][earliest]) | (one[order] != one[order][earliest])
                known_key, known_first = one_key[order][later], one[order][later]
                keep = order[head]
                row, group = np.concatenate([row[~wide], one_row[keep]]), np.concatenate([group[~wide], code[keep]])
                key, first = np.concatenate([key[~wide], one_key[keep]]), np.concatenate([first[~wide], one[keep]])
                size = np.concatenate([size[~wide], np.ones(len(keep), np.int64)])
                low = np.concatenate([low[~wide], (mix(code[keep].view(np.uint64)) % np.uint64(ranges.n)).astype(np.int64)])
            view = memoryview(data)
            begin = (offsets[row] + first).tolist()
            end = (offsets[row] + first + size + MATCH - 1).tolist()
            n = len(known_key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([low, known_key % ranges.n]), pa.int32()),
                 pa.array(np.concatenate([group, np.zeros(n, np.int64)])), pa.array(np.concatenate([key, known_key])),
                 pa.array(np.concatenate([first, known_first])),
                 pa.array(np.concatenate([size, np.full(n, -1)]), pa.int32()),
                 pa.array([*[bytes(view[a:b]) for a, b in zip(begin, end, strict=True)], *[b""] * n], pa.binary())],
                names=_CONTEXT.names)

    return texts.join(open_, "key").mapInArrow(tidied(run), _CONTEXT)


def repeated_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray,
                     first: np.ndarray) -> np.ndarray:
    """Whether each window of some runs (their bytes start at ``begin``) is equal to one that starts earlier."""
    of = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at = begin[of] + step
    lead = np.zeros(len(of), np.uint64)
    for k in range(8):
        lead = lead << np.uint64(8) | data[at + k].astype(np.uint64)
    rest = range_hash(data)(at, at + MATCH)
    own_key, own_first = key[of], first[of] + step
    order = multikey_order([lead, rest, own_key, own_first])
    lead, rest, own_key, own_first = lead[order], rest[order], own_key[order], own_first[order]
    head = np.ones(len(order), bool)
    head[1:] = (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])
    earliest = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    out = np.zeros(len(of), bool)
    out[order] = (own_key != own_key[earliest]) | (own_first != own_first[earliest])
    return out


def _compare_open(contexts: DataFrame, ranges: Ranges, chunk: int = 1 << 18) -> DataFrame:
    """(key, place) of the repeated windows among the open runs."""
    def emit(key, first, size):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first * _PLACE + size, pa.int64())],
                                          names=["key", "place"])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        group, key, first, size = (table.column(c).to_numpy() for c in ("group", "key", "first", "size"))
        known = size < 0
        if known.any():
            yield emit(key[known], first[known], 1)
        binary = table.column("bytes").combine_chunks()
        binary = binary.chunk(0) if isinstance(binary, pa.ChunkedArray) else binary
        order = np.argsort(group, kind="stable")
        order = order[~known[order]]
        edges = np.flatnonzero(np.diff(group[order])) + 1
        start = 0
        while start < len(order):  # whole groups, about ``chunk`` windows at a time
            ends = np.concatenate([edges[edges > start], [len(order)]])
            total = np.cumsum(size[order[start:]])
            end = int(ends[min(np.searchsorted(total[ends - start - 1], chunk), len(ends) - 1)])
            part = order[start:end]
            pieces = [binary[int(i)].as_py() for i in part]
            begin = np.cumsum([0, *map(len, pieces)])[:-1]
            many = size[part].astype(np.int64)
            again = repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), begin, many, key[part], first[part])
            of = np.repeat(np.arange(len(part)), many)
            step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            go = again.copy()
            go[1:] &= ~(again[:-1] & (of[1:] == of[:-1]))
            stop = again.copy()
            stop[:-1] &= ~(again[1:] & (of[1:] == of[:-1]))
            a, b = np.flatnonzero(go), np.flatnonzero(stop)
            yield emit(key[part][of[a]], first[part][of[a]] + step[a], b - a + 1)
            start = end

    return contexts.repartitionById(ranges.n, F.col("bucket")).mapInArrow(tidied(run), "key long, place long")


def _covered(place: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint byte ranges that the windows at ``place`` cover."""
    start, end = place // _PLACE, np.minimum(place // _PLACE + place % _PLACE + MATCH - 1, n_bytes)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    if not len(start):
        return start, end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def repeated_places(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 32,
                    carried: Column | None = None) -> DataFrame:
    """(key, text, places) for every row: its repeated windows as packed places, or null; and ``carried``, if asked for."""
    found = _found_runs(_text_rows(df, id_col, text_col), sample)
    let_go(df.sparkSession)  # the files of the dealt runs, before the texts are dealt
    # dealt by key once, for both joins
    by_key = _text_rows(df, id_col, text_col, carried).repartition(F.col("key"))
    codes = found.where(F.col("anchor").isNotNull()).select(F.col("anchor").alias("code"))
    ranges = _sampled_ranges(codes, 1.0, BUCKET // 8)
    late = _compare_open(_contexts(by_key, found, ranges), ranges)
    sure = found.where(F.col("anchor").isNull()).select("key", "place")
    places = sure.unionByName(late).groupBy("key").agg(F.collect_list("place").alias("places"))
    return by_key.join(places, "key", "left")


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                       T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   carried: Column | None = None, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with ``with_text``,
    ``kept``: the bytes left, less characters that a cut broke.

    ``carried``, a column of ``df``, and ``text`` as it was (null: empty) go along with each row, if asked for,
    so that the result needs no join with ``df``.
    """
    marked = repeated_places(df, id_col=id_col, text_col=text_col, carried=carried, **options)
    more = [marked.schema[c] for c in ("text", "carried")] if carried is not None else []

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            lists = batch.column("places")
            out: list[list] = [[] for _ in DIGEST]
            places = lists.flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            for i, key in enumerate(batch.column("key").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                start, end = _covered(places[cut[i]:cut[i + 1]], len(text))
                start, end = start[start < len(text)], end[start < len(text)]
                kept = text.tobytes() if not len(start) else b"".join(
                    text[a:b].tobytes() for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                values = (None if key == NO_KEY else key, len(text), int((end - start).sum()), len(start),
                          sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                              *[batch.column(f.name) for f in more]], names=[*DIGEST.names, *[f.name for f in more]])

    cut = marked.mapInArrow(tidied(run), T.StructType([*DIGEST, *more]))
    cut = cut if with_text else cut.drop("kept")
    return cut.withColumnRenamed("doc_id", id_col)
