"""Document fingerprints by locally consistent parsing.

A text, as UTF-8 bytes, is cut into phrases, the phrases into phrases of
phrases, and so on up to one phrase, the whole text.  At each level equal
neighbours are first joined to one symbol; then deterministic coin tossing
gives each symbol a label: twice the lowest bit in which its name differs from
the name before, plus that bit.  Four rounds leave six labels, a recolouring
three, and neighbours always differ.  Local maxima of the labels, and minima
not beside one, start the phrases, of two or three symbols each.  So a cut
depends on a few symbols around it only, and equal substrings are cut alike
inside, whatever their offset.  A phrase is named by its parts' names, hashed:
equal phrases have one name in all texts, without a table of names.

A fingerprint is the name of the whole text and a sketch of its distinct
phrases of ``LOW`` to ``HIGH`` levels (and of the whole text where it is
smaller than that).  A phrase falls into one of ``SLOTS`` slots and gets there
an exponential time with its length as the rate; the slot keeps 12 bits of the
earliest phrase.  Two fingerprints agree in a slot with a probability of about
the bytes in common phrases over the bytes in phrases of either (J); their
likeness is 2J / (1 + J), the part of both texts that is shared, and 1 if the
names are equal.

Cases: a null text is empty; empty texts are alike, and unlike any other; a
text of one symbol is its own phrase; rows without a key come last in the
order of keys, ties are in the order of texts; the last text is followed by
the first, a single one by itself; repeated rows each get their row; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import BYTE64, flat, mix, slices
from .shared import with_package, written

#: Levels of the phrases in a sketch.
LOW, HIGH = 1, 4
#: Slots of a sketch.
SLOTS = 128
#: Bytes of text that are parsed together.
PIECE = 1 << 18
_EMPTY_SLOT = 4095
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint8(255)


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit in which a symbol differs from the one before, plus that bit."""
    one = names.dtype.type(1)
    apart = np.empty_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=apart[1:])
    apart[first] = one
    lowest = apart & (~apart + one)
    return 2 * np.bitwise_count(lowest - one) + ((names & lowest) != 0)


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0, 1, 2 of symbols whose neighbours differ; ``first``: places where texts start."""
    found = names
    for _ in range(4):
        found = _toss(found, first)
    last = np.append(first[1:], len(names)) - 1
    for colour in (5, 4, 3):
        left, right = _beside(found, first, last)
        taken = (left == 0) | (right == 0)
        free = taken.view(np.uint8) * (((left == 1) | (right == 1)).view(np.uint8) + np.uint8(1))
        found = np.where(found == colour, free, found)
    return found


def _beside(found: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.empty_like(found), np.empty_like(found)
    left[1:], right[:-1] = found[:-1], found[1:]
    left[first] = right[last] = _NONE
    return left, right


def phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where phrases of two to five symbols start; a text of one symbol is one phrase."""
    found = labels(names, first)
    last = np.append(first[1:], len(names)) - 1
    left, right = (x.view(np.int8) for x in _beside(found, first, last))  # none: -1
    found = found.view(np.int8)
    top = (found > left) & (found > right)
    low = (found < left) & (found < right)
    low[1:] &= ~top[:-1]
    low[:-1] &= ~top[1:]
    start = top | low
    start[last] = False
    start[first[first < last] + 1] = False
    start[first] = True
    return np.flatnonzero(start)


def _fold(names: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Names of phrases of ``count`` symbols from ``start``."""
    name = mix(names[start] + _GOLDEN)
    for k in range(1, int(count.max(initial=1))):
        more = np.flatnonzero(count > k)
        name[more] = mix(name[more] * np.uint64(3) + names[start[more] + k] + np.uint64(k))
    return name


def parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level, from 1: (level, row, name, first byte, whole) of all phrases of the texts.

    ``whole`` marks phrases that are a whole text; a text ends there.
    """
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    names, place, level = data, np.arange(len(data)), 0
    while len(names):
        # equal neighbours are one symbol, told apart by what it repeats
        new = np.empty(len(names), bool)
        new[:1] = True
        new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        if len(at) < len(names):
            times = np.diff(np.append(at, len(names)))
            symbols, row, place = names[at], row[at], place[at]
        else:
            times, symbols = None, names
        first = _firsts(row)
        start = phrase_starts(symbols, first)
        named = symbols if level else BYTE64[symbols]
        if times is not None:
            again = np.flatnonzero(times > 1)
            named = named.copy()
            named[again] = mix(named[again] + times[again].astype(np.uint64) * _GOLDEN)
        names = _fold(named, start, np.diff(np.append(start, len(symbols))))
        row, place, level = row[start], place[start], level + 1
        first = _firsts(row)
        whole = np.zeros(len(names), bool)
        whole[first[np.diff(np.append(first, len(names))) == 1]] = True
        yield level, row, names, place, whole
        if whole.any():
            row, names, place = row[~whole], names[~whole], place[~whole]


def _firsts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(len(row) > 0, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)


def sketches(data: np.ndarray, offsets: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """(name of each text, its slots: rows x SLOTS)."""
    n = len(offsets) - 1
    names = np.zeros(n, np.uint64)
    best = np.full(n * SLOTS, np.inf)
    drawn = []
    for level, row, name, place, whole in parse(data, offsets):
        names[row[whole]] = name[whole]
        if level > high:
            continue
        # a phrase ends where the next of its text starts
        end = np.append(place[1:], 0)
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
        end[last] = offsets[row[last] + 1]
        length = end - place
        if level < low:
            row, name, length = row[whole], name[whole], length[whole]
        cell = row.astype(np.int64) * SLOTS + (name & np.uint64(SLOTS - 1)).astype(np.int64)
        time = -np.log(((name >> np.uint64(32)).astype(np.float64) + 0.5) / (1 << 32)) / length
        np.minimum.at(best, cell, time)
        drawn.append((cell, time, (name >> np.uint64(7) & np.uint64(0xFFFFFF)) % np.uint64(_EMPTY_SLOT)))
    slots = np.full(n * SLOTS, _EMPTY_SLOT, np.int64)
    for cell, time, code in drawn:
        mine = np.flatnonzero(time == best[cell])
        np.minimum.at(slots, cell[mine], code[mine].astype(np.int64))
    return names, slots.astype(np.int16).reshape(n, SLOTS)


def likeness(names_a: np.ndarray, slots_a: np.ndarray, names_b: np.ndarray, slots_b: np.ndarray) -> np.ndarray:
    used = (slots_a != _EMPTY_SLOT) | (slots_b != _EMPTY_SLOT)
    alike = (slots_a == slots_b) & used
    share = alike.sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    return np.where(names_a == names_b, 1.0, 2 * share / (1 + share))


def sketched(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sketches`` of any number of texts, some at a time."""
    names, slots = [np.zeros(0, np.uint64)], [np.zeros((0, SLOTS), np.int16)]
    for a, b in slices(offsets, PIECE):
        name, slot = sketches(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        names.append(name)
        slots.append(slot)
    return np.concatenate(names), np.concatenate(slots)


def packed(names: np.ndarray, slots: np.ndarray) -> pa.Array:
    """Fingerprints in bytes: the name in 8, then two slots in 3."""
    even, odd = slots[:, ::2].astype(np.int64), slots[:, 1::2].astype(np.int64)
    three = np.stack([even >> 4, (even & 15) << 4 | odd >> 8, odd & 255], axis=2).reshape(len(slots), SLOTS * 3 // 2).astype(np.uint8)
    rows = np.concatenate([names.astype(">u8").view(np.uint8).reshape(len(names), 8), three], axis=1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(fingerprints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(fingerprints), np.uint8).reshape(len(fingerprints), 8 + SLOTS * 3 // 2)
    names = rows[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    three = rows[:, 8:].astype(np.int16).reshape(len(rows), SLOTS // 2, 3)
    even, odd = three[:, :, 0] << 4 | three[:, :, 1] >> 4, (three[:, :, 1] & 15) << 8 | three[:, :, 2]
    return names, np.stack([even, odd], axis=2).reshape(len(rows), SLOTS)


def _shown(fingerprint: str) -> Column:
    """The fingerprint as text: the name in hexadecimal, a dash, the slots in base 64."""
    whole = F.col(fingerprint)
    return F.concat(F.lower(F.hex(F.substring(whole, 1, 8))), F.lit("-"),
                    F.translate(F.base64(F.substring(whole, 9, SLOTS * 3 // 2)), "\r\n", ""))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every text; no row is moved."""
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed(*sketched(data, offsets))], names=["id", "fingerprint"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with_package(df.sparkSession)
    rows = rows.withColumn("id", F.struct("id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")))
    found = rows.mapInArrow(run, "id struct<id: long, n_chars: long>, fingerprint binary")
    return found.select(F.col("id.id").alias(id_col), "id.n_chars", _shown("fingerprint").alias("fingerprint"))


def phrases(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> DataFrame:
    """(id, level, name, start, n_bytes): the phrases of at least ``least`` bytes, and every whole text (level -1).

    Equal names are equal phrases: a grouping by name finds passages that texts share.
    """
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in slices(offsets, PIECE):
                at = offsets[a:b + 1] - offsets[a]
                for level, row, name, place, whole in parse(data[offsets[a]:offsets[b]], at):
                    end = np.append(place[1:], 0)
                    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
                    end[last] = at[row[last] + 1]
                    use = (end - place >= least) | whole
                    row, place, end = row[use], place[use], end[use]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row + a)), pa.array(np.where(whole[use], -1, level)), pa.array(name[use].view(np.int64)),
                         pa.array(place - at[row]), pa.array(end - place)], names=["id", "level", "name", "start", "n_bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "id long, level long, name long, start long, n_bytes long")
            .withColumnRenamed("id", id_col))


# ---------------------------------------------------------------- texts beside the next
class _Texts:
    """Some texts in the order of keys, as bytes, with their fingerprints."""

    def __init__(self, ids: list, column: pa.Array) -> None:
        self.ids = ids
        self.data, self.offsets = flat(column)
        starts = np.flatnonzero((self.data & 0xC0) != 0x80)  # of code points
        self.first = np.searchsorted(starts, self.offsets)
        self.starts = np.append(starts, len(self.data))
        self.n_chars = np.diff(self.first)
        self.names, self.slots = sketched(self.data, self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()

    def up_to(self, row: int, n: int) -> bytes:
        """The first ``n`` code points of a text, or all."""
        n = min(n, int(self.n_chars[row]))
        return self.data[self.offsets[row]:self.starts[self.first[row] + n] if n < self.n_chars[row] else self.offsets[row + 1]].tobytes()


COMPARED = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = "id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: _Texts, at: list[int], others: _Texts, beside: list[int]) -> pa.RecordBatch:
    """Results of the texts ``at``, each followed by the one of ``others`` at ``beside``."""
    edited = []
    for i, j in zip(at, beside, strict=True):
        cut = int(texts.n_chars[i]) // 4
        edited.append(texts.up_to(i, int(texts.n_chars[i]) - cut) + others.up_to(j, cut))
    names, slots = sketched(np.frombuffer(b"".join(edited), np.uint8), np.cumsum([0, *map(len, edited)]))
    mine = texts.names[at], texts.slots[at]
    return pa.RecordBatch.from_arrays(
        [pa.array([texts.ids[i] for i in at], pa.int64()), pa.array(texts.n_chars[at]), pa.array([sha256(e).digest() for e in edited], pa.binary()),
         packed(*mine), packed(names, slots), pa.array(likeness(*mine, names, slots)),
         pa.array(likeness(*mine, others.names[beside], others.slots[beside]))], names=COMPARED)


def against_next(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside the next in the order of keys, and beside its own edited form.

    Texts are range-partitioned and sorted by key.  A task compares the texts
    that follow each other in its range; it hands on its first and last text,
    and the last of each range is compared with the first of the next.
    """
    def run(batches):
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, column = batch.column("id").to_pylist(), batch.column("text")
            if not ids:
                continue
            if last is not None:
                ids, column = [last[0], *ids], pa.concat_arrays([pa.array([last[1]], column.type), column])
            texts = _Texts(ids, column)
            first = first or (ids[0], column[0].as_py())
            last = ids[-1], column[-1].as_py()
            n = len(ids) - 1
            done = _compared(texts, list(range(n)), texts, list(range(1, n + 1)))
            yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())],
                                             names=[*COMPARED, "part", "is_first", "text"])
        if first is not None:
            edge = [pa.nulls(2, t.type) for t in done.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([first[0], last[0]], pa.int64()), *edge, pa.array([part, part]),
                                              pa.array([True, False]), pa.array([first[1], last[1]], pa.string())],
                                             names=[*COMPARED, "part", "is_first", "text"])

    with_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the row number only spreads rows that are equal in all else
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    found = written(rows.mapInArrow(run, f"{_KINDS}, part long, is_first boolean, text string"))
    inner = found.where("part IS NULL").select(*COMPARED)
    return _named(inner.unionByName(_across(found.where("part IS NOT NULL").select("part", "is_first", "id", "text"))), id_col)


def _across(edges: DataFrame) -> DataFrame:
    """Results of the last text of each range beside the first of the next one, the last range's beside the very first."""
    def run(batches):
        for batch in batches:
            texts, others = (_Texts(batch.column("id").to_pylist(), batch.column(c)) for c in ("text", "next"))
            every = list(range(batch.num_rows))
            yield _compared(texts, every, others, every)

    parts = sorted(r["part"] for r in edges.where("is_first").select("part").collect())  # one a task
    follow = edges.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, after long")
    firsts = edges.where("is_first").select(F.col("part").alias("after"), F.col("text").alias("next"))
    lasts = edges.where("NOT is_first").join(follow, "part")
    return lasts.hint("merge").join(firsts, "after").select("id", "text", "next").mapInArrow(run, _KINDS)


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"),
                        _shown("fingerprint").alias("fingerprint"), _shown("edited_fingerprint").alias("edited_fingerprint"),
                        "near_edited", "near_next")
