"""BPE encoding with a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merge rules
produce.  It starts as one state with a loop for every base symbol; each merge
(a, b) -> c, in order of priority, applies one gadget: the state behind the
arcs labelled ``a`` is split from the other labels that share it and loses its
arc ``b``, and every state with an arc ``a`` whose target had an arc ``b``
gains an arc ``c`` to the target of ``b``.  A state therefore is a copy of an
older state, taken at some merge, less the arcs removed since; the table holds
just that (base state, time of copy, removed arcs with their time), so it has
one entry per merge instead of one per pair of states and labels.

Encoding a pre-split word walks the table: every prefix of the word has one
accepted path at most, so a walk that tries long labels first and steps back
where the table has no arc meets each place of the word once.  Decoding emits the labels of the
arcs of the path.

Cases: a null or empty text, or one of white space only, has no tokens and
decodes to the empty text; repeated rows each get their own result; special
tokens in a text are cut out first, as their definition asks; very long texts
and words are handled whole (the walk is linear in the word, times the longest
token).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .buffers import AT_END, SLICE, append_columns, flat, mix, range_hash, slices

#: Pieces of text whose tokens a worker remembers, twice; beyond, the older half goes.
REMEMBERED = 100_000

#: Characters that str.split() takes for white space and the pattern \s doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it has a
    glyph in Latin-1, else the next free code point from 256 up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class TokenAutomaton:
    """Tables of the automaton; labels are token ids.

    ``target[label]`` is the state behind all arcs with that label; ``born``
    the time at which a merge made the label (-1: base symbol), ``left`` its
    left part; per state ``base`` and ``since`` name the state it was copied
    from and when, ``removed`` the arcs it lost and when.  Merge k removes arcs
    at time 2k and adds arcs at 2k + 1.
    """

    END = 1 << 60
    AHEAD = 4

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocabulary = vocabulary
        self.label = {i: t for t, i in vocabulary.items()}
        n = max(vocabulary.values(), default=-1) + 1
        self.target = [0] * n
        self.born = [-1] * n
        self.left = [-1] * n
        self.base, self.since, self.removed = [-1], [0], [{}]
        sharing = [n]  # labels that lead to each state
        for time, (a, b) in enumerate(merges):
            if a not in vocabulary or b not in vocabulary or a + b not in vocabulary:
                continue
            self._gadget(time, vocabulary[a], vocabulary[b], vocabulary[a + b], sharing)
        self._arcs: dict[int, int] = {}
        self.suffix = suffix

    @cached_property
    def by_text(self) -> tuple[dict[str, int], dict[str, int], dict[str, int]]:
        """Labels by their text, inside a word and (less the suffix) at its end, and the length of the
        longest label that starts with given (up to ``AHEAD``) characters; for single words only."""
        inner = {t: i for t, i in self.vocabulary.items() if not self.suffix or not t.endswith(self.suffix)}
        final = {t[:-len(self.suffix)]: i for t, i in self.vocabulary.items() if t.endswith(self.suffix)} if self.suffix else inner
        reach: dict[str, int] = {}
        for table in (inner, final):
            for text in table:
                for k in range(1, min(self.AHEAD, len(text)) + 1):
                    reach[text[:k]] = max(reach.get(text[:k], 0), len(text))
        return inner, final, reach

    def _gadget(self, time: int, a: int, b: int, c: int, sharing: list[int]) -> None:
        state = self.target[a]
        if sharing[state] > 1 or a == b:
            # with a = b the old state stays behind the new label: "aaa" is (aa)(a), never (a)(aa)
            sharing[state] -= 1
            self.base.append(state)
            self.since.append(2 * time)
            self.removed.append({})
            sharing.append(1)
            self.target[a] = len(self.base) - 1
        self.removed[self.target[a]].setdefault(b, 2 * time)
        self.born[c], self.left[c] = 2 * time + 1, a
        sharing[self.target[c]] -= 1
        self.target[c] = state if a == b else self.target[b]
        sharing[self.target[c]] += 1

    def step(self, state: int, label: int) -> int:
        """The state behind the arc, or -1 where the table has no such arc."""
        key = state << 20 | label
        return self.target[label] if self._arcs.get(key) or self._arc(key, state, label) else -1

    def _arc(self, key: int, state: int, label: int) -> bool:
        if len(self._arcs) >= 4 * REMEMBERED:
            self._arcs.clear()
        got = self._arcs[key] = self.has_arc(state, label)
        return got

    def has_arc(self, state: int, label: int) -> bool:
        """Whether an arc with the label leaves the state, after all merges."""
        time = self.END
        while True:
            if self.removed[state].get(label, time) < time:
                return False
            if self.base[state] >= 0 and self.since[state] > self.born[label]:
                time = min(time, self.since[state])  # the copy was made when the arc was there
                state = self.base[state]
            elif self.born[label] >= 0:
                time = min(time, self.born[label])  # the arc came with the arc of its left part
                label = self.left[label]
            else:
                return True

    def path(self, word: str) -> list[int]:
        """Labels of the accepted path of a word of one-character symbols.

        A prefix of a word has one accepted path, so a place of the word is
        reached once at most and the walk never returns to a place it left.
        Raises KeyError for a word without a path (a symbol that no label has).
        """
        n = len(word)
        (inner, final, reach), arcs, target = self.by_text, self._arcs, self.target
        ahead = self.AHEAD
        labels: list[int] = []
        left: list[tuple[int, int, int]] = []  # place, state and next end to try of the arcs taken
        place = state = 0
        end = -1  # the next end to try; -1: as far as a label can reach
        while True:
            if end < 0:
                start = word[place:place + ahead]
                while start not in reach and start:
                    start = start[:-1]
                end = min(n, place + reach[start]) if start else place
            while end > place:
                piece = word[place:end]
                table = final if end == n else inner
                if piece in table:
                    label = table[piece]
                    key = state << 20 | label
                    if arcs[key] if key in arcs else self._arc(key, state, label):
                        labels.append(label)
                        if end == n:
                            return labels
                        left.append((place, state, end - 1))
                        place, state, end = end, target[label], -1
                        break
                end -= 1
            else:
                if not left:
                    raise KeyError(word)
                labels.pop()
                place, state, end = left.pop()


class Walker:
    """Walks many words through the automaton at once.

    Words lie one after another in a byte buffer.  Each round tries one arc
    for every open word: the label by the hash of its bytes, the arc by the
    table of (state, label); ``back`` and ``state`` are kept by place, as a
    prefix has one path.
    """

    ARCS = 1 << 20

    def __init__(self, automaton: TokenAutomaton, symbols: list[str], suffix: str) -> None:
        self.automaton = automaton
        byte = {c: i for i, c in enumerate(symbols)}
        inner, final = [], []
        for text, label in automaton.vocabulary.items():
            ends = bool(suffix) and text.endswith(suffix)
            raw = bytes(byte[c] for c in (text[:-len(suffix)] if ends else text))
            if ends or not suffix:
                final.append((raw, label))
            if not ends:
                inner.append((raw, label))
        reach: dict[bytes, int] = {}
        for raw, _ in {*inner, *final}:
            for k in range(1, min(automaton.AHEAD, len(raw)) + 1):
                reach[raw[:k]] = max(reach.get(raw[:k], 0), len(raw))
        self.inner, self.final, self.reach = _Lookup(inner), _Lookup(final), _Lookup(list(reach.items()))
        self.target = np.array(automaton.target, np.int64)
        self.keys = np.full(self.ARCS, -1, np.int64)
        self.open = np.zeros(self.ARCS, bool)

    def _arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        key = state << 20 | label
        slot = (mix(key.astype(np.uint64)) & np.uint64(self.ARCS - 1)).astype(np.int64)
        ok, known = self.open[slot], self.keys[slot] == key
        if not known.all():
            new, at = np.unique(key[~known], return_inverse=True)
            has = self.automaton.has_arc
            found = np.fromiter((has(k >> 20, k & 0xFFFFF) for k in new.tolist()), bool, len(new))
            ok[~known] = found[at]
            slot = (mix(new.astype(np.uint64)) & np.uint64(self.ARCS - 1)).astype(np.int64)
            self.keys[slot] = new
            self.open[slot] = found
            self.keys[slot[self.keys[slot] != new]] = -1  # two new arcs in one slot: neither is kept
        return ok

    def _reach(self, hashed, place: np.ndarray, stop: np.ndarray) -> np.ndarray:
        end = np.minimum(place + self.automaton.AHEAD, stop)
        out = self.reach(hashed(place, end))
        short = np.flatnonzero(out < 0)
        while len(short):
            end[short] -= 1
            short = short[end[short] > place[short]]
            out[short] = self.reach(hashed(place[short], end[short]))
            short = short[out[short] < 0]
        return np.minimum(place + np.maximum(out, 0), stop)

    def paths(self, words: list[bytes]) -> list[bytes]:
        """Packed int32 labels of the path of each word."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        hashed = range_hash(data)
        back = np.full(len(data) + 1, -1, np.int64)  # by end of an arc: where it began, its label, the state behind
        label_at, state_at = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        # a word's end and the next word's start are one place: its start state is 0 by definition
        place, stop, state = starts.copy(), ends.copy(), np.zeros(len(words), np.int64)
        begin = starts.copy()
        end = self._reach(hashed, place, stop)
        while len(place):
            dead = end <= place
            if dead.any():
                if (dead & (place == begin)).any():
                    raise KeyError("no label for a symbol")
                here = place[dead]
                end[dead] = here - 1
                place[dead] = back[here]
                state[dead] = np.where(back[here] == begin[dead], 0, state_at[back[here]])
                continue
            whole = end == stop
            code = hashed(place, end)
            label = np.where(whole, -1, self.inner(code))
            label[whole] = self.final(code[whole])
            go = np.flatnonzero(label >= 0)
            go = go[self._arcs(state[go], label[go])]
            end_go = end[go]
            back[end_go], label_at[end_go] = place[go], label[go]
            behind = self.target[label[go]]
            state_at[end_go] = behind
            end -= 1
            place[go], state[go] = end_go, behind
            more = go[~whole[go]]
            end[more] = self._reach(hashed, place[more], stop[more])
            done = np.zeros(len(place), bool)
            done[go] = whole[go]
            if done.any():
                keep = ~done
                place, stop, state, begin, end = place[keep], stop[keep], state[keep], begin[keep], end[keep]
        # emit the labels, from the last arc to the first
        at, of, found, who = ends.copy(), np.arange(len(words)), [], []
        while len(at):
            found.append(label_at[at])
            who.append(of)
            at = back[at]
            live = at > starts[of]
            at, of = at[live], of[live]
        who = np.concatenate(who[::-1]) if who else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        packed = np.concatenate(found[::-1])[order].astype(np.int32).tobytes() if found else b""
        cut = (4 * np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))])).tolist()
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class _Lookup:
    """Values by the hash of byte strings; -1 for others."""

    def __init__(self, pairs: list[tuple[bytes, int]]) -> None:
        data = np.frombuffer(b"".join(k for k, _ in pairs), np.uint8)
        ends = np.cumsum([len(k) for k, _ in pairs])
        codes = range_hash(data)(ends - [len(k) for k, _ in pairs], ends)
        order = np.argsort(codes)
        self.codes, self.values = codes[order], np.array([v for _, v in pairs], np.int64)[order]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], -1)


class Library:
    """Normaliser and pre-tokeniser of the tokenizers library, for characters
    whose class depends on the version of Unicode."""

    def __init__(self, spec: dict) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers
        kinds = {"NFC": lambda _: normalizers.NFC(), "Lowercase": lambda _: normalizers.Lowercase(),
                 "Replace": lambda n: normalizers.Replace(Regex(n["pattern"]["Regex"]), n["content"])}
        self.normal = normalizers.Sequence([kinds[n["type"]](n) for n in spec["normalizer"]["normalizers"]])
        rule = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = pre_tokenizers.Split(Regex(rule["pattern"]["Regex"]), rule["behavior"].lower(), rule["invert"])

    def words(self, text: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]


class Tokenizer:
    """A published word-level BPE (its JSON file) run through the automaton."""

    def __init__(self, spec: str) -> None:
        import regex

        spec = json.loads(spec)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model.get("end_of_word_suffix") or ""
        automaton = TokenAutomaton(model["vocab"], merges, suffix)  # its tables by name go once the walker has its arrays
        self.walker = Walker(automaton, byte_symbols(), suffix)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix(list(self.special))  # texts without it have no special token
        labels = {**automaton.label, **{i: t for t, i in self.special.items()}}
        size = max(labels, default=-1) + 1
        encoded = [(labels.get(i, "") + " ").encode() for i in range(size)]
        self.label_at = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
        self.label_bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.library = Library(spec)
        # tokens of the newest and the second newest pieces met
        self._met: list[dict[str, bytes]] = [{}, {}]

    def _pieces(self, text: str | None) -> list[str]:
        """Special tokens, and pieces that neither normalisation nor the pattern looks across."""
        if not text:
            return []
        if self.special and self.mark in text and self.cut.search(text):
            return [w for p in self.cut.split(text) for w in ([p] if p in self.special else self._pieces(p))]
        return self.library.words(text) if _NOT_SPACE.search(text) else text.split()

    def _words(self, piece: str) -> list[str]:
        if piece.isascii():
            low = piece.lower()
            return [low] if low.isalpha() else self.split(low)
        if max(piece) < "\u0250":
            return self.split(normalize("NFC", piece).lower())
        return self.library.words(piece)

    def _resolve(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed int32 ids of pieces that are not among the newest."""
        new, old = self._met
        got = {p: old[p] for p in pieces if p in old}
        got |= {p: np.int32(self.special[p]).tobytes() for p in pieces if p in self.special}
        split = {p: self._words(p) for p in pieces if p not in got}
        known = {w: new[w] for ws in split.values() for w in ws if w in new}
        words = list({w for ws in split.values() for w in ws if w not in known})
        if words:
            known |= zip(words, self.walker.paths([w.encode() for w in words]), strict=True)
        got |= {p: b"".join([known[w] for w in ws]) for p, ws in split.items()}
        if len(new) + len(got) > REMEMBERED:
            self._met = [{}, new]
        self._met[0].update((p, g) for p, g in got.items() if len(p) <= 60)
        return got

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        get = self._met[0].get
        found = []
        missing: set[str] = set()
        split = [self._pieces(t) for t in texts]
        for pieces in split:
            ids = [get(p) for p in pieces]
            if None in ids:
                missing.update(p for p, i in zip(pieces, ids, strict=True) if i is None)
            found.append(ids)
        if missing:
            get = self._resolve(missing).__getitem__
            found = [[get(p) if i is None else i for p, i in zip(ps, ids, strict=True)] if None in ids else ids
                     for ps, ids in zip(split, found, strict=True)]
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs, in UTF-8, joined by one space."""
        if not len(ids):
            return b""
        start = self.label_at[ids]
        size = self.label_at[ids + 1] - start
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.label_bytes[shift + np.arange(len(shift))][:-1].tobytes()


def tokenizer_source(path: str) -> Callable[[], Tokenizer]:
    """Reads the JSON file on the driver; each worker compiles the automaton once."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    return _Source(spec)


class _Source:
    made: dict[int, Tokenizer] = {}

    def __init__(self, spec: str) -> None:
        self.spec = spec

    def __call__(self) -> Tokenizer:
        key = hash(self.spec)
        if key not in _Source.made:
            _Source.made[key] = Tokenizer(self.spec)
        return _Source.made[key]


# a worker that goes on to other work needs no tokenizer; making it anew takes half a second a task
AT_END.append(_Source.made.clear)


def _source(df: DataFrame, path: str):
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    return lambda: shared.value()


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def _encoded(tokenizer: Tokenizer, column: pa.Array) -> Iterator[np.ndarray]:
    """Token ids of the texts of a batch, in slices of whole texts."""
    _, offsets = flat(column)
    for a, b in slices(offsets, 2 * SLICE):
        yield from tokenizer.encode_all(column[a:b].to_pylist())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(df: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with the token ids of the whole text in ``ids``."""
    get = _source(df, path)

    def run(column: pa.Array, _) -> list[pa.Array]:
        tokenizer = get()
        return [_lists(list(_encoded(tokenizer, column)))]

    return append_columns(df, text_col, [IDS], run)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with the text of the token ids in ``decoded``."""
    get = _source(df, path)

    def run(column: pa.Array, _) -> list[pa.Array]:
        tokenizer = get()
        return [pa.array([tokenizer.decode(np.array(i.as_py() or [], np.int64)).decode() for i in column], pa.string())]

    return append_columns(df, ids_col, [DECODED], run)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
           T.StructField("decoded_sha256", T.StringType())]


def digest(df: DataFrame, path: str, *, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` with the count and the checksums of the ids and of the decoded text.

    Encodes and decodes like ``encode`` and ``decode``, in one worker, and
    leaves the decoded texts there; ``with_ids`` adds the ids.
    """
    from hashlib import sha256
    get = _source(df, path)

    def run(column: pa.Array, _) -> list[pa.Array]:
        tokenizer = get()
        decimal = [str(i) for i in range(len(tokenizer.label_at) - 1)]
        counts, of_ids, of_text, kept = [], [], [], []
        for ids in _encoded(tokenizer, column):
            counts.append(len(ids))
            if with_ids:
                kept.append(ids)
            of_ids.append(sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
            of_text.append(sha256(tokenizer.decode(ids)).hexdigest())
        out = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return [*out, _lists(kept)] if with_ids else out

    return append_columns(df, text_col, [*DIGESTS, IDS] if with_ids else DIGESTS, run)
