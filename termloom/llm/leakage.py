"""Evaluation passages inside training texts: a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.frequency import filesystem
from termloom.session import scratch

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 12
#: Words of test items in one automaton; a larger set of items makes several, loaded one after the other.
BLOCK_WORDS = 1_000_000
#: Words of documents that a task holds while it goes through the automata.
HELD_WORDS = 4_000_000


def normalised(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


class Automaton:
    """Suffix automaton of several word sequences. ``owner[s]`` holds the items with the last ``min_words`` words of state s."""

    def __init__(self, items: list[tuple], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(item, [self.words.setdefault(w, len(self.words)) for w in WORD.findall(normalised(text))]) for item, text in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.top = [0] * len(self.len)  # the ancestor whose shortest string still has min_words words or fewer; 0: none
        for s in order:
            if self.len[s] >= min_words:
                self.top[s] = s if self.len[self.link[s]] < min_words else self.top[self.link[s]]
        owner: dict[int, set[int]] = {}
        for item, codes in coded:
            for _, s, _ in self.walk(codes):
                owner.setdefault(s, set()).add(item)
        self.owner = {s: tuple(sorted(i)) for s, i in owner.items()}

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the strings that reach it from p by c and are no longer than that."""
        clone = self._new(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur = self._new(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end position, state of the last ``min_words`` words, longest match length) wherever that many words match."""
        nxt, link, length, least = self.next, self.link, self.len, self.min_words
        state = matched = 0
        for at, c in enumerate(codes):
            if c < 0:
                state = matched = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
                if matched >= least:
                    yield at + 1, self.top[state], matched

    def packed(self) -> dict:
        """The automaton as flat arrays; see :class:`Block`."""
        states = [(s, c, t) for s, near in enumerate(self.next) for c, t in near.items()]
        table = np.array(states, np.int64).reshape(-1, 3)
        key = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(key)
        pairs = [(first, c) for first, t in self.next[0].items() for c in self.next[t]] if self.min_words > 1 else []
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        owned = sorted(self.owner)
        items = sorted({x for o in self.owner.values() for x in o})
        place = {x: n for n, x in enumerate(items)}
        return {
            "min_words": self.min_words, "words": pa.array(list(self.words), pa.string()), "items": items, "key": key[order], "to": table[order, 2].astype(np.int32), "link": np.array(self.link, np.int32), "len": np.array(self.len, np.int32), "top": np.array(self.top, np.int32),
            "pairs": np.sort((pairs[:, 0] << 32) | pairs[:, 1]), "owned": np.array(owned, np.int32), "off": np.cumsum([0, *(len(self.owner[s]) for s in owned)]), "own": np.array([place[x] for s in owned for x in self.owner[s]], np.int32),
        }


class Block:
    """One automaton as flat arrays: transitions sorted by (state, word), suffix links, lengths, and the owners of states."""

    def __init__(self, packed: dict):
        self.__dict__.update(packed)
        self.min_words: int = packed["min_words"]
        self.begin: dict[int, int] = dict(zip(self.key[: self.key.searchsorted(1 << 32)].tolist(), self.to.tolist(), strict=False))

    def stretches(self, codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of ``codes`` (own codes, -1 unknown) that may hold a match: every word, and every two words in a row, occur.

        Whole arrays at a time; any run of ``min_words`` words that stands in an item lies inside one of them.
        """
        known = codes >= 0
        if self.min_words == 1:
            tied, least = known[:-1] & known[1:] & (doc[:-1] == doc[1:]), 0
        else:
            tied, least = known[:-1] & known[1:] & (doc[:-1] == doc[1:]), self.min_words - 1
            where = np.flatnonzero(tied)
            want = (codes[where].astype(np.int64) << 32) | codes[where + 1]
            at = np.minimum(self.pairs.searchsorted(want), len(self.pairs) - 1) if len(self.pairs) else None
            tied[where] = self.pairs[at] == want if at is not None else False
        if not least:
            edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
            return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        edge = np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= least
        return list(zip(first[long].tolist(), (last[long] + 1).tolist(), strict=True))

    def walk(self, codes: np.ndarray, doc: np.ndarray, first: int, end: int) -> Iterator[tuple[int, int]]:
        """(end position, state of the last ``min_words`` words) wherever that many words of the range match."""
        key, to, link, length, top = (memoryview(x) for x in (self.key, self.to, self.link, self.len, self.top))
        begin, n, least = self.begin, len(key), self.min_words
        state = matched = 0
        before = -1
        for at, c, d in zip(range(first, end), codes[first:end].tolist(), doc[first:end].tolist(), strict=True):
            if d != before:
                state, matched, before = 0, 0, d
            while state:
                want = state << 32 | c
                i = bisect_left(key, want)
                if i < n and key[i] == want:
                    state, matched = to[i], matched + 1
                    break
                state = link[state]
                matched = length[state]
            else:  # at the root
                got = begin.get(c)
                if got is not None:
                    state, matched = got, 1
            if matched >= least:
                yield at + 1, top[state]

    def find(self, codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        """(document, item, first position, end position) of the maximal runs whose every ``min_words`` words stand in the item."""
        runs: dict[tuple[int, int], list[int]] = {}
        owned, off, own = memoryview(self.owned), memoryview(self.off), memoryview(self.own)
        for first, stop in self.stretches(codes, doc):
            for end, state in self.walk(codes, doc, first, stop):
                at = bisect_left(owned, state)
                for item in own[off[at] : off[at + 1]]:
                    run = runs.get((item, int(doc[end - 1])))
                    if run and run[1] == end - 1:
                        run[1] = end
                        continue
                    if run:
                        yield int(doc[end - 1]), self.items[item], run[0], run[1]
                    runs[item, int(doc[end - 1])] = [end - self.min_words, end]
        for (item, d), (s, e) in runs.items():
            yield d, self.items[item], s, e


def build(items: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> str:
    """The automata of all items, built in tasks and written as one file each below the shared folder; returns the folder.

    Items are dealt to blocks of about ``BLOCK_WORDS`` words by the hash of their key. Items with a null key or text are left out.
    """
    spark = items.sparkSession
    kept = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    total = kept.agg(F.coalesce(F.sum(F.size(F.split(text, r"\s+"))), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Automaton(mine, min_words).packed(), 5)], pa.binary())], names=["automaton"])

    path = scratch(spark, "automata")
    kept.repartitionById(n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).mapInArrow(run, "automaton binary").write.parquet(path)
    return path


def automata(path: str) -> Iterator[Block]:
    """The automata below ``path``, read one after the other."""
    files, at = filesystem(path)
    for part in ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=False).get_fragments():
        for batch in part.to_batches(columns=["automaton"]):
            for packed in batch.column(0):
                yield Block(pickle.loads(packed.as_buffer()))


class Matcher:
    """Runs of documents shared with items: words are split and coded once, then held against every automaton in turn."""

    def __init__(self, path: str):
        self.path = path
        self.only: list[Block] | None = None

    def _blocks(self) -> Iterator[Block]:
        if self.only is not None:
            yield from self.only
            return
        seen = []
        for block in automata(self.path):
            seen = [*seen, block][:2]
            yield block
        if len(seen) < 2:  # a single automaton stays
            self.only = seen

    def find(self, texts: list[str | None]) -> list[list[tuple[object, int, int]]]:
        """Per text its runs (item, first word, end word), sorted by place."""
        out: list[list[tuple[object, int, int]]] = [[] for _ in texts]
        begin, names = 0, {}
        codes: list[int] = []
        starts: list[int] = []
        for i, t in enumerate(texts):
            starts.append(len(codes))
            if t:
                codes += [names.setdefault(w, len(names)) for w in WORD.findall(normalised(t))]
            if len(codes) >= HELD_WORDS or i + 1 == len(texts):
                self._match(codes, starts, list(names), out, begin)
                begin, names, codes, starts = i + 1, {}, [], []
        return out

    def _match(self, codes: list[int], starts: list[int], names: list[str], out: list, begin: int) -> None:
        if not codes:
            return
        local, off = np.array(codes, np.int64), np.array([*starts, len(codes)])
        doc = np.repeat(np.arange(len(starts)), np.diff(off))
        words = pa.array(names, pa.string())
        for block in self._blocks():
            own = pc.fill_null(pc.index_in(words, value_set=block.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for d, item, s, e in block.find(own[local], doc):
                out[begin + d].append((item, s - int(off[d]), e - int(off[d])))
        for runs in out[begin : begin + len(starts)]:
            runs.sort(key=lambda r: (r[1], r[2], str(r[0])))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, item_id, first_word, n_words``: every maximal run of at least ``min_words`` words a document shares with an item.

    Words are runs of letters and digits after NFKC and lower-casing. The automata are built once, in tasks; documents are
    streamed once, each task going through all automata with the words it holds; nothing is shuffled or broadcast. Null and empty
    texts, and items shorter than ``min_words``, give no row. A document that holds a passage of many items gives a row for each.
    """
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    path, arrow_item = build(items, item_key, item_text, min_words), _arrow_type(items, item_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(path)
        for batch in batches:
            found = matcher.find(batch.column(1).to_pylist())
            flat = [(i, *r) for i, runs in enumerate(found) for r in runs]
            cols = [batch.column(0).take(pa.array([f[0] for f in flat], pa.int64())), pa.array([f[1] for f in flat], arrow_item), pa.array([f[2] for f in flat], pa.int32()), pa.array([f[3] - f[2] for f in flat], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "item_id", "first_word", "n_words"])

    return docs.select(key, text).mapInArrow(run, f"{key} {key_type}, item_id {item_type}, first_word int, n_words int")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _cluster_places(text: str) -> tuple[str, list[int]]:
    """The normal form put together from clusters (a character and its marks), and the place each of its characters comes from."""
    made: list[str] = []
    starts: list[int] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or "\u1160" <= text[j] <= "\u11ff" or unicodedata.category(text[j]) in ("Mn", "Mc")):
            j += 1
        part = normalised(text[i:j])
        made.append(part)
        starts += [i] * len(part)
        i = j
    return "".join(made), [*starts, len(text)]


def word_places(text: str) -> list[tuple[int, int]]:
    """Character ranges in ``text`` of its normalised words, in order.

    Text is traced between white space. Where a stretch cannot be traced character by character (its normal form depends on
    more than single clusters), each of its words stands for the whole stretch.
    """
    out: list[tuple[int, int]] = []
    for chunk in re.finditer(r"\S+", text):
        at, raw = chunk.start(), chunk[0]
        if raw.isascii():
            out += [(at + m.start(), at + m.end()) for m in WORD.finditer(raw.lower())]
            continue
        whole = normalised(raw)
        made, starts = _cluster_places(raw)
        if len(made) != len(whole) or [m.span() for m in WORD.finditer(made)] != [m.span() for m in WORD.finditer(whole)]:
            out += [(at, chunk.end())] * len(WORD.findall(whole))
            continue
        for m in WORD.finditer(whole):
            end = m.end()
            while end < len(whole) and starts[end] == starts[m.end() - 1]:
                end += 1
            out.append((at + starts[m.start()], at + starts[end]))
    return out


def cleaned(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """``key, text, n_removed, coverage, dropped``: every document with its leaked runs cut out.

    ``coverage`` is the share of words in leaked runs; above ``max_coverage`` the whole text goes (``dropped``, text null). Null
    texts stay null with coverage 0. Runs are found and cut row by row in one pass: keys may be null or repeat.
    """
    key_type = docs.schema[key].dataType.simpleString()
    path = build(items, item_key, item_text, min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(path)
        for batch in batches:
            given = batch.column(1).to_pylist()
            texts, removed, share, dropped = [], [], [], []
            for t, runs in zip(given, matcher.find(given), strict=True):
                if not runs:
                    texts.append(t), removed.append(0), share.append(0.0), dropped.append(False)
                    continue
                gone = set()
                for _, a, b in runs:
                    gone.update(range(a, b))
                places = word_places(t)
                n_words = len(WORD.findall(normalised(t)))
                away = len(gone) / n_words > max_coverage or len(places) != n_words
                if not away:
                    kept, at = [], 0
                    for _, a, b in runs:
                        s, e = places[a][0], places[b - 1][1]
                        if s > at:
                            kept.append(t[at:s])
                        at = max(at, e)
                    t = "".join(kept) + t[at:]
                texts.append(None if away else t), removed.append(len(gone)), share.append(len(gone) / n_words), dropped.append(away)
            cols = [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(share, pa.float64()), pa.array(dropped, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, text, "n_removed", "coverage", "dropped"])

    return docs.select(key, text).mapInArrow(cut, f"{key} {key_type}, {text} string, n_removed int, coverage double, dropped boolean")
