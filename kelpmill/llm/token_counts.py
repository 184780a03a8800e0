"""Token counts by a compiled finite-state tokenizer, without making tokens.

A byte-level BPE tokenizer is compiled into a deterministic transducer over bytes. Reading a byte inside a piece moves
to the next state and emits by how much the count of tokens changes; the first byte of a piece starts from the root. The
theory: of the tokens that may end at a place, exactly one goes with the last token before it, a pair of tokens going
together if the tokenizer gives just these two for their joined bytes. A state therefore holds, for every start from
which the bytes read are the beginning of some token, the place in the tree of tokens, the last token before that start
and the count there, relative to the present one. States are made when they are first reached and kept by the worker.

Texts are cut into chunks of bytes, which run side by side. A chunk's map takes the state it is entered with to the state
it is left with and a count. If a piece starts in a chunk, the map's exit doesn't depend on the entry, so all chunks run
at once from their first piece on. A scan over the maps of the other chunks gives their entries; then the heads before
first pieces run, all at once.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import byte_letters, place, tokenizer
from .words import batches_of, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 128
#: States after which a worker's table is made anew. One takes four bytes for each byte value seen so far, and its key.
MAX_STATES = 250_000
#: Rounds of a scan before it composes maps, and maps' entries up to which it does.
ROUNDS, COMPOSED = 4, 50_000
OTHER, LETTER, NUMBER, SPACE = range(4)
PAD = 256
_ZERO = 128


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SPACE if kind[0] == "Z" else OTHER
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start by vocabulary.PATTERN, given code points and where texts start."""
    n = len(points)
    kind, blank = classes()[points], points == 32
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~first[1:]
    found = new & ((kind == SPACE) | ~after_blank)
    # The last white space before anything else is a piece of its own, or its first character if it is a space.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    found |= last
    # Contractions
    at = np.flatnonzero(found & (points == 39))
    text = np.cumsum(first)
    ahead = lambda k: np.where((at + k < n) & (text[np.minimum(at + k, n - 1)] == text[at]), points[np.minimum(at + k, n - 1)], 0)
    one, two = ahead(1), ahead(2)
    pair = np.isin(one * 65536 + two, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
    single = np.isin(one, [ord(c) for c in "stmd"])
    for hit, size in ((single, 2), (pair & ~single, 3)):
        found[at[hit] + 1] = False
        after = at[hit] + size
        found[after[after < n]] = True
    return found


class Transducer:
    """The compiled tokenizer; compiled on as it reads."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        library = tokenizer(path)
        made = json.loads(library.to_str())
        pre = made["pre_tokenizer"] or {}
        if made["model"]["type"] != "BPE" or made["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.model, self.max_states = library.model, max_states
        letters = byte_letters()
        #: The tree of tokens: children by byte, and the number (from 1) of the token that ends at each node.
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        self.tokens: list[str] = [""]
        for token in made["model"]["vocab"]:
            if token in self.special or any(c not in letters for c in token):
                continue
            node = 0
            for c in token:
                if (b := letters[c]) not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(0)
                node = self.children[node][b]
            self.ends[node] = len(self.tokens)
            self.tokens.append(token)
        self._clear()

    def _clear(self) -> None:
        self.together: dict[int, bool] = {}
        self.keys: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        #: Columns are given to byte values as they are met; the first is for PAD, which changes nothing.
        self.column, self.columns = np.full(PAD + 1, -1, np.int64), [PAD]
        self.column[PAD] = 0
        self.table = np.full((1024, 32), -1, np.int32)
        self._number((self._entry(0, 0, 0),))

    def _entry(self, node: int, before: int, count: int) -> int:
        """One start that a state holds, as one integer; before 0: the piece starts there."""
        if not -_ZERO <= count < _ZERO:
            raise ValueError("a token is too long for the table")
        return (node * len(self.tokens) + before) * 256 + _ZERO + count

    def _number(self, key: tuple[int, ...]) -> int:
        if key not in self.numbers:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[n, 0] = n * 256 + _ZERO
        return self.numbers[key]

    def _columns_for(self, symbols: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(symbols.ravel(), minlength=PAD + 1)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.columns)
                self.columns.append(b)
        if len(self.columns) > self.table.shape[1]:
            self.table = np.concatenate([self.table, *[np.full_like(self.table, -1)] * (-(-len(self.columns) // self.table.shape[1]) - 1)], axis=1)
        return self.column[symbols]

    def _goes(self, before: int, token: int) -> bool:
        """Whether the tokenizer gives just these tokens for their joined bytes."""
        if (pair := before * len(self.tokens) + token) not in self.together:
            want = [self.tokens[before], self.tokens[token]] if before else [self.tokens[token]]
            self.together[pair] = [t.value for t in self.model.tokenize("".join(want))] == want
        return self.together[pair]

    def compile(self, state: int, column: int) -> None:
        byte, n, reached, found = self.columns[column], len(self.tokens), [], []
        for entry in self.keys[state]:
            start, count = divmod(entry, 256)
            node, before = divmod(start, n)
            if (child := self.children[node].get(byte)) is not None:
                reached.append((child, before, count - _ZERO))
                if (token := self.ends[child]) and self._goes(before, token):
                    found.append((token, count - _ZERO + 1))
        if len(found) != 1:
            raise ValueError("the vocabulary has no unique tokens for some bytes")
        token, change = found[0]
        key = (*(self._entry(node, before, count - change) for node, before, count in reached if self.children[node]), self._entry(0, token, 0))
        self.table[state, column] = self._number(key) * 256 + _ZERO + change

    def run(self, symbols: np.ndarray, begin: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last states, counts) of lanes: symbols and begin have a row for each step; begin starts a piece."""
        counts = np.zeros(len(state), np.int64)
        for row, new in zip(self._columns_for(symbols), begin, strict=True):
            at = np.where(new, 0, state) * self.table.shape[1] + row
            move = self.table.ravel().take(at)
            if move.min(initial=0) < 0:
                for missing in np.unique(at[move < 0]).tolist():
                    self.compile(*divmod(missing, self.table.shape[1]))
                move = self.table.ravel().take(at)
            state = move >> 8
            counts += (move & 255) - _ZERO
        return state.astype(np.int64), counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, none of which holds an added token."""
        if len(self.keys) > self.max_states:
            self._clear()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        full = sizes > 0
        first = np.zeros(len(points), bool)
        first[(np.cumsum(sizes) - sizes)[full]] = True
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place_of = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = np.zeros(len(data), bool)
        if len(points):
            begin[place_of[:-1][starts(points.astype(np.int64), first)]] = True
        text_at = place_of[np.concatenate([[0], np.cumsum(sizes)])]
        return self._chunks(data, begin, text_at)

    def _chunks(self, data: np.ndarray, begin: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        lengths = np.diff(text_at)
        per_text = -(-lengths // CHUNK)
        n = int(per_text.sum())
        total = np.zeros(len(lengths), np.int64)
        if not n:
            return total
        text = np.repeat(np.arange(len(lengths)), per_text)
        nth = np.arange(n) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        at = text_at[text] + nth * CHUNK
        place = at[None, :] + np.arange(CHUNK)[:, None]
        inside = place < text_at[text + 1][None, :]
        place = np.minimum(place, len(data) - 1)
        symbols = np.where(inside, data.astype(np.int32)[place], PAD)
        flags = begin[place] & inside
        opens = flags.any(axis=0)
        head = np.where(opens, flags.argmax(axis=0), CHUNK)
        in_head = np.arange(CHUNK)[:, None] < head[None, :]
        exits, counts = self.run(np.where(in_head, PAD, symbols), flags, np.zeros(n, np.int64))
        closed = np.flatnonzero(~opens)
        if len(closed):
            exits[closed], counts[closed] = self._scan(symbols[:, closed], opens[closed - 1], exits[closed - 1])
        ahead = np.flatnonzero(opens & (head > 0))
        if len(ahead):
            longest = int(head[ahead].max())
            lanes = np.where(in_head[:longest, ahead], symbols[:longest, ahead], PAD)
            counts[ahead] += self.run(lanes, np.zeros(lanes.shape, bool), exits[ahead - 1])[1]
        np.add.at(total, text, counts)
        return total

    def _scan(self, symbols: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exits, counts) of chunks in which no piece starts; first marks those whose entry is known, the others follow the one before.

        A chunk's map is made for the entries that it is asked for, and once for equal chunks. Every chunk is entered first
        with what the one before leaves when it starts at the root; mostly that is what it leaves anyhow. Where rounds of
        this don't settle, as in long repetitions, maps over all states that occur there are composed by doubling.
        """
        content, of = np.unique(np.ascontiguousarray(symbols.T.astype(np.uint16)).view(f"V{2 * len(symbols)}").ravel(), return_inverse=True)
        lanes = content.view(np.uint16).reshape(len(content), -1).T.astype(np.int64)
        made: dict[int, tuple[int, int]] = {}

        def maps(which: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            asked, back = np.unique(which.astype(np.int64) << 32 | states, return_inverse=True)
            new = np.array([k for k in asked.tolist() if k not in made], np.int64)
            if len(new):
                part = lanes[:, new >> 32]
                left, more = self.run(part, np.zeros(part.shape, bool), new & 0xFFFFFFFF)
                made.update(zip(new.tolist(), zip(left.tolist(), more.tolist(), strict=True), strict=True))
            found = np.array([made[k] for k in asked.tolist()], np.int64).reshape(-1, 2)
            return found[back, 0], found[back, 1]

        before = np.maximum(np.arange(len(of)) - 1, 0)
        entry, rounds = np.where(first, known, maps(of, np.zeros(len(of), np.int64))[0][before]), 0
        while True:
            left, counts = maps(of, entry)
            want = np.where(first, known, left[before])
            wrong = want != entry
            if not wrong.any():
                return left, counts
            entry, rounds = want, rounds + 1
            if rounds % ROUNDS == 0:
                self._compose(maps, of, first, wrong, entry)

    def _compose(self, maps, of: np.ndarray, first: np.ndarray, wrong: np.ndarray, entry: np.ndarray) -> None:
        """Set the entries of runs of chunks that aren't settled, by a scan that composes maps; not if they reach too many states."""
        run = np.cumsum(first) - 1
        rows = np.flatnonzero(np.isin(run, run[wrong]))
        kinds, kind = np.unique(of[rows], return_inverse=True)
        states = np.unique(entry[rows])
        while len(kinds) * len(states) <= COMPOSED and len(rows) * len(states) <= 100 * COMPOSED:
            left = maps(np.repeat(kinds, len(states)), np.tile(states, len(kinds)))[0].reshape(len(kinds), -1)
            reached = np.union1d(states, left)
            if len(reached) == len(states):
                break
            states = reached
        else:
            return
        to = np.searchsorted(states, left)[kind]  # of each chunk, from the place of its entry to that of its exit
        starts = np.flatnonzero(first[rows])
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
        step = 1
        while step <= nth.max():
            later = np.flatnonzero(nth >= step)
            to[later] = np.take_along_axis(to[later], to[later - step], axis=1)
            step *= 2
        begun = np.searchsorted(states, entry[rows[starts]])[np.cumsum(first[rows]) - 1]
        inner = np.flatnonzero(nth > 0)
        entry[rows[inner]] = states[to[inner - 1, begun[inner]]]

    def count_all(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text; an added token inside a text counts once, and what stands on either side is a text of its own."""
        cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        for _, run in batches_of(texts):
            extra = [len(cut.findall(t)) if cut else 0 for t in run]
            parts = [cut.split(t) if e else [t] for t, e in zip(run, extra, strict=True)]
            counts = iter(self.count([p for own in parts for p in own]).tolist())
            yield from (sum(next(counts) for _ in own) + e for own, e in zip(parts, extra, strict=True))


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per input row.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, other columns are ignored.
    """
    path = place(vocabulary)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(machine.count_all(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_token_counts": (op10_token_counts, None)}
