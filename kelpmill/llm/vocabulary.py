"""Vocabulary files of public tokenizers, and encoding through a bounded cache of pieces."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps the ids of: so many in use now, as many before them, and as many words.
CACHED_PIECES = 600_000
#: Characters that are cut up at once.
RUN = 8_000_000
_SPACE_BEFORE_SPACE = re.compile(r"\s ")
#: How byte-level tokenizers split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here, the classes of characters are the same in all versions of Unicode.
_SETTLED = "\u024f"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it is a visible Latin-1 character, else as the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Kept(dict):
    """A dict of bounded size that forgets what hasn't been asked for since it was last full."""

    def __init__(self, most: int):
        self.most, self.before = most, {}

    def without(self, keys: set) -> list:
        """Those of keys that are not known; for the others, get() works until the next call."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        new = keys.difference(self)
        again = [k for k in new if k in self.before]
        self.update((k, self.before[k]) for k in again)
        return list(new.difference(again))


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class PieceEncoder:
    """Ids of texts by a byte-level BPE tokenizer of the tokenizers library, with the ids of pieces that came before.

    Such a tokenizer splits before every space that follows another character than white space, whatever stands
    around, and encodes what lies between by itself. So a text may be cut there and the ids of the cuts joined. New
    cuts are split as the tokenizer does, and its model gets each new word once. Texts with white space before a
    space, those that hold an added token, and cuts with rare characters go to the tokenizer as a whole.
    """

    def __init__(self, path: str, width: int, most: int = CACHED_PIECES):
        import regex

        self.library, self.kind, self.code = tokenizer(path), np.dtype(f"<u{width}"), {2: "H", 4: "I"}[width]
        made = json.loads(self.library.to_str())
        pre = made["pre_tokenizer"] or {}
        self.cuts = made["model"]["type"] == "BPE" and not made["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces, self.words = Kept(most), {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.library.model.tokenize(letters)]
            found = self.words[word] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return found

    def _cut(self, piece: str) -> bytes:
        """The ids of a piece: of its one word and the marks behind it, or of what the tokenizer's pattern finds."""
        stem = piece.rstrip(".,;:!?")
        if stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
            return self._word(stem) + self._word(piece[len(stem) :]) if len(stem) < len(piece) else self._word(stem)
        return b"".join(map(self._word, self.split(piece)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, its ids as little-endian integers of the encoder's width; about RUN characters are cut up at once."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= RUN:
                yield from self._run(run)
                run, held = [], 0
        yield from self._run(run)

    def _learn(self, pieces: set[str]) -> None:
        if len(self.words) > self.pieces.most:
            self.words.clear()
        new = self.pieces.without(pieces)
        rare = [p for p in new if not p.isascii() and max(p) > _SETTLED]
        self.pieces.update(zip(rare, self._library(rare), strict=True))
        self.pieces.update((p, self._cut(p)) for p in set(new).difference(rare))

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        whole = [not self.cuts or _SPACE_BEFORE_SPACE.search(t) is not None or any(s in t for s in self.special) for t in texts]
        direct = iter(self._library([t for t, w in zip(texts, whole, strict=True) if w]))
        parts = pc.split_pattern(pa.array([t for t, w in zip(texts, whole, strict=True) if not w], pa.string()), " ")
        # Of each text, all cuts but the first begin with a space. Equal cuts are looked up once.
        cuts = parts.flatten().dictionary_encode()
        own = [" " + p for p in cuts.dictionary.to_pylist()]
        firsts = pc.list_element(parts, 0).to_pylist()
        self._learn({*own, *firsts})
        joined = pa.array(map(self.pieces.__getitem__, own), pa.binary()).take(cuts.indices)
        ids, at = joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset) if len(joined) else []
        ends = parts.offsets.to_pylist()
        cut = (self.pieces[first] + bytes(memoryview(ids)[at[ends[k] + 1] : at[ends[k + 1]]]) for k, first in enumerate(firsts))
        yield from (next(direct) if w else next(cut) for w in whole)


@lru_cache(2)
def piece_encoder(path: str, width: int) -> PieceEncoder:
    return PieceEncoder(path, width)
