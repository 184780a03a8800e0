"""SentencePiece models in the tokenizers library: the model file is read and rebuilt, batches are encoded by several
threads, and what is encoded is held against the sentencepiece library, all of it.

A model of either kind is rebuilt: unigram scores go to the library as they are; of a BPE model, whose scores are ranks,
the pairs of pieces that join to a piece are its merges in the order of the scores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import place
from .words import slices

MODEL = "piece_bpe_32k.model"
THREADS = 2
#: Bytes of text encoded at once, and spans that are encoded as one text.
RUN, GROUP = 1_000_000, 64
MARK = "▁"
# Fixed values of the model format: kinds of model and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif key & 7 == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    mark_after: bool


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        data = file.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            pieces.append(dict(fields(value)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    return Model([p[1].decode() for p in pieces], [p.get(2, 0.0) for p in pieces], [p.get(3, NORMAL) for p in pieces], trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)), bool(trainer.get(24, 0)))


def merges_of(model: Model) -> list[tuple[str, str]]:
    usable = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind in (NORMAL, USER)}
    pairs = []
    for piece, k in usable.items():
        for cut in range(1, len(piece)):
            left, right = usable.get(piece[:cut]), usable.get(piece[cut:])
            if left is not None and right is not None:
                pairs.append((-model.scores[k], left, right))
    return [(model.pieces[left], model.pieces[right]) for _, left, right in sorted(pairs)]


def rebuild(model: Model):
    """A Tokenizer of the tokenizers library that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.kinds.index(UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: k for k, p in enumerate(model.pieces)}, merges_of(model), unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.mark_after or not model.escape:
        raise ValueError("only models with the white space mark in front can be rebuilt")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return made


class Encoded(NamedTuple):
    """The ids of texts, one text after another, and of each text: how many, whether sentencepiece gives the same, whether they decode to it."""

    ids: np.ndarray
    lengths: np.ndarray
    parity: np.ndarray
    restored: np.ndarray


def _joined(parts: list[np.ndarray], kind: str = "<i4") -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _as_array(ids: list[int]) -> np.ndarray:
    return np.array(ids, "<i4")


class Encoder:
    """Ids of texts by the rebuilt model, and whether the sentencepiece library gives the same.

    If in no piece of the model a mark follows another character, marks part texts into spans that are encoded by
    themselves. So texts in which every space is single and none is at an end are cut at their spaces, each different
    span of a run is encoded once, in groups that are joined by spaces again, and the ids are dealt out to the texts.
    Other texts, and all of models without that property or with a prefix of another kind, are encoded as a whole.
    """

    def __init__(self, path: str, threads: int = THREADS):
        import sentencepiece

        model = read_model(path)
        self.library, self.threads = rebuild(model), threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [p for p, kind in zip(model.pieces, model.kinds, strict=True) if kind in (NORMAL, USER)]
        self.cuts = model.dummy_prefix and not model.charsmap and not any(MARK in p.lstrip(MARK) for p in normal)
        #: What a piece stands for, and whether a span starts with it.
        self.bytes = pa.array([bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, kind in zip(model.pieces, model.kinds, strict=True)], pa.binary())
        self.opens = np.array([p.startswith(MARK) for p in model.pieces])

    def _both(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """(ids of each text by the rebuilt model, whether sentencepiece's are the same)."""
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.reference.encode(texts, num_threads=self.threads)
        return list(map(_as_array, got)), [g == w for g, w in zip(got, want, strict=True)]

    def _spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, parity) of spans without spaces; all are encoded, groups joined by spaces."""
        groups = [spans[at : at + GROUP] for at in range(0, len(spans), GROUP)]
        ids, lengths, parity = [], [], []
        for group, found, same in zip(groups, *self._both([" ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.opens[found])
            if same and len(at) == len(group) and at[0] == 0:
                ids.append(found)
                lengths.append(np.diff(at, append=len(found)))
                parity.append(np.ones(len(group), bool))
            else:  # which of them differs
                each, agree = self._both(group)
                ids += each
                lengths.append(np.array([len(e) for e in each]))
                parity.append(np.array(agree))
        return _joined(ids), _joined(lengths, "<i8"), _joined(parity, "?")

    def _cut(self, texts: pa.Array) -> Encoded:
        parts = pc.split_pattern(texts, " ")
        spans = parts.flatten().dictionary_encode()
        ids, lengths, same = self._spans(spans.dictionary.to_pylist())
        of = spans.indices.to_numpy()
        sizes = lengths[of]
        ends = np.cumsum(sizes)
        full = ids[np.repeat((np.cumsum(lengths) - lengths)[of] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        parity = np.ones(len(texts), bool)
        if not same.all():
            parity[np.searchsorted(parts.offsets.to_numpy(), np.flatnonzero(~same[of]), "right") - 1] = False
        return Encoded(full, np.diff(bounds), parity, self._restored(texts, full, bounds))

    def _restored(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the bytes that the ids stand for are a space and the text."""
        data = self.bytes.take(pa.array(ids))
        if not len(ids):
            return np.zeros(len(texts), bool)
        at = np.frombuffer(data.buffers()[1], np.int32, len(ids) + 1)[bounds]
        content = memoryview(data.buffers()[2])
        want = [b" " + t for t in texts.cast(pa.binary()).to_pylist()]
        return np.array([content[low:high].tobytes() == w for low, high, w in zip(at[:-1].tolist(), at[1:].tolist(), want, strict=True)], bool)

    def _whole(self, texts: list[str]) -> Encoded:
        ids, same = self._both(texts)
        back = self.library.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
        return Encoded(_joined(ids), np.array([len(i) for i in ids], np.int64), np.array(same, bool), np.array([b == t for b, t in zip(back, texts, strict=True)], bool))

    def encode(self, texts: pa.Array) -> Encoded:
        """Texts of any number; the caller bounds their size. A null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return self._whole(texts.to_pylist())
        whole = pc.equal(texts, "")
        for found in (pc.match_substring(texts, MARK), pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
            whole = pc.or_(whole, found)
        direct = whole.to_numpy(zero_copy_only=False)
        if not direct.any():
            return self._cut(texts)
        one, other = self._whole(texts.filter(whole).to_pylist()), self._cut(texts.filter(pc.invert(whole)))
        lengths, parity, restored = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for part, rows in ((one, direct), (other, ~direct)):
            lengths[rows], parity[rows], restored[rows] = part.lengths, part.parity, part.restored
        owner = np.repeat(direct, lengths)
        ids = np.empty(len(owner), "<i4")
        ids[owner], ids[~owner] = one.ids, other.ids
        return Encoded(ids, lengths, parity, restored)


@lru_cache(2)
def encoder(path: str, threads: int) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "true"  # the encoder is made in the worker, after its fork
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Encoder(path, threads)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """The columns keep (by default all but the text) as struct doc, with ids, n_tokens, parity (sentencepiece gives just these ids) and restored (they decode to the text).

    The ids are those of the rebuilt model. A null text counts as empty, with no ids. Repeated rows give repeated rows;
    columns stay inside doc, whatever their names.
    """
    path = place(model)
    keep = keep or [c for c in docs.columns if c != text_col] or [text_col]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs[text_col].alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, threads)
        for batch in slices(batches, 1, RUN):
            got = machine.encode(batch.column(1))
            ends = pa.array(np.concatenate([[0], np.cumsum(got.lengths)]), pa.int32())
            flat = pa.ListArray.from_arrays(ends, pa.array(got.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, *map(pa.array, (got.lengths, got.parity, got.restored))], ["doc", "ids", "n_tokens", "parity", "restored"])

    return rows.mapInArrow(encoded, f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>, n_tokens long, parity boolean, restored boolean")


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column text of the ids' text; null ids give an empty text. Texts come back but for what the model normalises."""
    path = place(model)

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        library = encoder(path, THREADS).library
        return pd.Series(library.decode_batch([[] if i is None else list(i) for i in ids], skip_special_tokens=False))

    return encoded.withColumn("text", text(F.col(ids_col)))


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_tokens", "ids", "parity", "restored")


QUERIES = {"op8_sentence_pieces": (op8_sentence_pieces, None)}
