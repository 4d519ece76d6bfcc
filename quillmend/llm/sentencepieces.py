"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here: pieces, scores and types, the trainer's
kind and byte fallback, and the normaliser. From these come a unigram model
with its scores, or a BPE model whose merges are the splits of each piece in
order of score, a byte fallback, the compiled normaliser and the space marker.
Where no piece holds a marker after another character, a text falls apart
exactly before its markers, which are its spaces and any marker it held itself;
each part is encoded once a worker, many to a multithreaded call. Models with
user-defined pieces, which are matched ahead of all others, are refused.
``parity`` compares with the sentencepiece library.

Defined results: a null text is empty and has no ids; rows that repeat get
equal ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import CACHE_ENTRIES, gaps_in

MARKER = "▁"
# The format's numbers for kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file holds, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        return model

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Splits of every piece into two pieces, best scored piece first."""
        known = {p for p, _, kind in self.pieces if kind == NORMAL}
        ranked = sorted((-score, i, p) for i, (p, score, kind) in enumerate(self.pieces) if kind == NORMAL)
        return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in known and p[k:] in known]

    def tokenizer(self):
        """A tokenizers library tokenizer for texts whose prefix has been added."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        built = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze_spaces:
            steps.append(normalizers.Replace(Regex(" {2,}"), " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARKER))
        built.normalizer = normalizers.Sequence(steps)
        return built


class Codec:
    """Encodes and decodes with a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.library = self.model.tokenizer()
        texts = [p for p, _, kind in self.model.pieces if kind == NORMAL]
        apart = self.model.kind == BPE and self.model.escape_spaces and not self.model.charsmap and not self.model.squeeze_spaces and not any(MARKER in p.lstrip(MARKER) for p in texts)
        lines = "" if any("\n" in p for p in texts) else "\n"
        self.find = re.compile(f"{MARKER}*[^{MARKER}{lines}]+|{MARKER}+" + f"|{lines}" * bool(lines)).findall if apart else None
        self.cache: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARKER, " ").encode() for p, _, kind in self.model.pieces]

    def prepared(self, text: str) -> str:
        if self.model.squeeze_spaces:
            text = text.strip(" ")
        return " " + text if text and self.model.dummy_prefix else text

    def learn(self, parts: list[str], at_once: int = 1000) -> None:
        lists = [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
        for words, got in zip(lists, self.library.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(got.ids, "<i4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)))
            a = 0
            for word, b in zip(words, ends.tolist()):
                self.cache[word] = ids[a:b]
                a = b

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ready = [self.prepared(t or "") for t in texts]
        if self.find is None:
            return [np.array(e.ids, "<i4") for e in self.library.encode_batch(ready, add_special_tokens=False)]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        get = self.cache.get
        split = [self.find(t.replace(" ", MARKER)) for t in ready]
        parts = [list(map(get, w)) for w in split]
        gaps = [(w, p, at) for w, p in zip(split, parts) for at in gaps_in(p)]
        if gaps:
            self.learn(list({w[at]: None for w, _, at in gaps}))
            for w, p, at in gaps:
                p[at] = self.cache[w[at]]
        return [np.frombuffer(b"".join(p), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process for each file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def parity(texts: list[str], path: str) -> list[int]:
    """Places of the texts whose ids or decoding differ from the sentencepiece library's."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = codec(path)
    return [i for i, (t, ids) in enumerate(zip(texts, ours.encode(texts))) if ids.tolist() != (want := library.encode(t)) or ours.decode(ids) != library.decode(want)]


def encode_pieces(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every row, whether decoding gives the text again, and a checksum of the decoding."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = ours.encode(texts)
            back = [ours.decode(i) for i in ids]
            columns = [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array([b == (t or "") for t, b in zip(texts, back)], pa.bool_()), pa.array([zlib.crc32(b.encode()) for b in back], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "n_ids", "ids_crc32", "same_text", "decoded_crc32"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, n_ids bigint, ids_crc32 bigint, same_text boolean, decoded_crc32 bigint")


def decode_pieces(df: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids give the empty text."""
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(model).decode(np.frombuffer(x or b"", "<i4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
