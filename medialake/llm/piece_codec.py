"""SentencePiece models run by the tokenizers library: the model file is parsed, and its normaliser, marker, scores and byte fallback rebuilt.

Pieces never hold the marker after another character, nor a line break, so a normalised text is cut there and each distinct chunk is encoded once,
in multithreaded batches. All ids are held against sentencepiece itself.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructType
from tokenizers import Encoding, Tokenizer, models, normalizers

from .common import small_batches, spread

#: Fixed values of the format: the marker of a space, and the kinds of pieces and of models.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    unknown_text: str = " \u2047 "

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normal = [], {}, {}
        for field, value in wire(data):
            if field == 1:
                piece = dict(wire(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire(value))
            elif field == 3:
                normal = dict(wire(value))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)), trainer.get(44, b" \xe2\x81\x87 ").decode())

    @cached_property
    def unknown(self) -> int:
        return next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)

    def normalise(self, text: str, precompiled: normalizers.Normalizer | None) -> str:
        if precompiled is not None:
            text = precompiled.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ")
        if not text:
            return text
        if self.dummy_prefix:
            text = f" {text}"
        text = text.replace(" ", MARKER) if self.escape else text
        return text.rstrip(f" {MARKER}" if self.escape else " ") if self.squeeze else text

    def core(self) -> Tokenizer:
        """The model over normalised text that holds no user-defined piece. In a unigram model only normal pieces may be found: the others get names that no such text holds."""
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            hidden = " " if self.escape else "\uffff"
            return Tokenizer(models.Unigram([(p, s) if k == NORMAL else (f"{hidden}{i}", 0.0) for i, (p, s, k) in enumerate(self.pieces)], self.unknown, False))
        if self.kind != BPE:
            raise ValueError("only unigram and BPE models are known")
        merges = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER_DEFINED):
                halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
                merges += [(-score, i, ids[a], ids[b], (a, b)) for a, b in halves]
        return Tokenizer(models.BPE(ids, [m[-1] for m in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def user_defined(self) -> re.Pattern | None:
        """Finds the user-defined pieces, which always stand alone."""
        own = sorted((p for p, _, k in self.pieces if k == USER_DEFINED), key=len, reverse=True)
        return re.compile("|".join(map(re.escape, own))) if own else None

    def chunks(self) -> re.Pattern | None:
        """Where normalised text may be cut; None if some piece forbids it."""
        pieces = [p for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)]
        if not self.escape or any(MARKER in p.lstrip(MARKER) or "\n" in p for p in pieces):
            return None
        return re.compile(f"{MARKER}*[^{MARKER}\n]+|{MARKER}+|\n")

    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        as_byte = lambda p: bytes([int(p[3:5], 16)])
        return [as_byte(p) if k == BYTE else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else p.replace(MARKER, " ").encode() for p, _, k in self.pieces]


class Codec:
    """batch(texts): for each text its ids, as little-endian unsigned 32-bit bytes, and whether sentencepiece gives the same.

    sentencepiece is given the distinct chunks of a BPE model whose normaliser only marks blanks; else the texts as they are. In a unigram model
    segmentations of just the same score, as of three blanks in pieces of one and two, may be told apart otherwise than by sentencepiece: parity is False there.
    """

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True, keep: int = 150_000):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = PieceModel.parse(data)
        self.core, self.cut, self.keep = self.model.core(), self.model.chunks(), keep
        self.user, self.unknown = self.model.user_defined(), self.model.unknown
        self.ids = {p: i for i, (p, _, _) in enumerate(self.model.pieces)}
        self.precompiled = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.reader = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.threads = threads
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.broken = self.encode(["\n"])[0]
        #: The id of a line break marks where one chunk ends, if only a line break has it.
        self.marks = len(self.broken) == 1 and self.broken[0] != self.unknown and self.user is None
        self.by_chunk = self.marks and self.model.kind == BPE and not self.model.charsmap and not self.model.squeeze

    def encode(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        if self.user is None:
            return [self.bytes_for(t, e) for t, e in zip(normal, self.core.encode_batch(normal, add_special_tokens=False))]
        parts = [[t[a:b] for a, b in self.bounds(t)] for t in normal]
        flat = [p for ps in parts for p in ps]
        plain = iter(self.core.encode_batch([p for p in flat if not self.user.fullmatch(p)], add_special_tokens=False))
        return [self.merged([i for p in ps for i in ([self.ids[p]] if self.user.fullmatch(p) else self.bytes_for(p, next(plain)))]) for ps in parts]

    def bounds(self, text: str) -> list[tuple[int, int]]:
        """Where the user-defined pieces, and what lies between them, start and stop."""
        at = sorted({0, len(text), *(x for m in self.user.finditer(text) for x in m.span())})
        return list(zip(at, at[1:]))

    def bytes_for(self, text: str, encoding: Encoding) -> list[int]:
        """The ids, unknown stretches spelled in bytes where the model has them."""
        ids = encoding.ids
        if not self.model.byte_fallback or self.model.kind == BPE or self.unknown not in ids:
            return ids
        return [j for i, (a, b) in zip(ids, encoding.offsets) for j in ([self.ids[f"<0x{x:02X}>"] for x in text[a:b].encode()] if i == self.unknown else [i])]

    def merged(self, ids: list[int]) -> list[int]:
        """Unknown stretches that touch are one."""
        return ids if self.unknown not in ids else [i for i, before in zip(ids, [-1, *ids]) if i != self.unknown or before != i]

    def learn(self, new: list[str], group: int = 50, at_once: int = 5000) -> None:
        """Encodes chunks, in groups joined by line breaks where those mark the seams. Encodings are large, so only some groups are held at a time."""
        for i in range(0, len(new), at_once):
            part = new[i : i + at_once]
            if self.marks:
                self.learn_groups(part, group)
            else:
                self.known.update((c, np.asarray(ids, "<u4").tobytes()) for c, ids in zip(part, self.encode(part)))

    def learn_groups(self, new: list[str], group: int) -> None:
        joined = ["\n" + "\n".join(new[i : i + group]) for i in range(0, len(new), group)]
        told = self.reader.encode([t.replace(MARKER, " ") for t in joined], num_threads=self.threads) if self.reader is not None and self.by_chunk else None
        for i, mine in enumerate(self.encode(joined)):
            part = new[i * group : (i + 1) * group]
            flat = np.asarray(mine, "<u4")
            stops = [*np.flatnonzero(flat == mine[0]).tolist(), len(flat)]
            raw = flat.tobytes()
            self.known.update((c, raw[4 * a + 4 : 4 * b]) for c, a, b in zip(part, stops, stops[1:]))
            if told is not None and told[i][int(self.model.dummy_prefix) :] != mine:
                self.differ.update(part)

    def batch(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        if len(self.known) > self.keep:
            self.known.clear()
            self.differ.clear()
        normal = [self.model.normalise(t, self.precompiled) for t in texts]
        if self.cut is None or self.user is not None:
            out = [np.asarray(ids, "<u4").tobytes() for ids in self.encode(normal)]
        else:
            self.known["\n"] = np.asarray(self.broken, "<u4").tobytes()
            chunks = [self.cut.findall(t) for t in normal]
            self.learn(list({c for cs in chunks for c in cs}.difference(self.known)))
            out = [b"".join(map(self.known.__getitem__, cs)) for cs in chunks]
            if not self.model.byte_fallback:
                out = [np.asarray(self.merged(np.frombuffer(ids, "<u4").tolist()), "<u4").tobytes() for ids in out]
            if self.by_chunk:
                return [(ids, not self.differ or self.differ.isdisjoint(cs)) for ids, cs in zip(out, chunks)]
        told = self.reader.encode(texts, num_threads=self.threads) if self.reader is not None else None
        return [(ids, told is None or np.asarray(told[i], "<u4").tobytes() == ids) for i, ids in enumerate(out)]


class Decoder:
    """text(ids) of little-endian unsigned 32-bit bytes: only the pieces' spelling is needed."""

    def __init__(self, data: bytes):
        self.model = PieceModel.parse(data)
        self.bytes_of = self.model.spelled()

    def text(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        each = list(map(self.bytes_of.__getitem__, found))
        if self.model.dummy_prefix or self.model.squeeze:
            for i, spelling in enumerate(each):  # the first piece loses a blank; a squeezing model goes on until something is left
                each[i] = spelling if found[i] == self.model.unknown else spelling.removeprefix(b" ")
                if each[i] or not self.model.squeeze:
                    break
        return b"".join(each).decode("utf-8", "replace")


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", parity_col: str | None = "parity", threads: int = 2) -> DataFrame:
    """docs(...) with ids_col, the ids as little-endian unsigned 32-bit integers, and parity_col: sentencepiece gave the same. A null text has null ids; an empty one none."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, threads, parity_col is not None)
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            got = codec.batch([t or "" for t in texts])
            new = [pa.array([None if t is None else i for t, (i, _) in zip(texts, got)], pa.binary())]
            if parity_col:
                new.append(pa.array([ok for _, ok in got]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, ids_col, *([parity_col] if parity_col else [])])

    schema = StructType([*docs.schema.fields]).add(ids_col, BinaryType())
    return spread(docs).mapInArrow(run, schema.add(parity_col, BooleanType()) if parity_col else schema)


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs(...) with text_col, the text that the ids spell; null for null ids. Ids that spell no valid UTF-8 give replacement characters."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            ids = batch.column(names.index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else decoder.text(i) for i in ids], pa.string())], names=[*names, text_col])

    return spread(docs).mapInArrow(run, StructType([*docs.schema.fields]).add(text_col, StringType()))


def code_round(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, parity, round_trip: whether the decoded ids are the text again. Null texts count as empty; repeated rows are each coded; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = decode(encode(rows, model), model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "parity", (F.col("decoded") == F.col("text")).alias("round_trip"))
