"""SentencePiece models run by the ``tokenizers`` library.

The model's protobuf is read field by field; normaliser, white-space marker,
scores or merges, byte fallback and decoder are rebuilt from it.  A BPE model's
merges follow from its pieces: every split of a piece into two others, by the
piece's score.  Texts are encoded in batches, by as many threads as a task has
cores (``spark.task.cpus``).  ``parity`` compares ids and decoded texts with
the ``sentencepiece`` library; every worker checks ``PROBES`` before its first
batch and fails if they differ.

Defined results: null and empty texts have no ids and decode to the empty text;
equal rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts that every worker encodes by both libraries first.
PROBES = ["", " ", "Hello  world.", " two  spaces \n\n line", "naïve Straße, 12345 ½ ① ﬁ", "日本語 кириллица 🙂👍🏽", "a\tb\r\nc", "<s> </s> <unk> <0x41> ▁▁x", "é é ​x", "x" * 300]


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields: int, or bytes for the other wire types."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What a model file says: pieces (text, score, type), kind, flags and the normaliser's table."""

    def __init__(self, path: str) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.remove_extra = bool(normalizer.get(4, 1))
        self.escape_space = bool(normalizer.get(5, 1))
        self.unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """The merges of a BPE model, best first."""
        known = {p: s for p, s, t in self.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for rank, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, UNUSED):
                found += [(-score, rank, k, (piece[:k], piece[k:])) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
        return [pair for *_, pair in sorted(found)]

    def tokenizer(self):
        """The model as a ``tokenizers.Tokenizer``."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: k for k, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"models of kind {self.kind} are not supported")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Replace(Regex(r"\A(?=[\s\S])"), " "))
        if self.escape_space:
            steps.append(normalizers.Replace(" ", MARK))
        tokenizer.normalizer = normalizers.Sequence(steps)
        if self.kind == BPE and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL):
            # no piece holds a marker after another character, so no merge crosses one
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, t in self.pieces if t == USER_DEFINED])
        return tokenizer


def parity(path: str, texts: list[str], tokenizer=None) -> list[str]:
    """The texts whose ids or decoded text differ between the two libraries."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = tokenizer or Model(path).tokenizer()
    bad = []
    for text, e in zip(texts, ours.encode_batch(texts, add_special_tokens=False)):
        ids = theirs.encode(text)
        if e.ids != ids or ours.decode(ids, skip_special_tokens=False) != theirs.decode(ids):
            bad.append(text)
    return bad


_made: dict[str, object] = {}


def worker_tokenizer(path: str, threads: int):
    """One tokenizer for each Python worker and model, checked against PROBES."""
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        tokenizer = Model(path).tokenizer()
        if bad := parity(path, PROBES, tokenizer):
            raise ValueError(f"the rebuilt model differs from its original on {bad!r}")
        _made[path] = tokenizer
    return _made[path]


def _threads(df: DataFrame) -> int:
    """Threads that encode or decode a batch: a task's cores, and two at least."""
    return max(2, int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each row (doc_id, text)."""
    threads = _threads(docs)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        found = worker_tokenizer(path, threads).encode_batch_fast(common.texts_of(batch), add_special_tokens=False)
        return {"doc_id": batch.column(0), "ids": [np.array(e.ids, np.uint32).tobytes() for e in found]}

    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row (doc_id, ids)."""
    threads = _threads(encoded)
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(x or b"", np.uint32).tolist() for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "text": worker_tokenizer(path, threads).decode_batch(ids, skip_special_tokens=False)}

    return common.map_batches(encoded.select("doc_id", "ids"), run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, decoded_chars, decoded_crc32 (of the decoded text's UTF-8), exact (decoded equals the text)."""
    threads = _threads(docs)
    kinds = [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_chars", T.LongType()), ("decoded_crc32", T.LongType()), ("exact", T.BooleanType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(a, b) for a, b in kinds]])

    def run(batch: pa.RecordBatch) -> dict:
        tokenizer, texts = worker_tokenizer(path, threads), common.texts_of(batch)
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = tokenizer.decode_batch(ids, skip_special_tokens=False)
        return {
            "doc_id": batch.column(0), "n_ids": [len(x) for x in ids], "ids_crc32": [zlib.crc32(np.array(x, np.uint32)) for x in ids],
            "decoded_chars": [len(t) for t in back], "decoded_crc32": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], "exact": [a == b for a, b in zip(texts, back)],
        }

    return common.map_batches(docs.select("doc_id", "text"), run, schema)
