"""Packing of token sequences: bounded-space online best fit.

A partition's documents come as a stream.  A fixed number of windows is open;
a document's full-length stretches leave at once, its rest goes to the open
window that it fills best.  When none has room and no more may be opened, the
fullest is topped up with the head of the rest and emitted.  At the end the
open windows are merged: whole windows into one another, then by topping up,
so at most one window of a partition is not full; that one leaves in lengths
that are powers of two, which need no padding.

Memory is bounded by one batch of texts and the open windows; rows never leave
their partition, so there is no shuffle and nothing to skew.

Defined results: null and empty texts are the end id alone; null ids and equal
rows are packed as they are; an empty table gives an empty result; each id lies
in exactly one piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common

#: Ids of a full window, and windows open at once in a partition.
LENGTH, OPEN = 2048, 64

#: doc (any handle), first id's place in the document, ids of the piece, ids of the document
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Packs a stream; ``add`` and ``finish`` yield sequences, each a list of pieces."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN) -> None:
        self.length, self.windows = length, windows
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int]] = []  # (room left, window), in order
        self.serial = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, at = len(ids), 0
        while total - at >= self.length:
            yield [(doc, at, ids[at : at + self.length], total)]
            at += self.length
        while at < total:
            rest = total - at
            k = bisect_left(self.gaps, (rest, -1))
            if k < len(self.gaps):
                gap, window = self.gaps.pop(k)
            elif len(self.gaps) < self.windows:
                gap, window = self.length, self.serial
                self.serial += 1
                self.open[window] = []
            else:
                gap, window = self.gaps.pop(0)
            take = min(gap, rest)
            self.open[window].append((doc, at, ids[at : at + take], total))
            at += take
            if take == gap:
                yield self.open.pop(window)
            else:
                insort(self.gaps, (gap - take, window))

    def finish(self) -> Iterator[list[Piece]]:
        """The leftovers, merged."""
        bins: list[tuple[int, list[Piece]]] = []
        for gap, window in self.gaps:  # the fullest first
            used, pieces = self.length - gap, self.open[window]
            fits = [k for k, (n, _) in enumerate(bins) if n + used <= self.length]
            if fits:
                k = max(fits, key=lambda k: bins[k][0])
                bins[k] = (bins[k][0] + used, bins[k][1] + pieces)
            else:
                bins.append((used, list(pieces)))
        self.open, self.gaps = {}, []
        bins.sort(key=lambda b: -b[0])
        while bins:
            used, pieces = bins.pop(0)
            while used < self.length and bins:
                n, last = bins[-1]
                doc, start, ids, total = last.pop()
                take = min(len(ids), self.length - used)
                pieces.append((doc, start, ids[:take], total))
                used += take
                if take < len(ids):
                    last.append((doc, start + take, ids[take:], total))
                bins[-1] = (n - take, last)
                if not last:
                    bins.pop()
            if used == self.length:
                yield pieces
            else:
                yield from _in_powers(pieces, used)


def _in_powers(pieces: list[Piece], used: int) -> Iterator[list[Piece]]:
    """The pieces cut into sequences whose lengths are powers of two."""
    pieces = list(reversed(pieces))
    while used:
        room = size = 1 << (used.bit_length() - 1)
        out = []
        while room:
            doc, start, ids, total = pieces.pop()
            take = min(room, len(ids))
            out.append((doc, start, ids[:take], total))
            room -= take
            if take < len(ids):
                pieces.append((doc, start + take, ids[take:], total))
        used -= size
        yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int, words=common.SPACED_WORDS, length: int = LENGTH, windows: int = OPEN, cached: int = 600_000) -> DataFrame:
    """The pieces of all documents (doc_id, text) in sequences of at most ``length`` ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (the
    piece's place in its sequence).  ``cached`` bounds the words a Python worker
    remembers, twice that many in all; fewer take less memory and more time.
    """
    common.bounded_batches(docs.sparkSession)
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length")]
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs, T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = common.word_cache(tokenizer, words, cached), Packer(length, windows)
        end = np.array([end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def place(done: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in done:
                rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            batch = common.to_batch(dict(zip(arrow.names, zip(*rows))), arrow)
            rows.clear()
            return batch

        for batch in batches:
            docs_of = common.values_of(batch, "doc_id")
            for doc, ids in zip(docs_of, cache.encode_column(batch.column(batch.schema.get_field_index("text")))):
                for done in packer.add(doc, np.concatenate([ids, end])):
                    place(done)
                if len(rows) >= 4096:
                    yield out()
        for done in packer.finish():
            place(done)
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
