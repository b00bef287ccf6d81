"""Binary token files: an adaptive context-mixing range coder over token ids.

A file holds the ids of consecutive documents.  Ids are cut into blocks that are
coded independently: each starts from a fresh model and carries a checksum, so
any block decodes alone and damage stays within it.  The probability of an id x
is a mixture of three predictions,

    P(x) = w2 [x = c2] + w1 [x = c1] + w0 P0(x),

* order 2: c2, the id remembered for the two ids before it,
* order 1: c1, the id remembered for the id before it,
* order 0: P0, one of up to TABLES frequency tables in the file's header, chosen
  anew by how well each has told the block's ids of late.

Every part adapts within its block, after every STEP ids.  A remembered id has a confidence that rises
with every right prediction and falls with a wrong one; only a weak one is
replaced.  Both confidences pick the weights w2 and w1, which follow how often
the predictions were right there (where c1 = c2, w1 is 0).  An id that two
predictions tell gets the sum of their shares.  A range coder with 60 bits of
state and 28-bit digits codes the result; all of it is integer arithmetic, so
files decode alike on any machine.

All blocks of a file are coded side by side, one numpy lane for each block, so
the cost of Python is paid once for each position in a block.

Defined results: a null text is an empty document (the end id alone), an empty
table gives no files, null ids come first and stay null, repeated rows stay rows
of their own; a text of any length is held whole by one task, which closes a
file after at least ``file_tokens`` ids.  ``doc_id`` must be an integer column;
columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

MAGIC = b"TCM2"
#: Ids of a block; slots of a block's tables of remembered ids, one table an order (a power of two).
BLOCK, SLOTS = 8192, 4096
#: Frequency tables of order 0 at most, ids for each of them at least, and ids after which a block's state changes (less than 2 to the power of _RATE).
TABLES, TABLE_TOKENS, STEP = 8, 1 << 16, 16
#: Bits of the mixing weights and of a digit.
W_BITS, DIGIT = 12, 28
#: Ids after which a file is closed.
FILE_TOKENS = 1 << 24
#: First and greatest weight of a prediction, and how slowly weights move (as a shift).
_FIRST, _MOST, _RATE = 1024, 4032, 5
_HEAD = struct.Struct("<4sIIIIIIIIII")
_LOW = (1 << DIGIT) - 1
_STATE = 32 + DIGIT  # bits of the coder's state; a span keeps more than 32 of them


class Damaged(ValueError):
    """A file or block whose checksum does not hold."""


# -- the model -----------------------------------------------------------------

#: By 2 * confidence + right: the new confidence less the old one, and whether another id moves in (with confidence 1).
_CHANGE = np.array([0, 0, 0, 1, -1, 1, -1, 0], np.int32)
_REPLACED = np.array([1, 0, 1, 0, 0, 0, 0, 0], np.int32)


class _Model:
    """The lanes' adaptive state; the coder and the decoder keep it alike.

    Arrays of two rows hold order 2 in the first and order 1 in the second.
    A remembered id x with confidence c in 1, 2, 3 is the entry 4 (x + 1) + c; 0
    is none, and has no weight.  The state changes after every STEP ids.
    """

    def __init__(self, lanes: int, freq: np.ndarray) -> None:
        tables, ids = freq.shape
        self.lanes, self.width = lanes, ids + 1
        self.bits = int(freq[0].sum()).bit_length() - 1
        # by table and id + 1
        self.freq = np.concatenate([np.zeros((tables, 1), np.int64), freq], axis=1).reshape(-1)
        self.cum = np.concatenate([np.zeros((tables, 1), np.int64), np.cumsum(freq, axis=1) - freq], axis=1).reshape(-1)
        part, whole = np.frexp(freq.T.astype(float))
        self.level = whole * np.int32(16) + (part * 32).astype(np.int32)  # 16 times a logarithm, exact on any machine
        self.score = np.zeros((lanes, tables), np.int32)
        lane = np.arange(lanes, dtype=np.int64)
        # slot by slot, so that the lanes' entries of a frequent context share cache lines; as narrow as the ids allow
        self.known = np.zeros(2 * lanes * SLOTS, np.uint16 if 4 * ids + 7 < 1 << 16 else np.int32)
        self.base = np.stack([SLOTS * lanes + lane, lane])
        spread = np.arange(ids, dtype=np.int64)
        self.slot1, self.slot2 = (spread * 0x9E3779B1 >> 15) & (SLOTS - 1), (spread * 0x85EBCA6B >> 13) & (SLOTS - 1)
        self.last = np.zeros((2, lanes), np.int64)  # the two ids before, the older one first
        kind = np.arange(16)
        self.weight = np.stack([np.tile(np.where(kind >> 2 & 3, _FIRST, 0), lanes), np.tile(np.where(kind & 3, _FIRST, 0), lanes)]).astype(np.int64).reshape(-1)
        self.context = np.stack([lane * 16, (lanes + lane) * 16])  # 64 bits wide: take is several times slower by other places
        self._set_out()

    def _set_out(self) -> None:
        self.weight0 = (1 << W_BITS) - self.weight[: len(self.weight) // 2] - self.weight[len(self.weight) // 2 :]
        self.share = self.weight << self.bits
        self.table = self.score.argmax(axis=1)
        self.slots, self.table = self.table << self.bits, self.table * self.width

    def kinds(self, entry: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of the two weights, for entries (..., 2, lanes); where both orders say the same, order 1 has no weight."""
        sure = entry & 3
        kind = sure[..., 1, :] * (ids[..., 0, :] != ids[..., 1, :])
        kind += sure[..., 0, :] * np.int32(4)
        return self.context + kind[..., None, :]

    def learn(self, x: np.ndarray, at: np.ndarray, entry: np.ndarray, kind: np.ndarray, right: np.ndarray) -> None:
        """Goes on by the ids x (steps x lanes), the entries at their places, and which were right (steps x 2 x lanes)."""
        state = (entry & 3) * np.int32(2)
        state += right
        state = state.astype(np.intp)
        new = (x * 4 + 5).astype(np.int32)[:, None] - entry
        new *= _REPLACED.take(state)
        new += entry
        new += _CHANGE.take(state)
        self.known[at] = new.astype(self.known.dtype, copy=False)  # of entries at one place the last stays
        told = right.copy()
        told[:, 1] &= ~right[:, 0]  # what order 2 told is not put down to order 1
        kind = kind * 2
        kind += told
        met = np.bincount(kind.reshape(-1), minlength=2 * len(self.weight)).reshape(-1, 2)
        self.weight += (met[:, 1] * (_MOST - self.weight) - met[:, 0] * self.weight) >> _RATE
        self.score -= self.score >> 1
        self.score += self.level.take(x.reshape(-1), axis=0).reshape(*x.shape, -1).sum(axis=0, dtype=np.int32)
        self.last = np.concatenate([self.last, x])[-2:]
        self._set_out()


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to a power of two, at least 1 each."""
    whole = 1 << max(12, len(counts).bit_length() + 2)
    if whole > 1 << 20:
        raise ValueError("too many distinct ids for one file")
    freq = np.maximum(1, (counts * ((whole - len(counts)) / max(1.0, counts.sum()))).astype(np.int64))
    freq[int(np.argmax(freq))] += whole - int(freq.sum())
    return freq


def _counts(values: np.ndarray, least: int = 0) -> np.ndarray:
    counts = np.zeros(max(least, int(values.max(initial=0)) + 1), np.int64)
    for part in _pieces(values):
        counts += np.bincount(part, minlength=len(counts))
    return counts


def _pieces(values: np.ndarray) -> list[np.ndarray]:
    """For np.bincount and take, which make eight bytes of each value first."""
    return [values[k : k + (1 << 18)] for k in range(0, len(values), 1 << 18)]


def _tables(dense: np.ndarray, ids: int) -> np.ndarray:
    """Frequency tables (tables x ids) that tell the stretches of a file well, each stretch by one of them.

    A clustering by code length: first of long stretches in every part of the
    file, then of short ones; the counts in the end are those of all ids.
    """
    counts = _counts(dense, ids).astype(float)
    tables = max(1, min(TABLES, len(dense) // TABLE_TOKENS))
    if tables == 1:
        return _frequencies(counts)[None]
    prior = counts * (50.0 / len(dense))
    own, cost = np.random.default_rng(0), None
    for stretch, rounds, ids_most in ((1024, 8, 1 << 19), (64, 3, 1 << 18), (64, 1, len(dense))):
        rows = dense[: len(dense) // stretch * stretch].reshape(-1, stretch)
        rows = rows[:: max(1, rows.size // ids_most)]
        for _ in range(rounds):
            if cost is None:
                of = own.integers(0, tables, len(rows))
            else:
                of = np.concatenate([_cheapest(part, cost) for part in np.array_split(rows, -(-rows.size // (1 << 18)))])
            found = np.stack([_counts(rows[of == k].reshape(-1), ids) for k in range(tables)]) + prior
            cost = np.log2(found / found.sum(axis=1, keepdims=True)).astype(np.float32)
    return np.stack([_frequencies(f) for f in found])


def _cheapest(rows: np.ndarray, cost: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.intp)
    return np.stack([c.take(rows).sum(axis=1) for c in cost]).argmax(axis=0)


# -- the coder -----------------------------------------------------------------


def _encode_lanes(rows: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits (lane by lane, flat) and their number per lane, for rows of dense ids (lanes x length)."""
    lanes, length = rows.shape
    model = _Model(lanes, freq)
    bits = W_BITS + model.bits
    low, span = np.zeros(lanes, np.int64), np.full(lanes, (1 << _STATE) - 1, np.int64)
    out, used = np.zeros((length // 3 + 2, lanes), np.int32), np.zeros(lanes, np.int64)
    flat, lane = out.reshape(-1), np.arange(lanes, dtype=np.int64)
    columns = _turned(rows)
    for begin in range(0, length, STEP):
        x = columns[begin : begin + STEP].astype(np.int64)
        context = np.concatenate([model.last, x])
        at = np.empty((len(x), 2, lanes), np.int64)
        at[:, 1] = model.slot1.take(context[1:-1])
        at[:, 0] = (at[:, 1] + model.slot2.take(context[:-2])) & (SLOTS - 1)
        at *= lanes
        at += model.base
        entry = model.known.take(at).astype(np.int32, copy=False)
        ids = entry >> 2
        kind = model.kinds(entry, ids)
        share, weight0 = model.share.take(kind), model.weight0.take(kind[:, 0])
        x1 = (x + 1).astype(np.int32)[:, None]
        right = ids == x1
        own = x + (model.table + 1)
        size, start = model.freq.take(own), model.cum.take(own)
        size *= weight0
        part = share * right
        size += part[:, 0]
        size += part[:, 1]
        start *= weight0
        share *= ids < x1
        start += share[:, 0]
        start += share[:, 1]
        if used.max() + STEP >= len(out):  # a step writes one digit at most
            out = np.concatenate([out, np.zeros((len(out) // 2 + 2 * STEP, lanes), np.int32)])
            flat = out.reshape(-1)
        for size_t, start_t in zip(size, start):
            span >>= bits
            start_t *= span
            low += start_t
            span *= size_t
            over = (low >> _STATE).nonzero()[0]
            if len(over):
                low[over] &= (1 << _STATE) - 1
                flat[(used[over] - 1) * lanes + over] += 1
            short = (span < 1 << 32).nonzero()[0]
            if len(short):
                part, n = low[short], used[short]
                flat[n * lanes + short] = part >> 32
                used[short] = n + 1
                low[short] = (part & 0xFFFFFFFF) << DIGIT
                span[short] <<= DIGIT
        model.learn(x, at, entry, kind, right)
    # a last digit that lies in the span whatever follows: the state's upper bits, rounded up
    flat[used * lanes + lane] = (low + 0xFFFFFFFF) >> 32
    used += 1
    for k in range(int(used.max()) - 1, 0, -1):
        out[k - 1] += out[k] >> DIGIT
        out[k] &= _LOW
    out = np.ascontiguousarray(out[: used.max()].T)
    return out[np.arange(out.shape[1]) < used[:, None]], used


def _decode_lanes(digits: np.ndarray, used: np.ndarray, length: int, freq: np.ndarray) -> np.ndarray:
    lanes = len(used)
    model = _Model(lanes, freq)
    bits = W_BITS + model.bits
    holders = np.concatenate([np.repeat(np.arange(len(f), dtype=np.int32), f) for f in freq])
    wide = int(used.max(initial=0)) + 4
    code_in = np.zeros((lanes, wide), np.int64)
    code_in[np.arange(wide) < used[:, None]] = digits
    flat, next_digit = code_in.reshape(-1), np.arange(lanes, dtype=np.int64) * wide + 3
    # the state has two digits and the upper bits of a third; the rest of that one comes with the next shift
    code = (code_in[:, 0] << 32) | (code_in[:, 1] << 4) | (code_in[:, 2] >> 24)
    rest = code_in[:, 2] & 0xFFFFFF
    span = np.full(lanes, (1 << _STATE) - 1, np.int64)
    columns = np.empty((length, lanes), _narrow(freq.shape[1]))
    first = np.empty((2, lanes), bool)
    for begin in range(0, length, STEP):
        n = min(STEP, length - begin)
        x_all, right_all = np.empty((n, lanes), np.int64), np.empty((n, 2, lanes), bool)
        at_all, entry_all, kind_all = np.empty((n, 2, lanes), np.int64), np.empty((n, 2, lanes), np.int32), np.empty((n, 2, lanes), np.int64)
        table, (older, last) = model.table, model.last
        for t in range(n):
            at = at_all[t]
            now = model.slot1.take(last)
            at[1] = now
            now += model.slot2.take(older)
            now &= SLOTS - 1
            at[0] = now
            at *= lanes
            at += model.base
            entry = model.known.take(at).astype(np.int32, copy=False)
            ids = entry >> 2
            kind = model.kinds(entry, ids)
            share, weight0 = model.share.take(kind), model.weight0.take(kind[0])
            span >>= bits
            v = code // span
            # where the two predictions' shares begin: order 2's comes first if both are the same
            start = model.cum.take(ids + table)
            start *= weight0
            np.less(ids[1], ids[0], out=first[0])
            np.logical_not(first[0], out=first[1])
            start += share[::-1] * first
            off = v - start
            np.maximum(off, 0, out=off)
            np.minimum(off, share, out=off)
            v -= off[0]
            v -= off[1]
            v //= weight0
            v += model.slots
            x = holders.take(v, mode="clip").astype(np.int64)
            x_all[t], entry_all[t], kind_all[t] = x, entry, kind
            older, last = last, x
            x = x + 1
            x1 = x.astype(np.int32)
            right = np.equal(ids, x1, out=right_all[t])
            x += table
            size, start = model.freq.take(x), model.cum.take(x)
            size *= weight0
            part = share * right
            size += part[0]
            size += part[1]
            start *= weight0
            share *= ids < x1
            start += share[0]
            start += share[1]
            start *= span
            code -= start
            span *= size
            short = (span < 1 << 32).nonzero()[0]
            if len(short):
                here = next_digit[short]
                new = flat.take(here, mode="clip")  # a damaged block may run on into the next
                code[short] = (code[short] << DIGIT) | (rest[short] << 4) | (new >> 24)
                rest[short] = new & 0xFFFFFF
                next_digit[short] = here + 1
                span[short] <<= DIGIT
        columns[begin : begin + n] = x_all
        model.learn(x_all, at_all, entry_all, kind_all, right_all)
    return _turned(columns)


def _narrow(ids: int) -> type:
    """For a file's dense ids: a task holds some copies of them at once."""
    return np.uint16 if ids <= 1 << 16 else np.int32


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transposed array, made in strips that fit the cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for k in range(0, len(rows), 64):
        out[:, k : k + 64] = rows[k : k + 64].T
    return out


def _pack(digits: np.ndarray) -> bytes:
    pairs = np.r_[digits, np.zeros(len(digits) % 2, np.int64)].reshape(-1, 2)
    whole = (pairs[:, 0] << DIGIT) | pairs[:, 1]
    return np.ascontiguousarray(whole.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, 1:] = raw
    whole = whole.view(">u8").reshape(-1).astype(np.int64)
    return np.column_stack([whole >> DIGIT, whole & _LOW]).reshape(-1)[:n]


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int | None = None) -> bytes:
    """A file of documents: their ids, their numbers of token ids, and all token ids.

    Blocks have BLOCK ids; those of a small file have fewer, down to an eighth, so that 64 are coded side by side.
    """
    block = block or min(BLOCK, max(BLOCK // 8, -(-len(ids) // 64)))
    ids = np.ascontiguousarray(ids, np.uint32)
    index = np.array([x if x is not None else 0 for x in doc_ids], np.int64)
    absent = np.packbits([x is None for x in doc_ids]) if doc_ids else np.zeros(0, np.uint8)
    index = zlib.compress(np.diff(index, prepend=np.int64(0)).tobytes() + np.asarray(lengths, np.int64).tobytes() + absent.tobytes(), 6)
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = _counts(ids)
        present = np.flatnonzero(counts)
        place = np.zeros(len(counts), _narrow(len(present)))
        place[present] = np.arange(len(present))
        dense = np.concatenate([place.take(part) for part in _pieces(ids)])
    else:
        present, dense = np.unique(ids, return_inverse=True)
    freq = _tables(dense, len(present)) if len(ids) else np.zeros((0, 0), np.int64)
    table = zlib.compress(np.diff(present.astype(np.uint32), prepend=np.uint32(0)).tobytes() + freq.astype(np.uint32).tobytes(), 6)
    block = max(1, min(block, len(ids)))
    lanes = -(-len(ids) // block)
    dense = np.pad(dense, (0, lanes * block - len(ids)), mode="edge") if lanes * block > len(ids) else dense
    digits, used = _encode_lanes(dense.reshape(lanes, block), freq) if lanes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = np.array([zlib.crc32(ids[k * block : (k + 1) * block]) for k in range(lanes)], np.uint32)
    directory = used.astype(np.uint32).tobytes() + sums.tobytes()
    body = index + table + directory + _pack(digits)
    start = index + table + directory
    return _HEAD.pack(MAGIC, zlib.crc32(start), len(doc_ids), len(ids), block, lanes, len(present), len(index), len(table), len(digits), len(freq)) + body


def decode_file(data: bytes, blocks: list[int] | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and token ids; with blocks, the token ids of those blocks alone."""
    magic, crc, n_docs, n_ids, block, lanes, n_present, n_index, n_table, n_digits, n_freq = _HEAD.unpack_from(data)
    at = _HEAD.size
    table_at, dir_at = at + n_index, at + n_index + n_table
    body_at = dir_at + 8 * lanes
    if magic != MAGIC or zlib.crc32(data[at:body_at]) != crc:
        raise Damaged("not a token file, or its header is damaged")
    index = zlib.decompress(data[at:table_at])
    doc_ids = np.cumsum(np.frombuffer(index, np.int64, n_docs)).tolist()
    lengths = np.frombuffer(index, np.int64, n_docs, 8 * n_docs)
    absent = np.unpackbits(np.frombuffer(index, np.uint8, -1, 16 * n_docs), count=n_docs) if n_docs else []
    doc_ids = [None if a else x for x, a in zip(doc_ids, absent)]
    table = zlib.decompress(data[table_at:dir_at])
    present = np.cumsum(np.frombuffer(table, np.uint32, n_present), dtype=np.uint32)
    freq = np.frombuffer(table, np.uint32, n_freq * n_present, 4 * n_present).astype(np.int64).reshape(n_freq, n_present)
    used = np.frombuffer(data, np.uint32, lanes, dir_at).astype(np.int64)
    sums = np.frombuffer(data, np.uint32, lanes, dir_at + 4 * lanes)
    if not lanes:
        return doc_ids, lengths, np.zeros(0, np.uint32)
    digits, take = _unpack(data[body_at:], n_digits), np.arange(lanes)
    if blocks is not None:
        ends, take = np.cumsum(used), np.array(blocks)
        digits = np.concatenate([digits[ends[k] - used[k] : ends[k]] for k in blocks])
    parts = []
    for row, k in zip(_decode_lanes(digits, used[take], block, freq), take.tolist()):
        part = present.take(row[: min(block, n_ids - k * block)])
        if zlib.crc32(part) != sums[k]:
            raise Damaged(f"block {k} is damaged")
        parts.append(part)
    return doc_ids, lengths, np.concatenate(parts)


# -- files of a corpus ---------------------------------------------------------

_FILES = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("part_start", "n_docs", "n_tokens")]
    + [T.StructField("data", T.BinaryType())]
)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, words=common.BARE_WORDS, file_tokens: int = FILE_TOKENS, cached: int = 600_000, path: str | None = None) -> DataFrame:
    """The token files of docs (doc_id, text) as a written table, in ascending doc_id order by (part, file).

    With a path the table is written there, to stay; else it goes when the session ends.

    Texts go once over the network, to consecutive ranges of doc_id; each range
    is encoded as a stream, so a task holds one file's ids at a time.  Null
    texts are empty, null ids come first, rows of one id stay rows of their own.
    ``cached`` bounds the words that a Python worker remembers.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark, 2000)  # more rows, fewer distinct words for each; bytes are bounded too
    # half as many ranges as shuffles have: longer files have more blocks to code side by side
    at, parts = common.range_of(docs, "doc_id", -(-common.shuffle_parts(spark) // 2))
    dealt = docs.select("doc_id", "text", F.coalesce(at, F.lit(0)).cast("int").alias("part")).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "text")
    schema = common.arrow_schema(_FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.word_cache(tokenizer, words, cached)
        end = np.array([end_id], np.uint32)
        held_ids: list = []
        held: list[np.ndarray] = []
        size, part, file, before = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held_ids, held, size, file, before
            lengths, ids = np.array([len(x) for x in held], np.int64), np.concatenate(held)
            held = []
            row = {"part": [part], "file": [file], "part_start": [before], "n_docs": [len(held_ids)], "n_tokens": [size], "data": [encode_file(held_ids, lengths, ids)]}
            held_ids, before, size, file = [], before + size, 0, file + 1
            pa.default_memory_pool().release_unused()  # a worker that waits would keep it
            return common.to_batch(row, schema)

        for batch in batches:
            for doc_id, of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), cache.encode_column(batch.column(1))):
                if part != of:
                    if held:
                        yield close()
                    part, file, before = of, 0, 0
                held_ids.append(doc_id)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= file_tokens:
                    yield close()
        if held:
            yield close()

    files = dealt.mapInArrow(run, _FILES)
    if path is None:
        return common.written(files, "tokens")
    files.write.mode("overwrite").parquet(path)
    return spark.read.schema(_FILES).parquet(path)


_INDEX = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_index(files: DataFrame) -> DataFrame:
    """Per document, from its decoded file: doc_id, start, n_tokens and ids_crc32."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part
    starts = np.cumsum([0, *[r["n"] for r in totals]]).tolist()
    base = spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts)], "part int, base long")
    common.bounded_batches(spark)
    schema = common.arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, before = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                doc_ids, lengths, ids = decode_file(batch.column(2)[k].as_py())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield common.to_batch({"part": np.full(len(doc_ids), part, np.int32), "doc_id": doc_ids, "start": before + ends - lengths, "n_tokens": lengths, "ids_crc32": sums}, schema)

    found = files.select("part", "part_start", "data").mapInArrow(run, _INDEX)
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
