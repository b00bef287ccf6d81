"""Document fingerprints by winnowing.

Hashes of all k-grams of code points are taken by doubling; of every window of
``w`` consecutive hashes the least is chosen, the rightmost of equal ones.  Any
passage of at least w + k - 1 code points that two texts share gives both a
common hash, and positions are kept, so a match can be located.

Very long texts go through in blocks that overlap by a window, with the same
result.  Texts move once over the network, to consecutive ranges of doc_id; the
first row of each range also goes to the range before it, so every row meets
its successor without a global order in one task.

Defined results: null is the empty text, whose fingerprint is empty; a text
shorter than k is one gram; fewer hashes than a window are one window; equal
texts have equal fingerprints; rows with equal doc_id are ordered by text, null
ids come first; with a single row, the row is its own successor; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Code points of a gram; hashes of a window (below 256, as positions are kept as steps of one byte).
K, W = 16, 32
#: Hashes of a block; bits of a hash.
BLOCK, HASH_BITS = 1 << 20, 40
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << (64 - HASH_BITS)) - 1)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of the code points."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    part = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    part ^= part >> np.uint64(29)
    whole, size, bits = None, 0, k
    length, step = 1, part
    while bits:
        power = np.uint64(pow(_BASE, length, 1 << 64))  # shifts what stands before a stretch of this length
        if bits & 1:  # append the stretch of this length to what is there
            if whole is None:
                whole, size = step, length
            else:
                m = n - size - length + 1
                whole, size = whole[:m] * power + step[size : size + m], size + length
        bits >>= 1
        if bits:
            m = n - 2 * length + 1
            step = step[:m] * power + step[length : length + m]
            length *= 2
    whole = (whole ^ (whole >> np.uint64(31))) * _MIX
    return (whole ^ (whole >> np.uint64(32))) >> np.uint64(64 - HASH_BITS)


def choose(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen: the rightmost least hash of each window."""
    out, n = [], len(hashes)
    for start in range(0, max(1, n - w + 1), BLOCK):
        part = hashes[start : start + BLOCK + w - 1]
        if not len(part):
            break
        key = (part << np.uint64(64 - HASH_BITS)) | (_POS - np.arange(len(part), dtype=np.uint64))
        size, width = 1, min(w, len(part))
        while 2 * size <= width:
            key = np.minimum(key[: len(key) - size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        key = key[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])]
        out.append((_POS - (key & _POS)).astype(np.int64) + start)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the text's fingerprint, in order of position."""
    hashes = grams(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32), k)
    at = choose(hashes, w)
    return hashes[at], at


def written_out(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: five bytes of hash and one of step from the position before, in base 64."""
    raw = np.empty((len(hashes), 6), np.uint8)
    raw[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    raw[:, 5] = np.diff(positions, prepend=0)
    return base64.b64encode(raw.tobytes()).decode()


def read_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, 3:] = raw[:, :5]
    return whole.view(">u8").reshape(-1).astype(np.uint64), np.cumsum(raw[:, 5].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of distinct hashes of either set that both have; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ / (len(both) - common_)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id and fingerprint (text as by written_out) of each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.StringType())])
    return common.map_batches(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column(0), "fingerprint": [written_out(*winnow(t, k, w)) for t in common.texts_of(b)]}, schema)


def with_successors(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and guest, dealt by part and sorted so that each own row (guest 0) is followed by its successor.

    The successor of a part's last row comes as a guest (guest 1); after the last row of all comes the first.
    """
    spark = docs.sparkSession
    at, parts = common.range_of(docs, "doc_id", common.shuffle_parts(spark))
    part = F.coalesce(at, F.lit(0)).cast("int")
    least = docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("part").collect()  # a row for each part
    had = [r["part"] for r in least] or [0]
    before = {p: had[k - 1] for k, p in enumerate(had)}
    firsts = [r["first"] for r in least if not r["nulls"]]
    is_first = F.col("doc_id").isin(firsts) if firsts else F.lit(False)
    if any(r["nulls"] for r in least):
        is_first = is_first | F.col("doc_id").isNull()
    to = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(parts)]), F.col("part") + 1)
    own, guest = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(to.alias("part"), F.lit(1).alias("guest"))
    rows = docs.select("doc_id", "text", part.alias("part")).withColumn("to", F.when(F.coalesce(is_first, F.lit(False)), F.array(own, guest)).otherwise(F.array(own)))
    rows = rows.select("doc_id", "text", F.explode("to").alias("to")).select("doc_id", "text", "to.part", "to.guest")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")


def edited_pairs(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per row: n_chars, and fingerprints of its text and of its edited text, with likenesses.

    The edited text has its last quarter of code points (rounded down) replaced
    by as many from the start of the next document, ascending doc_id.
    """
    kinds = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(a, b) for a, b in kinds]])
    arrow = common.arrow_schema(schema)
    common.bounded_batches(docs.sparkSession)

    def row(own: tuple, following: tuple) -> tuple:
        doc_id, text, (hashes, at) = own
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[1][:cut]
        e_hashes, e_at = (hashes, at) if edited == text else winnow(edited, k, w)
        mine = np.unique(hashes)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written_out(hashes, at), written_out(e_hashes, e_at),
            likeness(mine, np.unique(e_hashes)), likeness(mine, np.unique(following[2][0])),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, part = None, None
        for batch in batches:
            rows = []
            for doc_id, text, of, guest in zip(batch.column(0).to_pylist(), common.texts_of(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if guest and (pending is None or of != part):
                    continue  # another guest, or one of a part without rows
                now = (doc_id, text, winnow(text, k, w))
                if pending is not None:
                    rows.append(row(pending, now))
                pending, part = (None, of) if guest else (now, of)
            if rows:
                yield common.to_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return with_successors(docs).mapInArrow(run, schema)
