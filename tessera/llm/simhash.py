"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are 64-bit votes over the XXH64 hashes of word shingles.  Two link
when at most ``radius`` bits differ.  Distinct fingerprints are dealt into
buckets by radius + 1 disjoint bit blocks, one of which must agree for any
linked pair, so no link is lost.  A bucket is compared in tiles with numpy:
exclusive-or, bit counts, and tile pairs whose population counts differ beyond
the radius are skipped.  A bucket of more than ``TILE`` fingerprints is split
into tiles by population count, and each pair of tiles is a unit of work of its
own, so no task gets an unbounded group.  A unit returns links that connect
what it found connected, at most one for each fingerprint, not all pairs;
components come from alternating star contraction.

``keep_dissimilar`` asks for a similarity instead: copies that share 0.8 of
their word shingles differ in about ten bits, too many for bit blocks to be
selective.  There buckets are by ``BANDS`` keys of ``ROWS`` minimal shingle
hashes, fingerprints in a bucket are compared at the radius ``WIDE``, and what
is near is confirmed by the exact Jaccard similarity of the shingle sets.  A
large bucket is first compared along an order of its fingerprints, which links
most of a group of copies; the rest, all pairs of it that are not yet linked,
follows in tiles.  Texts move only where they are compared.

Defined results: null or empty texts and texts without words have fingerprint
zero and link like any other; equal rows are kept, each with the same class;
an empty table gives an empty result; null ids never name a component unless
all ids in it are null; other columns of the input are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Most fingerprints of a tile.
TILE = 2048
#: Rows and columns of the blocks in which a tile pair is compared.
BLOCK = 512
#: Parts that the rows of one component are dealt to when they get its name.
SALTS = 16
#: Keys of a text's shingle set and minimal hashes of a key: at a similarity of 0.8, all keys of two texts differ for 7 pairs in a million.
BANDS, ROWS = 30, 5
#: Bits in which fingerprints of texts of a similarity of 0.8 may differ (9.7 are expected, 24 are five deviations more).
WIDE = 24
#: Texts of a bucket that are all compared with each other at once; a bucket that is dealt to more than one task; texts of a tile of the rest.
ALL_PAIRS, LARGE, REST = 64, 4096, 512
#: Most bitmaps, of 4 KB and up to 32,768 rows each, that are sent to all executors.
BITMAPS = 16_384
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 hashes of a text's word shingles, in order, eight bytes (big-endian) each; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)


def _voted(raw: np.ndarray) -> int:
    """The fingerprint that shingle hashes vote for."""
    n = len(raw)
    if not n:
        return 0
    if n < 256:
        votes = np.unpackbits(raw, axis=1).sum(axis=0)
    else:
        votes = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned."""
    return _voted(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in common.texts_of(batch)], np.uint64)
        return {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "fp": fps.view(np.int64)}

    return common.map_batches(docs.select("doc_id", "text"), run, schema)


# -- comparison of tiles ----------------------------------------------------


class _Forest:
    """Union-find over positions, joined in bulk."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        found = self.root[at]
        while True:
            up = self.root[found]
            if np.array_equal(up, found):
                return found
            found = up

    def join(self, a: int, b: int) -> bool:
        root = self.root
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        root[max(a, b)] = min(a, b)
        return a != b


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or within one, right None) that connect all that is within the radius.

    At most len(left) + len(right) - 1 links are returned; their connected
    components equal those of all links.
    """
    both = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(both), np.int8)
    side[len(left) :] = 1
    order = np.argsort(np.bitwise_count(both), kind="stable")
    fps, side = both[order], side[order]
    counts = np.bitwise_count(fps).astype(np.int64)
    forest, out = _Forest(len(fps)), []
    for i in range(0, len(fps), BLOCK):
        rows = slice(i, min(i + BLOCK, len(fps)))
        for j in range(i, len(fps), BLOCK):
            if counts[j] - counts[rows.stop - 1] > radius:
                break  # population counts only grow from here
            cols = slice(j, min(j + BLOCK, len(fps)))
            near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= radius
            if right is not None:
                near &= side[rows, None] != side[None, cols]
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            while len(a):
                apart = forest.find(a) != forest.find(b)
                a, b = a[apart], b[apart]
                first = np.unique(a, return_index=True)[1]
                out += [(x, y) for x, y in zip(a[first].tolist(), b[first].tolist()) if forest.join(x, y)]
    if not out:
        return fps[:0], fps[:0]
    at = np.array(out)
    return fps[at[:, 0]], fps[at[:, 1]]


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once; group g is fps[starts[g] : starts[g] + sizes[g]]."""
    index = np.repeat(np.arange(len(starts)), sizes)
    at = (np.repeat(starts, sizes) + np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int64)
    own, last = fps[at], np.repeat(np.cumsum(sizes), sizes)
    forest, a_out, b_out = _Forest(len(own)), [], []
    for d in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(np.arange(len(own)) + d < last)
        if not len(i):
            break
        i = i[np.bitwise_count(own[i] ^ own[i + d]) <= radius]
        if len(i):
            i = i[forest.find(i) != forest.find(i + d)]
            for x in i.tolist():
                if forest.join(x, x + d):
                    a_out.append(x)
                    b_out.append(x + d)
    return own[a_out], own[b_out]


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of so many disjoint blocks of the 64 bits."""
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _parts(n: int, radius: int) -> int:
    """Into how many blocks to cut fingerprints so that n of them make the fewest rows to compare.

    Of ``parts`` blocks two near fingerprints share parts - radius at least, so
    every choice of that many blocks is a key.  More blocks give more and
    longer keys: a fingerprint has a row for each key, times the tiles of its
    bucket.  All links are found whatever the number.
    """

    def rows(parts: int) -> float:
        shared = parts - radius
        return math.comb(parts, shared) * max(1.0, n / 2.0 ** (64 * shared / parts) / TILE)

    return min(range(radius + 1, max(radius + 2, min(64, radius + 5))), key=rows)


def _units(classes: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """Rows (unit, side, fp): what is to be compared with each other.

    side 0 alone: within; sides 1 and 2: across.
    """
    parts = parts or _parts(classes.count(), radius)
    blocks, keys = _blocks(parts), []
    for band, chosen in enumerate(itertools.combinations(blocks, parts - radius)):
        key = F.lit(0).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1))
        keys.append(F.struct(F.lit(band).alias("band"), key.alias("key")))
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", F.bit_count("fp").cast("int").alias("pc"), "b.band", "b.key")
    by_count = rows.groupBy("band", "key", "pc").agg(F.count("*").alias("n"))
    large = (
        by_count.groupBy("band", "key")
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("pc", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))).alias("have"))
        .filter(F.col("total") > TILE)
        .select("band", "key", "have")
    )
    rows = rows.join(large, ["band", "key"], "left")
    small = rows.filter(F.col("have").isNull()).select(F.struct("band", "key", *[F.lit(0).alias(c) for c in ("pa", "sa", "pb", "sb")]).alias("unit"), F.lit(0).alias("side"), "fp")
    own = F.expr("element_at(filter(have, h -> h.pc = pc), 1).tiles")
    others = F.expr(f"flatten(transform(filter(have, h -> abs(h.pc - pc) <= {radius}), h -> transform(sequence(0, h.tiles - 1), s -> struct(h.pc as p, s as s))))")
    split = rows.filter(F.col("have").isNotNull()).select("band", "key", "fp", "pc", F.pmod(F.xxhash64("fp", F.lit(7)), own).cast("int").alias("s"), F.explode(others).alias("o"))
    first = F.struct(F.col("pc").alias("p"), F.col("s").alias("s"))
    low, high = F.least(first, F.col("o")), F.greatest(first, F.col("o"))
    split = split.select(
        F.struct("band", "key", low["p"].alias("pa"), low["s"].alias("sa"), high["p"].alias("pb"), high["s"].alias("sb")).alias("unit"),
        F.when(first == F.col("o"), 0).when(first == low, 1).otherwise(2).alias("side"),
        "fp",
    )
    return small.unionByName(split).select(F.xxhash64("unit").alias("h"), "unit.*", "side", "fp")


_UNIT = ["h", "band", "key", "pa", "sa", "pb", "sb"]
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(_LINKS)
        held = np.empty((0, 9), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(9)])
            rows = np.concatenate([held, rows]) if len(held) else rows
            last = (rows[:, :7] != rows[-1, :7]).any(axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = rows[cut:]
            if cut:
                yield from links(rows[:cut], schema)
        if len(held):
            yield from links(held, schema)

    def links(rows: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :7] != rows[:-1, :7]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        fps, side = np.ascontiguousarray(rows[:, 8]).view(np.uint64), rows[:, 7]
        easy = (sizes <= 96) & (np.maximum.reduceat(side, starts) == 0)
        pairs = [_small_groups(fps, starts[easy], sizes[easy], radius)]
        for a, n in zip(starts[~easy].tolist(), sizes[~easy].tolist()):
            x, s = fps[a : a + n], side[a : a + n]
            pairs.append(tile_links(x, None, radius) if not s.any() else tile_links(x[s == 1], x[s == 2], radius))
        a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
        if len(a):
            yield common.to_batch({"a": a, "b": b}, schema)

    return run


def links(classes: DataFrame, radius: int = 4, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links within the radius.

    parts (by default chosen by how many fingerprints there are) changes the cost, not the components.
    """
    spark = classes.sparkSession
    common.bounded_batches(spark, 50_000)
    units = _units(classes, radius, parts).repartition(common.shuffle_parts(spark), *_UNIT).sortWithinPartitions(*_UNIT)
    return units.select(*_UNIT, "side", "fp").mapInArrow(_compare(radius), _LINKS)


# -- components ----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b); label is the least node reachable.

    Alternating large-star and small-star contraction: each round joins edges
    with the minimum of a node's neighbours, a partial aggregation.  Every
    round is written to the shared folder.
    """
    now = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = common.written(small.filter("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the least doc_id reachable by links)."""
    fps = common.written(fingerprints(docs, shingle), "fingerprints")
    classes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = components(links(classes.select("fp"), radius))
    # linked classes share the least id of their component; a component may be large, so its rows are salted
    labelled = common.written(classes.join(linked.withColumnRenamed("node", "fp"), "fp"), "labels").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    of_label = labelled.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_class = labelled.join(of_label.withColumn("salt", F.col("salt").cast("long")), ["label", "salt"]).select("fp", "component_id")
    of_class = classes.join(of_class, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # written, so that this join stands alone and a fingerprint that many documents share can be split
    return fps.join(common.written(of_class, "named"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs without all but one row of each component: the one with the least doc_id (a null one is last).

    Rows are told apart by a number of their own, so null and repeated ids do no harm.
    """
    docs, back = common.set_aside(docs, ["doc_id", "text"])
    rows = common.written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    found = near_duplicates(rows.select(own.alias("doc_id"), "text"), shingle, radius).filter(F.col("doc_id._row") == F.col("component_id._row"))
    return rows.join(found.select(F.col("doc_id._row").alias("_row")), "_row", "left_semi").select(*back)


# -- copies by similarity --------------------------------------------------------

_FACTORS = np.random.default_rng(5).integers(0, 2**31, (2, BANDS * ROWS)).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set of shingle hashes (uint64), signed; sets of a similarity of 0.8 share one but for 7 in a million."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        least = np.minimum(least, (low[k : k + 2048, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(rows)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets given as sorted distinct values; 1 for two empty ones."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size or b.size else 1.0


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).view(">u8").ravel().astype(np.uint64))


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with _set (a hash of the shingle set), _fp and _keys."""
    schema = T.StructType([*docs.schema, T.StructField("_set", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_keys", T.ArrayType(T.LongType()))])
    arrow = common.arrow_schema(schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, fps, keys = [], [], []
        for text in common.texts_of(batch):
            raw = shingle_hashes(text, shingle)
            own = np.unique(raw.view(">u8").ravel().astype(np.uint64))
            sets.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
            fps.append(_voted(own.astype(">u8").view(np.uint8).reshape(-1, 8)))  # of the set: repeats would outvote what two texts share
            keys.append(band_keys(own))
        more = [pa.array(sets, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*[c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow)], *[c.cast(f.type) for c, f in zip(more, list(arrow)[-3:])]], schema=arrow)

    return common.map_batches(docs, run, schema)


def _rotated(fps: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) & np.uint64(63)
    return (fps << by) | (fps >> ((np.uint64(64) - by) & np.uint64(63)))


def _near_in_buckets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in one bucket whose fingerprints are near; rows (key, part, row, fp) sorted by key and part.

    In a bucket of up to ``ALL_PAIRS`` all pairs; in a larger one each with its next
    in the order of the fingerprint's bits from a place that the key picks, and with
    the first of its stretch of that order, so that links stay in proportion
    (``_rest`` compares what these leave unlinked).
    """
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(rows)])
    fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
    big = np.repeat(sizes > ALL_PAIRS, sizes)
    last = np.repeat(starts + sizes, sizes)
    if big.any():
        order = np.lexsort((np.where(big, _rotated(fps, rows[:, 0]), 0), np.repeat(np.arange(len(starts)), sizes)))
        rows, fps = rows[order], fps[order]
    pairs = []
    for d in range(1, ALL_PAIRS):
        i = np.flatnonzero((np.arange(len(rows)) + d < last) & (~big if d > 3 else True))
        if not len(i):
            break
        pairs.append((i, i + d))
    at = np.arange(len(rows)) - np.repeat(starts, sizes)
    i = np.flatnonzero(big & (at % ALL_PAIRS > 3))
    pairs.append((i - at[i] % ALL_PAIRS, i))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    near = np.bitwise_count(fps[a] ^ fps[b]) <= WIDE
    x, y = rows[a[near], 2], rows[b[near], 2]
    return np.minimum(x, y), np.maximum(x, y)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = common.arrow_schema(_LINKS)
    held = np.empty((0, 4), np.int64)
    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        rows = np.concatenate([held, rows]) if len(held) else rows
        other = (rows[:, :2] != rows[-1, :2]).any(axis=1)
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        held = rows[cut:]
        if cut:
            a, b = _near_in_buckets(rows[:cut])
            yield common.to_batch({"a": a, "b": b}, schema)
    if len(held):
        a, b = _near_in_buckets(held)
        yield common.to_batch({"a": a, "b": b}, schema)


def _those(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose number (_row) is among ids, told by a bit for each number, so that rows stay where they are."""
    bits = ids.groupBy(F.expr("bitmap_bucket_number(_row)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_row))").alias("_bits"))
    bits = common.checked_broadcast(common.written(bits, "bits"), BITMAPS)
    byte = "conv(hex(substring(_bits, cast(bitmap_bit_position(_row) div 8 as int) + 1, 1)), 16, 10)"
    own = F.expr(f"bit_get(cast({byte} as int), cast(bitmap_bit_position(_row) % 8 as int)) = 1")
    return rows.join(bits, (F.expr("bitmap_bucket_number(_row)") == F.col("_bucket")) & own, "left_semi")


def _texts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    return common.written(_those(rows, asked).select("_row", "text"), "texts")


def similar(rows: DataFrame, lead: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all rows (_row, _fp, _keys, text) among lead (_row; distinct shingle sets) of at least the similarity."""
    spark = rows.sparkSession
    keyed = common.written(_those(rows, lead).select(F.explode("_keys").alias("key"), "_row", "_fp"), "keys")
    sizes = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    keyed = common.written(keyed.join(sizes, "key"), "keyed")
    # parts of a large bucket: leading bits of the fingerprint, from a place that the key picks
    bits = F.ceil(F.log2(F.col("n") / LARGE)).cast("int")
    turned = F.expr("shiftleft(_fp, cast(key & 63 as int)) | shiftrightunsigned(_fp, cast((64 - (key & 63)) & 63 as int))")
    part = F.when(F.col("n") > LARGE, F.call_function("shiftrightunsigned", turned, 64 - bits)).otherwise(F.lit(0).cast("long"))
    common.bounded_batches(spark, 50_000)
    dealt = keyed.select("key", part.alias("part"), "_row", "_fp").repartition(common.shuffle_parts(spark), "key", "part").sortWithinPartitions("key", "part")
    pairs = common.written(dealt.mapInArrow(_bucket_pairs, _LINKS).distinct(), "pairs")
    texts = _texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct())
    of = lambda name: texts.select(F.col("_row").alias(name), F.col("text").alias(f"text_{name}"))

    def confirmed(batch: pa.RecordBatch) -> dict:
        a, b = (common.values_of(batch, c) for c in ("a", "b"))
        known: dict[int, np.ndarray] = {}
        for c, own in (("text_a", a), ("text_b", b)):
            for text, k in zip(common.texts_of(batch, c), own):
                if k not in known:
                    known[k] = _shingle_set(text, shingle)
        kept = [(x, y) for x, y in zip(a, b) if jaccard(known[x], known[y]) >= similarity]
        return {"a": [x for x, _ in kept], "b": [y for _, y in kept]}

    found = common.map_batches(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b"), confirmed, _LINKS)
    large = keyed.filter(F.col("n") > ALL_PAIRS)
    if large.isEmpty():
        return found
    label = common.written(components(found), "linked")
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(_rest(rows, large, label, shingle, similarity))


# -- large buckets: what is not linked yet ----------------------------------------

_TILE = ["key", "kind", "ta", "tb"]
_NEAR = T.StructType([T.StructField(c, T.LongType()) for c in [*_TILE, "side", "_row", "_fp", "label"]])


def _rest(rows: DataFrame, large: DataFrame, label: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between rows of large buckets (key, _row, _fp) that no label (node, label) connects yet.

    A bucket whose rows all have one label needs nothing.  In another the rows
    of its most frequent label meet the others, and the others each other, in
    tiles of about ``REST`` rows; a pair of tiles is a unit of work.  Texts go
    only to units where they have a near fingerprint of another label.
    """
    spark = rows.sparkSession
    named = large.select("key", "_row", "_fp").join(label.withColumnRenamed("node", "_row"), "_row", "left")
    named = common.written(named.select("key", "_row", "_fp", F.coalesce("label", "_row").alias("label")), "large")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "label"))
    mixed = counts.groupBy("key").agg(most["label"].alias("main"), most["n"].alias("n_main"), F.sum("n").alias("n")).filter("n > n_main")
    tiles = lambda n: F.ceil(n / REST)
    mixed = common.written(mixed.select("key", "main", tiles(F.col("n_main")).alias("mains"), tiles(F.col("n") - F.col("n_main")).alias("others")), "mixed")
    at = named.join(common.checked_broadcast(mixed, 100_000), "key").withColumn("main", F.col("label") == F.col("main"))
    at = at.withColumn("own", F.pmod(F.xxhash64("_row", F.lit(7)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    unit = "struct({} as kind, {} as ta, {} as tb, {} as side)".format
    across = "transform(sequence(0L, {} - 1), t -> {})".format
    within = unit("if(t = own, 0L, 1L)", "least(t, own)", "greatest(t, own)", "if(own <= t, 0L, 1L)")
    units = F.expr(f"if(main, {across('others', unit('2L', 'own', 't', '0L'))}, concat({across('mains', unit('2L', 't', 'own', '1L'))}, {across('others', within)}))")
    dealt = at.select("key", F.explode(units).alias("u"), "_row", "_fp", "label").select("key", "u.*", "_row", "_fp", "label")
    dealt = dealt.repartition(common.shuffle_parts(spark), *_TILE).sortWithinPartitions(*_TILE)
    common.bounded_batches(spark, 50_000)
    near = common.written(dealt.mapInArrow(_near_across, _NEAR), "near")
    if near.isEmpty():
        return spark.createDataFrame([], _LINKS)
    told = near.join(_texts(rows, near.select("_row").distinct()), "_row").select(*_NEAR.names, "text")
    common.bounded_batches(spark)
    told = told.repartition(common.shuffle_parts(spark), *_TILE).sortWithinPartitions(*_TILE)
    return common.written(told.mapInArrow(_linked_across(shingle, similarity), _LINKS), "rest")


def _near(unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a unit (columns as ``_NEAR``) the later ones, of the other side if there are two, with a near fingerprint and another label."""
    kind, side, fps, label = unit[0, 1], unit[:, 4], np.ascontiguousarray(unit[:, 6]).view(np.uint64), unit[:, 7]
    for i in range(len(unit)):
        near = (np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= WIDE) & (label[i + 1 :] != label[i])
        if kind:
            near &= side[i + 1 :] != side[i]
        if near.any():
            yield i, np.flatnonzero(near) + i + 1


def _near_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = common.arrow_schema(_NEAR)

    def asked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            met = np.zeros(b - a, bool)
            for i, others in _near(rows[a:b]):
                met[i] = True
                met[others] = True
            if met.any():
                yield common.to_batch(dict(zip(_NEAR.names, rows[a:b][met].T)), schema)

    held = np.empty((0, 8), np.int64)
    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)])
        rows = np.concatenate([held, rows]) if len(held) else rows
        other = (rows[:, :4] != rows[-1, :4]).any(axis=1)
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        held = rows[cut:]
        if cut:
            yield from asked(rows[:cut])
    if len(held):
        yield from asked(held)


def _linked_across(shingle: int, similarity: float):
    """Compares the units' texts exactly; what a link has connected meanwhile is not compared again."""

    def links(rows: list[tuple], sets: list[np.ndarray]) -> dict:
        unit, out = np.array(rows, np.int64), []
        forest = _Forest(len(unit))
        first: dict[int, int] = {}
        for k, own in enumerate(unit[:, 7].tolist()):
            forest.join(k, first.setdefault(own, k))
        # shingles as numbers from 0, one set after another, so that a row is compared with all later ones at once
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        ends = np.cumsum(sizes)
        shingles = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own = np.zeros(len(shingles), bool)
        for i, others in _near(unit):
            others = others[forest.find(others) != forest.find(np.array([i]))]
            if not len(others):
                continue
            at = shingles[ends[i] - sizes[i] : ends[i]]
            own[at] = True
            met = np.r_[0, np.cumsum(own[shingles[ends[i] :]])]
            own[at] = False
            both = met[ends[others] - ends[i]] - met[ends[others] - sizes[others] - ends[i]]
            close = both / (sizes[others] + sizes[i] - both) >= similarity  # the sets differ, so one is not empty
            out += [(i, j) for j in others[close].tolist() if forest.join(i, j)]
        a, b = (unit[np.array([p[k] for p in out], np.int64), 5] for k in (0, 1))
        return {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, sets = common.arrow_schema(_LINKS), [], []
        for batch in batches:
            for row, text in zip(zip(*[common.values_of(batch, c) for c in _NEAR.names]), common.texts_of(batch)):
                if rows and rows[-1][:4] != row[:4]:
                    yield common.to_batch(links(rows, sets), schema)
                    rows, sets = [], []
                rows.append(row)
                sets.append(_shingle_set(text, shingle))
        if rows:
            yield common.to_batch(links(rows, sets), schema)

    return run


def keep_dissimilar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of copies: the one with the least doc_id (a null one is last).

    Copies are texts whose sets of word shingles have at least the Jaccard
    similarity, and what they lead to.  Rows are told apart by a number of their
    own, so null and repeated ids do no harm.
    """
    docs, back = common.set_aside(docs, ["doc_id", "text"])
    rows = common.written(_sketched(docs, shingle).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    classes = common.written(rows.groupBy("_set").agg(F.min(first).alias("least")).select("least", F.col("least._row").alias("_row")), "classes")
    label = components(similar(rows, classes.select("_row"), shingle, similarity)).withColumnRenamed("node", "_row")
    named = classes.join(label, "_row", "left").select(F.coalesce("label", "_row").alias("label"), "least")
    kept = named.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    return _those(rows, kept).select(*back)
