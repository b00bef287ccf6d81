from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash

from .helpers import WORD, empty, table


def brute(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[j : j + k]).encode(), 42) for j in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_against_brute_force(spark):
    docs = table(spark)
    rows = docs.collect()
    fps = [brute(r["text"]) for r in rows]
    want = sorted(zip([str(r["doc_id"]) for r in rows], fps, map(str, closure(fps, [r["doc_id"] for r in rows]))))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [None, 5, 6, 7])
def test_hot_buckets_are_tiled(spark, monkeypatch, parts):
    """One large group of near fingerprints, chains across tiles, and random ones."""
    monkeypatch.setattr(simhash, "TILE", 20)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    r = random.Random(1)
    base = r.getrandbits(64)
    fps = {base}
    for _ in range(150):  # a chain that wanders
        base ^= 1 << r.randrange(64) | 1 << r.randrange(64)
        fps.add(base)
    fps |= {r.getrandbits(64) for _ in range(100)} | {0, 1, 3, 2**64 - 1}
    fps = sorted(fps)
    classes = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    links = simhash.links(classes, parts=parts)
    found = {r["node"] % 2**64: r["label"] for r in simhash.components(links).collect()}
    want = closure(fps, list(range(len(fps))))
    groups = {}
    for x, c in zip(fps, want):
        groups.setdefault(c, []).append(x)
    for own in groups.values():
        assert len({found.get(x, ("alone", x)) for x in own}) == 1
        assert len(own) == 1 or len([x for x in fps if found.get(x) == found[own[0]]]) == len(own)
    assert links.count() < 6 * len(fps) * 4 * (1 if parts == 5 else 7)


def test_tile_links_span_and_are_few():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 5).astype(np.uint64)
    fps = np.unique(np.concatenate([x, *[x ^ np.uint64(1 << k) for k in range(60)]]))
    a, b = simhash.tile_links(fps, None, 4)
    assert len(a) == len(fps) - 5 and (np.bitwise_count(a ^ b) <= 4).all()
    assert len(simhash.tile_links(fps[:0], None, 4)[0]) == 0
    a, b = simhash.tile_links(fps[::2], fps[1::2], 4)
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) <= 4).all()


def test_keep_one(spark):
    docs = table(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert simhash.keep_one(empty(spark)).count() == 0
    assert kept.filter(F.col("doc_id") == 15).count() == 1


def _edited(r, text, share):
    """text with words changed here and there, so that about that share of its 5-word shingles stays."""
    words = text.split()
    for k in r.sample(range(0, len(words) - 5, 6), max(1, round(len(words) * (1 - share) / 5))):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def _similarity(a, b):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_edited_copies_go(spark, monkeypatch):
    """Copies of a similarity from 0.8 are found by exact similarity; those below stay, and so does a group larger than a bucket's all pairs."""
    r, rows = random.Random(3), []
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    pairs = []
    for k in range(60):
        a = text(r.randint(50, 300))
        b = _edited(r, a, r.uniform(0.75, 0.95))
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append((2 * k + 1, _similarity(a, b)))
    base = text(120)
    rows += [(1000 + k, _edited(r, base, 0.95)) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *"fbkln") for k, t in rows], docs_schema()).repartition(5)
    for large in (4096, 64):
        monkeypatch.setattr(simhash, "LARGE", large)
        kept = {x["doc_id"] for x in simhash.keep_dissimilar(docs).collect()}
        assert {k for k, s in pairs if s < 0.8} == {k for k, _ in pairs} & kept
        assert {k for k in kept if k >= 1000} == {1000}
    assert len([s for _, s in pairs if s >= 0.8]) > 15 < len([s for _, s in pairs if s < 0.8])
    assert simhash.keep_dissimilar(empty(spark)).count() == 0


def docs_schema():
    from .helpers import SCHEMA

    return SCHEMA


def test_null_and_repeated_ids(spark):
    """Different texts stay whatever their ids; of copies one row stays."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (7, texts[5]), (7, texts[5])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *"fbkln") for k, t in rows], docs_schema()).repartition(3)
    want = sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("8", texts[4]), ("7", texts[5])])
    for keep in (simhash.keep_one, simhash.keep_dissimilar):
        assert sorted((str(x["doc_id"]), x["text"]) for x in keep(docs).collect()) == want


def test_blocks_follow_the_number_of_fingerprints():
    """Rows for each fingerprint stay few at any number; the blocks never miss a link."""
    assert [simhash._parts(n, 4) for n in (10, 10**6, 10**8, 10**11)] == [5, 5, 6, 7]
    for n in (10**6, 10**8, 10**9, 10**10, 10**11):
        parts = simhash._parts(n, 4)
        rows = math.comb(parts, parts - 4) * max(1, n / 2 ** (64 * (parts - 4) / parts) / simhash.TILE)
        assert rows < 40, (n, rows)
    assert all(sum(w for _, w in simhash._blocks(p)) == 64 for p in (5, 6, 7))


def test_columns_of_any_name_come_back(spark):
    rows = [(k, t, k * 10, f"r{k}", [k]) for k, t in enumerate(["one two three four five six"] * 3 + ["other words are here in this text", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _kept string, _set array<int>")
    for keep in (simhash.keep_one, simhash.keep_dissimilar):
        kept = keep(docs)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3], rows[4]]


def test_large_buckets_miss_no_link(spark, monkeypatch):
    """Pairs of copies among many texts that share most of their shingles: what the order of fingerprints leaves apart is compared, too."""
    r, rows = random.Random(11), []
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base = text(120)
    for k in range(250):  # a common passage, which makes them alike at 0.78, and an end of its own; every text twice, with a quarter of the end
        own = base + text(16)
        other = own[:124] + text(12)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *"fbkln") for k, t in rows], docs_schema()).repartition(5)
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {k for k in range(len(rows)) if root[k] == k}
    assert len(want) == 250
    monkeypatch.setattr(simhash, "REST", 100, raising=False)
    assert {x["doc_id"] for x in simhash.keep_dissimilar(docs).collect()} == want
