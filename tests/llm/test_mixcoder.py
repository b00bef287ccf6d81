from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, mixcoder

from .helpers import empty, table
from .test_packing import BYTE, WORDS, whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=400), st.integers(1, 90), st.integers(1, 6))
def test_round_trip(ids, block, docs):
    ids = np.array(ids, np.uint32)
    ids = np.concatenate([ids, ids[: len(ids) // 2]])
    cuts = np.linspace(0, len(ids), docs + 1).astype(int)
    names = [None, *range(-3, docs - 4)]
    data = mixcoder.encode_file(names, np.diff(cuts), ids, block)
    got = mixcoder.decode_file(data)
    assert got[0] == names and got[1].tolist() == np.diff(cuts).tolist() and np.array_equal(got[2], ids)


def test_blocks_decode_alone_and_damage_is_found():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 5000), 40_000).astype(np.uint32)
    ids[2000:2600] = ids[1000:1600]
    data = mixcoder.encode_file([1, 2], np.array([2000, 3000]), ids, block=512)
    assert np.array_equal(mixcoder.decode_file(data, [3])[2], ids[1536:2048])
    assert np.array_equal(mixcoder.decode_file(data, [9, 0])[2], np.concatenate([ids[4608:], ids[:512]]))
    body = bytearray(data)
    body[-400] ^= 1
    with pytest.raises(mixcoder.Damaged, match="block"):
        mixcoder.decode_file(bytes(body))
    for at in (0, 5, 45, 80):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(mixcoder.Damaged):
            mixcoder.decode_file(bytes(bad))


@pytest.mark.parametrize("distinct", [16_382, 16_383, 65_536, 65_537])
def test_tables_as_wide_as_the_ids_ask_for(distinct):
    ids = np.concatenate([np.tile(np.arange(distinct - 3, distinct), 3000), np.arange(distinct), np.tile([distinct - 1, 0], 3000)]).astype(np.uint32)
    assert np.array_equal(mixcoder.decode_file(mixcoder.encode_file([1], np.array([len(ids)]), ids))[2], ids)


def test_a_file_takes_few_copies_of_its_ids():
    """Lookups make eight bytes of each id unless they go in pieces."""
    ids = np.random.default_rng(2).integers(0, 3000, 3_000_000).astype(np.uint32)
    tracemalloc.start()
    try:
        data = mixcoder.encode_file([1], np.array([len(ids)]), ids)
        encoded, _ = tracemalloc.get_traced_memory()[1], tracemalloc.reset_peak()
        assert np.array_equal(mixcoder.decode_file(data)[2], ids)
        decoded = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert encoded < 3.5 * ids.nbytes and decoded < 4.5 * ids.nbytes


def test_it_compresses():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 30_000, 12) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 40, 4000)]).astype(np.uint32)
    size = len(mixcoder.encode_file([1], np.array([len(ids)]), ids))
    assert size < 0.9 * order0_bytes(ids)


def order0_bytes(ids) -> float:
    """What an ideal coder takes by the file's frequencies alone."""
    counts = np.bincount(ids)[np.unique(ids)]
    return -(counts * np.log2(counts / counts.sum())).sum() / 8


@pytest.fixture(scope="module")
def real():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"].to_pylist()
    return np.concatenate([np.array(x + [2], np.uint32) for x in whole(WORDS, texts)])


def test_real_documents_are_well_under_order_0(real):
    data = mixcoder.encode_file([1], np.array([len(real)]), real)
    assert np.array_equal(mixcoder.decode_file(data)[2], real)
    assert len(data) < 0.9 * order0_bytes(real)


def test_every_order_takes_part(real, monkeypatch):
    """A file is smaller by orders 1 and 2, by a choice of tables for order 0, and by longer blocks."""
    size = len(mixcoder.encode_file([1], np.array([len(real)]), real))
    assert size < len(mixcoder.encode_file([1], np.array([len(real)]), real, block=512))
    with monkeypatch.context() as m:
        m.setattr(mixcoder, "TABLES", 1)
        assert size < 0.97 * len(mixcoder.encode_file([1], np.array([len(real)]), real))
    with monkeypatch.context() as m:
        m.setattr(mixcoder, "_FIRST", 0)
        m.setattr(mixcoder, "_MOST", 0)
        assert size < 0.99 * len(mixcoder.encode_file([1], np.array([len(real)]), real))


def test_words_are_encoded_as_whole_texts_are():
    """Each letter, mark and sign beside signs, letters and space, for both models."""
    points = [*range(0x3000), *range(0xA000, 0xA100), *range(0xFB00, 0xFE00), *range(0x1D400, 0x1D500), *range(0x1F600, 0x1F640)]
    texts = [f"{chr(k)}. a{chr(k)}! {chr(k)}b; {chr(k)} {chr(k)}{chr(k)}, É{chr(k)}-" for k in points] + ["TEKİ.", "Aİ, b", "İ;", "\u0958.", "ΣΑΣ. ΑΣ, Σ", "e\u0301. E\u0301,"]
    for path, words in ((WORDS, common.BARE_WORDS), (BYTE, common.SPACED_WORDS)):
        cache = common.WordCache(path, words)
        want = whole(path, texts)
        assert [x.tolist() for x in cache.encode_column(pa.array(texts))] == want
        assert [x.tolist() for x in cache.encode_batch(texts)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aİΣßéD9 .,;!-'\"#_\t\n\u0301\u0307\u0958日<|>"))), min_size=1, max_size=8))
def test_words_are_encoded_as_whole_texts_are_fuzzed(texts):
    for path, words in ((WORDS, common.BARE_WORDS), (BYTE, common.SPACED_WORDS)):
        got = common.word_cache(path, words).encode_column(pa.array(texts))
        assert [x.tolist() for x in got] == whole(path, texts)


def test_stretches_are_encoded_once():
    """Signs, digits, capitals and white space do not make new entries of a word that is known."""
    cache = common.WordCache(WORDS, common.BARE_WORDS)
    texts = ["Alpha alpha. ALPHA, (alpha) alpha-alpha/alpha", "alpha12 21\x85été\u3000Été; <été>", None]
    assert [x.tolist() for x in cache.encode_column(pa.array(texts))] == whole(WORDS, [t or "" for t in texts])
    assert set(cache.number) == {"alpha", ".", ",", "(", ")", "-", "/", "1", "2", "été", ";", "<", ">"}


def test_a_capital_and_its_mark_that_are_one_character_in_lower_case_alone():
    texts = ["J\u030c T\u0308, W\u030aW H\u0331. Y\u030a", "J", "\u030c", "É\u0323 E\u0301", "É", "\u0331É"]
    cache = common.WordCache(WORDS, common.BARE_WORDS)
    assert [x.tolist() for x in cache.encode_column(pa.array(texts))] == whole(WORDS, texts)
    assert [x.tolist() for x in cache.encode_batch(texts)] == whole(WORDS, texts)


#: Characters whose neighbours matter: capitals, marks, signs, apostrophes, white space of every kind, letters of one to four bytes.
ODD = list("aAeEhHjJtTwWsS'.,!=<>|-5 0éÉßÿÞ×÷ªµºñÜ\x00\x1c\x1f\x7f\x85\xa0\u2003\u3000\u200b\u0300\u0301\u0304\u0307\u0308\u030a\u030c\u0323\u0331\u0338\u0345\u20e3İıΣς日\u1100\u1161²½Ⅷ٣\U0001d400😀ﬁ_\t\n\r")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(ODD))), min_size=1, max_size=12), st.integers(0, 3), st.booleans())
def test_columns_are_encoded_as_whole_texts_are_fuzzed(texts, skipped, large):
    cache = common.word_cache(WORDS, common.BARE_WORDS, 40)  # so few that words are forgotten
    column = pa.array(texts, pa.large_string() if large else pa.string()).slice(skipped)
    assert [x.tolist() for x in cache.encode_column(column)] == whole(WORDS, [t or "" for t in texts[skipped:]])


def test_a_kept_path(spark, tmp_path):
    mixcoder.write_files(table(spark), WORDS, 2, path=f"file://{tmp_path}/tokens")
    kept = spark.read.parquet(f"file://{tmp_path}/tokens")
    assert mixcoder.read_index(kept).count() == table(spark).count()


@pytest.mark.parametrize("file_tokens", [100, 1 << 21])
def test_files_of_a_corpus(spark, file_tokens):
    docs = table(spark)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r, ids in zip(rows, whole(WORDS, [r["text"] or "" for r in rows])):
        ids = np.array(ids + [2], np.uint32)
        want.append((str(r["doc_id"]), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files = mixcoder.write_files(docs, WORDS, 2, file_tokens=file_tokens)
    got = mixcoder.read_index(files).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert files.count() > 4 if file_tokens == 100 else files.count() <= 4
    assert mixcoder.read_index(mixcoder.write_files(empty(spark), WORDS, 2)).count() == 0


def test_paths_are_parameters():
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS
