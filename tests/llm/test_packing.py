from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, packing

from .helpers import empty, table

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def whole(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.sampled_from([8, 16, 20]), st.integers(1, 5))
def test_packer_covers_each_id_once(sizes, length, windows):
    packer = packing.Packer(length, windows)
    docs = [np.arange(n) + 1000 * k for k, n in enumerate(sizes)]
    done, most = [], 0
    for k, ids in enumerate(docs):
        done += packer.add(k, ids)
        most = max(most, len(packer.open))
    full = len(done)
    done += packer.finish()
    assert most <= windows and all(sum(len(p[2]) for p in s) == length for s in done[:full])
    lengths = [sum(len(p[2]) for p in s) for s in done]
    short = [n for n in lengths if n != length]
    assert all(n & (n - 1) == 0 for n in short) and sum(short) < length
    parts = {}
    for s in done:
        for doc, start, ids, total in s:
            assert total == sizes[doc] and len(ids)
            parts.setdefault(doc, []).append((start, ids))
    for k, ids in enumerate(docs):
        own = sorted(parts.get(k, []), key=lambda p: p[0])
        assert [p[0] for p in own] == np.cumsum([0, *[len(p[1]) for p in own]]).tolist()[:-1]
        assert np.array_equal(np.concatenate([p[1] for p in own]) if own else ids[:0], ids)


def test_word_cache_equals_whole_texts():
    from .helpers import odd_rows

    texts = [r[1] or "" for r in odd_rows()] + ["don't I'll '", "a  b\n\nc \t d", "é ́ ​ zz\r\n 12", "<|endoftext|> <|startoftext|>", "x |y| | z", "UPPER Case, ends. now!\nNext"]
    for path, words in ((BYTE, common.SPACED_WORDS), (WORDS, common.BARE_WORDS)):
        want = whole(path, texts)
        for limit in (400_000, 50):  # the second forgets all the time
            cache = common.WordCache(path, words, limit)
            assert [x.tolist() for x in cache.encode_batch(texts)] == want
            assert [x.tolist() for x in cache.encode_batch(texts[::-1])] == want[::-1]
            plain = [k for k, t in enumerate(texts) if not any(c in t for c in "\x1c\x1d\x1e\x1f")]
            assert [x.tolist() for x in cache.encode_column(pa.array([texts[k] for k in plain] + [None]))] == [want[k] for k in plain] + [[]]
            assert [x.tolist() for x in cache.encode_column(pa.array(texts, pa.string()))] == want
            assert sum(map(len, cache.encode_column(pa.array([], pa.string())))) == 0


def test_pack(spark):
    docs = table(spark)
    got = packing.pack(docs, BYTE, 1, length=64, windows=4).collect()
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), np.array(ids + [1], np.uint32).tobytes()) for r, ids in zip(rows, whole(BYTE, [r["text"] or "" for r in rows])))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for _, x in want)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]]).tolist()[:-1]
        n = sum(r["length"] for r in own)
        assert n == 64 or n & (n - 1) == 0
    # repeated rows: as many whole documents as rows
    by = {}
    for r in got:
        by.setdefault((str(r["doc_id"]), r["start"]), []).append(bytes(r["ids"]))
    for doc, ids in {w for w in want}:
        if sum(d == doc for d, _ in want) == 1:
            assert b"".join(v[0] for (d, s), v in sorted(by.items(), key=lambda x: x[0][1]) if d == doc) == ids
    assert packing.pack(empty(spark), BYTE, 1).count() == 0
    assert packing.pack(docs, BYTE, 1).filter(F.col("length") > 2048).count() == 0


def test_plain_splits_cut_as_the_pattern():
    import random

    from tessera.llm import common

    r = random.Random(1)
    signs = ["a", "b", " ", " ", "\n", "\t", "\0", "é", "\x1c", "\r", "\xa0", " "]
    for _ in range(20_000):
        text = "".join(r.choices(signs[: r.choice([4, 5, 5, 12])], k=r.randint(0, 12)))
        assert common.spaced_words(text) == common.SPACED_WORDS.findall(text), repr(text)
    assert {*common._RARE_SPACE, " ", "\n"} == {chr(k) for k in range(0x110000) if common.re.match(f"[{common.SPACE}]", chr(k))}


def test_stretches_are_encoded_once():
    """Signs, digits and line ends beside a word do not make new entries of it, whatever the alphabet."""
    cache = common.WordCache(BYTE, common.SPACED_WORDS)
    texts = [" word, word. (word) word12; word\nword\n\n word", " été. été! слово, слово? łąka: łąka", None, ""]
    assert [x.tolist() for x in cache.encode_column(pa.array(texts))] == whole(BYTE, [t or "" for t in texts])
    signs = [",", ".", " (", "word", ")", "12", ";", "\n", "\n\n", "!", "?", ":"]
    assert {w.decode() for w in cache.number} == {" word", " été", " слово", " łąka", *signs}


#: Characters whose neighbours matter: letters, digits, signs, apostrophes and what may follow them, white space of every kind.
ODD = list("abstSTvemdlr'0129.,!_<|>-    \n\n\t\r\v\x00\x1c\x1f\x7f\x85\xa0\u2003\u2028\u3000\u200béÉß×÷ªµº·ŁǄʼ˗\u0301\u0378ΩЖз҂\u0483Ӂא日²½Ⅷ٣\U0001d400😀")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(ODD))), min_size=1, max_size=12), st.integers(0, 3), st.booleans(), st.sampled_from([5, 1 << 22]))
def test_columns_are_encoded_as_whole_texts_are_fuzzed(texts, skipped, large, most):
    cache = common.word_cache(BYTE, common.SPACED_WORDS, 40)  # so few that words are forgotten
    column = pa.array(texts, pa.large_string() if large else pa.string()).slice(skipped)
    want = whole(BYTE, [t or "" for t in texts[skipped:]])
    assert [x.tolist() for x in cache.encode_column(column)] == want
    parts = common._pieces(column.fill_null(""), most)
    assert [x.tolist() for part in parts for x in cache.encode_column(part)] == want


def test_letters_of_two_bytes():
    """Every character of two bytes beside letters, signs, digits and spaces."""
    texts = [f"{chr(k)}. a{chr(k)}b {chr(k)}1 '{chr(k)}{chr(k)}' {chr(k)}\n{chr(k)}" for k in range(0x80, 0x800)]
    assert [x.tolist() for x in common.WordCache(BYTE, common.SPACED_WORDS).encode_column(pa.array(texts))] == whole(BYTE, texts)
