from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import winnowing

from .helpers import empty, table

TEXT = st.text(alphabet="ab é日\n", max_size=300)


def brute(hashes, w):
    out = set()
    for i in range(max(1, len(hashes) - w + 1)) if hashes else []:
        own = hashes[i : i + w]
        out.add(i + max(j for j, x in enumerate(own) if x == min(own)))
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 40), st.sampled_from([16, 50, 1 << 20]))
def test_choice_is_the_rightmost_least(text, k, w, block):
    hashes = winnowing.grams(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    own = [text[i : i + k] for i in range(len(hashes))]
    assert len(set(zip(own, hashes.tolist()))) == len(set(own)) == len(set(hashes.tolist()))
    before, winnowing.BLOCK = winnowing.BLOCK, block
    try:
        assert winnowing.choose(hashes, w).tolist() == brute(hashes.tolist(), w)
    finally:
        winnowing.BLOCK = before


@settings(max_examples=40, deadline=None)
@given(TEXT, TEXT, st.text(alphabet="xyz ", min_size=47, max_size=90))
def test_shared_passages_are_found_and_fingerprints_read_back(a, b, passage):
    (one, at), (two, _) = winnowing.winnow(a + passage), winnowing.winnow(passage + b)
    assert set(one.tolist()) & set(two.tolist())
    back = winnowing.read_in(winnowing.written_out(one, at))
    assert np.array_equal(back[0], one) and np.array_equal(back[1], at)
    assert winnowing.likeness(np.unique(one), np.unique(one)) == 1


def test_edited_pairs(spark):
    docs = table(spark)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want = []
    for k, r in enumerate(rows):
        text, after = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((str(r["doc_id"]), len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.written_out(*winnowing.winnow(text)), winnowing.written_out(*winnowing.winnow(edited))))
    got = winnowing.edited_pairs(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert winnowing.edited_pairs(empty(spark)).count() == 0
    one = winnowing.edited_pairs(table(spark, [(1, "abcdefgh", "en", "s", 8, *"fbkln")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1
    assert winnowing.fingerprints(docs).count() == len(rows)
