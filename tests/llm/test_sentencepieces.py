from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentencepieces

from .helpers import empty, odd_rows, table

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS = sentencepieces.Model(PATH).tokenizer()


def test_model_is_read():
    model = sentencepieces.Model(PATH)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [(p, round(s, 4)) for p, s, _ in model.pieces] == [(theirs.id_to_piece(k), round(theirs.get_score(k), 4)) for k in range(theirs.get_piece_size())]
    assert model.kind == sentencepieces.BPE and model.byte_fallback


def test_parity():
    assert sentencepieces.parity(PATH, sentencepieces.PROBES + [r[1] or "" for r in odd_rows()], OURS) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_parity_on_any_text(text):
    assert sentencepieces.parity(PATH, [text.replace("\x00", "").encode("utf-8", "ignore").decode()], OURS) == []


def test_tables(spark):
    docs = table(spark)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), zlib.crc32(np.array(theirs.encode(r["text"] or ""), np.uint32).tobytes()), zlib.crc32(theirs.decode(theirs.encode(r["text"] or "")).encode())) for r in rows)
    got = sentencepieces.round_trip(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"], r["decoded_crc32"]) for r in got) == want
    encoded = sentencepieces.encode(docs, PATH)
    back = sorted((str(r["doc_id"]), r["text"]) for r in sentencepieces.decode(encoded, PATH).collect())
    assert back == sorted((str(r["doc_id"]), theirs.decode(theirs.encode(r["text"] or ""))) for r in rows)
    assert sentencepieces.round_trip(empty(spark), PATH).count() == 0


def unigram_file(path):
    """A model file with pieces and scores of our own, written field by field; nothing is trained."""

    def field(number, value):
        def varint(x):
            out = b""
            while x > 127:
                out, x = out + bytes([x & 127 | 128]), x >> 7
            return out + bytes([x])

        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(value)) + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    words = "▁the ▁th e s ▁ an d ▁and ▁s ing er ▁in n i t a o h ▁a ab abc bc c b ▁abc ée é".split()
    pieces += [(w, -2.0 - 0.37 * k - (k % 5) * 0.011, 1) for k, w in enumerate(words)]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1) + field(4, len(pieces)) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, 1) + field(5, 1))
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_unigram_models(tmp_path):
    path = unigram_file(tmp_path / "own.model")
    model = sentencepieces.Model(path)
    assert model.kind == sentencepieces.UNIGRAM and model.byte_fallback
    texts = ["", "the and sing", "abc abcabc bcab", "thesinger  in the  end", "née é日本", " abc ", "xyz the", "aaaa bbbb\tnn"]
    assert sentencepieces.parity(path, texts, model.tokenizer()) == []
