from __future__ import annotations

import random
import zlib

import pytest

from tessera.llm import toxicity

from .helpers import empty, table


def corpus(n=600, seed=3):
    r = random.Random(seed)
    clean = ["".join(r.choice("bcdfgmnprst") + r.choice("aeou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = r.choices(clean, k=r.randint(5, 80))
        toxic = int(k % 5 == 0)
        if toxic:
            words[: r.randint(2, 4)] = r.choices(["zorgle", "zorglers", "frimbad"], k=3)
        elif k % 7 == 0:
            words[2:4] = ["frimbad", "garden"]  # an innocent phrase
        rows.append((k, " ".join(words), toxic))
    return rows


def test_folding():
    for odd in ("ZORGLE", "zоrgle", "z0rg1e", "z​orgle", "zoŕgle".replace("́", "̶"), "ｚorgle"):
        assert toxicity.fold(odd).strip() == toxicity.fold("zorgle").strip(), odd
    assert toxicity.fold("a$$et me@t ho!") == " asset meat ho  "
    assert toxicity.fold("a$$ @ss $hit") == " ass ass shit " and toxicity.fold("$5 5$ me@ 10€").split() == ["s", "s", "mea", "io"]
    for odd in ("z.o.r.g.l.e", "z o r g l e", "Z-0-R-G-1-E", "(z_o_r_g_l_e)"):
        assert toxicity.fold(odd).split() == ["zorgie"], odd
    assert toxicity.fold("zooorgle").split() == ["zoorgie", "zorgie"] and toxicity.fold("assss").split() == ["ass", "as"] and toxicity.fold("zoo ab 1000") == " zoo ab iooo "
    assert toxicity.fold("a b, c.d e") == " a b  c d e "
    assert toxicity.fold(None).split() == [] == toxicity.fold(" \n!").split()
    assert toxicity.fold("chón") != toxicity.fold("chon")


def test_learns_stems_and_exceptions():
    rows = corpus()
    lexicon = toxicity.learn([t for _, t, _ in rows[:400]], [y for *_, y in rows[:400]])
    assert any(p.startswith(" zorg") for p in toxicity.Lexicon(lexicon.weights).weights) or any("zorg" in p for p in lexicon.weights)
    wrong = [k for k, t, y in rows[400:] if (lexicon.score(t) >= 0.3) != bool(y)]
    assert len(wrong) <= 2
    plain, masked = lexicon.score("you zorgle you zorgle thing"), lexicon.score("you Z0RGLE you zоrgle thing")
    assert plain == masked and plain > 0.5 > lexicon.score("walking in the frimbad garden today with you and them")
    assert lexicon.score("") == lexicon.score(None) < 0.3
    for texts, labels in (([], []), (["a"], [1]), (["a", "b"], [0, 0])):
        assert toxicity.learn(texts, labels).score("a") == 0


def test_held_out_rows_are_not_learned_from(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = [(k, y) for k, _, y in rows]
    spoiled = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels]
    one, two = (toxicity.train(docs, spark.createDataFrame(x + [(None, 1), (5000, None)], "doc_id long, toxic int")) for x in (labels, spoiled))
    assert one.weights == two.weights and one.curve == pytest.approx(two.curve) and one.weights
    out = {r["doc_id"]: r for r in toxicity.score(docs, one).collect()}
    assert len(out) == 300 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert len(toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_labelled=10).weights) == 0


def test_odd_tables(spark):
    rows = corpus()
    lexicon = toxicity.learn([t for _, t, _ in rows], [y for *_, y in rows])
    docs = table(spark)
    assert toxicity.score(docs, lexicon).count() == docs.count()
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.keep_clean(empty(spark), lexicon).count() == 0 == toxicity.score(empty(spark), lexicon).count()


def test_matches_are_those_of_a_naive_scan():
    r = random.Random(8)
    for _ in range(300):
        letters = lambda n: "".join(r.choice("ab") for _ in range(n))  # noqa: E731, B023
        weights = {" " + letters(r.randint(1, 4)) + r.choice(["", " "]): round(r.uniform(1, 5), 3) for _ in range(r.randint(0, 6))}
        spared = {f" {letters(2)} {letters(2)} " for _ in range(r.randint(0, 3))}
        text = " " + " ".join(letters(r.randint(1, 5)) for _ in range(r.randint(0, 25))) + " "
        inside = [(k, k + len(p) - 1) for p in spared for k in range(len(text)) if text.startswith(p, k)]
        want = []
        for k in range(len(text)):
            own = [(w, k + len(p) - 1) for p, w in weights.items() if text.startswith(p, k)]
            if own and not any(a <= k < b for a, b in inside):
                want.append((k, max(own)[1], max(own)[0]))
        assert sorted(toxicity.Lexicon(weights, spared - weights.keys()).matches(text)) == want or not weights


def test_the_driver_learns_nothing_itself(spark, monkeypatch):
    rows = corpus(300)
    usable = sorted((t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2)
    want = toxicity.learn([t for t, _ in usable], [y for _, y in usable])
    docs, labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "learn", None)  # in the driver alone: tasks have their own
    found = toxicity.train(docs, labels)
    assert found.weights == want.weights and found.exceptions == want.exceptions and found.curve == pytest.approx(want.curve)
    assert toxicity.train(docs, labels.limit(0)) == toxicity.Lexicon()
