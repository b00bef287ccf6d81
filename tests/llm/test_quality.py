from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import quality

from .helpers import WORD, empty, table


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n, marked = len(words), set()
    seen = collections.Counter(tuple(words[j : j + 8]) for j in range(n - 7))
    for j in range(n - 7):
        if seen[tuple(words[j : j + 8])] > 1:
            marked.update(range(j, j + 8))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts(spark):
    docs = table(spark)
    got = sorted((str(r["doc_id"]), *[r[c] for c in quality.COUNTS], r["base_failed"]) for r in quality.judged(docs).collect())
    want = []
    for r in docs.collect():
        n = brute(r["text"])
        want.append((str(r["doc_id"]), *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(want)
    assert quality.judged(empty(spark)).count() == 0
    for t in ("a b c d e f g h " * 3, "x\ny\nx\n \n \ny", " ".join(map(str, range(50))) + " " + " ".join(map(str, range(10))), "w " * 5000):
        assert quality.statistics(t)[:5] == brute(t)


def clean(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) + r.choice(["", "", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(5)
    rows = []
    for k in range(900):
        text, junk = clean(r, int(np.exp(r.gauss(5, 0.7))) + 25), k % 11 == 0
        if junk:
            text = " ".join(w + "#$%" for w in text.split()) if k % 2 else " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text, ["en", "de", None][k % 3], "hot" if k % 2 else f"s{k % 40}", len(text), *"fbkln", junk))
    return rows


def test_outliers_go_and_clean_texts_stay(spark, mixed):
    got = {r["doc_id"]: r for r in quality.judged(table(spark, [x[:-1] for x in mixed]), min_rows=100).collect()}
    assert len(got) == 900
    wrong = [x[0] for x in mixed if got[x[0]]["kept"] == x[-1]]
    assert len(wrong) <= 3
    kept = quality.keep_good(table(spark, [x[:-1] for x in mixed]), min_rows=100)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, r in got.items() if r["kept"]}


def test_small_tables_are_held_to_the_base_rules_only(spark, mixed):
    got = quality.judged(table(spark, [x[:-1] for x in mixed[:60]])).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_rare_groups_are_judged_by_their_language_and_by_all(spark):
    """Rows of small sources and rare languages in a table with hot sources, too few together for an estimate."""
    r, rows, junk = random.Random(6), [], set()
    for k in range(440):
        text = clean(r, int(np.exp(r.gauss(5, 0.7))) + 25)
        lang, source = ("en", "hot") if k < 400 else ("en", f"rare{k % 3}") if k < 420 else (f"l{k % 4}", "hot")
        if k >= 400 and k % 5 == 0:
            text = " ".join(w + "#$%" for w in text.split())
            junk.add(k)
        rows.append((k, text, lang, source, len(text), *"fbkln"))
    got = {x["doc_id"]: x for x in quality.judged(table(spark, rows), min_rows=200).collect()}
    assert len(got) == 440 and all(x["distance"] is not None for x in got.values())
    assert {k for k in got if not got[k]["kept"]} >= junk and sum(not x["kept"] for x in got.values()) <= len(junk) + 2


def test_null_and_repeated_ids_are_judged_by_row(spark):
    good, r = [], random.Random(8)
    good = [clean(r, 40) for _ in range(4)]
    rows = [(None, good[0]), (None, "too short"), (None, None), (5, good[1]), (5, "short too"), (5, good[2]), (6, good[3])]
    docs = table(spark, [(k, t, None, "s", 1, *"fbkln") for k, t in rows])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(x["text"] for x in kept.collect()) == sorted(good)


def test_estimate_equals_numpy(spark, mixed):
    """The distributed steps against the same steps in numpy, for one group."""
    docs = table(spark, [(x[0], x[1], "en", "s", *x[4:-1]) for x in mixed])
    rows = [quality.statistics(x[1]) for x in mixed]
    x = np.array([r[5:] for r in rows if r[0] >= 20 and 100 * r[4] <= 30 * r[0]])
    p = quality.estimates(quality._grouped(quality.measured(docs).filter("not base_failed"), 100)).collect()
    assert len(p) == 1
    centre, low = np.array(p[0]["centre"]), np.zeros((quality.P, quality.P))
    for v, (i, j) in zip(p[0]["whiten"], quality._LOWER):
        low[i, j] = v
    d2 = (((x - centre) @ low.T) ** 2).sum(axis=1)
    near = x[np.argsort(d2)[: int(np.ceil(quality.H * len(x)))]]
    cov = np.cov(near.T, bias=True) + np.diag(np.array(list(quality.FLOORS.values())) ** 2)
    # a fixed point: estimates from the nearest rows are the estimates
    assert np.allclose(near.mean(axis=0), centre, atol=0.02)
    assert np.allclose(np.linalg.inv(low) @ np.linalg.inv(low).T, cov, atol=0.02)


def numpy_distances(vectors, to, groups):
    """Distances by the module's definition in plain numpy: vectors by row, the groups each enters, the group that judges each."""
    floors = np.array(list(quality.FLOORS.values()))
    rows = {g: np.array([vectors[k] for k in vectors if g in to[k]]) for g in set(groups.values())}

    def middle(x):
        cells = np.sort(np.floor(x / (floors / 16)), axis=0)
        return (cells[int(np.ceil(len(x) / 2)) - 1] + 0.5) * floors / 16

    def near(x, centre, inv):
        d2 = (((x - centre) @ inv.T) ** 2).sum(axis=1)
        bins = np.clip(np.floor((np.log(d2 + 1e-12) + 12) * (quality.BINS / 32)), 0, quality.BINS - 1)
        reach = np.sort(bins)[int(np.ceil(quality.H * len(x))) - 1]
        return bins <= reach, reach

    found, dets = {}, dict.fromkeys(rows, np.inf)
    for g, x in rows.items():
        found[g] = middle(x), np.diag(1 / np.maximum(1.4826 * middle(np.abs(x - middle(x))), floors))
    for _ in range(quality.STEPS):  # all groups go on while a determinant falls
        before = dict(dets)
        for g, x in rows.items():
            inner = x[near(x, *found[g])[0]]
            cov = np.cov(inner.T, bias=True) + np.diag(floors**2)
            found[g], dets[g] = (inner.mean(axis=0), np.linalg.inv(np.linalg.cholesky(cov))), np.linalg.slogdet(cov)[1]
        if all(dets[g] >= before[g] - 1e-3 for g in rows):
            break
    scale = {g: max(np.exp((near(x, *found[g])[1] + 1) / (quality.BINS / 32) - 12) / quality._chi2(quality.H, quality.P), 0.05) for g, x in rows.items()}
    return {k: (((vectors[k] - found[g][0]) @ found[g][1].T) ** 2).sum() / scale[g] for k, g in groups.items()}


def test_kept_equals_numpy(spark, mixed):
    """Every row's distance and verdict, for groups that are large, judged by language, and judged by all."""
    rows = [(k, text, "en" if k % 7 else "rare", source, *x) for k, text, _, source, *x, _ in mixed]
    got = {r["doc_id"]: r for r in quality.judged(table(spark, rows), min_rows=150).collect()}
    stats = {r[0]: quality.statistics(r[1]) for r in rows}
    passed = {r[0]: r for r in rows if stats[r[0]][0] >= 20 and 100 * stats[r[0]][4] <= 30 * stats[r[0]][0]}
    sizes = collections.Counter((r[2], r[3]) for r in passed.values())
    langs = collections.Counter(r[2] for r in passed.values())
    groups = {k: r[2:4] if sizes[r[2:4]] >= 150 else (r[2],) if langs[r[2]] >= 150 else () for k, r in passed.items()}
    assert {len(g) for g in groups.values()} == {0, 1, 2}
    want = numpy_distances({k: np.array(stats[k][5:]) for k in passed}, {k: {r[2:4], r[2:3], ()} for k, r in passed.items()}, groups)
    limit = quality.CUTOFF * quality._chi2(quality.H, quality.P)
    assert {k for k, r in got.items() if r["kept"]} == {k for k, d in want.items() if d <= limit}
    assert all(np.isclose(got[k]["distance"], d, rtol=1e-4) for k, d in want.items())
    assert all(got[k]["distance"] is None for k in got.keys() - want.keys())
    assert 20 < sum(not r["kept"] for r in got.values()) < 150


def test_steps_over_few_groups_write_no_files(spark, mixed, monkeypatch):
    docs = spark.createDataFrame([row[:3] + ("hot",) for row in mixed], "doc_id long, text string, lang string, source string")
    write, names = quality.common.written, []
    monkeypatch.setattr(quality.common, "written", lambda df, name, *a: names.append(name) or write(df, name, *a))
    few = sorted(quality.judged(docs).collect())
    assert names.count("mcd") == 1 and "reach" not in names
    monkeypatch.setattr(quality, "GROUPS", 0)  # as with too many groups to hold
    many = sorted(quality.judged(docs).collect())
    assert names.count("reach") > 1
    assert [r[:8] + (r["kept"],) for r in few] == [r[:8] + (r["kept"],) for r in many]
    near = [(a["distance"], b["distance"]) for a, b in zip(few, many) if a["distance"] is not None]
    assert near and np.allclose(*zip(*near), rtol=1e-6)
