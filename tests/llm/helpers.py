"""Small tables with every odd case, and brute-force versions to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bin string, kept string, label string, n string"


def odd_rows(seed: int = 0) -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "délta", "ΕΨ", "日本", "x" * 30, "7", "<b>", "#tag", "a​b", "\x1fz"]
    texts = ["", None, " \n\t ", "one", "one two three", "İstanbul ΣΑΣ   end", "tab\tand\x0bfeed\x0c", "  lead", "trail  ", "\n\nlines\n\n", "| bar | bars |", "Foo,,, bar... (baz)!"]
    texts += [" ".join(r.choices(words, k=r.randint(3, 120))) for _ in range(40)]
    texts += [" ".join(r.choices(words, k=6000))]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["s", None]), None if t is None else len(t), "f", "b", "k", "l", "n") for k, t in enumerate(texts)]
    rows += [rows[15], rows[15], (1000, rows[20][1], "en", "s", 1, "f", "b", "k", "l", "n"), (None, "no id here", None, None, None, None, None, None, None, None)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
