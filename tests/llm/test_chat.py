from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat

NASTY = ["", "\\", "\\\\", "\\l", "\\\\l", "<", "[", "[/]", "[INST] x [/INST]", "</s>", "\\<[", "]\\e[", "a\\b<c>[d]\n", "\x00", "日本 [é]", "<s>[ASST]x[/]"]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_undone(spark, text):
    e = chat.escape(F.lit(text))
    out, back, role = spark.range(1).select(e, chat.unescape(e), chat.unescape(chat._escape_role(F.lit(text)))).first()
    assert back == text == role and "<" not in out and "[" not in out


def fold(events):
    """The messages of a log, event by event."""
    order, state = [], {}
    for seq, message, kind, text in sorted(events, key=lambda e: e[0]):
        if message not in state:
            order.append(message)
            state[message] = {"role": "", "text": "", "gone": False}
        own = state[message]
        if kind == "start":
            own["role"] = text or ""
        elif kind == "delta":
            own["text"] += text or ""
        elif kind == "edit":
            own["text"] = text or ""
        elif kind == "regenerate":
            own["text"] = ""
        elif kind == "delete":
            own["gone"] = True
    return [(state[m]["role"], state[m]["text"]) for m in order if not state[m]["gone"]]


def test_folding_a_log(spark):
    r = random.Random(0)
    events, logs = [], {}
    for conv in range(30):
        for seq in range(r.randint(1, 40)):
            message = f"m{r.randint(0, 5)}"
            kind = r.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "delete"] if seq > 3 else ["start", "delta"])
            if kind == "start" and any(e[2] == "start" and e[1] == message for e in logs.get(conv, [])):
                kind = "delta"
            text = None if r.random() < 0.05 else r.choice(["system", "user", "assistant", "tool]x"]) if kind == "start" else r.choice(NASTY)
            logs.setdefault(conv, []).append((seq, message, kind, text))
            events.append((conv, seq, message, kind, text))
    r.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, seq long, message string, kind string, text string").repartition(6)
    out = chat.render(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(out) == 30
    for row in out:
        want = fold(logs[row["conv_id"]])
        assert [(t["role"], t["text"]) for t in row["turns"]] == want
        assert row["learned"] == "".join(t for role, t in want if role == "assistant")
        assert len(row["loss"]) == sum(role == "assistant" for role, _ in want)


def test_turn_tables(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"), (None, 0, None, "q", "x"), (2, None, "user", "r", "x"), (3, 0, "user", "w " * 50_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    out = {r["conv_id"]: r for r in chat.render(chat.events_of_turns(turns)).select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert len(out) == 4 and len(out[1]["turns"]) == 4 and len(out[1]["loss"]) == 3
    assert sorted(t["text"] for t in out[1]["turns"]) == ["", "a", "b", "b"] and out[None]["turns"][0]["role"] == ""
    assert out[3]["turns"][0]["text"] == "w " * 50_000
    assert chat.render(chat.events_of_turns(turns.limit(0))).count() == 0


def test_no_python_on_the_main_path(spark):
    from tessera.llm import queries

    plan = queries.op5_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_planted_conversation(spark):
    from tessera.llm import queries

    row = queries.op5_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
