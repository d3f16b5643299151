import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hindcast.llm import chat, queries

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"
STRANGE = ["<", "[", "|", "\\", ">", "/", "</s>", "<|user|>", "[INST]", "\n", "a", "é", "💬", "<\\", "\\<", "|>\n", ""]


@pytest.mark.parametrize("seed", range(200))
def test_segments_are_read_back(seed):
    rng = random.Random(seed)
    role, text = ("".join(rng.choices(STRANGE, k=rng.randint(0, 12))) for _ in range(2))
    segment, start, end = chat.render(role, text)
    assert chat.parse(segment) == (role, text)
    assert start == end or role == "assistant"
    body = segment[2 : -len("</s>\n")]
    assert "</s>" not in body and "<|" not in body and "[INST]" not in body and "[/INST]" not in body
    if role == "assistant":
        assert chat.unescape(segment[start:end]) == text


def replay(events):
    """The messages of a log, one event after the other."""
    state = {}
    for _, _, kind, turn, role, text in sorted(events, key=lambda e: (e[1], e[2], e[3])):
        if kind in ("edit", "regenerate"):
            state = {t: m for t, m in state.items() if t < turn}
        if kind != "regenerate":
            old = state.get(turn)
            state[turn] = (old[0], old[1] + text) if old else (role, text)
    return [state[t] for t in sorted(state)]


def test_folding_equals_replaying_the_log(spark):
    rng = random.Random(4)
    logs = {}
    for conv in range(60):
        log, seq = [], 0
        for _ in range(rng.randint(0, 30)):
            seq += 1
            turn = rng.randint(0, 5)
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            log.append((conv, seq, kind, turn, ["user", "assistant"][turn % 2], "".join(rng.choices(STRANGE, k=3))))
        logs[conv] = log
    rows = [e for log in logs.values() for e in log]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, EVENTS).repartition(4).withColumn("position", F.lit("x"))
    got = {}
    for r in chat.format_chat(events).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append(chat.parse(r.segment))
    assert got == {c: replay(log) for c, log in logs.items() if replay(log)}


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (2, None, "user", "first"), (2, 0, "user", "b"), (2, 0, "user", "b"),
        (2, 0, "assistant", "a"), (None, 0, "user", "no id"), (3, 0, "assistant", "long " * 50_000),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS seq", "'y' AS kind")
    events = chat.events_of(talks)
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(events)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1][1:5] == (3, sha("user\n\n\nx\nassistant\n\n"), 0, sha(""))
    assert got[2][1:5] == (4, sha("user\nfirst\nassistant\na\nuser\nb\nuser\nb\n"), 1, sha("a"))
    assert got[None].n_turns == 1
    assert got[3].loss_chars == 250_000
    assert chat.digests(chat.format_chat(events.limit(0))).collect() == []


def test_query_adds_the_fixed_conversation(spark):
    rows = {r.conv_id: r for r in queries.op4_chat(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    r = rows[-1]
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    parts = [chat.render(role, text)[0] for role in ("user", "assistant")]
    assert r.formatted_chars == len("".join(parts))
