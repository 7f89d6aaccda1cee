"""Order-dependent operators: their rules row by row, and that a stream restarted from its checkpoint gives what a table gives."""

import json
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.streaming import stateful as S


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def told(fold, rows):
    state, out = fold.start(), []
    for r in rows:
        state = json.loads(json.dumps(state))  # as a stream keeps it
        out += fold.step(state, dict(zip(fold.columns, r)))
    return out + list(fold.finish(state)), state


def test_cache_hits_expire_are_cut_and_cleared():
    a, near, b = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    ask = lambda t, i, e, res=None, k=None: (t, i, "ask", e, res, k)
    rows = [ask(0, 1, a, [7, 8, 9]), ask(1, 2, near, [1], 2), ask(2, 3, b, [5]), ask(301, 4, near, [6]), ask(302, 5, a, None, 1), (303, 6, "clear", None, None, None), ask(304, 7, a), ask(305, 8, [0.0, 0.0], [1]), ask(306, 9, None, [1])]
    out, state = told(S.QueryCache(), rows)
    assert out == [(1, False, None, [7, 8, 9], 1), (2, True, 1, [7, 8], 1), (3, False, None, [5], 2), (4, False, None, [6], 2), (5, True, 4, [6], 2), (7, False, None, None, 0), (8, False, None, [1], 1), (9, False, None, [1], 1)]
    out, state = told(S.QueryCache(entries=3), [(i, i, "put", [float(i == j) for j in range(9)], [i], None) for i in range(9)] + [ask(9, 9, [0.0] * 5 + [1.0] + [0.0] * 3), ask(9, 10, [0.0] * 8 + [2.0])])
    assert out == [(9, False, None, None, 3), (10, True, 8, [8], 3)] and [e[0] for e in state["held"]] == [6, 7, 8]


def frames(*said):
    return "".join(f"data: {x if isinstance(x, str) else json.dumps(x)}\n\n" for x in said)


def delta(t):
    return {"choices": [{"delta": {"content": t}}]}


def test_replies_are_the_same_however_they_are_cut():
    stream = ": ping\r\n\r\n" + frames(delta("Hel"), delta("lo wor"), {"choices": [{"message": {"content": "Hello world, é"}}]}, {"choices": [{"text": "Hello there"}]}, {"content": "Hello there you"}, {"choices": []}, {"id": 3}, "raw text", "5") + "event: x\rdata:[DONE]\r\ndata: late\n"
    r = random.Random(1)
    for trial in range(60):
        places = sorted(r.sample(range(1, len(stream)), r.randint(0, 30))) if trial else list(range(1, len(stream)))
        pieces = [stream[a:b] for a, b in zip([0, *places], [*places, len(stream)])]
        out, state = told(S.ReplyStream(), [(i, i / 2, p) for i, p in enumerate(pieces)])
        assert state["text"] == "Hello there youraw text5" and state["done"]
        assert "".join(x[1] for x in out) == "Hello world, éthere youraw text5"
        assert [x[5] for x in out] == [False] * (len(out) - 1) + [True] and out[-1][3] == 10
        assert {x[4] for x in out} == {out[0][0] / 2}
    again, _ = told(S.ReplyStream(), [(0, 0.0, frames(delta("a"))), (0, 0.0, frames(delta("a"))), (1, 1.0, None), (2, 1.0, frames("[DONE]"))])
    assert [x[1] for x in again] == ["a", ""] and again[-1][5]


def test_throttle_keeps_the_last_value():
    rows = [(0.0, 1, 10.0), (0.2, 2, 20.0), (0.9, 3, 30.0), (1.5, 4, 40.0), (5.0, 5, 50.0), (5.1, 6, 60.0)]
    assert told(S.Throttle(), rows)[0] == [(0.0, 1, 10.0, False), (1.0, 3, 30.0, True), (2.0, 4, 40.0, True), (5.0, 5, 50.0, False), (6.0, 6, 60.0, True)]
    r = random.Random(2)
    many = sorted((r.uniform(0, 60), i, float(i)) for i in range(500))
    out = told(S.Throttle(), many)[0]
    assert all(b[0] - a[0] >= 1 - 1e-9 for a, b in zip(out, out[1:])) and out[-1][1] == many[-1][1] and len(out) > 50


def test_entitlements_fall_on_revocation_and_ignore_repeats():
    buy = lambda t, n, p, x=None: (t, t, "purchase", p, n, x)
    undo = lambda t, n, p: (t, t, "revoke", p, n, None)
    rows = [buy(1, 1, "pro"), buy(2, 2, "starter"), buy(3, 3, "pack", 50.0), buy(4, 4, "pack"), buy(5, 4, "pack"), buy(6, 5, "pack"), buy(7, 6, "pack"), undo(8, 99, "pack"), undo(9, 2, "starter"), undo(10, 1, "pro"), buy(11, 1, "pro"), undo(12, 1, "pro"), (13, 13, "failed", "pro", 9, None), buy(60, 7, "lifetime"), buy(61, 8, "pro")]
    out, _ = told(S.Entitlements(), rows)
    assert [(x[1], x[2], x[5]) for x in out] == [
        ("pro", 0, "upgraded"), ("pro", 0, "ignored"), ("pro", 1, "pack"), ("pro", 2, "pack"), ("pro", 2, "ignored"), ("pro", 3, "pack"), ("pro", 3, "cap reached"), ("pro", 2, "pack removed"),
        ("pro", 2, "ignored"), ("free", 2, "revoked"), ("free", 2, "ignored"), ("free", 2, "ignored"), ("free", 2, "ignored"), ("lifetime", 2, "upgraded"), ("lifetime", 2, "ignored"),
    ]
    assert out[0][3:5] == (1000, 10) and out[9][3:5] == (60, 1)


def test_consent_asks_once_and_a_newer_question_denies_the_older():
    rows = [(1, 1, "send", None), (2, 2, "send", None), (3, 3, "decide", "once"), (4, 4, "send", None), (5, 5, "new_session", None), (6, 6, "send", None), (7, 7, "decide", "deny"), (8, 8, "send", None), (9, 9, "decide", "reset"), (10, 10, "send", None), (11, 11, "decide", "allow"), (12, 12, "send", None)]
    out, _ = told(S.Consent(), rows)
    assert out == [(1, "asked", None), (2, "denied", 1), (2, "asked", None), (3, "session", 2), (4, "session", None), (6, "asked", None), (7, "denied", 6), (8, "denied", None), (10, "asked", None), (11, "remembered", 10), (12, "remembered", None)]


CASES = {
    "cache": (S.QueryCache(seconds=40.0), "ts double, id long, kind string, embedding array<double>, results array<long>, k int", lambda r, i: (float(i), i, r.choice(["ask", "ask", "ask", "clear"]), [float(r.random() < 0.5), 1.0], [i, i + 1], r.choice([1, None]))),
    "reply": (S.ReplyStream(), "seq long, ts double, data string", lambda r, i: (i, float(i), r.choice(["data: ", "da", "ta: x\n", "\r", "\n\n", json.dumps(delta("w ")), '{"content": "w w', ' z"}\n']))),
    "entitlements": (S.Entitlements(), "ts double, id long, kind string, product string, transaction long, expires double", lambda r, i: (float(i), i, r.choice(["purchase", "purchase", "revoke", "failed"]), r.choice(["starter", "pro", "pack", "pack"]), r.randrange(12), float(i + 20))),
    "consent": (S.Consent(), "ts double, id long, kind string, value string", lambda r, i: (float(i), i, r.choice(["send", "decide", "new_session"]), r.choice(["once", "allow", "deny", "reset"]))),
}


@pytest.mark.parametrize("case", CASES)
def test_a_stream_restarted_from_its_checkpoint_equals_the_table(spark, tmp_path, case):
    fold, schema, make = CASES[case]
    r = random.Random(6)
    rows = [(f"key{r.randrange(3)}", *make(r, i)) for i in range(120)]
    all_ = spark.createDataFrame(rows, f"key string, {schema}")
    whole = sorted((tuple(x) for x in S.as_table(all_, "key", fold).collect()), key=repr)
    for part in range(3):  # each run reads the files that are new, then stops
        all_.filter(F.lit(False)).unionByName(spark.createDataFrame(rows[40 * part : 40 * part + 40], all_.schema)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(all_.schema).json(str(tmp_path / "in"))
        q = S.as_stream(stream, "key", fold).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == whole and len(whole) > 5


def test_the_throttles_timer_gives_what_waits(spark, tmp_path):
    batches = [[("a", 10.0, 1, 1.0), ("a", 10.25, 2, 2.0), ("b", 10.5, 3, 3.0)], [("z", 30.0, 4, 4.0)], [("z", 60.0, 5, 5.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "key string, ts double, id long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, ts double, id long, value double").json(str(tmp_path / "in")).withColumn("time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("time", "0 seconds")
        q = S.as_stream(stream, "key", S.Throttle()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x for x in got if x[0] != "z"] == [("a", 10.0, 1, 1.0, False), ("a", 11.0, 2, 2.0, True), ("b", 10.5, 3, 3.0, False)]
    assert [x[1:3] for x in got if x[0] == "z"] == [(30.0, 4), (60.0, 5)]
