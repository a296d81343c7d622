"""Redaction across messages: stream equals the redaction of the joined conversation; restart and expiry."""

import random
import re

import pytest

from tessera.functions.rules import DEFAULT_RULES
from tessera.session import scratch_dir
from tessera.streaming import conversations as C

OWN = C.compiled(DEFAULT_RULES)
VALUES = ["joe.doe@example.com", "+1 (523) 555-1055", "1234 5678 1234 5678", "10.0.0.1", 'token = "0a1b2c3d4e5f"', "12 Main Street"]


def conversation(seed):
    """Messages cut anywhere out of a text with values, so that many are cut between two of them."""
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 120)):
        words.append(rng.choice(VALUES) if rng.random() < 0.3 else rng.choice(["so", "mail", "12", "call", "the", "x.y"]))
    text, out = " ".join(words), []
    spaces = [m.start() for m in re.finditer(" ", text)]
    cuts = sorted(rng.sample(spaces, min(len(spaces), rng.randrange(0, 12))))
    for lo, hi in zip([-1, *cuts], [*cuts, len(text)], strict=True):
        out.append(text[lo + 1:hi])
    return out, text


@pytest.mark.parametrize("hold", [40, 256])
def test_pieces_are_the_redaction_of_the_whole(hold):
    for seed in range(150):
        messages, text = conversation(seed)
        tail, done = "", ""
        for k, m in enumerate(messages):
            tail += (C.JOINT if k else "") + m
            cut = C.safe_cut(tail, OWN, hold)
            done, tail = done + C.redacted(tail[:cut], OWN), tail[cut:]
            assert len(tail) <= hold + len(m) + 200
        assert done + C.redacted(tail, OWN) == C.redacted(text, OWN)


def drained(spark, source, sink, state, **options):
    stream = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    q = (C.redact_conversations(stream, **options).writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", state).trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    pieces = {}
    for r in spark.read.schema(C.PIECES).parquet(sink).collect():
        pieces.setdefault(r.conv_id, []).append((r.piece, r.text))
    return pieces


def test_stream_equals_batch_and_goes_on_after_a_restart(spark):
    source, sink, state = (scratch_dir(spark, f"conv-{n}") for n in ("in", "out", "state"))
    talks = {k: conversation(k) for k in range(12)}
    longest = max(len(m) for m, _ in talks.values())

    def write(turns):
        rows = [(k, t, m[t] if t < len(m) else None) for k, (m, _) in talks.items() for t in turns if t <= len(m)]
        spark.createDataFrame([*rows, (None, 0, "no conversation")], "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(source)
    write(range(0, 3))
    first = drained(spark, source, sink, state, hold=40)
    write(range(3, 6))
    write(range(6, longest + 1))
    pieces = drained(spark, source, sink, state, hold=40)
    assert set(pieces) == set(talks) and sum(map(len, first.values())) < sum(map(len, pieces.values()))
    for k, (_, text) in talks.items():
        own = sorted(pieces[k])
        assert [p for p, _ in own] == list(range(len(own)))
        assert "".join(t for _, t in own) == C.redacted(text, OWN)


def test_idle_conversations_are_sent_and_forgotten():
    class State:
        def __init__(self, held, timed_out):
            self.held, self.hasTimedOut, self.removed = held, timed_out, False

        exists = property(lambda self: self.held is not None)
        get = property(lambda self: self.held)

        def remove(self):
            self.held, self.removed = None, True

        def update(self, new):
            self.held = new

        def setTimeoutDuration(self, ms):
            self.wait = ms
    import pandas as pd

    run = C.conversation_pieces(DEFAULT_RULES, 40, 5000)
    state = State(None, False)
    assert list(run((7,), iter([pd.DataFrame({"_order": [1], "text": ["mail joe@exa"]})]), state)) == []
    assert state.wait == 5000 and state.held[0] == "mail joe@exa"
    assert list(run((7,), iter([pd.DataFrame({"_order": [3, 2], "text": ["or 10.0.0.1", "me@b.org"]})]), state)) == []
    state.hasTimedOut = True
    (out,) = run((7,), iter([]), state)
    assert out.values.tolist() == [[7, 0, "mail joe@exa [EMAIL] or [IP]"]] and state.removed
