"""S5, R3 with state: values that are cut between messages.

The messages of a conversation are one text, joined by ``JOINT``. A value may begin in one message and end in a later one, so
of each conversation the stream keeps the end of what it has read: a tail that begins behind white space which no match
spans, ``HOLD`` characters before the end or as little more as that needs. What is before it is redacted and
sent on. So the pieces that come out, joined in order, are the redaction of the joined messages, for all values of at
most ``HOLD`` characters; the state of a conversation is bounded by one message and ``HOLD``.

A message of NULL text, or ``idle`` without a message, ends a conversation: its tail is sent and its state removed.
Messages of one conversation arrive in the order of ``order`` from one micro-batch to the next; within one they are sorted. State,
offsets and output are checkpointed together, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.rules import DEFAULT_RULES, Rule

HOLD = 256
JOINT = " "
PIECES = "conv_id long, piece long, text string"


def compiled(rules: Sequence[Rule]) -> list[tuple[re.Pattern, str, int]]:
    return [(re.compile(r.pattern), re.sub(r"\$(\d)", r"\\\1", r.replacement), r.passes) for r in rules]


def redacted(text: str, rules: Sequence[tuple[re.Pattern, str, int]]) -> str:
    for pattern, replacement, passes in rules:
        for _ in range(passes):
            text = pattern.sub(replacement, text)
    return text


def safe_cut(text: str, rules: Sequence[tuple[re.Pattern, str, int]], hold: int) -> int:
    """The last place behind white space, at most ``len(text) - hold``, that no match of a rule spans; 0 if there is none."""
    most = len(text) - hold
    if most <= 0:
        return 0
    spans = []
    for pattern, _, _ in rules:
        at = 0
        while m := pattern.search(text, at):  # overlapping ones too: a second pass may find them
            spans.append(m.span())
            at = m.start() + 1
    spans.sort()
    places = [m.end() for m in re.finditer(r"\s", text[:most])]
    k, reach = 0, 0
    cut = 0
    for place in places:
        while k < len(spans) and spans[k][0] < place:
            # a match may take one delimiter on either side
            reach = max(reach, spans[k][1] - 1)
            k += 1
        if reach <= place:
            cut = place
    return cut


def conversation_pieces(rules: Sequence[Rule], hold: int, idle_ms: int | None):
    """The function of one conversation in one micro-batch."""
    def pieces(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = compiled(rules)
        tail, n, open_ = state.get if state.exists else ("", 0, False)
        out: list[str] = []
        if state.hasTimedOut:
            out.append(redacted(tail, own))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
            for text in rows["text"]:
                if text is None or (isinstance(text, float)):
                    out.append(redacted(tail, own))
                    tail, open_ = "", False
                    continue
                tail, open_ = tail + (JOINT if open_ else "") + text, True
                cut = safe_cut(tail, own, hold)
                if cut:
                    out.append(redacted(tail[:cut], own))
                    tail = tail[cut:]
            sent = n + len([x for x in out if x])
            if open_:
                state.update((tail, sent, True))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
            elif state.exists:
                state.remove()
        out = [x for x in out if x]
        if out:
            yield pd.DataFrame({"conv_id": [key[0]] * len(out), "piece": range(n, n + len(out)), "text": out})
    return pieces


def redact_conversations(messages: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text",
                         rules: Sequence[Rule] = DEFAULT_RULES, hold: int = HOLD, idle_ms: int | None = None) -> DataFrame:
    """``conv_id, piece, text`` of a stream of messages; the pieces of a conversation in order are its redacted text.

    A conversation that goes on after its end, or after ``idle_ms`` without a message, is a new one: its pieces
    count from 0 again. ``idle_ms`` is for queries that keep running: they wake without data to look for idle
    conversations, so a drain of what is available would not end.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = messages.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("_order"), F.col(text).alias("text"))
    return rows.groupBy("conv_id").applyInPandasWithState(
        conversation_pieces(rules, hold, idle_ms), PIECES, "tail string, n long, open boolean", "append", timeout)
