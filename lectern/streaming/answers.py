"""Answers followed live as keyed state (I1-I3, I6 and A10 as streams).

State holds only what has to wait: pieces that came before their turn, the unfinished end of a
text, the events that still decide about a turn. Parsing and folding are the column expressions
of the batch forms, applied to what the state releases; ``follow_answers`` works from the
places of the fields in the text, as ``operators.answers.emissions`` does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.answers import CLOSED, ESCAPES, RESPONSE_HEAD, STRING_BODY
from lectern.operators.answers import ended, turn_state
from lectern.sources.frames import framed

HELD = "seq array<bigint>, text array<string>"


def _stateful(stream: DataFrame, key: str, delay: str, step, out: str, state: str, mode: str) -> DataFrame:
    return (
        stream.withWatermark("ts", delay)
        .groupBy(key)
        .applyInPandasWithState(step, out, state, mode, GroupStateTimeout.EventTimeTimeout)
    )


def _wait(state: GroupState, values: tuple, timeout_ms: int) -> None:
    state.update(values)
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + timeout_ms)


def _in_turn(parts: Iterable[pd.DataFrame], following: int, seqs: list, texts: list) -> tuple[list, list, list]:
    """Texts whose ``seq`` is next, in order, and the (seqs, texts) that still wait for others.

    A piece that was already taken, or comes twice, is dropped; a null text is empty.
    """
    waiting = dict(zip(seqs, texts))
    for part in parts:
        for seq, text in zip(part["seq"], part["text"]):
            if seq >= following:
                waiting.setdefault(int(seq), text if isinstance(text, str) else "")
    ready = []
    while following in waiting:
        ready.append(waiting.pop(following))
        following += 1
    return ready, list(waiting), list(waiting.values())


_PLACES = {name: re.compile(pattern) for name, pattern in CLOSED.items()}
_HEAD, _BODY = re.compile(RESPONSE_HEAD), re.compile(STRING_BODY)
EVENTS = "answer_id string, seq long, event string, reference string, text string"


def _decoded(text: str) -> str:
    for escaped, plain in ESCAPES:
        text = text.replace(escaped, plain)
    return text


def _finished(raw: str) -> bool:
    """The text is one complete JSON object: nothing that follows can matter."""
    try:
        return raw.rstrip().endswith("}") and isinstance(json.loads(raw), dict)
    except ValueError:
        return False


def follow_answers(deltas: DataFrame, delay: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """The events of ``operators.answers.emissions`` as deltas arrive.

    ``deltas`` is a stream of ``(answer_id, seq, ts, text)`` with ``seq`` from 0 in each answer;
    pieces may come in any order and wait for those before them. The state of an answer goes when
    its JSON is complete or event time passes the timeout.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            following, raw, sent, again, seqs, texts = state.get if state.exists else (0, "", -1, 0, [], [])
            ready, seqs, texts = _in_turn(parts, following, seqs, texts)
            start, raw = len(raw), raw + "".join(ready)
            # places of the fields in all that is known; a closed field never changes
            reference, passage = (_PLACES[name].search(raw) for name in ("reference", "text"))
            shown_at = max(reference.end(), passage.end()) if reference and passage else -1
            head = _HEAD.search(raw)
            begin = head.end() if head else len(raw) + 1
            end = _BODY.match(raw, begin).end() if head else begin
            closed = raw[end : end + 1] == '"'
            sent = begin if sent < 0 and head else sent
            for seq, piece in enumerate(ready, start=following):
                stop = start + len(piece)
                if start < shown_at <= stop:
                    out.append((key[0], seq, "verse", _decoded(reference[1]), _decoded(passage[1])))
                seen = raw[begin:stop]
                run = 0 if closed and stop > end else len(seen) - len(seen.rstrip("\\"))
                if stop > begin and run % 2 == 0:
                    # a run of backslashes before may pair with this piece: decode it again, cut it off
                    grown = _decoded(raw[sent - again : min(stop, end)])[again // 2 :]
                    sent, again = min(stop, end), run
                    if grown:
                        out.append((key[0], seq, "response_delta", None, grown))
                start = stop
            if _finished(raw) and not seqs:
                state.remove()
            else:
                _wait(state, (following + len(ready), raw, sent, again, seqs, texts), timeout_ms)
        yield pd.DataFrame(out, columns=["answer_id", "seq", "event", "reference", "text"])

    held = f"following bigint, raw string, sent bigint, again bigint, {HELD}"
    return _stateful(deltas, "answer_id", delay, step, EVENTS, held, "append")


def parse_frames(chunks: DataFrame, delay: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """A10 as a stream: ``(stream_id, seq, ts, text)`` pieces cut anywhere to frames.

    ``seq`` counts from 0 in each stream and pieces may come in any order. The state is the tail
    behind the last empty line, the number of frames seen and the pieces that wait.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            following, tail, seen, seqs, texts = state.get if state.exists else (0, "", 0, [], [])
            ready, seqs, texts = _in_turn(parts, following, seqs, texts)
            *whole, tail = (tail + "".join(ready)).split("\n\n")
            out = [(key[0], i, frame) for i, frame in enumerate(whole, start=seen)]
            _wait(state, (following + len(ready), tail, seen + len(whole), seqs, texts), timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "frame"])

    held = f"following bigint, tail string, seen bigint, {HELD}"
    return framed(_stateful(chunks, "stream_id", delay, step, "stream_id string, seq long, frame string", held, "append"))


def _still_counts(events: dict[int, tuple]) -> list[tuple]:
    """The events that decide about a turn: the last of each kind, and deltas after the last result."""
    last = {}
    for seq in sorted(events):
        last[events[seq][0]] = seq
    result = last.get("result", -1)
    kept = {seq for kind, seq in last.items() if kind != "response_delta"}
    kept |= {seq for seq, (kind, _) in events.items() if kind == "response_delta" and seq > result}
    return [(seq, *events[seq]) for seq in sorted(kept)]


def fold_turns(frames: DataFrame, delay: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """I6 as a stream: the state of each turn after every trigger that brings events (update mode).

    The state keeps the events that still count, by their ``seq``, so late ones take their place. A
    turn whose event time runs out without a ``result`` ends in an error; one with a ``result`` is
    then forgotten without another row.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = {s: (e, d) for s, e, d in zip(*state.get)} if state.exists else {}
        over = state.hasTimedOut
        if over:
            state.remove()
        else:
            for part in parts:
                for seq, event, data in zip(part["seq"], part["event"], part["data"]):
                    events[int(seq)] = (event, data if isinstance(data, str) else None)
            kept = _still_counts(events)
            _wait(state, tuple(list(column) for column in zip(*kept)) if kept else ([], [], []), timeout_ms)
            events = {s: (e, d) for s, e, d in kept}
        if not over or not any(e == "result" for e, _ in events.values()):
            rows = [{"seq": s, "event": e, "data": d} for s, (e, d) in events.items()]
            yield pd.DataFrame({"stream_id": [key[0]], "over": [over], "events": [rows]})

    turn = "stream_id string, over boolean, events array<struct<seq: bigint, event: string, data: string>>"
    held = "seq array<bigint>, event array<string>, data array<string>"
    turns = _stateful(frames, "stream_id", delay, step, turn, held, "update")
    states = turns.select("stream_id", "over", turn_state(F.col("events")).alias("t"))
    now = F.struct(*[F.col(f"t.{name}").alias(name) for name in ("reference", "text", "response", "status", "error")])
    return states.select("stream_id", F.when(F.col("over"), ended(F.col("t"))).otherwise(now).alias("t")).select("stream_id", "t.*")
