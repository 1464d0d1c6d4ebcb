"""Streamed answers as tables (I1-I6); ``streaming.answers`` follows them live.

An answer is one JSON document. It has to be whole to be parsed, so its pieces meet in one
row per answer; nothing larger than an answer is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.answers import (
    CLOSED,
    RESPONSE_HEAD,
    STRING_BODY,
    final_fields,
    partial_fields,
    unescape,
)
from lectern.functions.binding import compute_once, let
from lectern.functions.text import web_trim
from lectern.operators.quotes import apply_to_answers


def accumulate(deltas: DataFrame) -> DataFrame:
    """``(answer_id, raw)``: the text pieces of each answer in order."""
    pieces = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return deltas.groupBy("answer_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("raw")
    )


def prefixes(deltas: DataFrame) -> DataFrame:
    """``(answer_id, seq, raw)``: the text received up to each piece.

    The answer is gathered once, and its prefixes are cut from it where each piece stops, behind
    the last shuffle. The rows hold the square of an answer's pieces, so this is for looking at;
    ``emissions``, ``fields_so_far`` and ``last_sent`` work from pieces and positions.
    """
    placed = _placed(deltas).select("answer_id", "seq", "stop")
    return placed.join(accumulate(deltas), "answer_id").select(
        "answer_id", "seq", F.substring("raw", F.lit(1), F.col("stop").cast("int")).alias("raw")
    )


def _end_of(raw: Column, pattern: str) -> Column:
    """Characters up to the end of the first match, null without one."""
    parts = F.split(raw, pattern, 2)
    return F.when(
        F.size(parts) == 2,
        F.length(F.get(parts, F.lit(0))) + F.length(F.regexp_extract(raw, pattern, 0)),
    )


def _landmarks(raw: Column) -> Column:
    """Where the fields of an answer begin and end, in characters, and its passage."""
    body = F.regexp_extract(raw, RESPONSE_HEAD + f"({STRING_BODY})", 1)
    begin = _end_of(raw, RESPONSE_HEAD)
    fields = partial_fields(raw)
    return F.struct(
        F.when(
            fields["reference"].isNotNull(),
            F.greatest(_end_of(raw, CLOSED["reference"]), _end_of(raw, CLOSED["text"])),
        ).alias("verse_end"),
        fields["reference"].alias("reference"),
        fields["text"].alias("text"),
        begin.alias("begin"),
        (begin + F.length(body)).alias("end"),
        raw.rlike(CLOSED["response"]).alias("closed"),
    )


def _placed(deltas: DataFrame) -> DataFrame:
    """Each piece with where it starts and stops, and the run of backslashes in which the text up to it ends."""
    upto = Window.partitionBy("answer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    plain = F.length(F.rtrim("text", F.lit("\\")))
    return (
        deltas.withColumn("stop", F.sum(n).over(upto))
        .withColumn("start", F.col("stop") - n)
        .withColumn(
            "run",
            F.col("stop")
            - F.coalesce(F.max(F.when(plain > 0, F.col("start") + plain)).over(upto), F.lit(0)),
        )
    )


def fields_so_far(deltas: DataFrame) -> DataFrame:
    """I2 at each piece: ``(answer_id, seq, reference, text, response)``.

    The same as ``partial_fields`` of every prefix, from positions in the whole answer as in
    ``emissions``: each answer is parsed once. Only the response shown is cut at each piece.
    """
    marks = accumulate(deltas).select("answer_id", "raw", let(F.col("raw"), _landmarks).alias("m"))
    placed = _placed(deltas).select("answer_id", "seq", "stop", "run").join(marks, "answer_id")
    stop, begin, end = F.col("stop"), F.col("m.begin"), F.col("m.end")
    finished = F.col("m.closed") & (stop > end)
    shown = (stop > begin) & (finished | (F.least(F.col("run"), stop - begin) % 2 == 0))
    share = F.substring("raw", (begin + 1).cast("int"), (F.least(stop, end) - begin).cast("int"))
    versed = stop >= F.col("m.verse_end")
    return placed.select(
        "answer_id",
        "seq",
        F.when(versed, F.col("m.reference")).alias("reference"),
        F.when(versed, F.col("m.text")).alias("text"),
        F.when(shown, unescape(share)).otherwise(F.lit("")).alias("response"),
    )


def emissions(deltas: DataFrame) -> DataFrame:
    """``(answer_id, seq, event, reference, text)``: what is sent on at each piece.

    A ``verse`` event once both parts of the passage are closed, ``response_delta`` events
    with only the new end of the response.

    No prefix is ever built, so the work grows with the text and not with its square. A
    string field that is closed in some prefix is the same in every longer one, so it is
    enough to know where in the whole answer the fields begin and end. A piece's share of
    the response is decoded on its own. Two things reach over its edges: a prefix ending in
    an odd run of backslashes shows no response, so its piece is sent with the next one; and
    an even run in front may pair differently with the letter behind it, so the run is
    decoded again with the piece and its own characters are cut off.
    """
    marks = accumulate(deltas).select("answer_id", let(F.col("raw"), _landmarks).alias("m"))
    places = marks.select("answer_id", "m.verse_end", "m.begin", "m.end", "m.closed")
    w = Window.partitionBy("answer_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = _placed(deltas).join(places, "answer_id")
    low, high = F.greatest("start", "begin"), F.least("stop", "end")
    share = F.substring(
        "text",
        (low - F.col("start") + 1).cast("int"),
        F.greatest(F.lit(0), high - low).cast("int"),
    )
    begun = F.coalesce(F.col("stop") > F.col("begin"), F.lit(False))
    finished = F.col("closed") & (F.col("stop") > F.col("end"))
    run = F.when(finished, 0).otherwise(F.least("run", F.col("stop") - F.col("begin")))
    completes = (F.col("start") < F.col("verse_end")) & (F.col("stop") >= F.col("verse_end"))
    shares = placed.select(
        "answer_id",
        "seq",
        F.when(begun, share).otherwise(F.lit("")).alias("share"),
        F.when(begun, run).alias("run"),
        (begun & (run % 2 == 0)).alias("shown"),
        F.when(completes, F.col("seq")).alias("verse_seq"),
    ).withColumns(
        {
            "step": F.coalesce(F.sum(F.col("shown").cast("int")).over(before), F.lit(0)),
            "again": F.coalesce(
                F.last(F.when(F.col("shown"), F.col("run")), ignorenulls=True).over(before), F.lit(0)
            ),
        }
    )
    # a step is one piece, or several when those before it showed no response
    steps = shares.groupBy("answer_id", "step").agg(
        F.max(F.when(F.col("shown"), F.col("seq"))).alias("seq"),
        F.max("verse_seq").alias("verse_seq"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "share"))), lambda x: x["share"]), ""
        ).alias("share"),
        F.max("again").cast("int").alias("again"),
    )
    decoded = unescape(F.concat(F.repeat(F.lit("\\"), F.col("again")), F.col("share")))
    grown = F.substring(decoded, (F.col("again") / 2 + 1).cast("int"), F.length(decoded))
    none = F.lit(None).cast("string")
    sent = F.array(
        F.struct(F.col("verse_seq").alias("seq"), F.lit("verse").alias("event"), none.alias("grown")),
        F.struct(F.col("seq").alias("seq"), F.lit("response_delta").alias("event"), grown.alias("grown")),
    )
    events = (
        steps.select("answer_id", F.explode(sent).alias("e"))
        .select("answer_id", "e.*")
        .filter("seq is not null and (event = 'verse' or grown <> '')")
    )
    verses = marks.filter("m.verse_end is not null").select(
        "answer_id", F.lit("verse").alias("event"), "m.reference", "m.text"
    )
    return events.join(verses, ["answer_id", "event"], "left").select(
        "answer_id", "seq", "event", "reference", F.coalesce("text", "grown").alias("text")
    )


_LONE_BACKSLASH = r"(?<!\\)(?:\\\\)*+\\\z"


def last_sent(deltas: DataFrame) -> DataFrame:
    """``(answer_id, raw, reference, text, response)`` as last sent on for each answer.

    These are the fields of the whole text, but a text ending in a lone backslash shows no
    response: then it is the response after the last piece that did not end in one.
    """
    gathered = deltas.groupBy("answer_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]
        ).alias("p")
    )

    def upto(i):
        return F.array_join(F.slice("p", F.lit(1), i + 1), "")

    places = F.transform("p", lambda x, i: i)
    shown = F.array_max(F.filter(places, lambda i: ~upto(i).rlike(_LONE_BACKSLASH)))
    whole = gathered.withColumn("raw", F.array_join("p", ""))
    before = F.when(
        F.col("raw").rlike(_LONE_BACKSLASH), F.coalesce(upto(shown), F.lit(""))
    ).otherwise(F.col("raw"))
    return (
        whole.select("answer_id", "raw", before.alias("before"))
        .select(
            "answer_id",
            "raw",
            partial_fields(F.col("raw")).alias("now"),
            partial_fields(F.col("before")).alias("seen"),
        )
        .select("answer_id", "raw", "now.reference", "now.text", "seen.response")
    )


def results(deltas: DataFrame, passages: DataFrame) -> DataFrame:
    """I4-I5 with H5-H6: the final record ``(answer_id, reference, text, response, warning, source)``.

    A readable answer is validated; an unreadable one is salvaged from what had been sent
    when that is long enough or holds a passage (checked again); else the apology.
    """
    sent = last_sent(deltas).select("*", final_fields(F.col("raw")).alias("final"))
    said = web_trim(F.col("response"))
    readable = F.col("final").isNotNull()
    kept = (F.length(said) > fixed.SALVAGE_MINIMUM) | F.col("reference").isNotNull()

    def either(name: str) -> Column:
        return F.when(readable, F.col(f"final.{name}")).when(kept, F.col(name))

    chosen = F.struct(
        F.when(readable, "parsed").when(kept, "salvaged").otherwise("apology").alias("source"),
        either("reference").alias("reference"),
        either("text").alias("text"),
        F.when(readable, F.col("final.response"))
        .when(kept, F.coalesce(F.nullif(said, F.lit("")), F.lit(fixed.KEEP_TALKING)))
        .otherwise(F.lit(fixed.APOLOGY))
        .alias("response"),
    )
    checked = apply_to_answers(compute_once(sent, ["answer_id"], chosen), passages)
    warning = F.when(F.col("source") == "parsed", F.col("warning"))
    return checked.withColumn("warning", warning).select(
        "answer_id", "reference", "text", "response", "warning", "source"
    )


EVENT_DATA = "struct<reference: string, text: string, response: string, message: string, verse: struct<reference: string, text: string>>"


def turn_state(events: Column) -> Column:
    """struct(reference, text, response, status, error) of the events of one turn.

    ``events`` is an array of (seq, event, data). Everything depends on the place of the last
    ``result``: the passage and response before it are overwritten, deltas after it are
    appended. Data that is no JSON object counts as one without fields. The batch and the
    streaming fold both use this.
    """
    parsed = F.transform(
        F.array_sort(events),
        lambda e: F.struct(e["seq"].alias("seq"), e["event"].alias("event"), F.from_json(e["data"], EVENT_DATA).alias("d")),
    )
    return let(parsed, _turn_state)


def _turn_state(events: Column) -> Column:
    def last(kind: str) -> Column:
        return F.try_element_at(F.filter(events, lambda e: e["event"] == kind), F.lit(-1))

    def at(kind: str) -> Column:
        return F.coalesce(last(kind)["seq"], F.lit(-1))

    r, v, d, e = (at(kind) for kind in ("result", "verse", "response_delta", "error"))
    result = last("result")["d"]
    tail = F.filter(events, lambda x: (x["event"] == "response_delta") & (x["seq"] > r))
    verse = F.when(v > r, F.struct(last("verse")["d"]["reference"].alias("reference"), last("verse")["d"]["text"].alias("text")))
    verse = verse.otherwise(F.struct(result["verse"]["reference"].alias("reference"), result["verse"]["text"].alias("text")))
    response = F.when(
        result["response"].isNotNull() | (F.size(tail) > 0),
        F.concat(F.coalesce(result["response"], F.lit("")), F.array_join(F.transform(tail, lambda x: x["d"]["text"]), "")),
    )
    newest = F.greatest(r, v, d, e)
    status = F.when(e == newest, F.when(e >= 0, "error").otherwise("loading")).when(r == newest, "done").otherwise("streaming")
    error = F.when(e >= 0, F.coalesce(last("error")["d"]["message"], F.lit(fixed.SOMETHING_WRONG)))
    return F.struct(
        verse["reference"].alias("reference"),
        verse["text"].alias("text"),
        response.alias("response"),
        status.alias("status"),
        error.alias("error"),
        (r < 0).alias("unanswered"),
    )


def ended(turn: Column) -> Column:
    """The state of a turn to which nothing more will come: one without a result is an error."""
    lost = turn["unanswered"]
    return F.struct(
        *[turn[name].alias(name) for name in ("reference", "text", "response")],
        F.when(lost, "error").otherwise(turn["status"]).alias("status"),
        F.when(lost, F.lit(fixed.NO_ANSWER)).otherwise(turn["error"]).alias("error"),
    )


def fold_turns(frames: DataFrame) -> DataFrame:
    """Final state ``(stream_id, reference, text, response, status, error)`` of each turn.

    ``frames`` (stream_id, seq, event, data); a turn is one answer and meets in one row.
    """
    events = F.collect_list(F.struct("seq", "event", "data"))
    turns = frames.groupBy("stream_id").agg(events.alias("events"))
    states = turns.select("stream_id", turn_state(F.col("events")).alias("t"))
    return states.select("stream_id", ended(F.col("t")).alias("t")).select("stream_id", "t.*")
