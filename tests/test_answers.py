import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.answers import final_fields, partial_fields
from lectern.operators import answers, passages

def pieces_of(text, rng):
    out = []
    while text:
        n = rng.randint(1, 9)
        out.append(text[:n])
        text = text[n:]
    return out


# how a text is written in JSON, and what it stands for
BITS = {"a": "a", "bc ": "bc ", '\\"': '"', "\\\\": "\\", "\\n": "\n", "\\t": "\t", "\\r": "", "ñ": "ñ", "é": "é", ",": ","}


@pytest.fixture(scope="module")
def made():
    """Answers in pieces, with the passage and response that they were made from."""
    rng = random.Random(11)
    out = {}
    for i in range(60):
        body, words = rng.choices(list(BITS), k=rng.randint(1, 30)), rng.choices(list(BITS), k=6)
        passage = '{"reference" : "Sal %d:1", "text":"%s"}' % (i, "".join(words)) if i % 3 else "null"
        parts = ['"verse": ' + passage, '"response" :"' + "".join(body) + '"']
        if i % 5 == 0:
            parts.reverse()
        truth = (f"Sal {i}:1", "".join(BITS[w] for w in words)) if i % 3 else None
        out[f"a{i:02d}"] = (pieces_of("{" + ", ".join(parts) + "}", rng), truth, "".join(BITS[b] for b in body))
    return out


@pytest.fixture(scope="module")
def streams(made):
    out = {k: pieces for k, (pieces, _, _) in made.items()}
    # cut off in the middle, or with runs of backslashes over the edges of pieces
    out |= {f"{k}-cut": pieces[: len(pieces) // 2] for k, (pieces, _, _) in made.items() if len(pieces) > 3}
    out["lone"] = ['{"response": "abc', "def\\"]
    out["slashes"] = ['{"response": "x\\', "\\", "\\", '\\n"', "}"]
    out["none"] = ["no json at all"]
    return out


@pytest.fixture(scope="module")
def deltas(spark, streams):
    rows = [(k, i, p) for k, ps in streams.items() for i, p in enumerate(ps)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "answer_id string, seq bigint, text string").repartition(4)


def test_emissions_add_up_to_the_answer(made, streams, deltas):
    verses, grown, places = {}, {}, {}
    for r in sorted(answers.emissions(deltas).collect(), key=lambda r: (r.answer_id, r.seq)):
        if r.event == "verse":
            assert r.answer_id not in verses
            verses[r.answer_id] = (r.reference, r.text)
            places[r.answer_id] = r.seq
        else:
            grown[r.answer_id] = grown.get(r.answer_id, "") + r.text
    for k, (pieces, truth, response) in made.items():
        assert verses.get(k) == truth and grown.get(k, "") == response
        if truth:  # sent with the piece that closes the second of the two fields
            before = "".join(pieces[: places[k]])
            assert '"text":"' not in before or not before.split('"text":"')[1].replace('\\\\', "").replace('\\"', "").count('"')
        assert response.startswith(grown.get(f"{k}-cut", ""))


def test_emissions_by_hand(spark):
    texts = {
        "a": ['{"verse": {"reference": "r", "te', 'xt": "t"}, "resp', 'onse": "uno', " dos", '"}'],
        "b": ['{"response": "x\\', "n", "y", '\\"z"', ', "verse": null}'],
        "c": ['{"response": "x\\', "\\", "\\", '\\n"', "}"],
    }
    rows = [(k, i, p) for k, ps in texts.items() for i, p in enumerate(ps)]
    found = answers.emissions(spark.createDataFrame(rows, "answer_id string, seq bigint, text string")).collect()
    assert sorted(tuple(str(x) for x in r) for r in found) == [
        ("a", "1", "verse", "r", "t"),
        ("a", "2", "response_delta", "None", "uno"),
        ("a", "3", "response_delta", "None", " dos"),
        ("b", "1", "response_delta", "None", "x\n"),
        ("b", "2", "response_delta", "None", "y"),
        ("b", "3", "response_delta", "None", '"z'),
        ("c", "1", "response_delta", "None", "x\\"),
        ("c", "3", "response_delta", "None", "\\\n"),  # a line break is decoded before a backslash
    ]


def test_last_sent(made, deltas):
    got = {r.answer_id: r for r in answers.last_sent(deltas).collect()}
    for k, (_, truth, response) in made.items():
        assert got[k].response == response and (got[k].reference, got[k].text) == (truth or (None, None))
    assert got["lone"].response == "abc" and got["none"].response == ""


def test_prefixes_and_whole(streams, deltas):
    got = {(r.answer_id, r.seq): r.raw for r in answers.prefixes(deltas).collect()}
    assert all(got[k, i] == "".join(ps[: i + 1]) for k, ps in streams.items() for i in range(len(ps)))
    whole = {r.answer_id: r.raw for r in answers.accumulate(deltas).collect()}
    assert whole == {k: "".join(ps) for k, ps in streams.items()}


def test_fields_so_far_equal_every_prefix(spark, streams, deltas):
    """At each piece what the prefix holds; pieces of 32 characters of a long answer, too."""
    long = '{"verse": {"reference": "Sal 1:1", "text": "t"}, "response": "' + "ab\\\\n\\\\\\\\ c" * 400 + '"}'
    every = streams | {"long": [long[i : i + 32] for i in range(0, len(long), 32)]}
    rows = [("long", i, p) for i, p in enumerate(every["long"])]
    got = answers.fields_so_far(deltas.union(spark.createDataFrame(rows, deltas.schema))).collect()
    prefixes = [(k, i, "".join(ps[: i + 1])) for k, ps in every.items() for i in range(len(ps))]
    brute = spark.createDataFrame(prefixes, "answer_id string, seq bigint, raw string")
    want = brute.select("answer_id", "seq", partial_fields(F.col("raw")).alias("f")).select("answer_id", "seq", "f.*").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(every["long"]) > 100


@pytest.mark.parametrize(
    "raw, want",
    [
        ('```json\n{"verse": {"reference": "a", "text": "b"}, "response": "c"}\n```', ("a", "b", "c")),
        ('Claro: {"verse": null, "response": "c"} espero', (None, None, "c")),
        ('{"verse": {"reference": 1, "text": "b"}, "response": "c"}', (None, None, "c")),
        ('{"response": 3}', None),
        ('{"verse": null}', None),
        ('{"response": "c"', None),
        ('{"response": "x", "response": "y"}', (None, None, "y")),
        ('{"response": "a"} y {"response": "b"}', None),
        ('{"response": "a"}, {"response": "b"}', None),
        ("nada", None),
        ("", None),
    ],
)
def test_final_fields(value, raw, want):
    got = value(final_fields, raw)
    assert (tuple(got) if got else None) == want


def test_long_answers_do_not_overflow(spark):
    body = "\\n\\\"" * 8000 + "x" * 20000
    rows = spark.createDataFrame([("a", 0, '{"verse": null, "response": "' + body), ("a", 1, '"}')], "answer_id string, seq bigint, text string")
    assert len(answers.last_sent(rows).first().response) == 16000 + 20000
    assert answers.emissions(rows).count() == 1


def test_results(spark):
    known = passages.with_refs(
        spark.createDataFrame([("Salmos", "Sal", 1, 1, "Dichoso el hombre", 0)], "book string, abbr string, chapter int, num int, text string, pos bigint")
    )
    good = {"verse": {"reference": "Sal 1:1", "text": "Dichoso"}, "response": "bien"}
    bad = {"verse": {"reference": "Sal 1:1", "text": "Infeliz"}, "response": "mal"}
    texts = {
        "good": json.dumps(good),
        "bad": json.dumps(bad),
        "plain": '{"verse": null, "response": "solo"}',
        "long": '{"verse": null, "response": "  una respuesta que se corta a la mitad',
        "short": '{"verse": null, "response": "corta',
        "verse": '{"verse": {"reference": "Sal 1:1", "text": "Dichoso"}, "resp',
        "wrong": '{"verse": {"reference": "Sal 9:1", "text": "Dichoso"}, "response": "x',
        "number": '{"response": 5}',
    }
    rows = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "answer_id string, seq bigint, text string")
    got = {r.answer_id: (r.reference, r.text, r.response, r.warning, r.source) for r in answers.results(rows, known).collect()}
    apology = "Disculpa, hubo un momento de silencio. ¿Quieres preguntarme de nuevo?"
    assert got == {
        "good": ("Salmos 1:1", "Dichoso el hombre", "bien", None, "parsed"),
        "bad": (None, None, "mal", "verse validation failed: quoted text does not match Bible verse", "parsed"),
        "plain": (None, None, "solo", None, "parsed"),
        "long": (None, None, "una respuesta que se corta a la mitad", None, "salvaged"),
        "short": (None, None, apology, None, "apology"),
        "verse": ("Salmos 1:1", "Dichoso el hombre", "Sigamos hablando, cuéntame más.", None, "salvaged"),
        "wrong": (None, None, "x", None, "salvaged"),
        "number": (None, None, apology, None, "apology"),
    }


def test_fold_turns(spark):
    verse, result = '{"reference": "r", "text": "t"}', '{"verse": null, "response": "final"}'
    rows = [
        ("done", 0, "verse", verse), ("done", 1, "response_delta", '{"text": "a"}'), ("done", 2, "result", result),
        ("open", 0, "response_delta", '{"text": "a"}'), ("open", 1, "response_delta", '{"text": "b"}'), ("open", 2, "verse", verse),
        ("fail", 0, "error", '{"message": "boom"}'),
        ("late", 0, "result", result), ("late", 1, "response_delta", '{"text": "+"}'),
        ("both", 0, "result", result), ("both", 1, "error", "{}"),
        ("odd", 0, "ping", "{}"),
    ]
    got = {r.stream_id: tuple(r)[1:] for r in answers.fold_turns(spark.createDataFrame(rows, "stream_id string, seq bigint, event string, data string")).collect()}
    lost = "No se recibió respuesta. Intenta de nuevo."
    assert got == {
        "done": (None, None, "final", "done", None),
        "open": ("r", "t", "ab", "error", lost),
        "fail": (None, None, None, "error", lost),
        "late": (None, None, "final+", "streaming", None),
        "both": (None, None, "final", "error", "Algo salió mal."),
        "odd": (None, None, None, "error", lost),
    }


# --- the streaming forms give the rows of the batch forms -----------------------------------------

def drain(stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name).collect()


def as_stream(spark, rows, schema, path, parts=3):
    """Rows with a time, written as files that arrive one per trigger in ``seq`` order."""
    import os
    import time

    os.makedirs(path)
    frame = spark.createDataFrame(rows, schema)
    for i in range(parts):
        part = frame.filter(F.col("batch") == i).drop("batch").toPandas()
        part.to_parquet(f"{path}/{i}.parquet", coerce_timestamps="us")
        os.utime(f"{path}/{i}.parquet", (time.time() + i, time.time() + i))
    read = spark.readStream.schema(frame.drop("batch").schema).option("maxFilesPerTrigger", 1)
    return read.parquet(path)


def test_streamed_answers_equal_batch(spark, streams, deltas, tmp_path):
    from lectern.streaming import answers as live

    rows = [
        (k, i, "2024-01-01 00:00:00", p, min(2, i * 3 // len(ps))) for k, ps in streams.items() for i, p in enumerate(ps)
    ]
    stream = as_stream(spark, rows, "answer_id string, seq bigint, at string, text string, batch int", str(tmp_path / "d"))
    timed = stream.withColumn("ts", F.to_timestamp("at"))
    got = drain(live.follow_answers(timed), "append", "followed")
    want = answers.emissions(deltas).collect()
    key = lambda r: (r.answer_id, r.seq, r.event, str(r.reference), r.text)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_streamed_frames_equal_batch(spark, tmp_path):
    from lectern.sources import frames
    from lectern.streaming import answers as live

    text = 'event: verse\ndata: {"reference": "r", "text": "t"}\n\nevent: x\ndata: {bad\n\nevent: y\n\n\n\ndata: 1\ndata: {"text": "é"}\n\nevent: torn\ndata: {'
    whole = spark.createDataFrame([("s", text), ("t", text * 2)], "stream_id string, text string")
    rng = random.Random(5)
    rows = [
        (k, i, "2024-01-01 00:00:00", p, min(2, i * 3 // 40))
        for k, t in (("s", text), ("t", text * 2)) for i, p in enumerate(pieces_of(t, rng))
    ]
    stream = as_stream(spark, rows, "stream_id string, seq bigint, at string, text string, batch int", str(tmp_path / "f"))
    got = drain(live.parse_frames(stream.withColumn("ts", F.to_timestamp("at"))), "append", "frames")
    want = frames.parse_frames(whole).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_streamed_turns_end_like_batch(spark, tmp_path):
    from lectern.streaming import answers as live

    verse, result = '{"reference": "r", "text": "t"}', '{"verse": null, "response": "final"}'
    rows = [
        ("done", 0, "verse", verse, 0), ("done", 1, "response_delta", '{"text": "a"}', 1), ("done", 2, "result", result, 2),
        ("lost", 0, "response_delta", '{"text": "a"}', 0), ("lost", 1, "response_delta", '{"text": "b"}', 1),
        # a much later turn moves the watermark past the timeout of the others
        ("zz", 0, "result", result, 2),
    ]
    timed = [(s, q, "2024-01-01 00:00:00" if s != "zz" else "2024-01-02 00:00:00", e, d, b) for s, q, e, d, b in rows]
    stream = as_stream(spark, timed, "stream_id string, seq bigint, at string, event string, data string, batch int", str(tmp_path / "t"))
    got = drain(live.fold_turns(stream.withColumn("ts", F.to_timestamp("at"))), "update", "turns")
    seen = [tuple(r) for r in got if r.stream_id == "lost"]
    assert seen[0][3:5] == ("a", "streaming") and seen[1][3:5] == ("ab", "streaming")
    assert seen[-1][3:] == ("ab", "error", "No se recibió respuesta. Intenta de nuevo.")
    assert [r.status for r in got if r.stream_id == "done"][:3] == ["streaming", "streaming", "done"]


def test_streams_wait_for_late_pieces_and_survive_odd_data(spark, tmp_path):
    from lectern.sources import frames
    from lectern.streaming import answers as live

    pieces = ['{"response": "uno', " dos", ' tres"}']
    at = "2024-01-01 00:00:00"
    rows = [("a", 0, at, pieces[0], 0), ("a", 2, at, pieces[2], 1), ("a", 1, at, pieces[1], 2), ("a", 1, at, pieces[1], 2), ("b", 0, at, None, 0)]
    stream = as_stream(spark, rows, "answer_id string, seq bigint, at string, text string, batch int", str(tmp_path / "late"))
    got = drain(live.follow_answers(stream.withColumn("ts", F.to_timestamp("at"))), "append", "late")
    assert sorted((r.seq, r.text) for r in got) == [(0, "uno"), (1, " dos"), (2, " tres")]

    text = 'data: {"a": 1, "a": 2}\n\ndata: NaN\n\ndata: [1]\n\nevent: e\u00a0\ndata:\u00a0{}\n\n'
    want = frames.parse_frames(spark.createDataFrame([("s", text)], "stream_id string, text string")).collect()
    assert [r.data for r in want] == ['{"a": 1, "a": 2}', "[1]", "{}"]
    rows = [("s", 1, at, text[20:], 0), ("s", 0, at, text[:20], 1), ("z", 0, at, "", 2)]
    stream = as_stream(spark, rows, "stream_id string, seq bigint, at string, text string, batch int", str(tmp_path / "odd"))
    got = drain(live.parse_frames(stream.withColumn("ts", F.to_timestamp("at"))), "append", "odd")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))

    result = '{"verse": null, "response": "fin"}'
    rows = [
        ("s", 0, "response_delta", "{}", 0), ("s", 1, "response_delta", "[3]", 0), ("s", 2, "verse", "7", 0), ("s", 4, "result", result, 1),
        ("s", 3, "response_delta", '{"text": "x"}', 2), ("s", 5, "response_delta", '{"text": "+"}', 2),
    ]
    batch = spark.createDataFrame([r[:4] for r in rows], "stream_id string, seq bigint, event string, data string")
    timed = [(*r[:2], at, *r[2:]) for r in rows]
    stream = as_stream(spark, timed, "stream_id string, seq bigint, at string, event string, data string, batch int", str(tmp_path / "turn"))
    got = drain(live.fold_turns(stream.withColumn("ts", F.to_timestamp("at"))), "update", "odd_turns")
    assert tuple(got[-1]) == tuple(answers.fold_turns(batch).first()) == ("s", None, None, "fin+", "streaming", None)
