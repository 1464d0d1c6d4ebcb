import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import answers, dates, text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Él «SEGÚN» ñandú!", "el  segun  nandu "),
        ("a“b”c", "a“b”c"),  # curly quotes stay
        ("Café ß ø", "cafe ß ø"),
        ("x—y–z-w|v", "x y z w v"),
    ],
)
def test_search_fold(value, raw, want):
    assert value(text.search_fold, raw) == want


def test_tokens_keep_accented_stop_words_without_plain_twin(value):
    words = "según están quién cuándo más también está cómo sí a x de casa casa"
    assert value(text.tokens, words) == ["segun", "estan", "quien", "cuando", "mas", "tambien", "casa", "casa"]
    assert value(text.tokens, "de la a") == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ("¡Sin él! he, Pe.", "él"),
        ("sinó", "ó"),  # word ends are ASCII, so the name in front of an accent goes
        ("sinuoso res", "sinuoso"),
        ("uno|dos  tres", "uno dos tres"),
        ("(Alef) «Bien» [a]", "bien a"),
        ("café", "café"),
        (" a  b ", "a b"),
    ],
)
def test_compare_fold(value, raw, want):
    assert value(text.compare_fold, raw) == want


def test_display_and_export_differ_in_order(value):
    assert value(text.display_text, "uno (PE)  dos | tres (Sámec)") == "uno dos — tres"
    assert value(text.display_text, "a |(Pe)| b") == "a —  — b"
    assert value(text.export_text, "a |(Pe)| b") == "a — — b"
    assert value(text.export_text, "a |(Pe)b") == "a — b"


def test_block_and_noise(value):
    assert value(text.normalize_block, " pala-\n  bra­ y  más\n") == "palabra y más"
    chunk = "uno\n 1: Gén 2,4-25; Sal 8\n55,1; Ap 21\n1:2 no\n\ndos *1,1 nota\ntres"
    assert value(text.strip_noise, chunk) == "uno\n1:2 no\n"
    assert value(text.is_cross_reference, "  ") is False
    assert value(text.is_cross_reference, "12.3: 1 Sam 4") is True
    assert value(text.is_cross_reference, "12: sin número") is False


def test_caps(value):
    assert value(lambda c: text.cap_at_word(c, 5), "ab cd ef") == "ab…"
    assert value(lambda c: text.cap_at_word(c, 5), "abcdefgh") == "abcde…"
    assert value(lambda c: text.cap_at_word(c, 5), "abcde") == "abcde"
    assert value(text.title_or_null, "") is None


def test_numbers(value):
    clamp = lambda c: text.clamp(c, 100, 1600, 600)
    assert value(clamp, None) == 600
    assert value(clamp, math.nan) == 100
    assert value(clamp, 5.0) == 100 and value(clamp, 1e9) == 1600
    assert math.isnan(value(text.leading_int, "abc"))
    assert value(text.leading_int, " 12px") == 12
    assert value(text.coordinates, "40.5abc", "-3.7") == (40.5, -3.7)
    for bad in (("", "1"), ("x", "1"), ("Infinity", "1"), ("1e999", "1"), (None, "1")):
        assert value(text.coordinates, F.lit(bad[0]).cast("string"), bad[1]) is None


def test_small_forms(value):
    assert value(text.distance_label, 999.4) == "999 m"
    assert value(text.distance_label, 999.6) == "1000 m"
    assert value(text.distance_label, 12340.0) == "12.3 km"
    assert value(text.compact_phone, "+34 91 1\t2") == "+349112"
    assert value(text.first_word, "  Ana María ") == "Ana"
    assert value(text.is_photo_name, "places/X/photos/Y") is True
    for bad in ("places/X/photos/", "places/X/photos/a/b", "places//photos/a", "xplaces/X/photos/Y"):
        assert value(text.is_photo_name, bad) is False
    assert value(text.maps_link, "https://m", 1.0, 2.5, "p") == "https://m"
    assert value(text.maps_link, "", 1.0, 2.5, "p").endswith("query=1,2.5&query_place_id=p")
    assert value(text.word_pieces, "  uno  dos\ntres") == ["uno  ", "dos\n", "tres"]
    assert value(text.passage_pair, "r", "") is None


def test_unescape_order(value):
    assert value(answers.unescape, r"a\nb\tc\r\"d\"\\") == 'a\nb\tc"d"\\'
    # an escaped backslash before n is decoded as a line end after a backslash
    assert value(answers.unescape, r"a\\nb") == "a\\\nb"
    assert value(answers.unescape, r"á") == r"á"


def test_json_body(value):
    assert value(answers.json_body, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(answers.json_body, 'Claro: {"a": {}} fin') == '{"a": {}}'
    assert value(answers.json_body, "nada") is None


def test_hours(value):
    day = F.to_date(F.lit("2024-03-06"))  # a Wednesday
    lines = F.array(F.lit("martes: 8"), F.lit("Miércoles:  9:00 - 19:00 "), F.lit("jueves: cerrado"))
    assert value(dates.hours_of_day, lines, day) == "Hoy 9:00 - 19:00"
    assert value(dates.hours_of_day, lines, F.to_date(F.lit("2024-03-07"))) is None
    assert value(dates.hours_of_day, lines, F.to_date(F.lit("2024-03-08"))) is None
    assert value(dates.hours_of_day, F.lit(None).cast("array<string>"), day) is None
    assert value(dates.hours_of_day, F.array(F.lit("MIÉRCOLES sin dos puntos")), day) == "Hoy MIÉRCOLES sin dos puntos"
    rows = value(dates.split_hours, F.array(F.lit("miércoles: 9:00"), F.lit("lunes:"), F.lit("Festivos DE todo")), day)
    assert [tuple(r) for r in rows] == [("Miércoles", "9:00", True), ("Lunes", "—", False), ("Festivos DE todo", "—", False)]


def test_calendar(value):
    assert value(lambda d: dates.pool_index(F.to_date(d), 50), "2024-01-01") == 1
    assert value(lambda d: dates.pool_index(F.to_date(d), 50), "2024-02-19") == 0
    assert value(lambda d: dates.long_date(F.to_date(d), True), "2024-03-05") == "martes, 5 de marzo de 2024"


def test_composition_equals_the_unicode_library(spark):
    import random
    import unicodedata

    rng = random.Random(1)
    tables = text._CANONICAL
    letters = [chr(c) for c in range(0x41, 0x250)] + list("ẹṩḗǖΐᾂ각漢\n 𝅗𐐀") + list(tables.apart) + list(tables.single)[:200]
    common, marks = "\u0300\u0301\u0304\u0308\u031b\u0323\u0327\u0328\u0338\u0345", list(tables.classes)
    rows = [("",), (None,), ("\u0301",), ("plain",), ("e\u0301e\u0301\u0323 e\u0323\u0301" * 50,), ("a" + "\u0301" * 3000,)]
    for _ in range(3000):
        some = [rng.choice(letters) + "".join(rng.choices(common if rng.random() < 0.8 else marks, k=rng.choice([0, 0, 1, 2, 3]))) for _ in range(6)]
        rows.append((rng.choice(["", "\u0323\u0301"]) + "".join(some),))
    found = spark.createDataFrame(rows, "t string").select("t", text.compose(F.col("t")).alias("c")).collect()
    assert [r.c for r in found] == [None if r.t is None else unicodedata.normalize("NFC", r.t) for r in found]


def test_hours_rows_equal_the_array_form(spark):
    rows = spark.sql("select * from values (1, array('lunes: 9–20', 'Martes:', 'cerrado', null, ':x'), date'2024-01-01'), (2, array(), date'2024-01-02'), (3, null, null) t(id, lines, date)")
    flat = dates.hours_rows(rows, ["id"]).collect()
    nested = rows.select("id", dates.split_hours(F.col("lines"), F.col("date")).alias("h")).collect()
    want = [(r.id, i, *h) for r in nested if r.h is not None for i, h in enumerate(r.h)]
    assert [tuple(r) for r in flat] == want and len(want) == 5


def test_mark_runs_are_looked_for_beside_marks_only(spark):
    """The classes of marks are tried on what stands beside marks, and find what they find in the whole text."""
    import random
    import re

    tables = text._CANONICAL
    marks = re.escape("".join(tables.classes))
    pattern = re.compile(f"[^{marks}][{marks}]+|[{''.join(tables.several)}]")
    rng = random.Random(3)
    some = ["a", " ", "\n", "\u00e9", "\u02ff", "\u0370", "\u6f22", "\U00010400", "\u0301", "\u034f", "\u0323", "\u20d0", *tables.several[:3]]
    texts = ["", "plain text", "x\u0301", "a" * 5000 + "e\u0301\u0323" + "b" * 5000]
    texts += ["a" + "".join(rng.choices(some, k=rng.randrange(40))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text._mark_runs(F.col("t")).alias("runs"), F.regexp_replace("t", text._UNMARKED, "").alias("left")
    ).collect()
    assert [r.runs for r in rows] == [pattern.findall(r.t) for r in rows]
    assert rows[3].left == "e\u0301\u0323" and rows[1].left == ""


def test_compare_fold_collapses_every_white_space(value):
    spaces = " \t\n\u000b\f\r\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\ufeff"
    assert value(text.compare_fold, "".join(f"a{x}b{x}{y}" for x in spaces for y in spaces)) == ("a b " * len(spaces) ** 2).strip()
