import pytest
from pyspark.sql import functions as F

from lectern.operators import passages, quotes

BOOKS = [
    ("Salmos", "Sal", 23, 1, "El Señor es mi pastor, | nada me falta.", 0),
    ("Salmos", "Sal", 23, 2, "En verdes praderas (Pe) me hace recostar", 1),
    ("1 Samuel", "1 Sam", 3, 4, "El Señor llamó a Samuel", 2),
    ("Salmos", "Sal", 23, 1, "El Señor es mi pastor, nada me falta.", 3),
    ("Viejo", "Vi", 1, 1, "uno", 4),
    ("viejo", "Vj", 1, 1, "dos", 5),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(BOOKS, "book string, abbr string, chapter int, num int, text string, pos bigint")
    return passages.with_refs(rows)


def test_last_duplicate_wins(corpus):
    rows = {r.ref: r.pos for r in passages.by_ref(corpus).collect()}
    assert rows["Sal 23:1"] == 3 and len(rows) == 5


def test_validation(spark, corpus):
    cases = [
        (0, "Salmos 23:1", "el señor es mi pastor", True, "Salmos 23:1"),
        (1, "salmos 23 , 2", "EN VERDES PRADERAS me hace recostar y algo más", True, "Salmos 23:2"),
        (2, "Sal 23.2", "verdes", True, "Salmos 23:2"),
        (3, "1 Samuel 3-4", "llamó a Samuel", True, "1 Samuel 3:4"),
        (4, "1 Sam 3:4", "llamo a Samuel", False, "quoted text does not match Bible verse"),
        (5, "sal 23:1", "pastor", False, "verse not found in Bible"),
        (6, "SALMOS 23:9", "x", False, "verse not found in Bible"),
        (7, "Salmos 23:1-2", "x", False, "reference unparseable"),
        (8, "Nadie 1:1", "x", False, "reference unparseable"),
        (9, "Salmos", "x", False, "reference unparseable"),
        (10, "Salmos 23:1", "", True, "Salmos 23:1"),
        (11, "Viejo 1:1", "dos", True, "viejo 1:1"),  # the later name wins
        (12, "Salmos 023:01", "pastor", True, "Salmos 23:1"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "quote_id int, reference string, text string")
    got = {r.quote_id: r for r in quotes.validate(rows, corpus).collect()}
    assert len(got) == len(cases)
    for quote_id, _, _, ok, outcome in cases:
        r = got[quote_id]
        assert (r.ok, r.found_reference if ok else r.reason) == (ok, outcome), quote_id
    assert got[0].found_text == "El Señor es mi pastor, nada me falta."


def test_containment_works_both_ways(value):
    assert value(quotes.texts_agree, "sin él he", "él") is True
    assert value(quotes.texts_agree, "a b", "a  b c") is True
    assert value(quotes.texts_agree, "a c", "a b c") is False


def test_answers_keep_their_response(spark, corpus):
    rows = spark.createDataFrame(
        [(1, "Sal 23:2", "verdes", "r1"), (2, "Sal 99:1", "x", "r2"), (3, None, None, "r3")],
        "answer_id int, reference string, text string, response string",
    )
    got = {r.answer_id: r for r in quotes.apply_to_answers(rows, corpus).collect()}
    assert got[1].reference == "Salmos 23:2" and got[1].warning is None
    assert got[2].reference is None and got[2].warning == "verse validation failed: verse not found in Bible"
    assert got[3].response == "r3" and got[3].warning is None


def test_calendar_flags_missing(spark, corpus):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "date string").select(F.to_date("date").alias("date"))
    rows = passages.daily_calendar(days, corpus, ["Sal 23:1", "Sal 99:9"]).orderBy("date").collect()
    assert [(r.ref, r.found) for r in rows] == [("Sal 99:9", False), ("Sal 23:1", True)]
