from pyspark.sql import functions as F

from lectern.operators import conversations
from lectern.streaming import conversations as live

TURNS = "id string, conversation_id string, ord int, question string, verse_reference string, verse_text string, response string, liked boolean, created_at timestamp"


def turns(spark, rows):
    frame = spark.createDataFrame(rows, TURNS.replace("created_at timestamp", "at string"))
    return frame.withColumn("created_at", F.to_timestamp("at")).drop("at")


def heads(spark, rows):
    frame = spark.createDataFrame(rows, "id string, user_id string, title string, a string")
    at = F.to_timestamp("a")
    return frame.select("id", "user_id", "title", at.alias("created_at"), at.alias("updated_at"))


def test_titles_are_seeded_once(spark):
    c = heads(spark, [("1", "u", None, "2024-01-01"), ("2", "u", "ya", "2024-01-01"), ("3", "u", None, "2024-01-01")])
    t = turns(spark, [
        ("b", "1", 0, "segunda", None, None, "r", False, "2024-01-03"), ("a", "1", 0, "p" * 100, None, None, "r", False, "2024-01-02"),
        ("c", "2", 0, "q", None, None, "r", False, "2024-01-02"), ("d", "3", 1, "no", None, None, "r", False, "2024-01-02"),
    ])
    assert {r.id: r.title for r in conversations.seed_titles(c, t).collect()} == {"1": "p" * 80, "2": "ya", "3": None}


def test_likes_last_change_wins(spark):
    t = turns(spark, [("a", "1", 0, "q", None, None, "r", True, "2024-01-02"), ("b", "1", 1, "q", None, None, "r", False, "2024-01-02")])
    changes = spark.createDataFrame(
        [("1", 0, False, "2024-01-05", 2), ("1", 0, True, "2024-01-04", 1), ("1", 9, True, "2024-01-04", 3), ("1", 1, None, "2024-01-09", 4)],
        "conversation_id string, ord int, liked boolean, ts string, change_id int",
    )
    assert {r.id: r.liked for r in conversations.apply_likes(t, changes).collect()} == {"a": False, "b": False}


def test_parts_make_the_whole_text(spark):
    t = turns(spark, [
        ("a", "1", 0, "¿Qué?", "Sal 1:1", "uno (Alef) | dos", "Así.", False, "2024-01-02"),
        ("b", "1", 1, "¿Y?", None, None, "Nada.", False, "2024-01-02"),
    ])
    rule = "─" * 40
    parts = conversations.transcript_parts(t, F.to_date(F.lit("2024-03-05")), "TÍTULO", "Fin").orderBy("part").collect()
    assert "".join(r.text for r in parts) == (
        f"TÍTULO\nConversación del martes, 5 de marzo de 2024\n{rule}\n\n"
        f'Tu pregunta:\n¿Qué?\n\nSal 1:1\n"uno (Alef) — dos"\n\nAsí.\n\n{rule}\n\n'.replace("(Alef) ", "")
        + f"Tu pregunta:\n¿Y?\n\nNada.\n\n{rule}\n\nFin"
    )
    shared = conversations.share_parts(t, "Título").orderBy("ord").collect()
    assert "".join(r.text for r in shared) == (
        'Título\n\nPregunta: ¿Qué?\n\n"uno (Alef) | dos"\n— Sal 1:1\n\nAsí.\n\n' + "—" * 20 + "\n\nPregunta: ¿Y?\n\nNada."
    )
    single = {r.ord: r.text for r in conversations.share_text(t, "Atril").collect()}
    assert single[1] == "¿Y?\n\nNada.\n\n— Atril"
    assert single[0] == '¿Qué?\n\n"uno (Alef) | dos"\n— Sal 1:1\n\nAsí.\n\n— Atril'


def test_load_tells_missing_from_empty(spark):
    c = heads(spark, [("1", "u", "t", "2024-01-01")])
    t = turns(spark, [("a", "9", 0, "q", None, None, "r", False, "2024-01-02")])
    asked = spark.createDataFrame([("1",), ("2",)], "id string")
    rows = {r.id: (r.found, r.ord) for r in conversations.load(asked, c, t).collect()}
    assert rows == {"1": (True, None), "2": (False, None)}


def test_streamed_inserts_are_stored_once(spark, tmp_path):
    rows = [
        ("a", "1", 0, "primera " * 20, None, None, "r", False, "2024-01-02"), ("b", "1", 1, "q", None, None, None, False, "2024-01-03"),
        ("c", "2", 0, "q", None, None, "s" * 9000, False, "2024-01-04"),
    ]
    turns(spark, rows[:2]).write.parquet(str(tmp_path / "in" / "x=1"))
    turns(spark, rows[2:]).write.parquet(str(tmp_path / "in" / "x=2"))
    schema = turns(spark, rows).schema
    path = str(tmp_path / "store")
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
        query = live.append_turns(stream, path).trigger(availableNow=True).start()
        query.awaitTermination(120)
    stored = live.stored_turns(spark, path)
    assert {r.id: len(r.response) for r in stored.collect()} == {"a": 1, "c": 8000}
    assert spark.read.parquet(f"{path}/rejected").count() == 1
    c = heads(spark, [("1", "u", None, "2024-01-01"), ("2", "u", "t", "2024-01-09"), ("3", "u", None, "2024-01-01")])
    now = {r.id: (r.title, str(r.updated_at)[:10]) for r in live.current_conversations(c, stored).collect()}
    assert now == {"1": (("primera " * 20)[:80], "2024-01-02"), "2": ("t", "2024-01-09"), "3": (None, "2024-01-01")}
