import json

from lectern.plans import lifecycle

RAW = """ GÉNESIS

Gén1 1 Al principio creó Dios el cielo y la tierra. 2 La tierra estaba informe y vacía.
Gén2 1 Quedaron concluidos el cielo y sus ejércitos.
SALMOS

Salmo 23* 1 El Señor es mi pastor, nada me falta. 2 En verdes praderas me hace recostar.
"""


def test_raw_text_to_checked_answers(spark, tmp_path):
    docs = spark.createDataFrame([("corpus", RAW)], "doc_id string, value string")
    store = lifecycle.build_store(docs, str(tmp_path))
    assert store.passages.count() == 5 and store.vectors.count() == 5

    questions = spark.createDataFrame([(1, " ¿quién es mi pastor? "), (2, "zzz"), (3, "  ")], "query_id int, question string")
    messages = spark.createDataFrame([(1, 0, "user", "praderas"), (1, 1, "assistant", "sí")], "query_id int, turn int, role string, content string")
    requests, defaults = lifecycle.ask(questions, messages, store)
    rows = requests.orderBy("query_id", "seq").collect()
    assert [(r.query_id, r.seq, r.role) for r in rows] == [(1, 1, "user"), (1, 2, "assistant"), (1, 3, "user")]
    assert "[Salmos 23:1] El Señor es mi pastor, nada me falta." in rows[2].parts[0]
    assert "[Salmos 23:2]" in rows[2].parts[0]  # found through the message before
    assert rows[2].parts[-1] == "PREGUNTA: ¿quién es mi pastor?"
    assert [r.query_id for r in defaults.collect()] == [2]

    vectors = store.vectors.filter("ref = 'Gén 2:1'").selectExpr("1 as query_id", "transform(q, x -> cast(x as float)) as v")
    requests, _ = lifecycle.ask(questions, messages, store, query_vectors=vectors, k=1)
    last = [r for r in requests.collect() if r.seq == 3][0]
    assert "[Génesis 2:1]" in last.parts[0] and "Salmos" not in last.parts[0]

    answer = json.dumps({"verse": {"reference": "Sal 23:1", "text": "es mi pastor"}, "response": "Él."}, ensure_ascii=False)
    deltas = spark.createDataFrame([(1, i, answer[i * 9 : i * 9 + 9]) for i in range(len(answer) // 9 + 1)], "answer_id int, seq bigint, text string")
    done = lifecycle.finish(deltas, store).collect()
    assert [(r.reference, r.response, r.source) for r in done] == [("Salmos 23:1", "Él.", "parsed")]
