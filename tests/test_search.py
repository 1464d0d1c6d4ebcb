import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors as vx
from lectern.operators import assemble, lexical, topk, vector_search

WORDS = [f"w{i}" for i in range(30)]


def brute_bm25(docs, queries, k):
    tokens = {p: [t for t in text.split() if len(t) > 1] for p, text in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for ts in tokens.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scored = []
        for p, ts in tokens.items():
            s = 0.0
            for t in text.split():
                if t in df:
                    tf = ts.count(t)
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if s > 0:
                scored.append((-round(s, 10), p, round(s, 6)))
        out += [(q, p, s, i + 1) for i, (_, p, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    # one word in nearly all texts, and many equal texts, so that ties are common
    docs = [(i, "hot " * rng.randint(0, 3) + " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(200)]
    docs += [(200 + i, "hot w1 w2") for i in range(100)]
    queries = [(i, " ".join(rng.choices(WORDS, k=4)) + " hot hot") for i in range(20)]
    queries += [(90, "hot"), (91, "unknown zz"), (92, "de la"), (93, "")]
    return docs, queries


@pytest.mark.parametrize("block_bytes", [topk.BLOCK_BYTES, 2_000])
def test_bm25_is_exact_for_any_block_size(spark, corpus, block_bytes):
    docs, queries = corpus
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "pos bigint, text string").repartition(5))
    asked = spark.createDataFrame(queries, "query_id int, text string")
    rows = lexical.search(asked, index, 8, block_bytes).collect()
    assert sorted((r.query_id, r.pos, r.score, r["rank"]) for r in rows) == brute_bm25(docs, queries, 8)


def test_index_round_trip(spark, corpus, tmp_path):
    docs, queries = corpus
    frame = spark.createDataFrame(docs, "pos bigint, text string")
    lexical.LexicalIndex.build(frame).write(str(tmp_path))
    index = lexical.LexicalIndex.read(spark, str(tmp_path))
    asked = spark.createDataFrame(queries[:3], "query_id int, text string")
    rows = lexical.search(asked, index, 3).collect()
    assert sorted((r.query_id, r.pos, r.score, r["rank"]) for r in rows) == brute_bm25(docs, queries[:3], 3)


def test_pairs_agree_with_search(spark, corpus):
    docs, queries = corpus
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "pos bigint, text string"))
    asked = spark.createDataFrame(queries, "query_id int, text string")
    hits = lexical.search(asked, index, 5)
    pairs = hits.select("query_id", "pos").join(asked, "query_id")
    scored = {(r.query_id, r.pos): r.score for r in lexical.score_pairs(pairs, index).collect()}
    assert scored == pytest.approx({(r.query_id, r.pos): r.score for r in hits.collect()}, abs=2e-6)


def test_statistics_count_empty_documents(spark):
    docs = spark.createDataFrame([(0, "uno dos"), (1, "de la")], "pos bigint, text string")
    assert tuple(lexical.corpus_statistics(docs).first()) == (2, 1.0)
    assert lexical.corpus_statistics(docs.filter("pos > 9")).first().avg_len == 0


def test_quantize_rounds_half_up(spark):
    row = spark.createDataFrame([([0.5, -0.5, 1.0],), ([0.0, 0.0, 0.0],)], "v array<float>")
    rows = [r.q for r in row.select(vx.quantize(F.col("v")).alias("q")).collect()]
    assert rows[0].q == [64, -63, 127] and rows[0].scale == 1.0
    assert rows[1].q == [0, 0, 0] and rows[1].scale == 0.0


def vector_table(spark, n=300, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype("float32")
    data[5] = 0
    data[7] = data[8]
    rows = [(i, f"r{i}", [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "pos bigint, ref string, v array<float>").repartition(3)


@pytest.mark.parametrize("small_store", [False, True])
@pytest.mark.parametrize("block_bytes", [topk.BLOCK_BYTES, 300])
def test_nearest_is_exact_for_any_block_size(spark, block_bytes, small_store):
    data, store = vector_table(spark, 60)
    asked = store.filter("pos < 10").select(F.col("pos").alias("query_id"), "v")
    rows = vector_search.nearest(asked, store, 4, block_bytes=block_bytes, small_store=small_store).collect()
    v = data.astype("float64")
    norms = np.linalg.norm(v, axis=1)
    want = []
    for q in range(10):
        bottom = norms * norms[q]
        s = np.round((v @ v[q]) / np.where(bottom == 0, 1, bottom), 10)
        best = sorted(range(len(v)), key=lambda i: (-s[i], i))[:4]
        want += [(q, i, float(s[i]), k + 1) for k, i in enumerate(best)]
    got = sorted((r.query_id, r.pos, r.score + 0.0, r["rank"]) for r in rows)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in sorted(want)], abs=2e-6)


def test_ranks_follow_the_seventh_decimal(spark):
    store = spark.createDataFrame([(0, [1.0, 4e-4]), (1, [1.0, 1e-4]), (2, [1.0, 2e-4])], "pos bigint, v array<double>")
    asked = spark.createDataFrame([(5, [1.0, 0.0])], "query_id int, v array<double>")
    rows = vector_search.nearest(asked, store, 2).orderBy("rank").collect()
    assert [(r.pos, r.score) for r in rows] == [(1, 1.0), (2, 1.0)]


def test_a_block_that_no_query_fills_gives_no_rows(spark):
    _, store = vector_table(spark, 20)
    none = store.filter("pos < 0").select(F.col("pos").alias("query_id"), "v")
    assert vector_search.nearest(none, store, 4).count() == 0
    some = store.select(F.col("pos").alias("query_id"), "v")
    assert vector_search.nearest(some, store.filter("pos < 0"), 4, small_store=True).count() == 0


def test_k_is_taken_before_the_lookup(spark):
    _, store = vector_table(spark)
    quantized = vector_search.quantize_store(store)
    asked = store.filter("pos = 1").select(F.col("pos").alias("query_id"), "v")
    first = vector_search.with_refs(vector_search.nearest(asked, quantized, 3), quantized)
    kept = first.orderBy("rank").limit(1).select("ref", F.lit("texto").alias("text"))
    rows = vector_search.search(asked, quantized, kept, 3).collect()
    assert len(rows) == 1 and rows[0]["rank"] == 1
    assert vector_search.search(asked, quantized.filter("pos < 0"), kept, 3).count() == 0


def test_mixed_vectors_are_refused(spark):
    _, store = vector_table(spark, 20)
    asked = store.filter("pos = 1").select(F.col("pos").alias("query_id"), F.slice("v", 1, 4).alias("v"))
    with pytest.raises(Exception, match="dimensions"):
        vector_search.nearest(asked, store, 2).collect()
    other = store.withColumn("model", F.lit("b"))
    with pytest.raises(Exception, match="expected vectors of model a"):
        vector_search.nearest(store.select(F.col("pos").alias("query_id"), "v"), other, 2, model="a").collect()


def test_relevance_is_a_cut_after_the_top_k(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 0.4999)], "rank int, score double")
    assert [r["rank"] for r in vector_search.relevant(hits).collect()] == [1]


def test_fallback_is_per_query(spark):
    schema = "query_id int, pos bigint, score double, rank int"
    vector = spark.createDataFrame([(1, 5, 0.9, 1), (1, 99, 0.8, 2), (3, 98, 0.7, 1)], schema)
    words = spark.createDataFrame([(1, 6, 3.0, 1), (2, 7, 2.0, 1), (3, 6, 1.0, 1)], schema)
    known = spark.createDataFrame([(5,), (6,), (7,)], "pos bigint")
    rows = assemble.with_fallback(vector, words, known).orderBy("query_id").collect()
    # hits of 1 and 3 that have no passage go, and 3 is left without any: it is searched by words
    assert [(r.query_id, r.pos, r.mode) for r in rows] == [(1, 5, "vector"), (2, 7, "bm25"), (3, 6, "bm25")]


def test_postings_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "casa casa perro"), (2, ""), (3, "perro")], "pos bigint, text string")
    found = lexical.postings(docs)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "casa", 2, 3), (1, "perro", 1, 3), (3, "perro", 1, 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_expansion_uses_users_of_the_window_only(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e")]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    asked = spark.createDataFrame([(1, "q"), (2, "sola")], "conv_id int, question string")
    got = {r.conv_id: r.query for r in assemble.expanded_queries(asked, messages).collect()}
    assert got == {1: "c d q", 2: "sola"}
    got = {r.conv_id: r.query for r in assemble.expanded_queries(asked, messages, size=2).collect()}
    assert got[1] == "d q"


def test_request_has_two_or_three_parts(spark):
    asked = spark.createDataFrame([(1, "¿a?"), (2, "¿b?"), (3, "¿c?")], "query_id int, question string")
    history = spark.createDataFrame([(1, 4, "user", "h")], "query_id int, turn int, role string, content string")
    passages = spark.createDataFrame([(1, "[x 1:1] t"), (2, "[y 1:1] u")], "query_id int, block string")
    qa = spark.createDataFrame([(2, "[1] p\nr")], "query_id int, block string")
    rows = assemble.request_rows(asked, history, passages, qa).orderBy("query_id", "seq").collect()
    assert [(r.query_id, r.seq, r.role, len(r.parts)) for r in rows] == [
        (1, 1, "user", 1), (1, 2, "user", 2), (2, 1, "user", 3),
    ]
    assert rows[2].parts[2] == "PREGUNTA: ¿b?"


def test_question_filter(spark):
    rows = spark.createDataFrame([("  hola ",), ("  \n",), (None,)], "question string")
    accepted, rejected = assemble.ask_filter(rows)
    assert [r.question for r in accepted.collect()] == ["hola"] and rejected.count() == 2


def test_context_is_joined_from_written_hits(spark, tmp_path, monkeypatch):
    """The hits' size is known before the join, so the texts of all passages are not shuffled to them."""
    from lectern.plans.catalog import search

    rows = [(i, f"text {i}", "en", "src1") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = spark.createDataFrame([(1, 7, 0.5, 2, "bm25"), (1, 55, 0.9, 1, "bm25"), (2, 99, 0.1, 1, "vector")], "query_id bigint, pos bigint, score double, rank int, mode string")
    monkeypatch.setattr(search, "fallback_hits", lambda *_: hits)
    blocks = search._passage_blocks(spark, str(tmp_path))
    assert any("/hits-" in name for name in blocks.inputFiles())
    assert [tuple(r) for r in blocks.collect()] == [(1, "[Source 1 2:6] text 55\n\n[Source 1 1:8] text 7")]
