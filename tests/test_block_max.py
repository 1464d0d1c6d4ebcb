"""BM25 through the stored index against brute force."""

import pytest

from lectern.operators import assemble, block_max
from tests.test_search import brute_bm25, corpus  # noqa: F401


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(corpus[0], "pos bigint, text string").repartition(3)
    block_max.BlockIndex.write(docs, path, range_docs=16)
    return block_max.BlockIndex.read(spark, path)


def rows_of(hits):
    return sorted((r.query_id, r.pos, r.score, r["rank"]) for r in hits.collect())


@pytest.mark.parametrize("k, seeds, group", [(8, 2, 100_000), (3, 1, 20), (400, 1, 100_000)])
def test_equals_scoring_everything(spark, corpus, index, k, seeds, group):  # noqa: F811
    docs, queries = corpus
    asked = spark.createDataFrame(queries, "query_id int, text string")
    assert rows_of(block_max.search(asked, index, k, seeds, group)) == brute_bm25(docs, queries, k)


def test_blocks_shuffled_instead_of_broadcast(spark, corpus, index, monkeypatch):  # noqa: F811
    docs, queries = corpus
    monkeypatch.setattr(block_max, "NEEDED_ROWS", 0)
    asked = spark.createDataFrame(queries[:6], "query_id int, text string")
    assert rows_of(block_max.search(asked, index, 5)) == brute_bm25(docs, queries[:6], 5)


def test_bounds_hold_and_leave_ranges_out(spark, corpus, index):  # noqa: F811
    _, queries = corpus
    asked = block_max.weighted_terms(spark.createDataFrame(queries[:5], "query_id int, text string"), index)
    tops = {(r["query_id"], r["range"]): r["bound"] for r in block_max.bounds(asked, index).collect()}
    where = {p: r["range"] for r in index.blocks.select("range", "pos").collect() for p in r["pos"]}
    for q, pos, score, _ in brute_bm25(corpus[0], queries[:5], 10**6):
        assert score <= tops[q, where[pos]] + 1e-6
    best = {q: s for q, _, s, rank in brute_bm25(corpus[0], queries[:5], 1) if rank == 1}
    assert any(bound < best[q] for (q, _), bound in tops.items() if q in best)


def test_a_search_reads_the_folders_of_its_terms(spark, index):
    asked = spark.createDataFrame([(1, "w3")], "query_id int, text string")
    number = block_max.weighted_terms(asked, index).first()["bucket"]
    some = index.of_buckets([number])
    plan = some.blocks._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {number})" in plan.split("PartitionFilters")[1]
    assert 0 < len(some.blocks.inputFiles()) and some.blocks.select("bucket").distinct().count() == 1
    assert rows_of(block_max.search(asked, some, 4)) == rows_of(block_max.search(asked, index, 4))


def test_empty_corpus_and_queries(spark, index, tmp_path):
    none = block_max.BlockIndex.write(spark.createDataFrame([], "pos bigint, text string"), str(tmp_path / "a"))
    asked = spark.createDataFrame([(1, "w3"), (2, None), (3, "zzzz")], "query_id int, text string")
    assert block_max.search(asked, none).collect() == [] and block_max.search(asked.limit(0), index).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "w3 w3")], "pos bigint, text string")
    some = block_max.BlockIndex.write(blank, str(tmp_path / "b"))
    assert [r.pos for r in block_max.search(asked, some).collect()] == [3]


def test_words_are_asked_for_unanswered_queries_only(spark):
    schema = "query_id int, pos bigint, score double, rank int"
    vector = spark.createDataFrame([(1, 5, 0.9, 1), (1, 99, 0.8, 2), (3, 98, 0.7, 1)], schema)
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, text string")
    known = spark.createDataFrame([(5,), (6,), (7,)], "pos bigint")
    asked = []

    def words(left):
        asked.extend(sorted(r.query_id for r in left.collect()))
        return spark.createDataFrame([(2, 7, 2.0, 1), (3, 6, 1.0, 1)], schema)

    rows = assemble.search_with_fallback(queries, vector, known, words).orderBy("query_id").collect()
    assert asked == [2, 3]
    assert [(r.query_id, r.pos, r.mode) for r in rows] == [(1, 5, "vector"), (2, 7, "bm25"), (3, 6, "bm25")]
