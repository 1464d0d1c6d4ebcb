"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import os

import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, plain
from lectern.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
KEYS = {"op1": "conversations", "op3": "documents", "op5": "documents", "op6": "pages", "op8": "documents", "op9": "documents", "op10": "documents", "op11": "embeddings", "op12": "documents"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    assert name in entry.queries()
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    if table := KEYS.get(name.split("_")[0]):  # one row for every row of its table
        assert len(got) == con.execute(f"select count(*) from {table}").fetchall()[0][0]
    if name in entry.oracle_sql():
        result = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)


def test_pipeline(spark):
    import public_tokenizers

    import corpus_pipeline as pipeline
    from lectern.llm import byte_bpe, decontamination, simhash_covering, toxicity
    from lectern.llm.common import fold, table

    docs = table(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r for r in pipeline.run(spark, FOLDER).collect()}
    # each decision once more, by itself
    model = toxicity.train(docs, table(spark, FOLDER, "labels"), fold("doc_id", 5) != 0)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {d: t for d, t in left.items() if model.score(model.sentences(t or "")) < 0.5}
    prints = {d: simhash_covering.fingerprint(t) for d, t in left.items()}
    seen, kept = set(), {}
    for d in sorted(left):
        if d not in seen:
            kept[d], todo = left[d], [d]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [y for y in left if y not in seen and bin(prints[x] ^ prints[y]).count("1") <= 3]
                seen.update(todo)
    items = [" ".join(decontamination.WORD.findall(r["text"].lower())) for r in table(spark, FOLDER, "benchmark").collect()]
    for d, t in list(kept.items()):
        words = " ".join(decontamination.WORD.findall((t or "").lower()))
        if any(f" {i} " in f" {words} " for i in items):
            del kept[d]
    assert set(rows) == set(kept)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN)
    from lectern.llm import secret_automaton

    scanner = secret_automaton.compile_rules()
    for d, t in kept.items():
        if not secret_automaton.scan(scanner, (t or "").encode()):
            ids = codec.ids(t or "")
            assert rows[d]["n_tokens"] == len(ids)
            assert rows[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert rows[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
