"""Registered queries of retrieval and assembly (E, F, G) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import vectors as vx
from lectern.operators import assemble, block_max, embedding, lexical, vector_search
from lectern.plans.catalog import inputs
from lectern.plans.catalog.corpus import CHECKSUM, QUANTIZED, _weighted_sum
from lectern.plans.catalog.text import tokens_sql
from lectern.session import shared_folder, written
from lectern.sources.tables import read_table

c = F.col


def _index(spark, folder):
    """The index of all documents, written and read again."""
    return block_max.BlockIndex.write(inputs.corpus(spark, folder), shared_folder(spark, "index"))


def lexical_hits(spark, folder, k=fixed.DEFAULT_K):
    return block_max.search(inputs.questions(spark, folder), _index(spark, folder), k)


def flagship(spark, folder):
    """BM25 top passages of every question, with key and text."""
    hits = lexical_hits(spark, folder)
    return hits.join(inputs.passages(spark, folder), "pos").select(
        "query_id", "rank", "score", "ref", "book", "chapter", "num", "text"
    )


def _scored_pairs(spark, folder):
    """Each user message as a query against the answer that follows it, among all answers."""
    rows = read_table(spark, folder, "conversations")
    at = c("conv_id") * 1000 + c("turn")
    answers = rows.filter("role = 'assistant'").select(at.alias("pos"), "text")
    pairs = rows.filter("role = 'user'").select(at.alias("query_id"), (at + 1).alias("pos"), "text").join(
        answers.select("pos"), "pos", "left_semi"
    )
    return lexical.score_pairs(pairs, lexical.LexicalIndex.build(answers))


# --- vectors -----------------------------------------------------------------------------------

def _quantized_rows(spark, folder):
    rows = vector_search.quantize_store(inputs.vectors(spark, folder))
    return rows.select("pos", F.round("scale", 6).alias("scale"), _weighted_sum(c("q")).alias("checksum"))


def _dequantized(spark, folder):
    rows = vector_search.quantize_store(inputs.vectors(spark, folder).withColumn("f", c("v")))
    back = vx.dequantize(c("q"), c("scale"))
    error = F.array_max(F.zip_with("f", back, lambda a, b: F.abs(a.cast("double") - b)))
    return rows.select("pos", F.round(F.element_at(back, 1), 6).alias("first"), F.round(error, 6).alias("worst"))


def _neighbours(spark, folder):
    rows = inputs.vectors(spark, folder)
    return rows.join(rows.select((c("pos") - 1).alias("pos"), c("v").alias("w")), "pos")


def _cosines(spark, folder):
    zero = F.transform("w", lambda x: F.lit(0.0))
    return _neighbours(spark, folder).select(
        "pos", F.round(vx.cosine(c("v"), c("w")), 6).alias("score"), F.round(vx.cosine(c("v"), zero), 6).alias("with_zero")
    )


def _quantized_cosines(spark, folder):
    rows = vector_search.quantize_store(_neighbours(spark, folder), "w")
    return rows.select(
        "pos",
        F.round(vx.cosine_quantized(c("v"), c("q"), c("scale")), 6).alias("score"),
        F.round(vx.cosine_quantized(c("v"), c("q"), F.lit(0.0)), 6).alias("with_zero"),
    )


def _vector_queries(spark, folder):
    return vector_search.mean_vectors(inputs.vectors(spark, folder), "label").withColumnRenamed("label", "query_id")


def _quantized_store(spark, folder):
    rows = inputs.vectors(spark, folder).withColumn("ref", c("pos").cast("string")).drop("label")
    return vector_search.quantize_store(rows)


def _vector_search(spark, folder):
    known = inputs.passages(spark, folder).filter("lang <> 'fr'").select(c("pos").cast("string").alias("ref"), c("ref").alias("key"))
    return vector_search.search(_vector_queries(spark, folder), _quantized_store(spark, folder), known).select(
        "query_id", "rank", "key", "score"
    )


def qa_pairs(spark, folder):
    """First question and answer of each conversation."""
    return inputs.live_turns(spark, folder).filter("ord = 0 and status = 'done'").select(
        c("conversation_id").alias("id"), "question", c("response").alias("answer")
    )


def qa_hits(spark, folder, queries):
    return vector_search.search(queries, _quantized_store(spark, folder), qa_pairs(spark, folder), fixed.DEFAULT_QA_K, key="id")


def _qa_search(spark, folder):
    return qa_hits(spark, folder, _vector_queries(spark, folder)).select(
        "query_id", "rank", c("ref").alias("id"), "score", F.md5("answer").alias("answer")
    )


def _every_twentieth(spark, folder):
    """Every vector whose number is divisible by 20 asks the whole store."""
    return inputs.vectors(spark, folder).filter("pos % 20 = 0").select(c("pos").alias("query_id"), "v")


def _vector_search_all(spark, folder):
    known = inputs.passages(spark, folder).select(c("pos").cast("string").alias("ref"), c("ref").alias("key"))
    return vector_search.search(_every_twentieth(spark, folder), _quantized_store(spark, folder), known).select(
        "query_id", "rank", "key", "score"
    )


def _qa_search_all(spark, folder):
    return qa_hits(spark, folder, _every_twentieth(spark, folder)).select(
        "query_id", "rank", c("ref").alias("id"), "score", F.md5("answer").alias("answer")
    )


def _relevant(spark, folder):
    """Every vector asks for the two nearest of the means of four vectors; near ones are kept."""
    rows = inputs.vectors(spark, folder)
    fours = rows.withColumn("pos", F.floor(c("pos") / 4))
    means = vector_search.mean_vectors(fours, "pos")
    asking = rows.select(c("pos").alias("query_id"), "v")
    hits = vector_search.nearest_pruned(asking, means, fixed.DEFAULT_QA_K)
    return vector_search.relevant(hits).select("query_id", "pos", "rank", "score")


def _hashed(spark, folder):
    rows = inputs.corpus(spark, folder).select(c("pos").alias("ref"), "text")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return embedding.embed_hashed(rows).select("ref", "dim", total.cast("bigint").alias("total"))


def _unembedded(spark, folder):
    """Vectors were made by two models; passages are missing that the wanted one has not seen."""
    stored = inputs.vectors(spark, folder).select(
        c("pos").alias("ref"), F.when(c("label") < 5, "new").otherwise("old").alias("model")
    )
    rows = inputs.corpus(spark, folder).withColumnRenamed("pos", "ref")
    return vector_search.unembedded(rows, stored, "new").select("ref", F.length("text").alias("chars"))


def _throughput(spark, folder):
    log = read_table(spark, folder, "events").select(
        F.lit(fixed.EMBED_BATCH).alias("batch_rows"), (c("value") + 1).alias("batch_seconds")
    )
    total = read_table(spark, folder, "lineitem").agg(F.count("*").alias("n")).scalar()
    return embedding.throughput(log, total).select(
        "done", *[F.round(x, 4).alias(x) for x in ("seconds", "rows_per_second", "remaining_seconds")]
    )


# --- assembly ----------------------------------------------------------------------------------

def question_vectors(spark, folder):
    """Vectors of questions by number; questions of low labels have none."""
    rows = inputs.vectors(spark, folder).filter("label > 4").select(c("pos").alias("query_id"), "v")
    return rows.join(inputs.questions(spark, folder).select("query_id"), "query_id", "left_semi")


def _vector_hits(spark, folder):
    return vector_search.nearest_pruned(question_vectors(spark, folder), _quantized_store(spark, folder), fixed.DEFAULT_K)


def fallback_hits(spark, folder):
    index = _index(spark, folder)
    return assemble.search_with_fallback(
        inputs.questions(spark, folder),
        _vector_hits(spark, folder),
        inputs.passages(spark, folder),
        lambda left: block_max.search(left, index),
    )


def _long_messages(spark, folder):
    """Messages of eight conversations as one, longer than a history."""
    return inputs.messages(spark, folder).withColumns(
        {"turn": c("conv_id") % 8 * 1000 + c("turn"), "conv_id": F.floor(c("conv_id") / 8)}
    )


def _expanded(spark, folder):
    rows = _long_messages(spark, folder)
    first = rows.groupBy("conv_id").agg(F.min_by("content", "turn").alias("question"))
    return assemble.expanded_queries(first, rows).select("conv_id", F.md5("query").alias("digest"))


def _turn_messages(spark, folder):
    conversation = c("conversation_id").cast("bigint")
    turns = inputs.live_turns(spark, folder).withColumns(
        {"ord": conversation % 8 * 1000 + c("ord"), "conversation_id": F.floor(conversation / 8).cast("string")}
    )
    rows = assemble.turns_to_messages(turns)
    return rows.select("conv_id", "turn", "role", F.md5("content").alias("digest"))


def _passage_blocks(spark, folder):
    # a few rows a question: once they are written their size is known, and the texts of all passages stay where they are
    hits = written(fallback_hits(spark, folder), "hits").join(inputs.passages(spark, folder), "pos")
    return assemble.passage_context(hits)


def _qa_blocks(spark, folder):
    return assemble.qa_context(qa_hits(spark, folder, question_vectors(spark, folder)))


def _request_rows(spark, folder):
    asked = inputs.questions(spark, folder).withColumnRenamed("text", "question")
    history = assemble.history_window(inputs.messages(spark, folder)).withColumnRenamed("conv_id", "query_id")
    rows = assemble.request_rows(asked, history, _passage_blocks(spark, folder), _qa_blocks(spark, folder))
    return rows.select("query_id", "seq", "role", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest"))


def _digest(query, key, value):
    return lambda s, d: query(s, d).select(key, F.md5(value).alias("digest"))


QUERIES = {
    "e01_postings": lambda s, d: lexical.postings(inputs.corpus(s, d)),
    "e01_document_lengths": lambda s, d: lexical.document_lengths(inputs.corpus(s, d)),
    "e02_document_frequencies": lambda s, d: lexical.document_frequencies(inputs.corpus(s, d)),
    "e02_corpus_statistics": lambda s, d: lexical.corpus_statistics(inputs.corpus(s, d)).select("n", F.round("avg_len", 6).alias("avg_len")),
    "e03_bm25_pairs": _scored_pairs,
    "e04_bm25_top_k": lexical_hits,
    "f01_quantize": _quantized_rows,
    "f02_dequantize": _dequantized,
    "f03_cosine": _cosines,
    "f04_cosine_quantized": _quantized_cosines,
    "f05_vector_top_k": _vector_search,
    "f06_qa_top_k": _qa_search,
    "f05_vector_top_k_of_store": _vector_search_all,
    "f06_qa_top_k_of_store": _qa_search_all,
    "f07_relevant_only": _relevant,
    "f08_hashed_embedding": _hashed,
    "f09_unembedded": _unembedded,
    "f10_size_report": lambda s, d: vector_search.size_report(inputs.vectors(s, d)),
    "f11_throughput": _throughput,
    "g01_search_with_fallback": fallback_hits,
    "g02_history_window": lambda s, d: assemble.history_window(_long_messages(s, d)).select("conv_id", "turn", "role", F.md5("content").alias("digest")),
    "g03_expanded_query": _expanded,
    "g04_turns_to_messages": _turn_messages,
    "g05_passage_context": _digest(_passage_blocks, "query_id", "block"),
    "g06_qa_context": _digest(_qa_blocks, "query_id", "block"),
    "g07_request_rows": _request_rows,
    "g08_unanswered": lambda s, d: assemble.unanswered(inputs.questions(s, d), _vector_hits(s, d)),
}

# the BM25 formula once more, over a corpus (pos, text) and queries (query_id, text)
_SCORE = """ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (len / avg_len))))"""


def bm25_sql(corpus: str, queries: str) -> str:
    return f"""toks as (select pos, {tokens_sql('text')} as t from ({corpus})),
  post as (select pos, term, count(*) as tf, any_value(len) as len from
    (select pos, len(t) as len, unnest(t) as term from toks) group by pos, term),
  freq as (select term, count(*) as df from post group by term),
  stat as (select count(*) as n, avg(len(t)) as avg_len from toks),
  qtoks as (select query_id, term, count(*) as qtf from
    (select query_id, unnest({tokens_sql('text')}) as term from ({queries})) group by query_id, term),
  scored as (select query_id, pos, sum(qtf * {_SCORE}) as exact, round(exact, 6) as score
    from qtoks join freq using (term) join post using (term), stat group by query_id, pos)"""


_CORPUS = "select doc_id as pos, text from documents"
_QUESTIONS = "select item_id as query_id, text from benchmark"
_LEXICAL = bm25_sql(_CORPUS, _QUESTIONS) + """,
  lexical as (select * from (select query_id, pos, score, row_number() over (partition by query_id order by round(exact, 10) desc, pos) as rank
    from scored where exact > 0) where rank <= 8)"""
_DOT = "list_sum(list_transform(list_zip(%s, %s), lambda p: p[1]::double * p[2]::double))"
_MEANS = """means as (select label, list(x order by i) as v from
  (select label, i, avg(x::double) as x from (select label, unnest(generate_series(1, len(embedding))) as i, unnest(embedding) as x from embeddings)
   group by label, i) group by label)"""


def _cos(a: str, b: str) -> str:
    return f"{_DOT % (a, b)} / (case when {_DOT % (a, a)} * {_DOT % (b, b)} = 0 then 1 else sqrt({_DOT % (a, a)}) * sqrt({_DOT % (b, b)}) end)"


def _nearest(asked: str, k: int, name: str = "hits", store: str = "quantized", column: str = "q") -> str:
    return f"""{name} as (select * from (select query_id, pos, score, row_number() over (partition by query_id order by round(exact, 10) desc, pos) as rank from
    (select a.query_id, s.pos, {_cos('a.v', 's.' + column)} as exact, round(exact, 6) as score from {asked} a, {store} s)) where rank <= {k})"""


_ASKED_MEANS = "asked as (select label as query_id, v from means)"
_ASKED_TWENTIETH = "asked as (select vec_id as query_id, embedding as v from embeddings where vec_id % 20 = 0)"
_ASKED_QUESTIONS = "asked as (select vec_id as query_id, embedding as v from embeddings join benchmark on item_id = vec_id where label > 4)"
_FALLBACK = f"""{QUANTIZED}, {_ASKED_QUESTIONS}, {_nearest('asked', 8)}, {_LEXICAL},
  found as (select query_id, pos, score, rank from hits where pos in (select doc_id from documents)),
  fallback as (select query_id, pos, score, rank, 'vector' as mode from found union all
    select query_id, pos, score, rank, 'bm25' from lexical where query_id not in (select query_id from found))"""
_QA = """qa as (select conversation_id as id, question, response as answer from live where ord = 0 and status = 'done')"""
_BLOCKS = """blocks as (select query_id, string_agg('[' || book || ' ' || chapter || ':' || num || '] ' || text, chr(10) || chr(10) order by rank) as block
    from fallback join passages using (pos) group by query_id)"""
_QA_BLOCKS = f"""{_nearest('asked', 2, 'near')},
  kept as (select query_id, question, answer, row_number() over (partition by query_id order by rank) as i from near join qa on id = cast(pos as varchar)),
  qablocks as (select query_id, string_agg('[' || i || '] ' || question || chr(10) || answer, chr(10) || chr(10) order by i) as block from kept group by query_id)"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_LONG_MESSAGES = inputs.MESSAGES.replace("select conv_id, turn,", "select conv_id // 8 as conv_id, conv_id % 8 * 1000 + turn as turn,")
_RECENT = """recent as (select * from (select *, row_number() over (partition by conv_id order by turn desc) as n from messages) where n <= %d)"""
ESCAPED = "replace(replace(replace(%s, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"

SQL = {
    "e01_postings": f"with {bm25_sql(_CORPUS, _QUESTIONS)} select pos, term, tf, cast(len as int) as len from post",
    "e01_document_lengths": f"with {bm25_sql(_CORPUS, _QUESTIONS)} select pos, cast(len(t) as int) as len from toks",
    "e02_document_frequencies": f"with {bm25_sql(_CORPUS, _QUESTIONS)} select term, df from freq",
    "e02_corpus_statistics": f"with {bm25_sql(_CORPUS, _QUESTIONS)} select n, round(avg_len, 6) as avg_len from stat",
    "e03_bm25_pairs": f"""with {bm25_sql("select conv_id * 1000 + turn as pos, text from conversations where role = 'assistant'",
        "select conv_id * 1000 + turn as query_id, text from conversations where role = 'user'")}
  select q.query_id, q.query_id + 1 as pos, coalesce(s.score, 0) as score from
    (select conv_id * 1000 + turn as query_id from conversations where role = 'user') q
    join toks on toks.pos = q.query_id + 1 left join scored s on s.query_id = q.query_id and s.pos = q.query_id + 1""",
    "e04_bm25_top_k": f"with {_LEXICAL} select query_id, pos, score, cast(rank as int) as rank from lexical",
    "f01_quantize": f"with {QUANTIZED} select pos, round(scale, 6) as scale, {CHECKSUM} from quantized",
    "f02_dequantize": f"""with {QUANTIZED} select pos, round(q[1] * scale / 127, 6) as first,
  round(list_max(list_transform(list_zip(v, q), lambda p: abs(p[1]::double - p[2] * scale / 127))), 6) as worst from quantized""",
    "f03_cosine": f"""select a.vec_id as pos, round({_cos('a.embedding', 'b.embedding')}, 6) as score, 0.0::double as with_zero
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "f04_cosine_quantized": f"""with {QUANTIZED} select a.pos, round({_cos('a.v', 'b.q')}, 6) as score, 0.0::double as with_zero
  from quantized a join quantized b on b.pos = a.pos + 1""",
    "f05_vector_top_k": f"""with {inputs.PASSAGES}, {QUANTIZED}, {_MEANS}, {_ASKED_MEANS}, {_nearest('asked', 8)}
  select query_id, cast(rank as int) as rank, ref as key, score from hits join passages using (pos) where lang <> 'fr'""",
    "f06_qa_top_k": f"""with {inputs.LIVE_TURNS}, {_QA}, {QUANTIZED}, {_MEANS}, {_ASKED_MEANS}, {_nearest('asked', 2)}
  select query_id, cast(rank as int) as rank, id, score, md5(answer) as answer from hits join qa on id = cast(pos as varchar)""",
    "f05_vector_top_k_of_store": f"""with {inputs.PASSAGES}, {QUANTIZED}, {_ASKED_TWENTIETH}, {_nearest('asked', 8)}
  select query_id, cast(rank as int) as rank, ref as key, score from hits join passages using (pos)""",
    "f06_qa_top_k_of_store": f"""with {inputs.LIVE_TURNS}, {_QA}, {QUANTIZED}, {_ASKED_TWENTIETH}, {_nearest('asked', 2)}
  select query_id, cast(rank as int) as rank, id, score, md5(answer) as answer from hits join qa on id = cast(pos as varchar)""",
    "f07_relevant_only": f"""with {_MEANS.replace('select label, unnest', 'select vec_id // 4 as label, unnest')}, store as (select label as pos, v from means), asked as (select vec_id as query_id, embedding as v from embeddings),
  {_nearest('asked', 2, 'hits', 'store', 'v')} select query_id, cast(pos as bigint) as pos, cast(rank as int) as rank, score from hits where score >= 0.5""",
    "f08_hashed_embedding": f"select doc_id as ref, 64 as dim, cast(len({tokens_sql('text')}) as bigint) as total from documents",
    "f09_unembedded": """select doc_id as ref, cast(length(text) as int) as chars from documents
  where doc_id not in (select vec_id from embeddings where label < 5)""",
    "f10_size_report": """select cast(sum(len(embedding) * 4) as bigint) as float_bytes, cast(sum(len(embedding) + 8) as bigint) as int8_bytes,
  round(sum(len(embedding) * 4) / sum(len(embedding) + 8), 4) as ratio from embeddings""",
    "f11_throughput": """with l as (select count(*) as done, sum((value + 1) / 128) as seconds from events)
  select done, round(seconds, 4) as seconds, round(done / seconds, 4) as rows_per_second,
    round(((select count(*) from lineitem) - done) / (done / seconds), 4) as remaining_seconds from l""",
    "g01_search_with_fallback": f"with {_FALLBACK} select query_id, pos, score, cast(rank as int) as rank, mode from fallback",
    "g02_history_window": f"with {_LONG_MESSAGES}, {_RECENT % 10} select conv_id, turn, role, md5(content) as digest from recent",
    "g03_expanded_query": f"""with {_LONG_MESSAGES}, {_RECENT % 10}, last2 as (select * from
    (select *, row_number() over (partition by conv_id order by turn desc) as m from recent where role = 'user') where m <= 2),
  joined as (select conv_id, string_agg(content, ' ' order by turn) as r from last2 group by conv_id)
  select f.conv_id, md5(case when r is null then q else r || ' ' || q end) as digest from
    (select conv_id, arg_min(content, turn) as q from messages group by conv_id) f left join joined using (conv_id)""",
    "g04_turns_to_messages": f"""with {inputs.LIVE_TURNS}, k as (select * from
    (select *, row_number() over (partition by conversation_id order by ord desc) as n from (select * replace
      (cast(cast(conversation_id as bigint) // 8 as varchar) as conversation_id, cast(conversation_id as bigint) % 8 * 1000 + ord as ord)
      from live) where status = 'done' and response <> '') where n <= 10)
  select conversation_id as conv_id, ord * 2 as turn, 'user' as role, md5(question) as digest from k
  union all select conversation_id, ord * 2 + 1, 'assistant', md5('{{"verse":' || case when verse_reference is null then 'null' else
    '{{"reference":"' || verse_reference || '","text":"' || {ESCAPED % 'verse_text'} || '"}}' end || ',"response":"' || {ESCAPED % 'response'} || '"}}') from k""",
    "g05_passage_context": f"with {inputs.PASSAGES}, {_FALLBACK}, {_BLOCKS} select query_id, md5(block) as digest from blocks",
    "g06_qa_context": f"with {inputs.LIVE_TURNS}, {_QA}, {QUANTIZED}, {_ASKED_QUESTIONS}, {_QA_BLOCKS} select query_id, md5(block) as digest from qablocks",
    "g07_request_rows": f"""with {inputs.LIVE_TURNS}, {_QA}, {_FALLBACK}, {_BLOCKS}, {_QA_BLOCKS}, {_RECENT % 10},
  past as (select conv_id as query_id, row_number() over (partition by conv_id order by turn) as seq, role, content from recent
    where conv_id in (select query_id from blocks)),
  lengths as (select query_id, count(*) as n from past group by query_id)
  select query_id, cast(seq as int) as seq, role, 1 as n, md5(content) as digest from past union all
  select q.item_id, cast(coalesce(l.n, 0) + 1 as int), 'user', case when a.block is null then 2 else 3 end,
    md5({_text(fixed.PASSAGES_PART)} || b.block || '|' || coalesce({_text(fixed.QA_PART)} || a.block || '|', '') || {_text(fixed.QUESTION_PART)} || q.text)
  from benchmark q join blocks b on b.query_id = q.item_id left join qablocks a on a.query_id = q.item_id left join lengths l on l.query_id = q.item_id""",
    "g08_unanswered": f"""select item_id as query_id, cast(null as varchar) as reference, cast(null as varchar) as text, {_text(fixed.NOTHING_FOUND)} as response
  from benchmark where item_id not in (select vec_id from embeddings where label > 4)""",
}
