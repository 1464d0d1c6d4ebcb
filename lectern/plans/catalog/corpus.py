"""Registered queries of sources, sinks and corpus structuring (A, D) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import RAW_SPACE
from lectern.operators import passages, places, segment, vector_search
from lectern.plans.catalog import inputs
from lectern.plans.catalog.text import block_sql
from lectern.session import shared_folder
from lectern.sources import corpus, frames, vector_store
from lectern.sources import places as place_source
from lectern.sources.tables import read_table

c = F.col
MODEL = "test-64"


def _weighted_sum(q):
    """A sum that changes when any two elements are exchanged."""
    return F.aggregate(
        F.transform(q, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x
    )


def _passages_with_duplicates(spark, folder):
    """Keys that several documents share, so that the last has to win."""
    rows = inputs.passages(spark, folder).select(
        "pos", "book", "abbr", F.floor((c("chapter") - 1) / 4).alias("chapter"), (c("num") % 10).alias("num"), "text"
    )
    return passages.by_ref(passages.with_refs(rows)).select("ref", "pos", F.md5("text").alias("digest"))


def _whole_files(spark, folder):
    path = shared_folder(spark, "raw-text")
    inputs.documents(spark, folder).select("source", c("text").alias("value")).write.partitionBy("source").text(path)
    files = corpus.read_documents(spark, path)
    source = F.regexp_extract("doc_id", "source=([^/]+)/", 1)
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("value")).cast("bigint").alias("chars"))


def _store(spark, folder):
    """Float vectors with key, model and dimension."""
    return inputs.vectors(spark, folder).select(
        "pos", c("pos").cast("string").alias("ref"), "v", F.lit(MODEL).alias("model"), F.size("v").alias("dim"), "label"
    )


def _float_files(spark, folder):
    """Vectors written as documents of 256 each and read back."""
    path = shared_folder(spark, "float-vectors")
    items = F.sort_array(F.collect_list(F.struct("pos", "ref", "v")))
    documents = _store(spark, folder).groupBy(F.floor(c("pos") / 256).alias("block"), "model", "dim").agg(
        F.transform(items, lambda e: F.struct(e["ref"].alias("ref"), e["v"].alias("v"))).alias("verses")
    )
    documents.select(F.to_json(F.struct("model", "dim", "verses"))).write.text(path)
    rows = vector_store.read_float_vectors(spark, path, lines=True)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("ref", "pos", "model", "dim", F.round(total, 6).alias("total"))


def _quantized(spark, folder):
    return vector_search.quantize_store(_store(spark, folder))


def _packed(spark, folder):
    """Vectors packed into blobs of 256 and unpacked again."""
    q = _quantized(spark, folder)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", vector_store.pack(c("q")).alias("b")))), lambda e: e["b"])
    blobs = q.groupBy(F.floor(c("pos") / 256).alias("block"), "dim").agg(rows.alias("rows")).select(
        (c("block") * 256).alias("first"),
        F.unhex(F.array_join(F.transform("rows", lambda b: F.hex(b)), "")).alias("content"),
        "dim",
    )
    unpacked = vector_store.unpack(blobs).join(q.select("pos", "ref", "scale"), "pos")
    return unpacked.select("pos", "ref", F.round("scale", 6).alias("scale"), F.size("q").alias("dim"), _weighted_sum(c("q")).alias("checksum"))


def _preferred(spark, folder):
    """Half of the labels are stored quantized at double scale, all of them as floats."""
    store = _store(spark, folder)
    quantized = vector_search.quantize_store(store.filter("label < 5")).withColumn("scale", c("scale") * 2)
    best = vector_search.prefer_quantized(quantized.select("ref", "q", "scale"), store.select("ref", "v"))
    return best.select("ref", F.round("scale", 6).alias("scale"), _weighted_sum(c("q")).alias("checksum"))


def _qa_files(spark, folder):
    path = shared_folder(spark, "qa")
    rows = inputs.turns(spark, folder).select(
        c("conversation_id").cast("int").alias("id"), c("ord").alias("numero"),
        c("question").alias("pregunta"), c("response").alias("respuesta"),
    )
    corpus.write_qa(rows, path)
    both = corpus.read_qa(spark, path, lines=True).unionByName(corpus.read_qa(spark, path + "-absent"))
    return both.select("id", "numero", F.md5("pregunta").alias("question"), F.md5("respuesta").alias("answer"))


def _passage_files(spark, folder):
    path = shared_folder(spark, "passages")
    corpus.write_passages(inputs.passages(spark, folder), path)
    return corpus.read_written_passages(spark, path).select(
        "libro", "abbr", "capitulo", "versiculo", F.md5("texto").alias("digest")
    )


def _written_store(spark, folder):
    path = shared_folder(spark, "vectors")
    vector_store.write_vector_store(_quantized(spark, folder).drop("label"), path)
    rows = vector_store.read_vector_store(spark, path)
    meta = spark.read.parquet(f"{path}/meta")
    return rows.join(meta, ["model", "dim"]).select(
        "ref", "model", "dim", c("count"), F.round("scale", 6).alias("scale"), _weighted_sum(c("q")).alias("checksum")
    )


def _frame_texts(spark, folder):
    return read_table(spark, folder, "events").select(
        "event_id", frames.frame_text(c("event_type"), c("props")).alias("frame")
    )


def _parsed_frames(spark, folder):
    """Per event: a good frame, one with bad JSON, one without data, a nameless one, a torn one."""
    text = F.concat(
        F.lit("event: lost\n"), frames.frame_text(c("event_type"), c("props")),
        frames.frame_text(c("event_type"), F.concat(c("props"), c("event_type"))),
        F.lit("event: empty\n\n"), F.lit("data: 0\ndata:"), c("user_id").cast("string"), F.lit(" \n\n"),
        F.lit("event: torn\ndata: {"),
    )
    rows = read_table(spark, folder, "events").select(c("event_id").alias("stream_id"), text.alias("text"))
    return frames.parse_frames(rows)


def raw_places(spark, folder):
    """Search responses as JSON, one place per supplier, parts missing here and there."""
    key = c("s_suppkey")
    few = c("s_nationkey") < 12
    place = F.struct(
        c("s_name").alias("id"),
        F.struct(
            F.concat(F.when(c("s_nationkey") == 3, "Testigos ").when(c("s_nationkey") == 5, "IGLESIA EVANGÉLICA ").otherwise("Parroquia "), c("s_name")).alias("text")
        ).alias("displayName"),
        F.when(c("s_nationkey") != 7, F.concat(F.lit("Calle "), key.cast("string"))).alias("formattedAddress"),
        F.when(
            c("s_nationkey") != 9,
            F.struct((key * 37 % 1200 / 10 - 60).alias("latitude"), (key * 91 % 3600 / 10 - 180).alias("longitude")),
        ).alias("location"),
        F.when(few, F.lit("91 1")).alias("nationalPhoneNumber"),
        F.concat(F.lit("+34 "), key.cast("string")).alias("internationalPhoneNumber"),
        F.round(c("s_acctbal"), 2).alias("rating"),
        key.alias("userRatingCount"),
        F.struct(F.array(F.lit("lunes: 8"), F.lit("martes: cerrado")).alias("weekdayDescriptions")).alias("regularOpeningHours"),
        F.when(few, F.lit("")).alias("googleMapsUri"),
        F.transform(F.sequence(F.lit(1), c("s_nationkey") + 1), lambda i: F.struct(F.when(i > 1, F.concat(F.lit("places/p/photos/"), i.cast("string"))).otherwise(F.lit("")).alias("name"))).alias("photos"),
        F.when(few, F.struct(F.concat(F.lit("Junto a "), c("s_name")).alias("text"))).alias("editorialSummary"),
    )
    rows = read_table(spark, folder, "supplier")
    return rows.select(key.alias("request"), F.to_json(F.struct(F.array(place).alias("places"))).alias("body"))


def flat_places(spark, folder):
    return places.flatten(place_source.parse_places(raw_places(spark, folder)))


def _parsed_places(spark, folder):
    return place_source.parse_places(raw_places(spark, folder)).select(
        "request", c("place.id").alias("id"), c("place.displayName.text").alias("name"),
        c("place.location.latitude").alias("lat"), F.size("place.photos").alias("photos"),
        F.element_at("place.regularOpeningHours.weekdayDescriptions", 2).alias("second_line"),
    )


PLACES_SQL = """raw as (
  select s_suppkey as request, s_name as id, s_nationkey as n,
    case s_nationkey when 3 then 'Testigos ' when 5 then 'IGLESIA EVANGÉLICA ' else 'Parroquia ' end || s_name as name,
    case when s_nationkey <> 9 then (s_suppkey * 37) % 1200 / 10 - 60 end as lat,
    case when s_nationkey <> 9 then (s_suppkey * 91) % 3600 / 10 - 180 end as lng, s_acctbal
  from supplier)"""


# --- raw documents: every line of a text becomes a numbered passage --------------------------

def _numbered(spark, folder):
    """``(doc_id, body)``: the lines of each document, digits out, numbered 1, 2, 3, ..."""
    lines = F.filter(
        F.split(F.regexp_replace("text", r"\d", ""), "\n", -1), lambda x: x.rlike(f"[^{RAW_SPACE[1:-1]}]")
    )
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    return inputs.documents(spark, folder).select("doc_id", F.array_join(numbered, "\n").alias("body"))


RAW_FRAME = (
    "Índice\nGénesis 3, Rut 4\n GÉNESIS\n\nIntroducción\nGén1 ", "\n1: Éx 2,4-25; Sal 8\n", "Gén2*", "\nRUT\n",
    "Rut1 ", "\n1\nSAMUEL\n\n", "1 Sam7 ", "\n SALMOS\n\nSalmo 5 (6)* ", "\nABDÍAS\n\nIntroducción\n", "\n*1,1-2 Nota 9 x\n",
)


def raw_documents(spark, folder):
    """Documents shaped like the raw text of a corpus of books, each book holding all lines."""
    f, b = [F.lit(x) for x in RAW_FRAME], c("body")
    value = F.concat(f[0], b, f[1], f[2], F.lit("\n"), b, f[3], f[4], b, f[5], f[6], b, f[7], b, f[8], b, f[9])
    return _numbered(spark, folder).select("doc_id", value.alias("value"))


def _sections(spark, folder):
    return segment.sections(raw_documents(spark, folder)).select("doc_id", "ord", F.md5("chunk").alias("digest"))


def _chapters(*kinds):
    def query(spark, folder):
        dim = segment.book_dimension(spark)
        rows = segment.chapters(segment.sections(raw_documents(spark, folder)), dim.filter(c("kind").isin(*kinds)))
        return rows.select("doc_id", "abbr", "chapter", F.md5("chunk").alias("digest"))

    return query


def _split_passages(spark, folder):
    rows = _numbered(spark, folder).select(
        "doc_id", F.lit(0).alias("ord"), F.lit("Libro").alias("name"), F.lit("Lib").alias("abbr"),
        F.lit(1).alias("chapter"), F.concat(F.lit("** "), c("body")).alias("chunk"),
    )
    return segment.passages(rows).select("doc_id", "num", F.md5("text").alias("digest"))


def _structured(spark, folder):
    rows = segment.structure(raw_documents(spark, folder), segment.book_dimension(spark))
    return rows.select("doc_id", "book", "abbr", "chapter", "num", F.md5("text").alias("digest"))


def _coverage(spark, folder):
    rows = inputs.passages(spark, folder)
    dim = spark.range(25).select(
        c("id").cast("int").alias("ord"), F.concat(F.lit("Source "), c("id").cast("string")).alias("name"), F.lit(20).alias("chapters")
    )
    numbered = rows.withColumn("ord", F.regexp_extract("abbr", r"\d+", 0).cast("int"))
    return segment.coverage(dim, numbered.select("ord", "chapter"), numbered.select("ord"))


def raw_questions(spark, folder):
    """Documents whose line ends became headings, some of them too short to count."""
    text = F.replace(c("text"), F.lit("\n"), F.lit("\n7. ¿Qué sigue ahora mismo?\n"))
    value = F.concat(F.lit("Portada\n 3. ¿Corta?\n1. ¿Cómo empieza todo esto?\n"), text, F.lit("\n  4. ¿No?\nfin 12. ¿perdida"))
    return inputs.documents(spark, folder).select("doc_id", value.alias("value"))


def _questions_answers(spark, folder):
    rows = segment.questions_answers(raw_questions(spark, folder))
    return rows.select("doc_id", "id", "numero", "pregunta", F.md5("respuesta").alias("digest"))


QUERIES = {
    "a01_passages_last_wins": _passages_with_duplicates,
    "a02_whole_text_files": _whole_files,
    "a03_float_vector_files": _float_files,
    "a04_packed_vectors": _packed,
    "a05_prefer_quantized": _preferred,
    "a06_qa_files": _qa_files,
    "a07_passage_files": _passage_files,
    "a08_vector_store": _written_store,
    "a09_frame_text": _frame_texts,
    "a10_parse_frames": _parsed_frames,
    "a11_parse_places": _parsed_places,
    "d01_sections": _sections,
    "d02_standard_chapters": _chapters("standard"),
    "d03_hymn_chapters": _chapters("salmos"),
    "d04_single_chapter": _chapters("single"),
    "d05_split_passages": _split_passages,
    "d06_coverage": _coverage,
    "d07_structure": _structured,
    "d08_questions_answers": _questions_answers,
    "d09_length_profile": lambda s, d: segment.length_profile(inputs.documents(s, d), "text"),
}

QUANTIZED = """scaled as (
  select vec_id as pos, label, embedding as v,
    list_max(list_transform(embedding, lambda x: abs(x::double))) as scale from embeddings),
quantized as (
  select pos, label, v, scale, case when scale = 0 then list_transform(v, lambda x: 0::bigint) else
    list_transform(v, lambda x: greatest(-127, least(127, floor(x::double / scale * 127 + 0.5)))::bigint) end as q from scaled)"""
CHECKSUM = "cast(list_sum(list_transform(q, lambda x, i: x * i)) as bigint) as checksum"

_L = """n as (
  select doc_id, list_filter(string_split(regexp_replace(text, '\\d', '', 'g'), chr(10)), lambda x: trim(x) <> '') as l from documents),
body as (
  select doc_id, l, array_to_string(list_transform(l, lambda x, i: i || ' ' || x), chr(10)) as b from n)"""
_V = """v as (
  select doc_id, unnest(generate_series(1, len(l))) as num, unnest(l) as line from body),
clean as (
  select doc_id, num, trim(regexp_replace(regexp_replace(line, '\\*+', '', 'g'), '\\s+', ' ', 'g')) as text from v)"""


def _chunks(rows):
    """SQL rows ``(doc_id, key, text)`` of literal pieces, b standing for the body."""
    parts = []
    for key, pieces in rows:
        text = " || ".join("b" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in pieces)
        parts.append(f"select doc_id, {key}, md5({text}) as digest from body")
    return f"with {_L} " + " union all ".join(parts)


_F = RAW_FRAME

SQL = {
    "a01_passages_last_wins": f"""with {inputs.PASSAGES}, k as (select pos, abbr || ' ' || (chapter - 1) // 4 || ':' || num % 10 as ref, text from passages)
  select ref, max(pos) as pos, md5(arg_max(text, pos)) as digest from k group by ref""",
    "a02_whole_text_files": "select source, cast(sum(length(text) + 1) as bigint) as chars from documents group by source",
    "a03_float_vector_files": f"""select cast(vec_id as varchar) as ref, vec_id % 256 as pos, '{MODEL}' as model, cast(len(embedding) as int) as dim,
  round(list_reduce(list_transform(embedding, lambda x: x::double), lambda a, b: a + b), 6) as total from embeddings""",
    "a04_packed_vectors": f"with {QUANTIZED} select pos, cast(pos as varchar) as ref, round(scale, 6) as scale, cast(len(q) as int) as dim, {CHECKSUM} from quantized",
    "a05_prefer_quantized": f"with {QUANTIZED} select cast(pos as varchar) as ref, round(case when label < 5 then 2 * scale else scale end, 6) as scale, {CHECKSUM} from quantized",
    "a06_qa_files": f"with {inputs.TURNS} select cast(conversation_id as int) as id, ord as numero, md5(question) as question, md5(response) as answer from turns",
    "a07_passage_files": f"with {inputs.PASSAGES} select book as libro, abbr, cast(chapter as int) as capitulo, cast(num as int) as versiculo, md5(text) as digest from passages",
    "a08_vector_store": f"""with {QUANTIZED} select cast(pos as varchar) as ref, '{MODEL}' as model, cast(len(q) as int) as dim,
  (select count(*) from embeddings) as count, round(scale, 6) as scale, {CHECKSUM} from quantized""",
    "a09_frame_text": "select event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) as frame from events",
    "a10_parse_frames": """select event_id as stream_id, 0::bigint as seq, event_type as event, props as data from events
  union all select event_id, 3, 'message', cast(user_id as varchar) from events""",
    "a11_parse_places": f"""with {PLACES_SQL} select request, id, name, lat, cast(n + 1 as int) as photos, 'martes: cerrado' as second_line from raw""",
    "d01_sections": _chunks(
        [
            ("0 as ord", ["\n\nIntroducción\nGén1 ", None, _F[1] + _F[2] + "\n", None, "\n"]),
            ("7", ["\n" + _F[4], None, "\n"]),
            ("8", ["\n\n" + _F[6], None, "\n "]),
            ("22", ["\n\nSalmo 5 (6)* ", None, "\n"]),
            ("37", ["\n\nIntroducción\n", None, _F[9]]),
        ]
    ),
    "d02_standard_chapters": _chunks(
        [
            ("'Gén' as abbr, 1 as chapter", [None, "\n"]),
            ("'Gén', 2", [None, "\n"]),
            ("'Rut', 1", [None, "\n"]),
            ("'1 Sam', 7", [None, "\n "]),
        ]
    ),
    "d03_hymn_chapters": _chunks([("'Sal' as abbr, 5 as chapter", [" ", None, "\n"])]),
    "d04_single_chapter": _chunks([("'Abd' as abbr, 1 as chapter", [None])]),
    "d05_split_passages": f"with {_L}, {_V} select doc_id, num::int as num, md5(text) as digest from clean where text <> ''",
    "d06_coverage": f"""with {inputs.PASSAGES}, f as (select abbr, count(distinct chapter) as found, count(*) as passages from passages group by abbr),
  b as (select 'Source ' || i as name, coalesce(found, 0) as found, 20::bigint as expected, coalesce(passages, 0) as passages, found is null as missing
    from (select unnest(generate_series(0, 24)) as i) left join f on abbr = 'src' || i)
  select 'book' as level, name, found, expected, passages, cast(missing as bigint) as missing, cast(found >= expected as bigint) as complete from b
  union all select 'total', null, sum(found)::bigint, sum(expected)::bigint, sum(passages)::bigint, sum(missing::int)::bigint, sum((found >= expected)::int)::bigint from b""",
    "d07_structure": f"""with {_L}, {_V}, k(book, abbr, chapter) as (values ('Génesis', 'Gén', 1), ('Génesis', 'Gén', 2), ('Rut', 'Rut', 1),
    ('1 Samuel', '1 Sam', 7), ('Salmos', 'Sal', 5), ('Abdías', 'Abd', 1))
  select doc_id, book, abbr, chapter, num::int as num, md5(text) as digest from clean, k where text <> ''""",
    "d08_questions_answers": f"""with lines as (select doc_id, string_split(text, chr(10)) as l from documents),
  v as (select doc_id, unnest(generate_series(1, len(l))) - 1 as id, unnest(l) as line from lines),
  body as (select doc_id, id, {block_sql('line')} as t from v),
  capped as (select doc_id, id, case when length(t) > 2500 then regexp_replace(substr(t, 1, 2500), ' [^ ]*$', '') || '…' else t end as t from body)
  select doc_id, cast(id as int) as id, case when id = 0 then 1 else 7 end as numero,
    case when id = 0 then '¿Cómo empieza todo esto?' else '¿Qué sigue ahora mismo?' end as pregunta, md5(t) as digest
  from capped where length(t) >= 30""",
    "d09_length_profile": """with s as (select length(text) as size, row_number() over (order by length(text)) - 1 as i, count(*) over () as n from documents)
  select max(n) as n, cast(max(case when i = n // 2 then size end) as int) as median, cast(max(size) as int) as longest from s""",
}
