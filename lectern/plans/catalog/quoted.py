"""Registered queries of quote validation and streamed answers (H, I) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.answers import final_fields, partial_fields
from lectern.functions.text import ref_key
from lectern.operators import answers, passages, quotes
from lectern.plans.catalog import inputs
from lectern.plans.catalog.text import compare_sql

c = F.col
PIECE = 32


def quoted(spark, folder):
    """One quotation per document, in seven forms of reference and text."""
    rows = inputs.passages(spark, folder)
    form = c("pos") % 7
    at = F.concat(c("chapter").cast("string"), F.lit(":"), c("num").cast("string"))
    comma = F.concat(c("chapter").cast("string"), F.lit(" , "), c("num").cast("string"))
    reference = (
        F.when(form == 0, F.concat(F.lit(" "), c("book"), F.lit(" "), at, F.lit("\n")))
        .when(form == 1, F.concat(F.lower("book"), F.lit("  "), comma))
        .when(form == 2, F.concat(c("abbr"), F.lit(" "), at))
        .when(form == 3, F.concat(F.upper("abbr"), F.lit(" "), at))
        .when(form == 4, F.concat(F.lit("Nadie "), at))
        .when(form == 5, F.concat(c("abbr"), F.lit(" "), at, F.lit("-9")))
        .otherwise(F.concat(c("book"), F.lit(" 99"), at))
    )
    text = (
        F.when((form == 1) & (c("lang") != "de"), F.upper("text"))
        .when(form == 2, F.concat(F.lit("«"), F.substring("text", 5, 40), F.lit("»")))
        .when((form == 0) & (c("lang") == "fr"), F.concat(F.lit("otra cosa "), c("lang")))
        .when((form == 0) & (c("lang") == "de"), F.lit(" (¡!) "))
        .otherwise(c("text"))
    )
    return rows.select(c("pos").alias("quote_id"), reference.alias("reference"), text.alias("text"))


def _parsed(spark, folder):
    return quoted(spark, folder).select("quote_id", quotes.parse_reference(c("reference")).alias("p")).select("quote_id", "p.*")


def _resolved(spark, folder):
    rows = quoted(spark, folder).withColumn("parsed", quotes.parse_reference(c("reference")))
    return quotes.resolve_books(rows, inputs.passages(spark, folder))


def _found(spark, folder):
    rows = _resolved(spark, folder).select("quote_id", ref_key(c("abbr"), c("parsed.chapter"), c("parsed.num")).alias("ref"))
    hits = passages.lookup(rows, passages.by_ref(inputs.passages(spark, folder).select("ref", "pos", "lang")), ["pos", "lang"])
    return hits.select("quote_id", "ref", "pos", "lang")


def _agreement(spark, folder):
    """Each quotation against the passage it was taken from."""
    stored = inputs.passages(spark, folder).select(c("pos").alias("quote_id"), c("text").alias("stored"))
    return quoted(spark, folder).join(stored, "quote_id").select("quote_id", quotes.texts_agree(c("text"), c("stored")).alias("agrees"))


def _validated(spark, folder):
    rows = quotes.validate(quoted(spark, folder), inputs.passages(spark, folder))
    return rows.select("quote_id", "ok", "found_reference", F.md5("found_text").alias("digest"), "reason")


def _applied(spark, folder):
    """Quotations as answers; those whose text is a copy of nothing have no passage."""
    rows = quoted(spark, folder).select(
        c("quote_id").alias("answer_id"),
        F.when(~c("text").startswith("otra"), c("reference")).alias("reference"),
        F.when(~c("text").startswith("otra"), c("text")).alias("text"),
        F.concat(F.lit("Respuesta "), c("quote_id").cast("string")).alias("response"),
    )
    done = quotes.apply_to_answers(rows, inputs.passages(spark, folder))
    return done.select("answer_id", "reference", F.md5("text").alias("digest"), "response", "warning")


def _escape(x):
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def raw_answers(spark, folder):
    """``(answer_id, raw)``: finished turns as the JSON text a model would send."""
    verse = F.concat(
        F.lit('{"reference": "'), _escape(c("verse_reference")), F.lit('", "text": "'), _escape(c("verse_text")), F.lit('"}')
    )
    raw = F.concat(
        F.lit('{"verse": '), F.coalesce(verse, F.lit("null")), F.lit(', "response": "'), _escape(c("response")), F.lit('"}')
    )
    return inputs.turns(spark, folder).select(c("id").alias("answer_id"), raw.alias("raw"))


def deltas(spark, folder, size=None):
    """The raw answers in pieces of 32 characters, or of the size an expression gives."""
    size = F.lit(PIECE) if size is None else size
    cut = F.regexp_extract_all("raw", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), 0)
    rows = raw_answers(spark, folder).select("answer_id", F.posexplode(cut).alias("seq", "text"))
    return rows.select("answer_id", c("seq").cast("bigint").alias("seq"), "text")


def eighths(spark, folder):
    """The raw answers in eight pieces each."""
    return deltas(spark, folder, F.ceil(F.length("raw") / 8))


def _accumulated(spark, folder):
    return answers.accumulate(deltas(spark, folder)).select("answer_id", F.md5("raw").alias("digest"))


def _prefixes(spark, folder):
    return answers.prefixes(eighths(spark, folder)).select("answer_id", "seq", F.md5("raw").alias("digest"))


def _partial(spark, folder):
    rows = answers.prefixes(eighths(spark, folder)).select("answer_id", "seq", partial_fields(c("raw")).alias("f"))
    return rows.select("answer_id", "seq", "f.reference", F.md5("f.text").alias("text"), F.md5("f.response").alias("response"))


def _prefixes_of_pieces(spark, folder):
    return answers.prefixes(deltas(spark, folder)).select("answer_id", "seq", F.md5("raw").alias("digest"))


def _partial_of_pieces(spark, folder):
    rows = answers.fields_so_far(deltas(spark, folder))
    return rows.select("answer_id", "seq", "reference", F.md5("text").alias("text"), F.md5("response").alias("response"))


def _emitted(spark, folder):
    return answers.emissions(deltas(spark, folder)).select("answer_id", "seq", "event", "reference", F.md5("text").alias("digest"))


def _final(spark, folder):
    """Answers fenced; those of odd turns have a number for a response, and cannot be read."""
    bad = F.regexp_replace("raw", r'(?s)"response": ".*\z', '"response": 7}')
    raw = F.when(c("answer_id").rlike("[13579]$"), bad).otherwise(F.concat(F.lit("```json\nBien: "), c("raw"), F.lit("\n```")))
    rows = raw_answers(spark, folder).select("answer_id", final_fields(raw).alias("f"))
    return rows.select("answer_id", "f.reference", F.md5("f.text").alias("text"), F.md5("f.response").alias("response"))


def _results(spark, folder):
    """Answers of odd turns lose their last piece and are salvaged."""
    whole = deltas(spark, folder)
    lost = whole.filter(c("answer_id").rlike("[13579]$")).groupBy("answer_id").agg(F.max("seq").alias("seq"))
    rows = answers.results(whole.join(lost, ["answer_id", "seq"], "left_anti"), inputs.passages(spark, folder))
    return rows.select("answer_id", "reference", F.md5("text").alias("text"), F.md5("response").alias("response"), "warning", "source")


def _folded(spark, folder):
    """Emitted events as frames; turns of even number end in a result, odd ones in none."""
    sent = answers.emissions(deltas(spark, folder)).select(
        c("answer_id").alias("stream_id"), c("seq") * 2 + F.when(c("event") == "verse", 0).otherwise(1), "event",
        F.to_json(F.struct("reference", "text")).alias("data"),
    )
    ends = raw_answers(spark, folder).filter(~c("answer_id").rlike("[13579]$")).select(
        c("answer_id").alias("stream_id"), F.lit(1 << 40), F.lit("result").alias("event"), c("raw").alias("data")
    )
    rows = sent.union(ends).toDF("stream_id", "seq", "event", "data")
    return answers.fold_turns(rows).select(
        "stream_id", "reference", F.md5("text").alias("text"), F.md5("response").alias("response"), "status", "error"
    )


QUERIES = {
    "h01_parse_reference": _parsed,
    "h02_resolve_book": lambda s, d: _resolved(s, d).select("quote_id", "abbr"),
    "h03_exact_lookup": _found,
    "h04_text_agreement": _agreement,
    "h05_validate_quotes": _validated,
    "h06_apply_to_answers": _applied,
    "i01_accumulate": _accumulated,
    "i01_prefixes": _prefixes,
    "i01_prefixes_of_pieces": _prefixes_of_pieces,
    "i02_partial_fields": _partial,
    "i02_fields_of_pieces": _partial_of_pieces,
    "i03_emit_on_change": _emitted,
    "i04_final_fields": _final,
    "i05_results": _results,
    "i06_fold_turns": _folded,
}

_QUOTED = f"""{inputs.PASSAGES}, quoted as (
  select pos as quote_id, pos % 7 as form, chapter, num, abbr, book, lang, text as stored, case pos % 7
    when 0 then ' ' || book || ' ' || chapter || ':' || num || chr(10)
    when 1 then lower(book) || '  ' || chapter || ' , ' || num
    when 2 then abbr || ' ' || chapter || ':' || num
    when 3 then upper(abbr) || ' ' || chapter || ':' || num
    when 4 then 'Nadie ' || chapter || ':' || num
    when 5 then abbr || ' ' || chapter || ':' || num || '-9'
    else book || ' 99' || chapter || ':' || num end as reference,
    case when pos % 7 = 1 and lang <> 'de' then upper(text) when pos % 7 = 2 then '«' || substr(text, 5, 40) || '»'
      when pos % 7 = 0 and lang = 'fr' then 'otra cosa fr' when pos % 7 = 0 and lang = 'de' then ' (¡!) ' else text end as text
  from passages),
parsed as (
  select *, regexp_extract(reference, '^\\s*(.+?)\\s+(\\d+)[\\s,:.\\-]+(\\d+)\\s*$', 1) as pbook,
    try_cast(regexp_extract(reference, '^\\s*(.+?)\\s+(\\d+)[\\s,:.\\-]+(\\d+)\\s*$', 2) as bigint) as pchapter,
    try_cast(regexp_extract(reference, '^\\s*(.+?)\\s+(\\d+)[\\s,:.\\-]+(\\d+)\\s*$', 3) as bigint) as pnum
  from quoted),
named as (select distinct lower(book) as k, abbr as a from passages),
resolved as (
  select p.*, coalesce(n.a, case when lower(trim(pbook)) in (select lower(abbr) from passages) then trim(pbook) end) as rabbr
  from parsed p left join named n on n.k = lower(trim(pbook))),
found as (
  select r.*, s.pos as fpos, s.lang as flang, s.text as ftext, s.book || ' ' || s.chapter || ':' || s.num as freference
  from resolved r left join passages s on s.ref = r.rabbr || ' ' || r.pchapter || ':' || r.pnum),
judged as (
  select *, case when rabbr is null then 'reference unparseable' when fpos is null then 'verse not found in Bible'
    when not (contains({compare_sql('ftext')}, {compare_sql('text')}) or contains({compare_sql('text')}, {compare_sql('ftext')}))
    then 'quoted text does not match Bible verse' end as reason from found)"""

_E = "replace(replace(replace(%s, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
_RAW_OF = f"""{inputs.TURNS}, raws as (
  select id as answer_id, verse_reference, verse_text, response, '{{"verse": ' || coalesce('{{"reference": "' || {_E % 'verse_reference'}
    || '", "text": "' || {_E % 'verse_text'} || '"}}', 'null') || ', "response": "' || {_E % 'response'} || '"}}' as raw from turns),
pieces as (
  select *, unnest(generate_series(0, cast(ceil(length(raw) / @) as bigint) - 1)) as seq from raws),
prefixes as (select *, substr(raw, 1, (seq + 1) * @) as prefix from pieces)"""
_RAW = _RAW_OF.replace("@", str(PIECE))
_EIGHTHS = _RAW_OF.replace("@", "cast(ceil(length(raw) / 8) as bigint)")
_D = "replace(replace(replace(replace(replace(%s, '\\n', chr(10)), '\\t', chr(9)), '\\r', ''), '\\\"', '\"'), '\\\\', '\\')"


def _grab(name: str, close: str) -> str:
    return rf"""regexp_extract(prefix, '"{name}"\s*:\s*"((?:[^"\\]|\\.)*){close}', 1)"""


_SEEN = _D % f"coalesce(nullif({_grab('response', chr(34))}, ''), {_grab('response', '$')})"
_FIELDS = f""" partial as (
  select answer_id, seq, case when regexp_matches(prefix, '"text"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"') then {_D % _grab('reference', '"')} end as reference,
    case when regexp_matches(prefix, '"text"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"') then {_D % _grab('text', '"')} end as text,
    {_SEEN} as response from prefixes)"""
_PARTIAL = f"{_RAW}, {_FIELDS}"
_ODD = "regexp_matches(answer_id, '[13579]$')"

SQL = {
    "h01_parse_reference": f"with {_QUOTED} select quote_id, nullif(pbook, '') as book, pchapter as chapter, pnum as num from parsed",
    "h02_resolve_book": f"with {_QUOTED} select quote_id, rabbr as abbr from resolved",
    "h03_exact_lookup": f"with {_QUOTED} select quote_id, rabbr || ' ' || pchapter || ':' || pnum as ref, fpos as pos, flang as lang from found",
    "h04_text_agreement": f"""with {_QUOTED} select quote_id, contains({compare_sql('stored')}, {compare_sql('text')})
  or contains({compare_sql('text')}, {compare_sql('stored')}) as agrees from quoted""",
    "h05_validate_quotes": f"""with {_QUOTED} select quote_id, reason is null as ok, case when reason is null then freference end as found_reference,
  case when reason is null then md5(ftext) end as digest, reason from judged""",
    "h06_apply_to_answers": f"""with {_QUOTED} select quote_id as answer_id, case when reason is null and text not like 'otra%' then freference end as reference,
  case when reason is null and text not like 'otra%' then md5(ftext) end as digest, 'Respuesta ' || quote_id as response,
  case when reason is not null and text not like 'otra%' then 'verse validation failed: ' || reason end as warning from judged""",
    "i01_accumulate": f"with {_RAW} select answer_id, md5(raw) as digest from raws",
    "i01_prefixes": f"with {_EIGHTHS} select answer_id, seq, md5(prefix) as digest from prefixes",
    "i02_partial_fields": f"with {_EIGHTHS}, {_FIELDS} select answer_id, seq, reference, md5(text) as text, md5(response) as response from partial",
    "i01_prefixes_of_pieces": f"with {_RAW} select answer_id, seq, md5(prefix) as digest from prefixes",
    "i02_fields_of_pieces": f"with {_PARTIAL} select answer_id, seq, reference, md5(text) as text, md5(response) as response from partial",
    "i03_emit_on_change": f"""with {_PARTIAL}, steps as (select *, lag(reference) over w as before,
    coalesce(last_value(nullif(response, '') ignore nulls) over (partition by answer_id order by seq rows between unbounded preceding and 1 preceding), '') as sent
    from partial window w as (partition by answer_id order by seq))
  select answer_id, seq, 'verse' as event, reference, md5(text) as digest from steps where reference is not null and before is null
  union all select answer_id, seq, 'response_delta', null, md5(substr(response, length(sent) + 1)) from steps
    where response <> '' and response <> sent and length(response) > length(sent)""",
    "i04_final_fields": f"""with {_RAW} select answer_id, case when not {_ODD} then verse_reference end as reference,
  case when not {_ODD} then md5(verse_text) end as text, case when not {_ODD} then md5(response) end as response from raws""",
    "i05_results": f"""with {_RAW}, {_QUOTED.split('quoted as (', 1)[0].rstrip().rstrip(',').replace(inputs.PASSAGES, 'known as (select distinct lower(book) as k from passages)')},
  cut as (select *, case when {_ODD} then substr(raw, 1, (cast(ceil(length(raw) / {PIECE}) as bigint) - 1) * {PIECE}) end as prefix from raws),
  seen as (select *, {_SEEN} as part,
    regexp_matches(prefix, '"text"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"') as versed from cut)
  select answer_id, case when prefix is null or versed then verse_reference end as reference,
    case when prefix is null or versed then md5(verse_text) end as text,
    md5(case when prefix is null then response when length(trim(part, ' ' || chr(10))) > 30 or (versed and part <> '') then trim(part, ' ' || chr(10))
      when versed then 'Sigamos hablando, cuéntame más.' else 'Disculpa, hubo un momento de silencio. ¿Quieres preguntarme de nuevo?' end) as response,
    cast(null as varchar) as warning,
    case when prefix is null then 'parsed' when length(trim(part, ' ' || chr(10))) > 30 or versed then 'salvaged' else 'apology' end as source from seen""",
    "i06_fold_turns": f"""with {_PARTIAL}, steps as (select answer_id, arg_max(reference, seq) as reference, arg_max(text, seq) as text,
    arg_max(response, seq) as response from partial group by answer_id)
  select answer_id as stream_id, reference, md5(text) as text, md5(response) as response, case when {_ODD} then 'error' else 'done' end as status,
    case when {_ODD} then 'No se recibió respuesta. Intenta de nuevo.' end as error from steps""",
}
