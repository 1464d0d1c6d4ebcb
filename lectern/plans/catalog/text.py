"""Registered queries of text and date functions (B, C) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import answers, dates, text
from lectern.operators import assemble, passages
from lectern.plans.catalog import inputs
from lectern.sources.tables import read_table

c = F.col
SPECIALS = r"""'[«»¿?¡!.,;:"''()\[\]{}|—–-]'"""


def fold_sql(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), {SPECIALS}, ' ', 'g')"


def tokens_sql(x: str) -> str:
    stop = inputs.sql_list(fixed.STOP_WORDS_ES)
    return (
        f"list_filter(string_split_regex({fold_sql(x)}, '\\s+'),"
        f" lambda t: length(t) > 1 and t not in ({stop}))"
    )


def block_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(replace({x}, chr(173), ''),"
        f" '-\\n\\s*', '', 'g'), '\\s+', ' ', 'g'))"
    )


def compare_sql(x: str) -> str:
    names = "|".join(fixed.COMPARE_LETTER_NAMES)
    first = rf"""regexp_replace(nfc_normalize(lower({x})), '[«»"''()\[\]]', '', 'g')"""
    words = rf"regexp_replace(replace({first}, '|', ' '), '\b(?:{names})\b', '', 'g')"
    marks = f"regexp_replace({words}, '[.,;:¿?¡!—–-]', '', 'g')"
    return rf"trim(regexp_replace({marks}, '\s+', ' ', 'g'), ' ' || chr(10))"


DISPLAY_NAMES = "|".join(fixed.DISPLAY_LETTER_NAMES)
MARKS_OFF = rf"regexp_replace(%s, '(?i)\((?:{DISPLAY_NAMES})\)\s*', '', 'g')"
BARS = r"regexp_replace(%s, '\s*\|\s*', ' — ', 'g')"
TRIM = "trim(%s, ' ' || chr(10))"


def display_sql(x: str) -> str:
    return TRIM % (BARS % (MARKS_OFF % x))


def export_sql(x: str) -> str:
    return TRIM % (MARKS_OFF % (BARS % x))


def _documents(columns):
    def query(spark, folder):
        return inputs.documents(spark, folder).select("doc_id", *columns())

    return query


def _replaced(column, *pairs):
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def _cross_reference_lines(spark, folder):
    line = (
        F.when(c("l_returnflag") == "R", F.concat(c("l_orderkey").cast("string"), F.lit(": Sal "), c("l_partkey").cast("string"), F.lit(",2")))
        .when(c("l_returnflag") == "A", F.concat(c("l_orderkey").cast("string"), F.lit(","), c("l_linenumber").cast("string"), F.lit(" | 3")))
        .when(c("l_linestatus") == "F", F.lit("  "))
        .otherwise(F.concat(c("l_orderkey").cast("string"), F.lit(" y dijo "), c("l_partkey").cast("string")))
    )
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return rows.select("l_orderkey", "l_linenumber", text.is_cross_reference(c("line")).alias("is_cross"))


#: Letters taken apart: one mark, two marks, two marks in the other order.
MARKED = (("e ", "e\u0301 "), ("o ", "o\u031b\u0301 "), ("a ", "a\u0302\u0323 "), (" t", " t\u0326"))
NOISY = (("\n", "\n1: Gén 2,4-25; Sal 8 | 3: Is 1,2\n"), (", ", "\n55,1; Ap 21,6 | 20: Hch 3,20s\n"), (" la ", "\n*1,1-2,4a Nota "))


def _ask(spark, folder):
    rows = read_table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(c("role") == "system", F.lit(" \n ")).otherwise(F.concat(F.lit("  "), c("text"), F.lit("\n"))).alias("question"),
    )
    accepted, rejected = assemble.ask_filter(rows)
    return accepted.select("conv_id", "turn", "question", F.lit(True).alias("accepted")).unionByName(
        rejected.select("conv_id", "turn", "question", F.lit(False).alias("accepted"))
    )


def _keys(spark, folder):
    return inputs.passages(spark, folder).select(
        "pos",
        text.ref_key(c("abbr"), c("chapter"), c("num")).alias("ref"),
        F.md5(text.embedding_input(c("ref"), c("text"))).alias("embedding_digest"),
        F.md5(text.qa_input(c("ref"), c("text"))).alias("qa_digest"),
    )


def _clamped(spark, folder):
    orders = read_table(spark, folder, "orders")
    radius = F.when(c("o_orderstatus") != "F", c("o_totalprice") / 5)
    width = F.when(
        c("o_orderpriority") != "1-URGENT", text.leading_int(c("o_orderpriority")) * c("o_totalprice") / 200
    ).otherwise(F.lit("x").try_cast("double"))
    return orders.select(
        "o_orderkey",
        F.round(text.clamp(radius, 500, 50000, 5000), 6).alias("radius"),
        F.round(text.clamp(width, 100, 1600, 600), 6).alias("width"),
    )


def _coordinates(spark, folder):
    lat = F.substring("props", 7, 20)
    lng = F.when(c("event_type") == "error", F.lit("nowhere")).otherwise(F.concat(F.lit("-"), lat, F.lit(" E")))
    rows = read_table(spark, folder, "events").select("event_id", text.coordinates(lat, lng).alias("p"))
    return rows.select("event_id", "p.lat", "p.lng")


def _photo_names(spark, folder):
    name = F.concat(F.lit("places/"), c("p_brand"), F.lit("/photos/"), c("p_name"), F.when(c("p_size") > 25, "?w=1").otherwise(""))
    return read_table(spark, folder, "part").select("p_partkey", text.is_photo_name(name).alias("is_photo"))


def _supplier_places(spark, folder):
    key = c("s_suppkey")
    return read_table(spark, folder, "supplier").select(
        key.alias("pos"),
        (key * 37 % 1200 / 10 - 60).alias("lat"),
        (key * 91 % 3600 / 10 - 180).alias("lng"),
        "s_name",
        "s_nationkey",
    )


def _maps(spark, folder):
    uri = F.when(c("s_nationkey") < 10, F.lit("")).when(c("s_nationkey") < 20, F.lit("https://example.org/m"))
    return _supplier_places(spark, folder).select(
        "pos", text.maps_link(uri, c("lat"), c("lng"), c("s_name")).alias("link")
    )


def _pairs(spark, folder):
    reference = F.when(c("lang") == "fr", F.lit("")).when(c("lang") != "de", c("source"))
    body = F.when(c("lang") == "es", F.lit("")).otherwise(c("text"))
    p = text.passage_pair(reference, body)
    return inputs.documents(spark, folder).select("doc_id", p["reference"].alias("reference"), F.md5(p["text"]).alias("digest"))


# --- dates ---------------------------------------------------------------------------------

def _orders(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("date"))


def _daily(spark, folder):
    return passages.daily_picks(_orders(spark, folder)).select("o_orderkey", "idx", "ref")


def _calendar(spark, folder):
    docs = inputs.documents(spark, folder)
    chapter, num = c("doc_id") % 150 + 1, F.floor(c("doc_id") / 150) + 1
    rows = docs.select(
        c("doc_id").alias("pos"), F.lit("Salmos").alias("book"), F.lit("Sal").alias("abbr"),
        chapter.alias("chapter"), num.alias("num"), "text",
    )
    span = _orders(spark, folder).agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    days = passages.calendar(c("d0"), c("d1"), span)
    full = passages.daily_calendar(days, rows)
    return full.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "ref", "reference", F.md5("text").alias("digest"), "found")


def _with_hours(spark, folder):
    k = c("o_custkey") % 7
    lines = F.array(
        *[
            F.concat(
                F.lit(day.capitalize() if i % 2 else day),
                F.when(k == i, F.lit(": Cerrado"))
                .when(k == (i + 1) % 7, F.lit(""))
                .otherwise(F.concat(F.lit(":  "), (c("o_custkey") % 12).cast("string"), F.lit(":00 - 20:00 "))),
            )
            for i, day in enumerate(fixed.WEEKDAYS_ES)
        ]
    )
    return _orders(spark, folder).withColumn("lines", lines)


def _hours_today(spark, folder):
    return _with_hours(spark, folder).select("o_orderkey", dates.hours_of_day(c("lines"), c("date")).alias("hours"))


def _hours_week(spark, folder):
    return dates.hours_rows(_with_hours(spark, folder), ["o_orderkey"])


WEEK = "[" + inputs.sql_list(fixed.WEEKDAYS_ES) + "]"
MONTHS = "[" + inputs.sql_list(fixed.MONTHS_ES) + "]"
POOL = ", ".join(f"({i}, '{r}')" for i, r in enumerate(fixed.DAILY_POOL))
LINES = f"""lines as (
  select o_orderkey, cast(o_orderdate as date) as date, i, name,
    case when i % 2 = 1 then upper(name[1]) || substr(name, 2) else name end as shown,
    case when o_custkey % 7 = i then ' Cerrado' when o_custkey % 7 = (i + 1) % 7 then null
      else '  ' || (o_custkey % 12) || ':00 - 20:00 ' end as rest
  from orders, (select unnest(generate_series(0, 6)) as i, unnest({WEEK}) as name))"""


def long_date_sql(d: str, weekday: bool = False) -> str:
    s = f"day({d}) || ' de ' || {MONTHS}[month({d})] || ' de ' || year({d})"
    return f"{WEEK}[dayofweek({d}) + 1] || ', ' || {s}" if weekday else s


QUERIES = {
    "b01_normalize_block": _documents(lambda: [F.md5(text.normalize_block(_replaced(c("text"), (". ", "-\n  "), ("qu", "q­u")))).alias("digest")]),
    "b02_strip_asterisks": lambda s, d: read_table(s, d, "pages").select("page_id", F.md5(text.strip_asterisks(c("html"))).alias("digest")),
    "b03_cross_reference_lines": _cross_reference_lines,
    "b04_strip_noise": _documents(lambda: [F.md5(text.strip_noise(_replaced(c("text"), *NOISY))).alias("digest")]),
    "b05_search_fold": _documents(lambda: [F.md5(text.search_fold(c("text"))).alias("digest")]),
    "b06_tokens": lambda s, d: inputs.documents(s, d).select("doc_id", text.tokens(c("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest")
    ),
    "b07_compare_fold": _documents(lambda: [F.md5(text.compare_fold(_replaced(c("text"), *MARKED))).alias("digest")]),
    "b08_display_text": _documents(lambda: [
        F.md5(text.display_text(_replaced(c("text"), (" the ", " (Pe)  "), (" la ", " (sámec) | "), (". ", " | ")))).alias("shown"),
        F.md5(text.export_text(_replaced(c("text"), (" the ", " (Pe)  "), (" la ", " (sámec) | "), (". ", " | ")))).alias("exported"),
    ]),
    "b09_unescape": _documents(lambda: [F.md5(answers.unescape(_replaced(c("text"), (". ", ".\\n"), (", ", "\\\\n\\\""), (" la ", "\\t\\r")))).alias("digest")]),
    "b10_json_body": _documents(lambda: [F.md5(answers.json_body(F.when(c("lang") == "fr", c("text")).otherwise(F.concat(F.lit("```JSON\n pre {"), c("text"), F.lit("} post {}\n``` \n"))))).alias("digest")]),
    "b11_length_caps": _documents(lambda: [
        F.md5(text.title_or_null(F.when(c("lang") == "fr", "").otherwise(c("text")))).alias("title"),
        F.md5(text.cap(c("text"), fixed.QUESTION_LIMIT)).alias("question"),
        F.md5(text.cap(c("text"), fixed.RESPONSE_LIMIT)).alias("response"),
        text.cap(c("text"), fixed.SEEDED_TITLE_LIMIT).alias("seeded"),
    ]),
    "b12_cap_at_word": _documents(lambda: [F.md5(text.cap_at_word(c("text"))).alias("digest")]),
    "b13_key_templates": _keys,
    "b14_distance_label": lambda s, d: read_table(s, d, "orders").select("o_orderkey", text.distance_label(c("o_totalprice") / 97 + 0.0137).alias("label")),
    "b15_compact_phone": lambda s, d: read_table(s, d, "events").select("event_id", text.compact_phone(c("props")).alias("phone")),
    "b16_first_word": _documents(lambda: [text.first_word(c("text")).alias("word")]),
    "b17_clamp": _clamped,
    "b18_coordinates": _coordinates,
    "b19_photo_name": _photo_names,
    "b20_maps_link": _maps,
    "b21_word_pieces": lambda s, d: inputs.documents(s, d).select("doc_id", text.word_pieces(c("text")).alias("p")).select(
        "doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest")
    ),
    "b22_passage_pair": _pairs,
    "b23_title_default": lambda s, d: inputs.headers(s, d).select("id", text.title_or_default(c("title")).alias("shown")),
    "b24_required_question": _ask,
    "c01_daily_pick": _daily,
    "c02_daily_calendar": _calendar,
    "c03_day_part": lambda s, d: read_table(s, d, "events").select("event_id", dates.day_part(c("ts")).alias("part")),
    "c04_hours_today": _hours_today,
    "c05_hours_week": _hours_week,
    "c06_long_dates": lambda s, d: _orders(s, d).select("o_orderkey", dates.long_date(c("date")).alias("plain"), dates.long_date(c("date"), True).alias("full")),
}

_BROKEN = "replace(replace(text, '. ', '-' || chr(10) || '  '), 'qu', 'q' || chr(173) || 'u')"
_MARKED = "text"
for _old, _new in MARKED:
    _MARKED = f"replace({_MARKED}, '{_old}', '{_new}')"
_SHOWN = "replace(replace(replace(text, ' the ', ' (Pe)  '), ' la ', ' (sámec) | '), '. ', ' | ')"
_NOISE = (
    "replace(replace(replace(text, chr(10), chr(10) || '1: Gén 2,4-25; Sal 8 | 3: Is 1,2' || chr(10)),"
    " ', ', chr(10) || '55,1; Ap 21,6 | 20: Hch 3,20s' || chr(10)), ' la ', chr(10) || '*1,1-2,4a Nota ')"
)
_CROSS = r"""(regexp_matches(trim(%s), '^\d+(?:[.,:\-]\d+)*\s*:\s+[12]?\s*[A-ZÁÉÍÓÚÑa-záéíóúñ]+\s*\d')
   or regexp_matches(trim(%s), '^\d+,\d+[a-z]?\s*[|;]'))"""
_UNESCAPED = (
    "replace(replace(replace(replace(replace(e, '\\n', chr(10)), '\\t', chr(9)), '\\r', ''), '\\\"', '\"'), '\\\\', '\\')"
)

SQL = {
    "b01_normalize_block": f"select doc_id, md5({block_sql(_BROKEN)}) as digest from documents",
    "b02_strip_asterisks": r"select page_id, md5(regexp_replace(html, '\*+', '', 'g')) as digest from pages",
    "b03_cross_reference_lines": f"""with rows as (
  select l_orderkey, l_linenumber, case l_returnflag when 'R' then l_orderkey || ': Sal ' || l_partkey || ',2'
    when 'A' then l_orderkey || ',' || l_linenumber || ' | 3'
    else case when l_linestatus = 'F' then '  ' else l_orderkey || ' y dijo ' || l_partkey end end as line from lineitem)
  select l_orderkey, l_linenumber, {_CROSS % ('line', 'line')} as is_cross from rows""",
    "b04_strip_noise": f"""with lines as (select doc_id, string_split({_NOISE}, chr(10)) as l from documents),
  marked as (select *, list_position(list_transform(l, lambda x: regexp_matches(x, '\\*\\d+,\\d')), true) as k from lines)
  select doc_id, md5(array_to_string(list_filter(case when coalesce(k, 0) = 0 then l else l[1:k - 1] end,
    lambda x: not {_CROSS % ('x', 'x')}), chr(10))) as digest from marked""",
    "b05_search_fold": f"select doc_id, md5({fold_sql('text')}) as digest from documents",
    "b06_tokens": f"""with t as (select doc_id, {tokens_sql('text')} as t from documents)
  select doc_id, cast(len(t) as int) as n, md5(array_to_string(t, ' ')) as digest from t""",
    "b07_compare_fold": f"select doc_id, md5({compare_sql(_MARKED)}) as digest from documents",
    "b08_display_text": f"select doc_id, md5({display_sql(_SHOWN)}) as shown, md5({export_sql(_SHOWN)}) as exported from documents",
    "b09_unescape": f"""with e as (select doc_id, replace(replace(replace(text, '. ', '.\\n'), ', ', '\\\\n\\"'), ' la ', '\\t\\r') as e from documents)
  select doc_id, md5({_UNESCAPED}) as digest from e""",
    "b10_json_body": """select doc_id, case when lang = 'fr' then case when regexp_matches(text, '\\{') then 'unexpected' end
    else md5('{' || text || '} post {}') end as digest from documents""",
    "b11_length_caps": """select doc_id, md5(nullif(substr(case when lang = 'fr' then '' else text end, 1, 200), '')) as title,
  md5(substr(text, 1, 4000)) as question, md5(substr(text, 1, 8000)) as response, substr(text, 1, 80) as seeded from documents""",
    "b12_cap_at_word": """select doc_id, md5(case when length(text) > 2500
    then regexp_replace(substr(text, 1, 2500), ' [^ ]*$', '') || '…' else text end) as digest from documents""",
    "b13_key_templates": f"""with {inputs.PASSAGES} select pos, ref, md5(ref || ' — ' || text) as embedding_digest,
  md5(ref || chr(10) || chr(10) || text) as qa_digest from passages""",
    "b14_distance_label": """with m as (select o_orderkey, o_totalprice / 97 + 0.0137 as m from orders)
  select o_orderkey, case when m < 1000 then cast(floor(m + 0.5) as bigint) || ' m' else printf('%.1f', m / 1000) || ' km' end as label from m""",
    "b15_compact_phone": r"select event_id, regexp_replace(props, '\s+', '', 'g') as phone from events",
    "b16_first_word": r"select doc_id, string_split_regex(trim(text, ' ' || chr(10)), '\s+')[1] as word from documents",
    "b17_clamp": """with r as (select o_orderkey, case when o_orderstatus <> 'F' then o_totalprice / 5 end as radius,
    case when o_orderpriority <> '1-URGENT' then cast(o_orderpriority[1] as int) * o_totalprice / 200 end as width from orders)
  select o_orderkey, round(greatest(500.0::double, least(50000.0::double, coalesce(radius, 5000.0))), 6) as radius,
    round(greatest(100.0::double, least(1600.0::double, coalesce(width, 600.0))), 6) as width from r""",
    "b18_coordinates": r"""with n as (select event_id, event_type, cast(regexp_extract(props, '\d+') as double) as n from events)
  select event_id, case when event_type <> 'error' then n end as lat, case when event_type <> 'error' then -n end as lng from n""",
    "b19_photo_name": """select p_partkey, p_size <= 25 and p_brand not like '%/%' and length(p_brand) > 0
    and not regexp_matches(p_name, '[/?#]') and length(p_name) > 0 as is_photo from part""",
    "b20_maps_link": r"""with p as (select s_suppkey as pos, s_name, s_nationkey,
    (s_suppkey * 37) % 1200 / 10 - 60 as lat, (s_suppkey * 91) % 3600 / 10 - 180 as lng from supplier)
  select pos, case when s_nationkey >= 10 and s_nationkey < 20 then 'https://example.org/m' else
    'https://www.google.com/maps/search/?api=1&query=' || regexp_replace(cast(lat as varchar), '\.0$', '') || ','
    || regexp_replace(cast(lng as varchar), '\.0$', '') || '&query_place_id=' || s_name end as link from p""",
    "b21_word_pieces": r"""with p as (select doc_id, regexp_extract_all(text, '\S+\s*') as p from documents)
  select doc_id, cast(len(p) as int) as n, md5(array_to_string(p, '|')) as digest from p""",
    "b22_passage_pair": """select doc_id, case when lang not in ('fr', 'de', 'es') then source end as reference,
  case when lang not in ('fr', 'de', 'es') then md5(text) end as digest from documents""",
    "b23_title_default": f"with {inputs.HEADERS} select id, coalesce(nullif(title, ''), '{fixed.UNTITLED}') as shown from headers",
    "b24_required_question": """select conv_id, turn, case when role = 'system' then '' else trim('  ' || text || chr(10), ' ' || chr(10)) end as question,
  role <> 'system' as accepted from conversations""",
    "c01_daily_pick": f"""with pool(idx, ref) as (values {POOL})
  select o_orderkey, idx, ref from orders join pool on dayofyear(o_orderdate) % 50 = idx""",
    "c02_daily_calendar": f"""with pool(idx, ref) as (values {POOL}),
  days as (select cast(unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as date) as date from orders),
  keyed as (select 'Sal ' || (doc_id % 150 + 1) || ':' || (doc_id // 150 + 1) as ref, 'Salmos ' || (doc_id % 150 + 1) || ':' || (doc_id // 150 + 1) as reference, text from documents)
  select strftime(date, '%Y-%m-%d') as date, ref, reference, md5(text) as digest, text is not null as found
  from days join pool on dayofyear(date) % 50 = idx left join keyed using (ref)""",
    "c03_day_part": """select event_id, case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 18 then 'afternoon' else 'night' end as part from events""",
    "c04_hours_today": f"""with {LINES} select o_orderkey, case when rest = ' Cerrado' then null when rest is null then 'Hoy ' || shown
    else 'Hoy ' || trim(rest) end as hours from lines where i = dayofweek(date)""",
    "c05_hours_week": f"""with {LINES} select o_orderkey, cast(i as int) as line, upper(name[1]) || substr(name, 2) as day,
    coalesce(trim(rest), '—') as hours, i = dayofweek(date) as is_today from lines""",
    "c06_long_dates": f"with d as (select o_orderkey, cast(o_orderdate as date) as d from orders) select o_orderkey, {long_date_sql('d')} as plain, {long_date_sql('d', True)} as full from d",
}
