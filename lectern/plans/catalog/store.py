"""Registered queries of the conversation store and of places (J, K) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.geo import haversine
from lectern.operators import conversations, places
from lectern.plans.catalog import inputs
from lectern.plans.catalog.corpus import PLACES_SQL, flat_places
from lectern.plans.catalog.text import export_sql, long_date_sql
from lectern.sources.tables import read_table

c = F.col


def _now():
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))


def _report(spark, folder):
    """Turns of all events' users as inserts; many belong to no conversation."""
    rows = inputs.live_turns(spark, folder).withColumn("liked", F.lit(False))
    orphans = inputs.headers(spark, folder).filter("title is null")
    return conversations.constraint_report(orphans, rows)


def _created(spark, folder):
    rows = read_table(spark, folder, "customer").select(
        c("c_custkey").cast("string").alias("id"), c("c_nationkey").cast("string").alias("user_id"),
        F.when(c("c_mktsegment") == "BUILDING", F.lit("")).when(c("c_acctbal") > 0, F.repeat("c_name", F.lit(20))).alias("title"),
    )
    made = conversations.conversation_defaults(conversations.new_conversations(rows, F.lit(None).cast("timestamp_ntz")), _now())
    return made.select("id", "user_id", "title", inputs.seconds("created_at"), inputs.seconds("updated_at"))


def _accepted(spark, folder):
    rows = inputs.live_turns(spark, folder).select(
        "id", "conversation_id", "ord", F.repeat("question", F.lit(30)).alias("question"),
        F.repeat("response", F.lit(12)).alias("response"), F.lit(None).cast("boolean").alias("liked"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    good, bad = conversations.accept_turns(rows)
    both = conversations.turn_defaults(good, _now()).withColumn("accepted", F.lit(True)).unionByName(
        conversations.turn_defaults(bad, _now()).withColumn("accepted", F.lit(False))
    )
    return both.select("id", "ord", F.md5("question").alias("question"), F.md5("response").alias("response"), "liked", inputs.seconds("created_at"), "accepted")


def _titled(spark, folder):
    return conversations.seed_titles(inputs.headers(spark, folder), inputs.turns(spark, folder)).select("id", "user_id", "title")


def _inserts(spark, folder):
    return read_table(spark, folder, "events").select(
        c("user_id").cast("string").alias("conversation_id"), c("ts").alias("created_at"),
        (c("event_id") % 4).cast("int").alias("ord"), (c("event_type") == "click").alias("liked"), "ts",
        c("event_id").alias("change_id"),
    )


def _touched(spark, folder):
    return conversations.touch(inputs.headers(spark, folder), _inserts(spark, folder)).select("id", inputs.seconds("updated_at"))


def _liked(spark, folder):
    return conversations.apply_likes(inputs.turns(spark, folder), _inserts(spark, folder)).select("id", "conversation_id", "ord", "liked")


def _users(spark, folder):
    """Users in debt."""
    return read_table(spark, folder, "customer").filter("c_acctbal < 2000").select(c("c_custkey").cast("string").alias("user_id"))


def _recent(spark, folder):
    rows = read_table(spark, folder, "orders").select(
        c("o_orderkey").alias("id"), (c("o_custkey") % 10).alias("user_id"), c("o_orderpriority").alias("title"),
        c("o_orderdate").alias("created_at"), c("o_orderdate").alias("updated_at"),
    )
    return conversations.recent(rows).select("user_id", "position", "id", "title", inputs.seconds("updated_at"))


def _loaded(spark, folder):
    asked = read_table(spark, folder, "customer").select(c("c_custkey").cast("string").alias("id"))
    rows = conversations.load(asked, inputs.headers(spark, folder), inputs.turns(spark, folder))
    return rows.select("id", "found", "title", inputs.seconds("created_at"), "ord", F.md5("question").alias("question"), "verse_reference", F.md5("response").alias("response"))


def _deleted(spark, folder):
    doomed = _users(spark, folder).withColumnRenamed("user_id", "id")
    heads, turns = conversations.delete(inputs.headers(spark, folder), inputs.turns(spark, folder), doomed)
    return heads.select(F.lit("conversation").alias("kind"), "id").unionByName(turns.select(F.lit("turn").alias("kind"), "id"))


def _unsaved(spark, folder):
    live = inputs.live_turns(spark, folder).drop("ord")
    saved = inputs.turns(spark, folder).filter("verse_reference is not null")
    return conversations.unsaved(live, saved).select("id", "ord", F.md5("response").alias("response"))


def _exported(spark, folder):
    return conversations.exportable(inputs.live_turns(spark, folder)).select(
        "conversation_id", "ord", F.md5("question").alias("question"), "verse_reference", F.md5("response").alias("response")
    )


def _transcripts(spark, folder):
    """Commas of passages as line separators, so that cleaning has work."""
    rows = inputs.turns(spark, folder).withColumn("verse_text", F.replace("verse_text", F.lit(", "), F.lit(" (Alef) | ")))
    date = F.to_date(F.lit("2024-03-05"))
    return conversations.transcript_parts(rows, date, footer="Fin").select("conversation_id", "part", F.md5("text").alias("digest"))


def _shared(spark, folder):
    return conversations.share_text(inputs.turns(spark, folder), "Atril").select("conversation_id", "ord", F.md5("text").alias("digest"))


def _share_parts(spark, folder):
    return conversations.share_parts(inputs.turns(spark, folder)).select("conversation_id", "ord", F.md5("text").alias("digest"))


# --- places --------------------------------------------------------------------------------------

def _flat(spark, folder):
    return flat_places(spark, folder).select(
        "place_id", "name", "address", "lat", "lng", "phone", "website", "rating", "rating_count",
        F.array_join("opening_hours", "|").alias("hours"), "maps_url", "photo_name", "description",
    )


def _kept(spark, folder):
    return places.keep(flat_places(spark, folder)).select("place_id", "name")


def _customers(spark, folder):
    return read_table(spark, folder, "customer").select(
        c("c_custkey").alias("centre_id"), "c_nationkey",
        (c("c_custkey") * 37 % 1200 / 10 - 60).alias("lat"), (c("c_custkey") * 91 % 3600 / 10 - 180).alias("lng"),
    )


def _distances(spark, folder):
    nation = read_table(spark, folder, "nation").select(
        c("n_nationkey").alias("c_nationkey"), (c("n_nationkey") * 3 - 36.5).alias("lat2"), (c("n_nationkey") * 7 - 90.25).alias("lng2")
    )
    rows = _customers(spark, folder).join(nation, "c_nationkey")
    return rows.select("centre_id", F.round(haversine(c("lat"), c("lng"), c("lat2"), c("lng2")), 4).alias("metres"))


def _supplier_points(spark, folder):
    return read_table(spark, folder, "supplier").select(
        c("s_suppkey").alias("pos"), (c("s_suppkey") * 37 % 1200 / 10 - 60).alias("lat"),
        (c("s_suppkey") * 91 % 3600 / 10 - 180).alias("lng"),
    )


def _nearest(spark, folder):
    hits = places.nearest(_customers(spark, folder), _supplier_points(spark, folder))
    return hits.select("centre_id", "pos", F.round("distance", 3).alias("metres"), "rank")


def _details(spark, folder):
    rows = flat_places(spark, folder)
    origin = F.when(c("s_nationkey") > 11, F.struct(F.lit(40.4).alias("lat"), F.lit(-3.7).alias("lng")))
    asked = read_table(spark, folder, "supplier").select(c("s_name").alias("place_id"), origin.alias("origin"))
    return places.detail(rows, asked).select(
        "place_id", "name", F.array_join("photo_names", "|").alias("photos"), "description", F.round("distance", 3).alias("metres")
    )


def _centres(spark, folder):
    """Customers with a position, with an address, with an unknown one, or with neither."""
    seg = c("c_mktsegment")
    asked = read_table(spark, folder, "customer").join(
        read_table(spark, folder, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    ).select(
        c("c_custkey").alias("centre_id"),
        F.when(seg == "BUILDING", c("c_acctbal") / 200).alias("lat"),
        F.when(seg.isin("BUILDING", "MACHINERY"), c("c_acctbal") / 100).alias("lng"),
        F.when(seg == "AUTOMOBILE", F.lit(" "))
        .when(c("c_acctbal") < 0, F.lit("Nowhere 1"))
        .otherwise(F.concat(F.lit(" "), c("n_name"), F.lit(" "))).alias("address"),
        (c("c_acctbal") * 10).alias("radius"),
    )
    geocodes = read_table(spark, folder, "nation").select(
        c("n_name").alias("address"), (c("n_nationkey") * 3 - 36.5).alias("lat"), (c("n_nationkey") * 7 - 90.25).alias("lng"),
        F.concat(c("n_name"), F.lit(", Tierra")).alias("formatted_address"),
    )
    good, bad = places.choose_centres(asked, geocodes)
    good = good.select("centre_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "formatted_address", F.round("radius", 6).alias("radius"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


QUERIES = {
    "j01_constraint_report": _report,
    "j02_new_conversations": _created,
    "j03_accept_turns": _accepted,
    "j04_seed_titles": _titled,
    "j05_touch_updated_at": _touched,
    "j06_apply_likes": _liked,
    "j07_owned_conversations": lambda s, d: conversations.owned_conversations(inputs.headers(s, d), _users(s, d)).select("id", "user_id"),
    "j08_owned_turns": lambda s, d: conversations.owned_turns(inputs.turns(s, d), inputs.headers(s, d), _users(s, d)).select("id", "conversation_id", "ord"),
    "j09_recent_conversations": _recent,
    "j10_load_conversations": _loaded,
    "j11_delete_cascade": _deleted,
    "j12_unsaved_turns": _unsaved,
    "j13_exportable_turns": _exported,
    "j14_transcript_parts": _transcripts,
    "j15_share_text": _shared,
    "j16_share_parts": _share_parts,
    "k01_flatten_places": _flat,
    "k02_keep_places": _kept,
    "k03_distances": _distances,
    "k04_nearest_places": _nearest,
    "k05_place_detail": _details,
    "k06_choose_centres": _centres,
}

_T = f"{inputs.TURNS}, {inputs.HEADERS}"
_USERS = "users as (select cast(c_custkey as varchar) as user_id from customer where c_acctbal < 2000)"
_RULE = conversations.RULE
_ALEF = "replace(verse_text, ', ', ' (Alef) | ')"
_NL = "chr(10)"


def _hav(lat1, lng1, lat2, lng2):
    x = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    )
    return f"2 * 6371000 * atan2(sqrt({x}), sqrt(1 - ({x})))"


def _rule_count(table: str, column: str, source: str) -> str:
    return f"select '{table}.{column} not null' as rule, count(*) filter (where {column} is null) as violations from {source}"


_LINK = r"""'https://www.google.com/maps/search/?api=1&query=' || regexp_replace(cast(lat as varchar), '\.0$', '') || ','
    || regexp_replace(cast(lng as varchar), '\.0$', '') || '&query_place_id=' || id"""
_QUOTE = f"'\"' || verse_text || '\"' || {_NL} || '— ' || verse_reference"

SQL = {
    "j01_constraint_report": f"with {_T}, heads as (select * from headers where title is null) "
    + " union all ".join(
        [_rule_count("conversations", x, "heads") for x in ("id", "user_id", "created_at", "updated_at")]
        + [_rule_count("turns", x, "live") for x in ("id", "conversation_id", "ord", "question", "response")]
        + [
            "select 'turns.liked not null', 0",
            "select 'turns.conversation_id exists', count(*) from live where conversation_id not in (select id from heads)",
        ]
    ),
    "j02_new_conversations": """select cast(c_custkey as varchar) as id, cast(c_nationkey as varchar) as user_id,
  case when c_mktsegment = 'BUILDING' then null when c_acctbal > 0 then substr(repeat(c_name, 20), 1, 200) end as title,
  '2024-02-01 00:00:00' as created_at, '2024-02-01 00:00:00' as updated_at from customer""",
    "j03_accept_turns": f"""with {inputs.LIVE_TURNS} select id, ord,
  md5(case when response is null then repeat(question, 30) else substr(repeat(question, 30), 1, 4000) end) as question,
  md5(substr(repeat(response, 12), 1, 8000)) as response, false as liked, '2024-02-01 00:00:00' as created_at, response is not null as accepted from live""",
    "j04_seed_titles": f"""with {_T} select h.id, user_id, coalesce(title, substr(t.question, 1, 80)) as title
  from headers h left join turns t on t.conversation_id = h.id and t.ord = 0""",
    "j05_touch_updated_at": f"""with {inputs.HEADERS}, m as (select cast(user_id as varchar) as id, max(ts) as at from events group by 1)
  select h.id, strftime(greatest(h.updated_at, coalesce(m.at, h.updated_at)), '%Y-%m-%d %H:%M:%S') as updated_at from headers h left join m on m.id = h.id""",
    "j06_apply_likes": f"""with {inputs.TURNS}, last as (select cast(user_id as varchar) as conversation_id, event_id % 4 as ord,
    arg_max(event_type = 'click', event_id) as liked from (select * from events order by ts) group by 1, 2)
  select t.id, t.conversation_id, t.ord, coalesce(l.liked, t.liked) as liked from turns t left join last l on l.conversation_id = t.conversation_id and l.ord = t.ord""",
    "j07_owned_conversations": f"with {inputs.HEADERS}, {_USERS} select id, user_id from headers where user_id in (select user_id from users)",
    "j08_owned_turns": f"""with {_T}, {_USERS} select t.id, t.conversation_id, t.ord from turns t
  where exists (select 1 from headers h where h.id = t.conversation_id and h.user_id in (select user_id from users))""",
    "j09_recent_conversations": """select user_id, cast(position as int) as position, id, title, strftime(changed, '%Y-%m-%d %H:%M:%S') as updated_at from (
  select o_custkey % 10 as user_id, o_orderkey as id, o_orderpriority as title, o_orderdate as changed,
    row_number() over (partition by o_custkey % 10 order by o_orderdate desc, o_orderkey) as position from orders) where position <= 100""",
    "j10_load_conversations": f"""with {_T} select cast(c_custkey as varchar) as id, h.id is not null as found, h.title, {inputs.sql_seconds('h.created_at')},
  t.ord, md5(t.question) as question, t.verse_reference, md5(t.response) as response
  from customer left join headers h on h.id = cast(c_custkey as varchar) left join turns t on t.conversation_id = cast(c_custkey as varchar)""",
    "j11_delete_cascade": f"""with {_T}, {_USERS} select 'conversation' as kind, id from headers where id not in (select user_id from users)
  union all select 'turn', id from turns where conversation_id not in (select user_id from users)""",
    "j12_unsaved_turns": f"""with {inputs.TURNS} select id, cast(ord as bigint) as ord, md5(response) as response from live where status = 'done' and response <> ''
  and id not in (select id from turns where verse_reference is not null)""",
    "j13_exportable_turns": f"""with {inputs.LIVE_TURNS} select conversation_id, ord, md5(question) as question, verse_reference, md5(response) as response
  from live where status = 'done' and (response <> '' or verse_reference is not null)""",
    "j14_transcript_parts": f"""with {inputs.TURNS}, e as (select conversation_id, max(ord) as last from turns group by 1)
  select conversation_id, cast(ord as bigint) as part, md5('Tu pregunta:' || {_NL} || question || {_NL} || {_NL}
    || coalesce(verse_reference || {_NL} || '"' || {export_sql(_ALEF)} || '"' || {_NL} || {_NL}, '')
    || coalesce(nullif(response, '') || {_NL} || {_NL}, '') || '{_RULE}' || {_NL} || {_NL}) as digest from turns
  union all select conversation_id, -1, md5('CONVERSACIÓN' || {_NL} || 'Conversación del ' || {long_date_sql("date '2024-03-05'", True)} || {_NL} || '{_RULE}' || {_NL} || {_NL}) from e
  union all select conversation_id, last + 1, md5('Fin') from e""",
    "j15_share_text": f"""with {inputs.TURNS} select conversation_id, ord, md5(question || coalesce({_NL} || {_NL} || {_QUOTE}, '')
  || coalesce({_NL} || {_NL} || nullif(response, ''), '') || {_NL} || {_NL} || '— Atril') as digest from turns""",
    "j16_share_parts": f"""with {inputs.TURNS} select conversation_id, ord, md5(case when ord = min(ord) over (partition by conversation_id)
    then 'Conversación' || {_NL} || {_NL} else {_NL} || {_NL} || '{conversations.SHORT_RULE}' || {_NL} || {_NL} end
  || 'Pregunta: ' || question || coalesce({_NL} || {_NL} || {_QUOTE}, '') || coalesce({_NL} || {_NL} || nullif(response, ''), '')) as digest from turns""",
    "k01_flatten_places": f"""with {PLACES_SQL} select id as place_id, name, case when n <> 7 then 'Calle ' || request else '' end as address, lat, lng,
  case when n < 12 then '91 1' else '+34 ' || request end as phone, cast(null as varchar) as website, round(s_acctbal, 2) as rating, request as rating_count,
  'lunes: 8|martes: cerrado' as hours, {_LINK} as maps_url, case when n >= 1 then 'places/p/photos/2' end as photo_name,
  case when n < 12 then 'Junto a ' || id end as description from raw""",
    "k02_keep_places": f"with {PLACES_SQL} select id as place_id, name from raw where n not in (3, 5, 9)",
    "k03_distances": f"""with p as (select c_custkey as centre_id, (c_custkey * 37) % 1200 / 10 - 60 as lat, (c_custkey * 91) % 3600 / 10 - 180 as lng,
    c_nationkey * 3 - 36.5::double as lat2, c_nationkey * 7 - 90.25::double as lng2 from customer)
  select centre_id, round({_hav('lat', 'lng', 'lat2', 'lng2')}, 4) as metres from p""",
    "k04_nearest_places": f"""with d as (select c_custkey as centre_id, s_suppkey as pos, round({_hav('c.lat', 'c.lng', 's.lat', 's.lng')}, 6) as m from
    (select *, (c_custkey * 37) % 1200 / 10 - 60 as lat, (c_custkey * 91) % 3600 / 10 - 180 as lng from customer) c,
    (select *, (s_suppkey * 37) % 1200 / 10 - 60 as lat, (s_suppkey * 91) % 3600 / 10 - 180 as lng from supplier) s)
  select centre_id, pos, round(m, 3) as metres, cast(rank as int) as rank from
    (select *, row_number() over (partition by centre_id order by m, pos) as rank from d) where rank <= 20""",
    "k05_place_detail": f"""with {PLACES_SQL} select id as place_id, name, case when n = 0 then '' else
    array_to_string(list_transform(generate_series(2, least(n + 1, 11)), lambda i: 'places/p/photos/' || i), '|') end as photos,
  case when n < 12 then 'Junto a ' || id end as description,
  round(case when n > 11 then {_hav('40.4::double', '(-3.7)::double', 'lat', 'lng')} else 0 end, 3) as metres from raw where lat is not null""",
    "k06_choose_centres": """with r as (select c_custkey as centre_id, c_mktsegment as seg, c_acctbal as b, n_nationkey as n, n_name from customer join nation on n_nationkey = c_nationkey)
  select centre_id, round(case when seg = 'BUILDING' then b / 200 when seg <> 'AUTOMOBILE' and b >= 0 then n * 3 - 36.5::double end, 6) as lat,
    round(case when seg = 'BUILDING' then b / 100 when seg <> 'AUTOMOBILE' and b >= 0 then n * 7 - 90.25::double end, 6) as lng,
    case when seg not in ('BUILDING', 'AUTOMOBILE') and b >= 0 then n_name || ', Tierra' end as formatted_address,
    case when seg = 'BUILDING' or (seg <> 'AUTOMOBILE' and b >= 0) then round(greatest(500.0::double, least(50000.0::double, b * 10)), 6) end as radius,
    case when seg = 'BUILDING' then null when seg = 'AUTOMOBILE' then 'no position and no address' when b < 0 then 'address not found' end as reason from r""",
}
