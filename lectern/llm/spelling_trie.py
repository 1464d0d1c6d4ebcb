"""Spelling variants: words one edit apart, found by walking a trie of all words level by level.

The trie is an edge table (node, letter, child) on the shared store, one folder a level; a node is
named by its prefix. A state is (path, node, edits): ``path`` is the prefix that a word has
read up to the current position, so words that begin alike share their states, and ``node`` is
where the other word stands. States without an edit are the nodes themselves (path = node) and
are read from the edge table. Each level joins the states with the edges of both sides:

* at a node without an edit, two different letters make a replacement, one letter taken by the
  path alone makes a deletion (an insertion seen from the other word);
* a state with its edit goes on with equal letters only.

States in which both sides end a word are neighbours. Of a run of equal letters the last one is
deleted, so no state is reached twice and nothing has to be made distinct. No join key is hot,
however the words are spread: a node has as many edges as there are letters, and a path meets
at most (position x letters) nodes that differ from it in one edit.

A word of more than LEVELS code points would make a level for each of them. Such words (and
their neighbours of LEVELS) are joined by a hash of the word without one position instead, with
the words themselves compared afterwards: the same neighbours, one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ready, written
from lectern.session import shared_folder

#: What a run is, which runs lose a letter, which results count as words.
RUN = "[A-Za-zÀ-ÿ]+"
DROPPED, SHORTEST, FEWEST = 97, 5, 3
#: Levels that are walked; longer words meet by hashes.
LEVELS = 32
_STATE = "path string, node string, path_ends boolean, node_ends boolean"


def words(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word`` and ``n``: the runs of letters of all texts, A-Z lower-cased, some shortened by a letter.

    A run whose crc32 with its key is divisible by DROPPED loses the letter at crc32 modulo its
    length. A null text has no runs, a null key counts as the empty text.
    """
    rows = df.select(F.coalesce(df[key].cast("string"), F.lit("")).alias("key"), df[text].alias("text"))
    runs = rows.select("key", F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.select("key", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    place = F.pmod("h", F.length("run")).cast("int")
    shortened = F.concat(F.substring("run", F.lit(1), place), F.expr("substring(run, int(pmod(h, length(run))) + 2)"))
    left = hashed.select(F.when(F.col("h") % DROPPED == 0, shortened).otherwise(F.col("run")).alias("word"))
    return left.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def edges(vocabulary: DataFrame) -> str:
    """The edge table of the words, a folder with one part a level; returns its path.

    Rows are (node, node_ends, letter, child, child_ends): ``ends`` tells where a word is whole.
    """
    size = F.length("word")
    nodes = (
        vocabulary.select("word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
        .select(F.expr("left(word, at)").alias("child"), (F.col("at") == size).alias("whole"), "at")
        .groupBy("child")
        .agg(F.max("whole").alias("child_ends"), (F.first("at") - 1).alias("level"))
    )
    nodes = written(nodes, "trie-nodes")
    above = nodes.select(F.col("child").alias("node"), F.col("child_ends").alias("above_ends"))
    whole = nodes.withColumn("node", F.expr("left(child, level)")).join(above, "node", "left")
    path = shared_folder(vocabulary.sparkSession, "trie-edges")
    whole.select(
        "node",
        F.coalesce("above_ends", F.lit(False)).alias("node_ends"),
        F.expr("right(child, 1)").alias("letter"),
        "child",
        "child_ends",
        "level",
    ).repartitionByRange("level", "child").write.partitionBy("level").parquet(path)
    return path


def _after(states: DataFrame, here: DataFrame, both: DataFrame) -> DataFrame:
    """States with their edit, one equal letter further on both sides."""
    path = here.select(
        F.col("node").alias("path"), "letter", F.col("child").alias("to_path"), F.col("child_ends").alias("path_ends")
    )
    node = both.select("node", F.col("letter").alias("same"), F.col("child").alias("to_node"), F.col("child_ends").alias("node_ends"))
    # the last letter of a run is the one deleted: nothing goes on with the letter just deleted
    again = (F.length("path") > F.length("node")) & F.expr("left(path, length(node)) = node") & F.expr("right(path, 1) = letter")
    return (
        states.select("path", "node")
        .join(path, "path")
        .where(~again)
        .join(node, ["node"])
        .where("letter = same")
        .select(F.col("to_path").alias("path"), F.col("to_node").alias("node"), "path_ends", "node_ends")
    )


def _edited(here: DataFrame) -> DataFrame:
    """New states from the nodes of a level: one letter replaced by another, or taken by the path alone."""
    other = here.select("node", F.col("letter").alias("with"), F.col("child").alias("to_node"), F.col("child_ends").alias("to_ends"))
    replaced = here.join(other, "node").where("letter < with")
    deleted = here.select(F.col("child").alias("path"), "node", F.col("child_ends").alias("path_ends"), "node_ends")
    return replaced.select(
        F.col("child").alias("path"), F.col("to_node").alias("node"), F.col("child_ends").alias("path_ends"), F.col("to_ends").alias("node_ends")
    ).union(deleted)


def walk(vocabulary: DataFrame) -> DataFrame:
    """(a, b): each pair of words one edit apart, once."""
    spark = ready(vocabulary.sparkSession)
    deepest = vocabulary.agg(F.max(F.length("word")).alias("n")).first()["n"]
    if deepest is None:
        return spark.createDataFrame([], "a string, b string")
    trie = edges(vocabulary)
    frontier = shared_folder(spark, "trie-frontier")
    schema = "node string, node_ends boolean, letter string, child string, child_ends boolean"

    def level(n: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{trie}/level={n}")

    for n in range(deepest):
        here = level(n)
        made = _edited(here)
        if n:
            states = spark.read.schema(_STATE).parquet(f"{frontier}/level={n - 1}")
            made = made.union(_after(states, here, here.union(level(n - 1))))
        made.write.parquet(f"{frontier}/level={n}")
    found = spark.read.schema(_STATE).parquet(*[f"{frontier}/level={n}" for n in range(deepest)])
    return found.where("path_ends and node_ends").select(F.col("path").alias("a"), F.col("node").alias("b"))


_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, key, place) of a word: whole (place -1) and without each position."""
    for batch in batches:
        for number, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            points = [ord(c) + 1 for c in word]
            after = [0] * (len(points) + 1)  # hash of what follows, first letter lowest
            for i in range(len(points) - 1, -1, -1):
                after[i] = (after[i + 1] * _BASE + points[i]) % _MODULUS
            keys, before, power = [after[0]], 0, 1
            for i, p in enumerate(points):
                keys.append((before + after[i + 1] * power) % _MODULUS)
                before, power = (before + p * power) % _MODULUS, power * _BASE % _MODULUS
            n = len(points)
            for start in range(0, n + 1, 1 << 16):
                part = keys[start : start + (1 << 16)]
                places = range(start - 1, start - 1 + len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(part), pa.int64()),
                        pa.array([n] * len(part), pa.int32()),
                        pa.array(part, pa.int64()),
                        pa.array(places, pa.int32()),
                    ],
                    ["id", "size", "key", "place"],
                )


def by_hashes(vocabulary: DataFrame, above: int = LEVELS) -> DataFrame:
    """(a, b): each pair one edit apart of which a word has more than ``above`` code points, once.

    Rows grow with the letters of the words. Words meet if they are alike without one position,
    or if one without a position is the other; at most an alphabet of words meets in a key.
    """
    numbered = written(
        vocabulary.where(F.length("word") >= above).select(F.monotonically_increasing_id().alias("id"), "word"), "long-words"
    )
    keys = written(numbered.mapInArrow(_without_one, "id bigint, size int, key bigint, place int"), "long-keys")
    cut = keys.where("place >= 0")
    other = cut.withColumnRenamed("id", "other")
    replaced = cut.join(other, ["size", "key", "place"]).where("id < other")
    whole = keys.where("place < 0").select((F.col("size") + 1).alias("size"), "key", F.col("id").alias("other"))
    deleted = cut.join(whole, ["size", "key"])

    def less(word: str) -> Column:
        return F.expr(f"left({word}, place) || substring({word}, place + 2)")

    met = replaced.select("id", "other", "place", F.lit(True).alias("same")).union(
        deleted.select("id", "other", "place", F.lit(False).alias("same"))
    )
    a = numbered.select("id", F.col("word").alias("a"))
    b = numbered.select(F.col("id").alias("other"), F.col("word").alias("b"))
    checked = met.join(a, "id").join(b, "other").where(F.greatest(F.length("a"), F.length("b")) > above)
    alike = less("a") == F.when(F.col("same"), less("b")).otherwise(F.col("b"))
    return checked.where(alike).select("a", "b").distinct()


def neighbours(vocabulary: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, other): the words that differ by one inserted, deleted or replaced code point, in both directions.

    ``vocabulary`` has distinct words in ``word``.
    """
    short = walk(vocabulary.where(F.length("word") <= levels))
    pairs = short.union(by_hashes(vocabulary, levels))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))
    return pairs.select(F.inline(both))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): where the forms end. Steps double, the lengths of chains too."""
    held = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        held = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return held


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", levels: int = LEVELS, **limits) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the texts.

    ``form`` is the near word of largest n (ties: the first in code-point order) if that n is at
    least twice the word's own, else null; ``root`` is where the forms from the word end, the word
    itself without a form. Null and empty texts have no words; repeated rows count again; an empty
    table has no rows; a word of any length is compared whole. Other columns are not read.
    """
    ready(df.sparkSession)
    vocabulary = written(words(df, key, text, **limits), "words")
    near = neighbours(vocabulary, levels).join(
        vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"
    )
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    form_n = -F.col("best.less")
    formed = F.when(form_n >= 2 * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("n")))
    chosen = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), formed.alias("to")
    )
    chosen = written(chosen.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n")), "forms")
    rooted = chosen.join(_roots(chosen.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """The same rows in DuckDB: crc32 by half bytes, neighbours by joining words without one position."""
    return f"""with recursive half as (
            select list(c order by i) as t from (
                select i, list_reduce(list_prepend(cast(i as bigint), cast(range(4) as bigint[])),
                    lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
                from range(16) r(i))),
        runs as (
            select key, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') as run, count(*) as times from (
                select coalesce(cast(doc_id as varchar), '') as key,
                    unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run
                from documents)
            group by all),
        hexed as (select run, times, hex(key || ':' || run) as x from runs where length(run) >= {SHORTEST}),
        hashed as (
            select run, times, xor(4294967295, list_reduce(
                list_prepend(cast(4294967295 as bigint), list_transform(range(length(x)),
                    lambda k: cast(instr('0123456789ABCDEF', substr(x, xor(k, 1) + 1, 1)) - 1 as bigint))),
                lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1]))) as h
            from hexed, half),
        w as (
            select word, cast(sum(times) as bigint) as n from (
                select times, case when h % {DROPPED} = 0
                    then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
                from hashed)
            where length(word) >= {SHORTEST} group by word having sum(times) >= {FEWEST}),
        cut as (select word, i, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from w)),
        one as (
            select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union select c.word, w.word from cut c join w on c.rest = w.word
            union select w.word, c.word from cut c join w on c.rest = w.word),
        best as (
            select o.word, count(*) as n_near, min({{'less': -w.n, 'form': o.other}}) as b
            from one o join w on w.word = o.other group by o.word),
        f as (
            select w.word, w.n, coalesce(n_near, 0) as n_near,
                case when -b.less >= 2 * w.n then b.form end as form, case when -b.less >= 2 * w.n then -b.less end as form_n
            from w left join best using (word)),
        chain as (
            select word, word as at from f
            union all select c.word, f.form from chain c join f on f.word = c.at where f.form is not null),
        ends as (select c.word, c.at as root from chain c join f on f.word = c.at where f.form is null)
        select word, form, root, n, n_near, form_n from f join ends using (word)"""
