"""Raw text to passages and question/answer pairs.

A document is one row. Every step works inside the row, so a corpus is cut up without any
shuffle, documents in parallel; rows are multiplied only when sections, chapters and passages
leave their text. These three are cut in Arrow batches: plain searches find the few places where a
pattern is tried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern import fixed
from lectern.functions.binding import let
from lectern.functions.text import RAW_SPACE, cap_at_word, normalize_block, raw_trim
from lectern.session import prepare

#: Characters of pieces that leave a task together.
CHUNK_CHARS = 4 << 20
UPPER, LOWER = "A-ZÁÉÍÓÚÑ", "a-záéíóúñ"
DIM = "ord int, name string, abbr string, header string, chapters int, kind string"


def book_dimension(spark: SparkSession, books: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Books in order. The header is the name in capitals; a book of one chapter is
    ``single``, the hymn book has its own markers, all others are ``standard``."""
    rows = []
    for i, (name, abbr, chapters) in enumerate(fixed.BOOKS if books is None else books):
        kind = "single" if chapters == 1 else "salmos" if abbr == "Sal" else "standard"
        rows.append((i, name, abbr, name.upper(), chapters, kind))
    return spark.createDataFrame(rows, DIM)


def _header_finder(header: str) -> Callable[[str, int], int]:
    """The function ``(text, last)`` to where a header begins behind ``last``, or -1.

    A header followed by a paragraph break goes before a header anywhere; a numbered one may stand
    without its number. A position must lie past the previous one, so a character is needed in
    front. The break is looked for behind the full header length even where only its bare
    suffix was found.
    """
    m = re.match(r"(\d)\s+(.*)", header, re.S)
    digit, word = m.groups() if m else ("", header)
    broken = re.compile(rf"[\s\S]{{{len(header)}}}\s{{0,199}}\n")
    inside = re.compile(r"\w")

    def starts(text: str, last: int) -> Iterator[int]:
        at = text.find(word, last)
        while at >= 0:
            if not inside.match(text, at + len(word)):
                if digit:
                    head = text[max(last, at - 81) : at]
                    bare = head.rstrip()
                    if len(head) - len(bare) <= 80 and bare.endswith(digit):
                        yield at - (len(head) - len(bare)) - 1
                yield at
            at = text.find(word, at + 1)

    def find(text: str, last: int) -> int:
        loose = -1
        for at in starts(text, last):
            if at > last and not inside.match(text[at - 1]):
                if broken.match(text, at):
                    return at
                loose = at if loose < 0 else loose
        return loose

    return find


def _cut_rows(rows: DataFrame, keep: list[str], given: list[str], made: str, cutter: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """The columns ``keep`` of a row for each of its pieces, with the columns ``made`` of the piece.

    ``cutter()`` is called in the task and gives the function from the columns ``given`` of a row to
    its pieces, whose last field is a text.
    """
    kept, fields = rows.select(*keep).schema.fields, T.StructType.fromDDL(made).fields
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept + fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        for batch in batches:
            pieces, origin, size = [], [], 0
            for i, row in enumerate(zip(*(batch.column(name) for name in given), strict=True)):
                found = cut(*(value.as_py() for value in row))
                pieces += found
                origin += [i] * len(found)
                size += sum(len(piece[-1]) for piece in found)
                if pieces and (size >= CHUNK_CHARS or i + 1 == len(batch)):
                    at = pa.array(origin, pa.int32())
                    columns = [batch.column(f.name).take(at) for f in kept]
                    columns += [pa.array(column, kind) for column, kind in zip(zip(*pieces), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    pieces, origin, size = [], [], 0

    prepare(rows.sparkSession)
    return rows.select(*dict.fromkeys(keep + given)).mapInArrow(run, T.StructType(kept + fields))


def _section_cutter(books: list[tuple[str, str, int]] | None) -> Callable[[str | None], list[tuple[int, str]]]:
    """The function from a text to ``(ord, chunk)`` of its headers."""
    headers = [name.upper() for name, _, _ in (fixed.BOOKS if books is None else books)]
    finders = [(len(h), _header_finder(h)) for h in headers]

    def cut(text: str | None) -> list[tuple[int, str]]:
        text, hits, last = text or "", [], 0
        for i, (size, find) in enumerate(finders):
            if (start := find(text, last)) >= 0:
                last = start + size
                hits.append((i, start, last))
        ends = [start for _, start, _ in hits[1:]] + [len(text)]
        return [(i, text[content:end]) for (i, _, content), end in zip(hits, ends)]

    return cut


def sections(docs: DataFrame, books: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """``(doc_id, ord, chunk)`` for the headers found, in the order of the dimension.

    ``docs`` is ``(doc_id, value)``. Each header is looked for behind the end of the last one taken,
    by a plain search for its word.
    """
    return _cut_rows(docs, ["doc_id"], ["value"], "ord int, chunk string", lambda: _section_cutter(books))


# White space is the same set in these patterns, in str.split and in RAW_SPACE. A word character above
# U+FFFF in front does not keep a marker from being one.
_NO_WORD_BEFORE = r"(?<![^\W\U00010000-\U0010ffff])"
_FOOTNOTE = re.compile(r"\*[0-9]+,[0-9]")
_CROSS_REFERENCE = re.compile(
    rf"\s*+[0-9]++(?:,[0-9]++[a-z]?\s*+[|;]|(?:[.,:\-][0-9]++)*+\s*+:\s++(?:[12]\s*+)?+[{UPPER}{LOWER}]++\s*+[0-9])"
)
_RARE_SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace() and ch not in " \n")
_HYPHENATED = re.compile(r"-\n\s*+")
_HYMN = re.compile(r"Salmo\s++([0-9]++)\s*+(?:\([0-9]++\))?\*?")
_TORN_HYMN = re.compile(_NO_WORD_BEFORE + r"Salmo(?!\w)[\s\S]{0,500}?([0-9]{1,3})\s*+\([0-9]{1,3}\)\*?")
_ONE_LINE = re.compile(rf"1\s++[«¿“\"{UPPER}{LOWER}]")
# a number that may belong to the chain but begins with 0
_ZERO_FIRST = re.compile(" 0[0-9]")
_PASSAGE = re.compile(rf"(?:^| )([0-9]{{1,3}})(?=[ «¿\"“{UPPER}{LOWER}])")
_BEHIND_NUMBER = frozenset(" «¿\"“ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑabcdefghijklmnopqrstuvwxyzáéíóúñ")


def _without_noise(chunk: str) -> str:
    """B4 of one text."""
    if note := _FOOTNOTE.search(chunk):
        chunk = chunk[: max(0, chunk.rfind("\n", 0, note.start()))]
    lines = chunk.split("\n")
    kept = [line for line in lines if not _CROSS_REFERENCE.match(line)]
    return chunk if len(kept) == len(lines) else "\n".join(kept)


def _flat(text: str) -> str:
    """B2, then B1 of one text."""
    text = text.replace("*", "").replace("\u00ad", "")
    if "-\n" in text:
        text = _HYPHENATED.sub("", text)
    # blanks and line ends, nearly all there is, need no list of words
    if any(space in text for space in _RARE_SPACES):
        return " ".join(text.split())
    text = text.replace("\n", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def _add_marks(found: dict[int, tuple[int, int]], chunk: str, word: str, pattern: re.Pattern, total: int) -> None:
    """Add to ``found`` where the first match of each chapter 1..total not in it yet begins and ends.

    The pattern is tried where its ``word`` stands.
    """
    at = chunk.find(word)
    while at >= 0:
        if m := pattern.match(chunk, at):
            number = m[1].lstrip("0")
            if number and len(number) <= 9 and int(number) <= total:
                found.setdefault(int(number), (at, m.end()))
            at = m.end() - 1
        at = chunk.find(word, at + 1)


def _marked_chapters(chunk: str, found: dict[int, tuple[int, int]]) -> list[tuple[int, str]]:
    """Chunks in chapter order, each up to where the next chapter's marker begins."""
    ordered = sorted(found.items())
    ends = [start for _, (start, _) in ordered[1:]] + [len(chunk)]
    return [(chapter, _without_noise(chunk[content:end])) for (chapter, (_, content)), end in zip(ordered, ends)]


@functools.cache
def _standard_marks(abbr: str) -> tuple[re.Pattern, re.Pattern]:
    """Markers followed by a passage 1, and bare ones."""
    head = rf"{_NO_WORD_BEFORE}{re.escape(abbr)}([0-9]{{1,3}})\*?"
    return re.compile(rf"{head}\s*(?=1[\s*{UPPER}{LOWER}«¿\"“])"), re.compile(rf"{head}(?![0-9])")


def _standard(chunk: str, abbr: str | None, total: int | None) -> list[tuple[int, str]]:
    """Markers followed by a passage 1 first, then bare ones for the missing chapters."""
    found: dict[int, tuple[int, int]] = {}
    if abbr is not None and total is not None:
        for pattern in _standard_marks(abbr):
            _add_marks(found, chunk, abbr, pattern, total)
    return _marked_chapters(chunk, found)


def _hymns(chunk: str) -> list[tuple[int, str]]:
    """D3: ``Salmo N (M)*`` first, then markers torn apart by up to 500 characters."""
    found: dict[int, tuple[int, int]] = {}
    for pattern in (_HYMN, _TORN_HYMN):
        _add_marks(found, chunk, "Salmo", pattern, 150)
    return _marked_chapters(chunk, found)


def _single(chunk: str) -> list[tuple[int, str]]:
    """From the first line ``1 X`` on, else from the first `` 1 ``, else nothing."""
    chunk = _without_noise(chunk)
    loose, at = -1, chunk.find("1")
    while at >= 0:
        line = at
        while line and chunk[line - 1] != "\n" and chunk[line - 1].isspace():
            line -= 1
        if (not line or chunk[line - 1] == "\n") and _ONE_LINE.match(chunk, at):
            break
        if loose < 0 and at and chunk[at - 1].isspace() and chunk[at + 1 : at + 2].isspace():
            loose = at
        at = chunk.find("1", at + 1)
    start = at if at >= 0 else loose
    return [(1, chunk[start:].rstrip())] if start >= 0 else []


def _chapters(chunk: str | None, kind: str | None, abbr: str | None, total: int | None) -> list[tuple[int, str]]:
    """``(chapter, chunk)`` of a section, by the kind of its book."""
    if chunk is None:
        return []
    if kind == "standard":
        return _standard(chunk, abbr, total)
    return _hymns(chunk) if kind == "salmos" else _single(chunk)


def chapters(found: DataFrame, dim: DataFrame) -> DataFrame:
    """``(doc_id, ord, name, abbr, chapter, chunk)``, by the kind of the book."""
    # the dimension is a list of books made on the driver, so its size is known to be small
    rows = found.join(F.broadcast(dim), "ord")
    return _cut_rows(
        rows, ["doc_id", "ord", "name", "abbr"], ["chunk", "kind", "abbr", "chapters"],
        "chapter int, chunk string", lambda: _chapters,
    )


def _pieces(texts: Column, marks: Column, kept: Column, j: Column) -> Column:
    """Text from behind kept marker ``j`` to the next kept one, other markers included."""
    here = F.get(kept, j)
    end = F.coalesce(F.get(kept, j + 1), F.size(marks))
    inner = F.transform(
        F.sequence(here, end - 1),
        lambda i: F.concat(
            F.when(i == here, F.lit("")).otherwise(F.get(marks, i)), F.get(texts, i + 1)
        ),
    )
    return F.array_join(inner, "")


def _passages(chunk: str | None) -> list[tuple[int, str]]:
    """``(num, text)`` of a chapter.

    Numbers are candidates; of these the chain 1, 2, 3, ... takes the first that fits. Each
    number is looked for behind the one before, so the text is read once.
    """
    if chunk is None:
        return []
    text = _flat(chunk)
    marks: list[tuple[int, int]] = []
    if text.startswith("0") or _ZERO_FIRST.search(text):
        for m in _PASSAGE.finditer(text):
            if int(m[1]) == len(marks) + 1:
                marks.append(m.span())
    else:
        if text[:1] == "1" and text[1:2] in _BEHIND_NUMBER:
            marks.append((0, 1))
        after = 1 if marks else 0
        while len(marks) < 999:
            mark = f" {len(marks) + 1}"
            at = text.find(mark, after)
            while at >= 0 and text[at + len(mark) : at + len(mark) + 1] not in _BEHIND_NUMBER:
                at = text.find(mark, at + 1)
            if at < 0:
                break
            after = at + len(mark)
            marks.append((at, after))
    ends = [start for start, _ in marks[1:]] + [len(text)]
    # the white space inside was collapsed with the whole text
    found = [(num, text[content:end].strip(" ")) for num, ((_, content), end) in enumerate(zip(marks, ends), 1)]
    return [(num, passage) for num, passage in found if passage]


def passages(chapter_rows: DataFrame) -> DataFrame:
    """``(doc_id, ord, book, abbr, chapter, num, text)``."""
    rows = chapter_rows.withColumnRenamed("name", "book")
    return _cut_rows(rows, ["doc_id", "ord", "book", "abbr", "chapter"], ["chunk"], "num int, text string", lambda: _passages)


def structure(docs: DataFrame, dim: DataFrame, books: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """D1-D7 in a row: raw documents to passages, a document's cuts one after the other in one task.

    The same cuts as ``passages(chapters(sections(docs, books), dim))``, whose chunks would go to the
    workers and back three times. The dimension, a list of books made on the driver, is read there.
    """
    named: dict[int, list[tuple]] = {}
    for book in dim.select("ord", "name", "abbr", "chapters", "kind").collect():
        named.setdefault(book[0], []).append(tuple(book[1:]))

    def cutter() -> Callable[[str | None], list[tuple]]:
        sections_of = _section_cutter(books)
        return lambda text: [
            (number, name, abbr, chapter, num, passage)
            for number, chunk in sections_of(text)
            for name, abbr, total, kind in named.get(number, ())
            for chapter, body in _chapters(chunk, kind, abbr, total)
            for num, passage in _passages(body)
        ]

    return _cut_rows(
        docs, ["doc_id"], ["value"], "ord int, book string, abbr string, chapter int, num int, text string", cutter
    )


def coverage(dim: DataFrame, chapter_rows: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Per book chapters found and expected, passages, flags; and the grand total.

    ``kind`` of the row is ``book`` or ``total``.
    """
    found = chapter_rows.groupBy("ord").agg(F.countDistinct("chapter").alias("found"))
    counted = passage_rows.groupBy("ord").agg(F.count("*").alias("passages"))
    per_book = (
        dim.join(found, "ord", "left")
        .join(counted, "ord", "left")
        .select(
            "ord",
            "name",
            F.coalesce("found", F.lit(0)).alias("found"),
            F.col("chapters").cast("bigint").alias("expected"),
            F.coalesce("passages", F.lit(0)).alias("passages"),
            F.col("found").isNull().alias("missing"),
        )
    )
    return (
        per_book.rollup("ord")
        .agg(
            F.first("name").alias("name"),
            F.sum("found").alias("found"),
            F.sum("expected").alias("expected"),
            F.sum("passages").alias("passages"),
            F.sum(F.col("missing").cast("int")).alias("missing"),
            F.sum((F.col("found") >= F.col("expected")).cast("int")).alias("complete"),
            F.grouping("ord").alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, "total").otherwise("book").alias("level"),
            F.when(F.col("_total") == 0, F.col("name")).alias("name"),
            "found",
            "expected",
            "passages",
            "missing",
            "complete",
        )
    )


HEADING = rf"(?dm)^{RAW_SPACE}*(\d{{1,4}})\.{RAW_SPACE}+([¿«].+?\??[?»]){RAW_SPACE}*$"
INNER_HEADING = rf"{RAW_SPACE}\d{{1,4}}\.{RAW_SPACE}+[¿«]"


def split_qa(text: Column) -> Column:
    """Array of struct(id, numero, pregunta, respuesta).

    ``id`` counts the headings kept, before short answers are dropped, so ids have gaps.
    """

    def cut(p: Column) -> Column:
        long_enough = F.filter(
            F.transform(
                p["questions"],
                lambda q, i: F.when(F.length(raw_trim(q)) >= fixed.HEADING_MINIMUM, i),
            ),
            lambda i: i.isNotNull(),
        )

        def one(kept: Column, k: Column, j: Column) -> Column:
            body = normalize_block(_pieces(p["texts"], p["marks"], kept, j))
            body = raw_trim(F.get(F.split(body, INNER_HEADING, 2), F.lit(0)))
            return F.struct(
                j.alias("id"),
                F.get(p["numbers"], k).cast("int").alias("numero"),
                raw_trim(F.get(p["questions"], k)).alias("pregunta"),
                cap_at_word(body).alias("respuesta"),
            )

        return let(long_enough, lambda kept: F.transform(kept, lambda k, j: one(kept, k, j)))

    parts = F.struct(
        F.split(text, HEADING, -1).alias("texts"),
        F.regexp_extract_all(text, F.lit(HEADING), 0).alias("marks"),
        F.regexp_extract_all(text, F.lit(HEADING), 1).alias("numbers"),
        F.regexp_extract_all(text, F.lit(HEADING), 2).alias("questions"),
    )
    return F.filter(let(parts, cut), lambda r: F.length(r["respuesta"]) >= fixed.ANSWER_BODY_MINIMUM)


def questions_answers(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, numero, pregunta, respuesta)``."""
    return docs.select("doc_id", F.explode(split_qa(F.col("value"))).alias("r")).select("doc_id", "r.*")


def length_profile(qa: DataFrame, text: str = "respuesta") -> DataFrame:
    """``(n, median, longest)`` of the text lengths, the median being element n // 2.

    Lengths are counted first; the running count goes over distinct lengths only.
    """
    sizes = qa.groupBy(F.length(text).alias("size")).agg(F.count("*").alias("c"))
    w = Window.orderBy("size")
    ranked = sizes.withColumns(
        {"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy())}
    )
    return ranked.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("size"))).alias("median"),
        F.max("size").alias("longest"),
    )
