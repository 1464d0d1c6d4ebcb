import random
import re

from pyspark.sql import functions as F

from lectern.operators import segment

RAW = """Índice
Génesis 1
 GÉNESIS

Intro
Gén1 1 Al principio creó* el cielo. 2 La tierra
estaba infor-
 me. 3 Dijo 12 hombres 7 «hola»
2: Éx 2,4-25; Sal 8
4 Y fue.
Gén2*
Así 1 Fueron 2 acabados
Gén3 sin comienzo. 2 solo dos
Gén99 fuera
JUDAS MACABEO
1
SAMUEL

1 Sam1 1 Hubo un hombre 2 Tenía
*1,1 nota al pie 3 no
2 SAMUEL de nuevo
SALMOS

Salmo 1* 1 Dichoso 2 sino
Salmo 5 (6)* 1 Escucha
ABDÍAS

Prólogo
1 Visión de Abdías 2 Te haré
JUDAS
1 Yo
"""


def docs(spark, text, copies=2):
    return spark.createDataFrame([(str(i), text) for i in range(copies)], "doc_id string, value string")


def test_sections(spark):
    rows = segment.sections(docs(spark, RAW, 1)).orderBy("ord").collect()
    assert [r.ord for r in rows] == [0, 8, 9, 22, 37, 71]
    # the header broken over two lines is skipped by its full length
    assert rows[1].chunk.startswith("\n\n1 Sam1")
    # without a paragraph break the first mention is taken
    assert rows[2].chunk.startswith(" de nuevo")
    assert rows[5].chunk == "\n1 Yo\n"


def test_structure(spark):
    dim = segment.book_dimension(spark)
    found = segment.chapters(segment.sections(docs(spark, RAW)), dim).filter("doc_id = '1'")
    assert [(r.abbr, r.chapter) for r in found.orderBy("ord", "chapter").collect()] == [
        ("Gén", 1), ("Gén", 2), ("Gén", 3), ("1 Sam", 1), ("Sal", 1), ("Sal", 5), ("Abd", 1), ("Jud", 1),
    ]
    rows = segment.passages(found).orderBy("ord", "chapter", "num").collect()
    assert [(r.abbr, r.chapter, r.num, r.text) for r in rows] == [
        ("Gén", 1, 1, "Al principio creó el cielo."),
        ("Gén", 1, 2, "La tierra estaba informe."),
        ("Gén", 1, 3, "Dijo 12 hombres 7 «hola»"),
        ("Gén", 1, 4, "Y fue."),
        ("Gén", 2, 1, "Fueron"),  # a chapter found in the second pass only
        ("Gén", 2, 2, "acabados"),
        ("1 Sam", 1, 1, "Hubo un hombre"),  # the footnote ends the chapter
        ("1 Sam", 1, 2, "Tenía"),
        ("Sal", 1, 1, "Dichoso"),
        ("Sal", 1, 2, "sino"),
        ("Sal", 5, 1, "Escucha"),
        ("Abd", 1, 1, "Visión de Abdías"),
        ("Abd", 1, 2, "Te haré"),
        ("Jud", 1, 1, "Yo"),
    ]  # Gén 3 has no 1 and so no passage


def test_torn_hymn_marker(spark):
    dim = segment.book_dimension(spark)
    raw = "x SALMOS\n\nSalmo\n texto 9 (10)* 1 Gracias 2 Canto"
    rows = segment.structure(docs(spark, raw, 1), dim).orderBy("num").collect()
    assert [(r.chapter, r.num, r.text) for r in rows] == [(9, 1, "Gracias"), (9, 2, "Canto")]


def test_coverage_lists_missing_books(spark):
    dim = segment.book_dimension(spark)
    found = segment.chapters(segment.sections(docs(spark, RAW, 1)), dim)
    report = {r.name: r for r in segment.coverage(dim, found, segment.passages(found)).collect()}
    assert report["Abdías"].complete == 1 and report["Abdías"].passages == 2
    assert report["Génesis"].found == 3 and report["Génesis"].complete == 0
    assert report["Éxodo"].missing == 1
    assert report[None].level == "total" and report[None].passages == 14


QA = """Portada
1. ¿Qué es la fe en esta vida?

La fe es la res-
puesta del hombre a Dios que se revela.
2. ¿Corta?
Cuerpo de la corta, que queda en la primera.
3. ¿Otra pregunta bastante larga?
breve
4. «Una más que sí cuenta»
Texto largo del cuerpo que supera treinta. 5. ¿Perdida y en
dos líneas? resto
6. ¿Y la muy larga del final?
""" + "palabra " * 400


def test_questions_answers(spark):
    rows = segment.questions_answers(docs(spark, QA, 1)).orderBy("id").collect()
    assert [(r.id, r.numero, r.pregunta) for r in rows] == [
        (0, 1, "¿Qué es la fe en esta vida?"),
        (2, 4, "«Una más que sí cuenta»"),
        (3, 6, "¿Y la muy larga del final?"),
    ]  # ids count the dropped heading 3
    # the heading too short to count stays in the body, where it is cut off as a missed one
    assert rows[0].respuesta == "La fe es la respuesta del hombre a Dios que se revela."
    assert rows[1].respuesta == "Texto largo del cuerpo que supera treinta."
    assert len(rows[2].respuesta) == 2496 and rows[2].respuesta.endswith("palabra…")


def test_length_profile(spark):
    rows = spark.createDataFrame([("a" * n,) for n in (3, 1, 9, 4)], "respuesta string")
    assert tuple(segment.length_profile(rows).first()) == (4, 4, 9)
    empty = segment.length_profile(rows.filter(F.lit(False))).first()
    assert empty.n == 0 and empty.median is None


def test_headers_are_found_by_plain_search(spark):
    """Every position a pattern would find, in the order strict before loose, without a pattern a book."""
    books = [("Génesis", "Gén", 2), ("1 Samuel", "1 Sam", 2), ("2 Samuel", "2 Sam", 2), ("Rut", "Rut", 4)]
    texts = [
        "GÉNESIS x GÉNESIS y\n",  # the first character is no header
        "x GÉNESIS a\n GÉNESIS \n b",  # one with a break goes first
        "x 1 \n SAMUEL a 2SAMUEL b",
        "x SAMUEL \n a SAMUEL b RUTA _RUT RUT",  # without its number, for both books
        "x 1" + " " * 81 + "SAMUEL",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, value string")
    found = segment.sections(docs, books)
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, 0, " y\n"),
        (1, 0, " \n b"),
        (2, 1, "EL a "),
        (2, 2, "b"),
        (3, 1, " a "),
        (3, 2, " RUTA _RUT "),
        (3, 3, ""),
        (4, 1, ""),
    ]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


UP, LOW = "A-ZÁÉÍÓÚÑ", "a-záéíóúñ"


def plain_noise(chunk):
    kept = []
    for line in chunk.split("\n"):
        if re.search(r"\*[0-9]+,[0-9]", line):
            break
        s = line.strip()
        start = rf"[0-9]+(?:[.,:\-][0-9]+)*\s*:\s+[12]?\s*[{UP}{LOW}]+\s*[0-9]"
        if not re.match(start, s) and not re.match(r"[0-9]+,[0-9]+[a-z]?\s*[|;]", s):
            kept.append(line)
    return "\n".join(kept)


def plain_chapters(chunk, kind, abbr, total):
    """Every pattern over the whole text."""
    if kind == "single":
        chunk = plain_noise(chunk)
        m = re.search(rf"(?m)(?:^|\n)\s*1\s+[«¿“\"{UP}{LOW}]", chunk) or re.search(r"\s1\s", chunk)
        return [(1, chunk[m.start() :].strip())] if m else []
    head = rf"(?<!\w){re.escape(abbr)}([0-9]{{1,3}})\*?"
    patterns = [rf"{head}\s*(?=1[\s*{UP}{LOW}«¿\"“])", rf"{head}(?![0-9])"]
    if kind == "salmos":
        patterns = [r"Salmo\s+([0-9]+)\s*(?:\([0-9]+\))?\*?", r"\bSalmo\b[\s\S]{0,500}?([0-9]{1,3})\s*\([0-9]{1,3}\)\*?"]
    found = {}
    for pattern in patterns:
        for m in re.finditer(pattern, chunk):
            if 1 <= int(m[1]) <= total:
                found.setdefault(int(m[1]), m.span())
    ordered = sorted(found.items())
    ends = [start for _, (start, _) in ordered[1:]] + [len(chunk)]
    return [(n, plain_noise(chunk[content:end])) for (n, (_, content)), end in zip(ordered, ends)]


def plain_passages(chunk):
    flat = re.sub(r"\s+", " ", re.sub(r"-\n\s*", "", chunk.replace("*", "").replace("\u00ad", ""))).strip()
    taken = []
    for m in re.finditer(rf"(?:^|\s)([0-9]{{1,3}})(?=[\s«¿\"“{UP}{LOW}])", flat):
        if int(m[1]) == len(taken) + 1:
            taken.append(m.span())
    ends = [start for start, _ in taken[1:]] + [len(flat)]
    texts = [flat[content:end].strip() for (_, content), end in zip(taken, ends)]
    return [(n, text) for n, text in enumerate(texts, 1) if text]


def test_cuts_equal_patterns_over_the_whole_text(spark):
    """Chapters and passages of random texts, by every pattern tried everywhere."""
    rng = random.Random(11)
    blanks = [" ", " ", " ", "\n", "\n", "  ", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "\u00ad", "-\n", "*"]
    tokens = (
        "1 2 3 4 5 01 002 0 10 123 1234 Gén1 Gén2* xGén1 _Gén3 ²Gén2 Gén11 Gén1*3 Salmo Salmos Salmo_1 (3) (6)* a B É ñ « ¿ “ | ; : ,"
        " *1,2 3,4a; 5,6| 1:2: 1.2-3: palabra 😀"
    ).split() + ["Gén1 1 A", "Salmo 5 (6)*", "9 (10)*", "Salmo\n0007(8)", "Salmo " + "9" * 20, "\n1: 2 Sam 3", "\n1 «x", "y" * 480]
    texts = ["", *("".join(rng.choice(tokens) + rng.choice([*blanks, ""]) for _ in range(rng.randint(1, 60))) for _ in range(600))]
    texts += [" ".join(f"{i}{rng.choice(['', ' '])}{rng.choice(['a', 'Ñ', '?', '«'])}" for i in range(1, n)) for n in (1, 5, 120, 1005)]
    books = [(0, "standard", "Gén", 11), (1, "salmos", "Sal", 150), (2, "single", "Abd", 1)]
    dim = spark.createDataFrame([(i, abbr, abbr, abbr, total, kind) for i, kind, abbr, total in books], segment.DIM)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, chunk string")
    found = segment.chapters(docs.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("ord"))), dim)
    assert sorted((r.doc_id, r.ord, r.chapter, r.chunk) for r in found.collect()) == [
        (doc, i, *chapter) for doc, text in enumerate(texts) for i, kind, abbr, total in books
        for chapter in plain_chapters(text, kind, abbr, total)
    ]
    rows = docs.selectExpr("doc_id", "0 as ord", "'' as name", "'' as abbr", "1 as chapter", "chunk")
    assert sorted((r.doc_id, r.num, r.text) for r in segment.passages(rows).collect()) == [
        (doc, *passage) for doc, text in enumerate(texts) for passage in plain_passages(text)
    ]


def test_missing_values_have_no_pieces(spark):
    dim = spark.createDataFrame([(0, "n", None, "", 3, "standard"), (1, "n", "A", "", None, "standard"), (2, None, "A", "", 1, None)], segment.DIM)
    rows = spark.createDataFrame([(7, 0, "A1 1 x"), (7, 1, "A1 1 x"), (7, 2, None), (None, 2, "1 x"), (7, None, "1 x")], "doc_id int, ord int, chunk string")
    found = segment.chapters(rows, dim)
    assert [tuple(r) for r in found.collect()] == [(None, 2, None, "A", 1, "1 x")]
    assert segment.passages(rows.selectExpr("*", "'n' as name", "'A' as abbr", "1 as chapter").filter("chunk is null")).count() == 0


def test_structure_cuts_in_one_pass(spark):
    """One pass of the workers over a document, nothing interpreted for each number or line of it; the rows of the steps."""
    texts = [RAW, None, "", "x SALMOS\n\nSalmo 1\n" + "\n".join(f"{i} {'palabra ' * 900}" for i in range(1, 999)), RAW.replace("ABDÍAS", "RUT")]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id bigint, value string").coalesce(1)
    dim = segment.book_dimension(spark)
    rows = segment.structure(docs, dim)
    steps = segment.passages(segment.chapters(segment.sections(docs), dim))
    assert rows.schema == steps.schema
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, steps.collect()))
    assert rows.filter("doc_id = 3").count() == 998
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "lambda" not in plan
