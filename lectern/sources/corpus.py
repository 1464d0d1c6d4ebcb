"""Corpus files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.passages import with_refs

PASSAGE_JSON = "libro string, abbr string, capitulo int, versiculo int, texto string"
QA_JSON = "id int, numero int, pregunta string, respuesta string"


def read_json_array(spark: SparkSession, path: str, item: str, lines: bool = False) -> DataFrame:
    """Items of JSON array files with their place in the file as ``pos``.

    With ``lines`` every line is a document of its own, an array or a single item.
    """
    whole = spark.read.text(path, wholetext=not lines)
    items = F.from_json("value", f"array<struct<{_typed(item)}>>")
    return whole.select(F.posexplode(items).alias("pos", "r")).select(
        F.col("pos").cast("bigint").alias("pos"), "r.*"
    )


def _typed(ddl: str) -> str:
    return ", ".join("{}: {}".format(*field.split()) for field in ddl.split(", "))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """A1: ``(book, abbr, chapter, num, text, pos, ref)``."""
    rows = read_json_array(spark, path, PASSAGE_JSON).select(
        F.col("libro").alias("book"),
        "abbr",
        F.col("capitulo").alias("chapter"),
        F.col("versiculo").alias("num"),
        F.col("texto").alias("text"),
        "pos",
    )
    return with_refs(rows)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A2: whole files, layout kept, as ``(doc_id, value)``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc_id"), "value"
    )


def read_qa(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """question/answer pairs; a path that does not exist is an empty table."""
    try:
        return read_json_array(spark, path, QA_JSON, lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "pos bigint, " + QA_JSON)


def write_passages(passages: DataFrame, path: str) -> None:
    """A JSON dataset with one folder per book abbreviation.

    Rows of a book may come from any task; they are written where they are, without a
    shuffle on a key of which a few values could hold most rows.
    """
    passages.select(
        F.col("book").alias("libro"),
        "abbr",
        F.col("chapter").alias("capitulo"),
        F.col("num").alias("versiculo"),
        F.col("text").alias("texto"),
    ).write.mode("overwrite").partitionBy("abbr").json(path)


def read_written_passages(spark: SparkSession, path: str) -> DataFrame:
    """Read back what ``write_passages`` wrote."""
    return spark.read.schema(PASSAGE_JSON).json(path)


def write_qa(qa: DataFrame, path: str) -> None:
    """A7 for question/answer pairs."""
    qa.select("id", "numero", "pregunta", "respuesta").write.mode("overwrite").json(path)
