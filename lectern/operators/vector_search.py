"""Vector stores and exact cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.vectors import quantize
from lectern.operators import pivots, topk


def quantize_store(store: DataFrame, vector: str = "v") -> DataFrame:
    """replace the float column by ``q array<tinyint>`` and ``scale``."""
    return (
        store.withColumn("_q", quantize(F.col(vector)))
        .withColumns({"q": F.col("_q.q"), "scale": F.col("_q.scale")})
        .drop("_q", vector)
    )


def prefer_quantized(quantized: DataFrame, floats: DataFrame) -> DataFrame:
    """A5: the quantized vector of a ref where there is one, else its float vector quantized."""
    missing = floats.join(quantized.select("ref"), "ref", "left_anti")
    return quantized.unionByName(quantize_store(missing).select(*quantized.columns))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    if lists.null_count or not (np.diff(lists.offsets.to_numpy()) == dim).all():
        raise ValueError(f"vectors must all have {dim} dimensions")
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), dim)


def _scaled(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their factor (the scale of int8 vectors) and their length."""
    v = _matrix(table.column("q" if "q" in table.column_names else "v"), dim)
    factor = table.column("scale").to_numpy() / 127 if "q" in table.column_names else np.ones(len(v))
    return v, factor, np.sqrt(np.einsum("ij,ij->i", v, v)) * factor


def cosine_kernel(shared: pa.Table) -> topk.Prepared:
    """Cosines of batches of vectors with a block of vectors, float or int8 on either side."""
    dim = len(shared.column("q" if "q" in shared.column_names else "v")[0])
    block, block_factor, block_length = _scaled(shared, dim)

    def prepared(batch: pa.Table) -> np.ndarray:
        v, factor, length = _scaled(batch, dim)
        bottom = np.outer(length, block_length)
        bottom[bottom == 0] = 1.0
        return (v @ block.T) * np.outer(factor, block_factor) / bottom

    return prepared


def _of_model(df: DataFrame, model: str | None, key: str) -> DataFrame:
    """Let no vector of another model into a comparison."""
    if model is None or "model" not in df.columns:
        return df
    wrong = F.raise_error(F.concat(F.lit(f"expected vectors of model {model}, found "), F.col("model")))
    return df.withColumn(key, F.when(F.col("model") == model, F.col(key)).otherwise(wrong))


def nearest(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    model: str | None = None,
    block_bytes: int = topk.BLOCK_BYTES,
    small_store: bool = False,
) -> DataFrame:
    """``(query_id, pos, score, rank)``: the k vectors of highest cosine for each query.

    ``store`` holds ``pos`` and either ``q``/``scale`` or ``v``; ``queries`` hold
    ``query_id`` and ``v``. All vectors must share one dimension, and one ``model`` when one
    is named. ``small_store`` says that the store is the smaller side: it is then the one that
    goes to the tasks, and the queries stay where they are. Ranked on the cosine to ten
    decimals; ``score`` is given to six.
    """
    columns = ["pos", "q", "scale"] if "q" in store.columns else ["pos", "v"]
    rows = _of_model(store, model, "pos").select(*columns)
    asked = _of_model(queries, model, "query_id").select("query_id", "v")
    hits = topk.top_k(rows, asked, cosine_kernel, k, block_bytes, share_rows=small_store)
    return hits.withColumn("score", F.round("score", 6))


def nearest_pruned(queries: DataFrame, store: DataFrame, k: int, model: str | None = None, **sizes) -> DataFrame:
    """As ``nearest``, by pivots: neither side passes through the driver, and blocks out of reach are not read."""
    # a scale turns no vector, but a scale of zero makes it zero
    parts = F.transform("q", lambda x: F.when(F.col("scale") == 0, 0.0).otherwise(x.cast("double")))
    v = parts if "q" in store.columns else F.col("v").cast("array<double>")
    rows = _of_model(store, model, "pos").select("pos", v.alias("v"))
    asked = _of_model(queries, model, "query_id").select("query_id", F.col("v").cast("array<double>").alias("v"))
    return pivots.nearest(asked, rows, k, **sizes).withColumn("score", F.round("score", 6))


def with_refs(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Give each hit its store key back."""
    return hits.join(store.select("pos", "ref"), "pos")


def search(
    queries: DataFrame,
    store: DataFrame,
    passages: DataFrame,
    k: int = fixed.DEFAULT_K,
    key: str = "ref",
    model: str | None = None,
    **sizes: int,
) -> DataFrame:
    """vector top-k, then the passages by key.

    k is taken before the lookup: a ref without a passage leaves a shorter result.
    """
    hits = with_refs(nearest_pruned(queries, store, k, model, **sizes), store).drop("pos")
    return hits.join(passages.withColumnRenamed(key, "ref") if key != "ref" else passages, "ref")


def relevant(hits: DataFrame, minimum: float = fixed.QA_MIN_SCORE) -> DataFrame:
    """threshold on a finished top-k."""
    return hits.filter(F.col("score") >= minimum)


def unembedded(passages: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """the passages that have no stored vector of this model."""
    done = stored.filter(F.col("model") == model).select("ref")
    return passages.join(done, "ref", "left_anti")


def size_report(store: DataFrame, vector: str = "v") -> DataFrame:
    """bytes as float32, bytes as int8 with one scale, and their ratio."""
    n = F.size(vector).cast("bigint")
    return store.agg(
        F.sum(n * 4).alias("float_bytes"), F.sum(n + 8).alias("int8_bytes")
    ).withColumn("ratio", F.round(F.col("float_bytes") / F.col("int8_bytes"), 4))


def mean_vectors(store: DataFrame, group: str, vector: str = "v") -> DataFrame:
    """One mean vector per group. Sums are taken per (group, dimension), combined before the
    shuffle, so a group of any size is no one task's burden."""
    per_dim = (
        store.select(group, F.posexplode(vector).alias("dim", "x"))
        .groupBy(group, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return per_dim.groupBy(group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]
        ).alias(vector)
    )
