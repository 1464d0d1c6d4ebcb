"""The registered queries of this subpackage, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    bit_sliced,
    byte_bpe,
    chat_repair,
    content_region,
    decontamination,
    licences,
    ppm_language,
    secret_automaton,
    simhash_covering,
    span_crf,
    spelling_trie,
    toxicity,
    walsh_codes,
)
from lectern.llm.common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of every chat, repaired at least cost."""
    return chat_repair.repair(table(spark, folder, "conversations"))


def top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest scores of every vector whose id is divisible by 20, against all others."""
    vectors = bit_sliced.quantised(table(spark, folder, "embeddings"))
    return bit_sliced.search(vectors, F.col("id") % 20 == 0)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the secrets of every document."""
    found = secret_automaton.find_secrets(spark, table(spark, folder, "documents"))
    base = [r.kind for r in secret_automaton.BASE]

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    based = joined(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[of(k) for k in base], F.sha2(based, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, paragraphs and texts that match a licence template."""
    return licences.find_licences(table(spark, folder, "documents"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four of five label rows."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    found = content_region.extract(pages, content_region.train(pages))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three of four."""
    docs = table(spark, folder, "documents")
    model = ppm_language.train(docs, fold("doc_id", 4) != 2)
    found = ppm_language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_covering.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by the rank file, and the bytes they decode to, as digests."""
    return digests(
        byte_bpe.encode(spark, table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    )


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes and errors of every usable vector."""
    return walsh_codes.compress(table(spark, folder, "embeddings"))


def personal(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the personal data of every document."""
    docs = table(spark, folder, "documents")
    found = span_crf.find_personal(spark, docs, span_crf.train(docs))
    based = F.filter("spans", lambda s: s["base"])

    def of(kind):
        return F.size(F.filter(based, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(k) for k in span_crf.KINDS],
        F.sha2(joined(based), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )


def spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with the spelling they are a variant of."""
    return spelling_trie.variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_chat_repair": chat,
    "op2_bit_sliced_top_k": top_k,
    "op3_secret_automaton": secrets,
    "op4_licence_dice": licence_scan,
    "op5_toxicity_noisy_or": toxic,
    "op6_content_region": main_text,
    "op7_latent_decontamination": leaks,
    "op8_ppm_language": language,
    "op9_simhash_covering": near_duplicates,
    "op10_byte_bpe": tokens,
    "op11_walsh_codes": vector_codes,
    "op12_span_crf": personal,
    "op13_spelling_trie": spelling,
}

SQL = {
    "op2_bit_sliced_top_k": """
        with v as (
            select row_number() over () as r, vec_id,
                list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as q
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.r, a.vec_id as query_id, b.vec_id,
                cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score
            from v a join v b on a.vec_id % 20 = 0 and a.r <> b.r)
        select query_id, vec_id, score,
            cast(row_number() over (partition by r order by score desc, vec_id nulls last) as int) as rank
        from s qualify rank <= 20
    """,
    "op4_licence_dice": licences.sql(),
    "op11_walsh_codes": walsh_codes.sql(),
    "op13_spelling_trie": spelling_trie.sql(),
}
