"""The registered queries of the operators, over whole tables and with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysweep.llm import dialogue, embdup, language, mixing, neardup, negatives, packing, pii, quality, substrings, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns.split())


def held_out(n: int, remainder: int) -> str:
    """Whether crc32 of the doc_id's text leaves the remainder; a null doc_id is not held out."""
    return f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {n} = {remainder}, false)"


def surrogate_key(spark: SparkSession) -> str:
    """The setting spark.skysweep.surrogateKey. Without it, sessions on one machine (tests) get a key that is no secret, and an application on a cluster a random one, which it draws once and
    which no other knows: surrogates then agree within the application only."""
    key = spark.conf.get("spark.skysweep.surrogateKey", None)
    if key:
        return key
    if spark.sparkContext.master.startswith("local"):
        return "no secret: set spark.skysweep.surrogateKey"
    return vars(spark.sparkContext).setdefault("_skysweep_surrogate_key", secrets.token_hex(32))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id text lang")
    model = language.fit(docs.where(f"not {held_out(4, 2)} and doc_id is not null"))
    return language.identify(docs, model).selectExpr("doc_id", f"{held_out(4, 2)} as held_out", "lang_pred", "score", "letters_score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id text")
    labels = table(spark, sf_dir, "labels", "doc_id toxic").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lexicon = toxicity.fit(docs, labels.where(f"not {held_out(5, 0)}"))
    return toxicity.scored(docs, lexicon, ["doc_id"]).selectExpr("doc_id", f"{held_out(5, 0)} as held_out", "score", "int(score >= 0.5) as predicted", "hits", "words")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id text"), k=3, percent=85)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id text source"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integers(table(spark, sf_dir, "embeddings", "vec_id embedding"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id text"), window=13)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id embedding label"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id url html")
    files = warc.write_archive(pages, warc.archive_folder(pages), min_revisit=0)
    return warc.read_archive(files, pages.schema["page_id"].dataType.simpleString()).drop("url")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id source text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents", "doc_id text"), surrogate_key(spark))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id text n_chars")
    machine = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id quality").where(f"not {held_out(3, 1)}"), metadata=("n_chars",))
    return quality.scored(docs, machine, ["doc_id"]).selectExpr("doc_id", f"{held_out(3, 1)} as held_out", "score", "int(score >= 0.5) as predicted")


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that op12 puts into conversations, by a hash of conv_id and turn. Nulls count as one blank, in the hash too."""
    rows = conversations.selectExpr("conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text", "crc32(cast(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')) as binary)) % 20 as h")
    hurt = rows.where("h <> 0").selectExpr("conv_id", "turn", "if(h = 4, 'user', role) as role", "case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end as text", "explode(sequence(1, if(h = 3, 2, 1))) as copy")
    return hurt.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id turn role text")
    found = dialogue.summarised(dialogue.repaired(damaged(given))).withColumnRenamed("conv_id", "_own")
    every = given.select("conv_id").distinct().join(found, F.expr("conv_id <=> _own"), "left").drop("_own")  # conversations that lost all rows too
    return every.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).selectExpr("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "coalesce(audit, '') as audit", "coalesce(repaired_sha256, sha2('', 256)) as repaired_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id embedding label").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.hard_negatives(negatives.integers(rows), "vec_id % 50 = 0")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_mixing": op4_mixing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_quality": op11_quality,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op13_hard_negatives": negatives.ORACLE, "op12_conversation_repair": dialogue.ORACLE, "op3_minhash_dedup": neardup.ORACLE, "op4_mixing": mixing.ORACLE, "op5_exact_top_k": topk.ORACLE, "op6_substring_dedup": substrings.ORACLE, "op7_embedding_dedup": embdup.ORACLE, "op8_warc": warc.ORACLE}
