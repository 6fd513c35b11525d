"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null and empty texts go in the first
stage; an empty table stays empty. Columns that the stages don't know are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import skysweep
from skysweep.functions.stored import delete, new_path, scratch
from skysweep.llm import language, mixing, neardup, packing, pii
from skysweep.llm.common import aside, written
from skysweep.llm.queries import held_out, surrogate_key

#: Below this posterior no language explains a text better than the others together.
LEAST_POSTERIOR = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the languages learned from labelled rows; null texts, texts without letters and texts that no language explains go."""
    skysweep.ship(spark)
    model = language.fit(docs.where(f"not {held_out(4, 2)} and doc_id is not null"))
    own, names, back = aside(docs, "text")
    return back(language.identify(own, model, keep=names).where(f"lang_pred <> 'und' and score >= {LEAST_POSTERIOR}"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more), and of rows that share an
    id the one with the first text. Rows without an id are kept: nothing is known to be their copy."""
    skysweep.ship(spark)
    own, names, back = aside(docs, "doc_id", "text")
    kept = written(neardup.near_duplicates(own, k=5, percent=80).where("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("times")))
    once = own.join(kept.where("times = 1 or kept_id is null"), F.expr("doc_id <=> kept_id"), "left_semi")
    repeated = kept.where("times > 1 and kept_id is not null")
    if repeated.isEmpty():
        return back(once)
    rows = own.join(repeated, F.expr("doc_id = kept_id"), "left_semi")
    first = rows.withColumn("place", F.expr(f"row_number() over (partition by doc_id order by text, xxhash64({', '.join(names)}))")).where("place = 1").drop("place")
    return back(once.unionByName(first))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data and secrets."""
    changed = pii.replace_entities(docs, surrogate_key(spark), count=None)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


#: Words of a source whose documents are rounded together, about.
ROUNDED = 32_768


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, 0 to 3 equal rows of each, so that a source's words come near what the mix takes from it.

    The words taken of a document are rounded to whole times, the largest documents first, and what is lost or won is carried to the next one. This is done for some documents of a source at
    a time (by a hash, about ROUNDED words): what is left over is half of the smallest of them at most. Documents without words are not taken."""
    own, names, back = aside(docs, "doc_id", "source", "text")
    mixed = mixing.mix(own, keep=names).where("size > 0").withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, size, text), greatest(1L, source_size div {ROUNDED}))"))
    groups = mixed.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct("size", "taken", *names)), asc=False).alias("rows"))
    times = "greatest(0L, least(3L, cast(round((x.taken + a.carry) / x.size) as bigint)))"
    folded = f"aggregate(transform(rows, x -> struct(x.size as size, x.taken as taken)), struct(0L as carry, cast(array() as array<bigint>) as times), (a, x) -> struct(a.carry + x.taken - {times} * x.size as carry, concat(a.times, array({times})) as times)).times"
    taken = groups.withColumn("times", F.expr(folded)).select(F.explode(F.arrays_zip("rows", "times")).alias("x")).where("x.times > 0")
    return back(taken.withColumn("copy", F.explode(F.expr("sequence(1L, x.times)"))).select("x.rows.*"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    skysweep.ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages fit a model, hash with seeds and cut token sequences; DuckDB can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage stored, and the documents that it has read, are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES:
        out_path = new_path(spark, f"stage-{name}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(out_path)
            if path:
                delete(spark, path)
        docs, path = spark.read.schema(out.schema).parquet(out_path), out_path
    return docs
