"""A corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm import minhash, packing, secret_scans, suffix_dedup, toxicity
from larkgrid.llm.common import cut, discard, discard_since, numbered, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The classifier learns from labelled rows of documents."""
    rows = toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "text")
    model = toxicity.learn(rows, "text", "_toxic")
    plain = numbered(docs)
    scored = toxicity.score_texts(plain, model, f"_c{docs.columns.index('text')}")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id. Shingles of five words, similarity of 0.8 or more.

    Rows are told apart by id (null last) and two 64-bit digests of the text; of rows that are equal in these one
    stays. Texts without words are in no group: all of them stay.
    """
    plain = numbered(docs)
    id_col, text_col = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit(1), text_col).alias("y"))
    keyed = plain.withColumn("_key", key)
    found = minhash.near_duplicates(keyed, id_col="_key", text_col=text_col).where("n_shingles > 0")
    groups = found.groupBy("_key", "component_id").agg(F.count("*").alias("n"))
    marked = cut(groups.where("_key <> component_id or n > 1").select(F.col("_key").alias("_mark"), (F.col("_key") == F.col("component_id")).alias("_first")), "pipeline-marked")
    out = keyed.join(marked.select("_mark").hint("shuffle_hash"), F.col("_key") == F.col("_mark"), "left_anti")
    again = marked.where("_first").select("_mark")
    if not again.isEmpty():  # equal rows, one of which stays
        out = out.union(keyed.join(again.hint("shuffle_hash"), F.col("_key") == F.col("_mark"), "left_semi").dropDuplicates(["_key"]))
    return out.drop("_key").toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere, which takes away repeated passages of 50 words whole."""
    return suffix_dedup.remove_repeats(docs, suffix_dedup.PASSAGE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    clean = secret_scans.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: The stages learn, hash and solve. tests/llm compares each stage but the first with a brute-force version; the first's scores are tested by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = cut(stage(spark, before, sf_dir), f"pipeline-{name}")
        discard_since(mark, docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
