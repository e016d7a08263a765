"""The corpus pipeline: documents -> language ID -> near-duplicates -> decontamination -> mixing -> token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, minhash_dedup, mixing, token_store
from tessera.llm.common import crc_of, table, written

#: A document stays if the model is at least this sure of its language.
SURE = 0.5
#: The mix takes this share of all words, each at most once; a document stays if at least half its words are taken.
MIX, ONCE = 0.75, 1.0
#: Documents whose word shingles reach this similarity, in percent, are near-duplicates here; the query of op2 alone asks for 85.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the model knows; lang becomes the predicted one. Rows with a null doc_id go: nothing later could name them."""
    docs = docs.where("doc_id is not null")
    model = langid.fit(docs.where(F.pmod(crc_of("doc_id"), F.lit(4)) != 2))
    found = langid.predict(docs, model, keep=docs.columns, names=("is__", "sure__"))
    return found.where((F.col("is__") != "und") & (F.col("sure__") >= SURE)).withColumn("lang", F.col("is__")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates."""
    kept = minhash_dedup.near_duplicates(docs, threshold=NEAR).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes; wordless ones cannot be taken and go."""
    taken = mixing.mix(docs, MIX, ONCE).where("size > 0 and 2 * taken >= size").select("doc_id")
    return docs.join(taken, "doc_id", "left_semi").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the token store's files."""
    return token_store.verified(token_store.write_store(docs))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token_store", tokens)]
#: Fitting, linking and tokenizing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
