"""A training corpus from raw documents, in stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents, extra ones and ones with names of a stage's own too.
Null and empty texts pass through as they are, texts of any length are read
whole, and rows that repeat an id or are equal stay or go together; of a group
of copies the smallest doc_id stays, of a shared line the largest.  An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, linededup, pieces, sample, simhash, toxicity
from cloudloom.llm.kernel import fresh
from cloudloom.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a model from the labels that aren't held out."""
    held = sample.crc_of(F.col("doc_id")) % 5 == 0
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    name = fresh("toxicity_score", docs.columns)
    return toxicity.score(docs, model, docs.columns, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share, but for the largest doc_id; n_chars follows the text."""
    found = linededup.dedup_lines(docs, counts=(fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns))).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group whose SimHashes link at 3 bits."""
    return simhash.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents without near duplicates, the one with the smallest doc_id of each group that links of four fifths of their five-word shingles connect."""
    return simhash.one_of_near_copies(stored(drop_near_duplicates(spark, docs, sf_dir), "near-duplicates"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within a tenth of its characters."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces of every document, and as op1 the best segmentation's score, the three next ones and a digest of the decoded text."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    found = pieces.encode(docs, pieces.load(), 4, keep, other_ids=False)
    return found.select(*keep, "ids", F.size("ids").alias("n_pieces"), "score", "others", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: Learned scores, XXH64 fingerprints and edit distances are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
