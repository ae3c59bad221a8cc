"""From raw documents to packed training sequences: toxicity, exact and near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tidebar.llm.common import Scratch, table, text_key

THRESHOLD = 0.3


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, row): each row whole in a struct, whatever its columns are called, and what tells it from all others.

    Of a table of files that is the row's place: its file, by 128 bits of the path's MD5, and its index there, the same
    however a scan is split.  Other rows are numbered once and written, as a second scan might deal them otherwise, where
    executors came or went.
    """
    doc = F.struct(*docs.columns).alias("doc")
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    if plain and "_metadata" not in (c.lower() for c in docs.columns):
        file, nth = F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))), F.col("_metadata.row_index")
        return docs.select(doc, F.struct(file.alias("file"), nth.alias("nth")).alias("row"))
    return scratch.put(docs.select(doc, F.monotonically_increasing_id().alias("row")), "numbered")


def _only(own: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each (doc_id, text_key) of ``kept``, the first as stored.

    Numbers are chosen by keys alone; texts are exchanged once, to meet the chosen numbers.
    """
    keyed = own.select("row", F.col("doc.doc_id").alias("doc_id"), text_key("doc.text").alias("_key"))
    first = keyed.groupBy("doc_id", "_key").agg(F.min("row").alias("row"))
    keys = kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_kept"))
    same = (F.col("_key") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return own.join(first.join(keys, same, "left_semi").select("row"), "row", "left_semi").select("doc.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects.

    Null and empty texts get the intercept's score and stay unless that rejects; repeated rows are judged each; an
    empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.train(docs, labels, "toxic"), THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal ones, that with the largest doc_id; null texts count as empty ones.

    Of rows that repeat doc_id and text one stays, the first as stored.
    """
    own = _numbered(docs, Scratch(spark, "distinct"))
    found = exact_dedup.exact_dedup(own.select("doc.doc_id", "doc.text")).where("kept")
    return _only(own, found.select("doc_id", F.unhex(F.substring("text_sha256", 1, 32)).alias("text_key")))


def without_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a similarity of 0.8 or more join: that with the least doc_id.

    Null texts count as empty ones; texts without words link to none; of rows that repeat doc_id and text one stays.
    """
    own = _numbered(docs, Scratch(spark, "near"))
    return _only(own, jaccard_join.jaccard_join(own.select("doc.doc_id", "doc.text")).where("kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each pass, in the order of their virtual finish times.

    Where the mix cuts a document, its first words stay, between blanks.  Null texts and texts without words aren't
    taken; rows that repeat a doc_id, or a text, too, are documents of their own; sources may be null.
    """
    scratch = Scratch(spark, "mixed")
    own = _numbered(docs, scratch)
    queue = mixing.packets(own.select("doc.doc_id", "doc.source", "doc.text", "row"), row="row").where("words > 0")
    queue = scratch.put(queue.select("row", "at", "words", "size"), "queue")
    total = queue.agg(F.sum("words")).first()[0] or 0
    words = F.filter(F.split("doc.text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")).otherwise(F.col("doc.text"))
    both = own.join(queue, "row").select("at", "words", F.col("doc").withField("text", text).alias("doc"))
    return mixing.mixed_order(both, total).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents fill, in the order in which the mix is stored.

    Null texts are an end id alone; long ones span sequences; no documents, no pieces.
    """
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", without_near), ("mixing", mixed), ("packing", packed)]

#: A learned model takes part, so there is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, over the documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
