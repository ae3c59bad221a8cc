"""Line dedup with DataFrame functions alone: lines that many documents hold stay in one of them.

Normalised lines are exploded and hashed, documents are counted for each hash, lines whose hash is over the threshold go
from all documents but the one with the largest doc_id, and documents are put together again by the lines' positions.

Hashes are 128 bits of the key's SHA-256.  What is exchanged for the decision are hashes and positions; hashes that many
lines have are counted before they are exchanged and joined by a broadcast of bounded size.  Texts are exchanged once, to
meet the positions that they lose.

Defined cases: a null or empty text is one empty line.  Rows of one doc_id are one document; rows without a doc_id
together are one, too, which comes before all others.  Rows that repeat doc_id and text lose the same lines.  A document
all of whose lines go has an empty text.  Only doc_id and text are read, so other columns may have any name.  An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, join_counted, text_key, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without the six blanks at both ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the ascending positions ``gone``: the runs between them, so time grows with their sum."""

    def run(k: Column) -> Column:
        first = F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))
        return F.slice(lines, first + 1, F.coalesce(F.get(gone, k), F.size(lines)) - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(hash, keep, n_lines): hashes in at least ``least_docs`` documents and the largest doc_id that has each."""
    found = lines.groupBy("hash").agg(
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))).alias("n_docs"),
        F.max("doc_id").alias("keep"),
        F.count("*").alias("n_lines"),
    )
    return found.where(F.col("n_docs") >= least_docs).drop("n_docs")


def drop_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", text_key())
    each = own.select("doc_id", "text_key", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = each.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    lines = scratch.put(keyed.select("doc_id", "text_key", "pos", text_key("key").alias("hash")), "lines")
    shared = scratch.put(shared_lines(lines, least_docs), "shared")
    lost = join_counted(lines, shared, ["hash"], "n_lines", lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    gone = lost.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = own.join(gone, same, "left").select("doc_id", "text", "gone")
    kept = _with(_lines(F.col("text")), lambda lines: F.array_join(_without(lines, F.col("gone")), "\n"))
    return joined.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
