"""Stateful streams over the events, and the tables they end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.plans import query
from tidebar.plans.indicators import BARS, r6
from tidebar.sources.views import bars, epoch_s, table
from tidebar.streaming import books
from tidebar.streaming.sliced import arriving

SYMBOLS = ["click", "error", "purchase", "signup", "view"]
WIDTH, RING = 5 * 86_400, 2
_SECONDS = "epoch_ms(ts) // 1000"
_KNOWN = f"event_type IN ({', '.join(repr(s) for s in SYMBOLS)})"

COMMITTED = f"""ticks AS (
        SELECT user_id::VARCHAR AS book, event_type AS symbol, event_id AS seq, ({_SECONDS}) // {WIDTH} AS bucket, value AS close FROM events
        WHERE value > 0 AND value < 'Infinity'::DOUBLE AND {_KNOWN}
    ), kept AS (
        SELECT * FROM (SELECT *, max(bucket) OVER (PARTITION BY book, symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks)
        WHERE top IS NULL OR bucket >= top
    ), built AS (
        SELECT book, symbol, bucket, last(close ORDER BY seq) AS close FROM kept GROUP BY 1, 2, 3
    ), staged AS (
        SELECT * FROM (SELECT *, lead(bucket) OVER (PARTITION BY book, symbol ORDER BY bucket) AS later FROM built) WHERE later = bucket + 1
    ), full_buckets AS (
        SELECT book, bucket, row_number() OVER (PARTITION BY book ORDER BY bucket) AS sequence FROM staged GROUP BY 1, 2 HAVING count(*) = {len(SYMBOLS)}
    ), framed AS (
        SELECT book, sequence, bucket, symbol, close, ln(close / lag(close) OVER (PARTITION BY book, symbol ORDER BY sequence)) AS delta
        FROM full_buckets JOIN staged USING (book, bucket)
    )"""


def event_ticks(spark: SparkSession, sf: str, seq: str = "event_id") -> DataFrame:
    """A book for each user, a symbol for each kind of event; events arrive in the order of ``seq``."""
    own = table(spark, sf, "events")
    return own.select(F.col("user_id").cast("string").alias("book"), F.col("event_type").alias("symbol"), F.expr(seq).cast("long").alias("seq"), epoch_s(F.col("ts")).alias("ts_s"), F.col("value").alias("close"))


def streamed_frames(spark: SparkSession, sf: str, seq: str = "event_id") -> DataFrame:
    stream, root = arriving(event_ticks(spark, sf, seq), "seq", 3, files=12)
    with books.state_store(spark):
        sink = books.frames(stream, SYMBOLS, WIDTH, RING).writeStream.format("parquet").option("path", f"{root}/out")
        sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(books.FRAMES).parquet(f"{root}/out")


@query("committed_frames", f"WITH {COMMITTED} SELECT book, sequence, bucket, symbol, close, round(delta, 6) AS delta FROM framed")
def committed_frames(spark: SparkSession, sf: str) -> DataFrame:
    found = streamed_frames(spark, sf).where("kind = 'frame'")
    return found.select("book", "sequence", "bucket", "symbol", "close", r6("delta").alias("delta"))


@query(
    "ring_deltas",
    f"""WITH {COMMITTED} SELECT book, symbol, sequence, count(delta) OVER w AS ring_n, round(coalesce(sum(delta) OVER w, 0), 6) AS ring_sum FROM framed
        WINDOW w AS (PARTITION BY book, symbol ORDER BY sequence ROWS BETWEEN {RING - 1} PRECEDING AND CURRENT ROW)""",
)
def ring_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The ring of a book's last deltas at each of its frames."""
    found = streamed_frames(spark, sf).where("kind = 'frame'")
    return found.select("book", "symbol", "sequence", "ring_n", r6(F.col("ring_sum") + 0.0).alias("ring_sum"))


@query("acted_once", f"WITH {COMMITTED} SELECT book, sequence, bucket FROM full_buckets")
def acted_once(spark: SparkSession, sf: str) -> DataFrame:
    """Committed frames delivered again and again, acted on once."""
    # a frame has one row for each symbol
    frames = streamed_frames(spark, sf).where(f"kind = 'frame' AND symbol = '{SYMBOLS[0]}'").select("book", "sequence", "bucket", "seq")
    stream, root = arriving(frames, "seq", 3, again=0.5)
    with books.state_store(spark):
        sink = books.acted_once(stream).writeStream.format("parquet").option("path", f"{root}/out")
        sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("book string, sequence long, bucket long").parquet(f"{root}/out")


@query("appended_stream", f"WITH {BARS} SELECT symbol, ts_ms, close FROM bars")
def appended_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that arrive in overlapping slices, appended by what is newer; the sink is read only here."""
    own = bars(spark, sf).select("symbol", "ts_ms", "close")
    stream, root = arriving(own, "ts_ms", 3, again=0.5)
    with books.state_store(spark):
        books.append_newer(stream, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("symbol string, ts_ms long, close double, batch int").parquet(f"{root}/out").drop("batch")


#: Events arrive shuffled inside runs of 500.
_SHUFFLED = "event_id - event_id % 500 + (event_id % 500) * 77 % 500"


@query(
    "late_ticks",
    f"""WITH ticks AS (
            SELECT user_id::VARCHAR AS book, event_type AS symbol, {_SHUFFLED} AS seq, ({_SECONDS}) // {WIDTH} AS bucket, value AS close, {_KNOWN} AS known FROM events
        ), priced AS (
            SELECT *, coalesce(known AND close > 0 AND close < 'Infinity'::DOUBLE, false) AS ok FROM ticks
        ), topped AS (
            SELECT *, max(CASE WHEN ok THEN bucket END) OVER (PARTITION BY book, symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM priced
        )
        SELECT book, symbol, count(*) FILTER (ok AND bucket < top) AS late, count(*) FILTER (NOT ok) AS invalid FROM topped GROUP BY 1, 2
        HAVING count(*) FILTER (ok AND bucket < top) + count(*) FILTER (NOT ok) > 0""",
)
def late_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive out of order are counted as errors, not dropped."""
    found = streamed_frames(spark, sf, _SHUFFLED).where("kind <> 'frame'")
    return found.groupBy("book", "symbol").agg(F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "invalid").alias("invalid"))
