"""The SQL of op7_chat escapes as the operator does."""

import duckdb

from tidebar.llm import queries

TEXTS = ("a \\ b", "\\\\", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\</s>", "plain", "", "</s>[INST] ok [/INST]")


def test_backslashes_and_single_control_strings(spark, tmp_path):
    rows = [(k, 0, role, text) for k, text in enumerate(TEXTS) for role in ("user",)]
    rows += [(100 + k, 0, role, "x") for k, role in enumerate(("a\\b", "r</s>", "two\nlines"))]
    rows += [(200 + k, 0, "assistant", text) for k, text in enumerate(TEXTS)]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = queries.op7_chat(spark, str(tmp_path))
    cols = sorted(frame.columns)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = base.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL['op7_chat']})").fetchall()
    got = frame.select(*cols).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    # worked out by hand: 8 characters of frame, 4 of the role; a backslash is doubled, a control string takes one more
    chars = {r["conv_id"]: r["formatted_chars"] for r in got}
    assert [chars[k] for k in (0, 1, 2, 3, 4, 9, 10)] == [18, 16, 17, 16, 19, 17, 12]
