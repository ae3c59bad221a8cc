"""The pipeline's stages, each held against brute force on what the stage before has kept."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_operators import SMALL, awkward, brute_classes, check_packing, encoded
from tests.llm.test_operators import SCHEMA
from tidebar.llm import mixing, toxicity
from tidebar.llm.common import table

PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return [tuple(r[c] for c in PLAIN) for r in frame.select(*PLAIN).collect()]


@pytest.fixture(scope="module", params=["small", "awkward"])
def docs(spark, request, tmp_path_factory):
    frame = table(spark, SMALL, "documents") if request.param == "small" else spark.createDataFrame(awkward(), SCHEMA)
    at = str(tmp_path_factory.mktemp("docs") / "docs")
    frame.repartition(3).write.parquet(at)
    return spark.read.parquet(at)


def test_stage_order():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    assert pipeline.ORACLE_SQL is None


def test_toxicity_stage(spark, docs):
    labels = table(spark, SMALL, "labels").where(~toxicity.held_out())
    model = toxicity.train(docs, labels, "toxic")
    scores = toxicity.score(docs, model, pipeline.THRESHOLD).where("predicted = 0")
    kept = pipeline.clean(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in rows_of(kept)) == Counter(r.doc_id for r in scores.collect())


def test_exact_stage(spark, docs):
    kept = pipeline.distinct(spark, docs, SMALL)
    assert kept.columns == docs.columns
    best = {}
    for r in rows_of(docs):
        key = (r[0] is not None, r[0] or 0)
        best[r[1] or ""] = max(best.get(r[1] or "", key), key)
    assert Counter((r[1] or "", r[0]) for r in rows_of(kept)) == Counter((t, k[1] if k[0] else None) for t, k in best.items())


def test_near_stage(spark, docs):
    kept = pipeline.without_near(spark, docs, SMALL)
    assert kept.columns == docs.columns
    rows = rows_of(docs)
    classes = brute_classes([(r[0], r[1]) for r in rows])
    mine = Counter(classes[r[1] or ""][0] for r in rows_of(kept))
    assert set(mine.values()) == {1} and set(mine) == {c for c, _ in classes.values()}
    assert all(r[0] == classes[r[1] or ""][0] for r in rows_of(kept))


def test_mixing_stage(spark, docs):
    kept = pipeline.mixed(spark, docs, SMALL)
    assert kept.columns == docs.columns
    order = [r["row"] for r in mixing.mixed_order(mixing.packets(docs), sum(r.taken for r in mixing.mix(docs).collect())).collect()]
    place = {r["row"]: r["doc_id"] for r in mixing.packets(docs).collect()}
    assert [r[0] for r in rows_of(kept)] == [place[k] for k in order]
    words = Counter()
    for r in rows_of(kept):
        words[r[0], r[3]] += len((r[1] or "").encode().split())
    want = Counter()
    for r in mixing.mix(docs).where("taken > 0").collect():
        want[r.doc_id, r.source] += r.taken
    assert words == want
    whole = {r[1] for r in rows_of(docs)}
    cut = [r for r in rows_of(kept) if r[1] not in whole]
    assert len(cut) <= 2 * len({r[3] for r in rows_of(docs)})


def test_packing_stage_and_whole_run(spark):
    found = pipeline.run(spark, SMALL)
    pieces = [r.asDict() for r in found.collect()]
    assert pieces and sum(r["length"] for r in pieces)
    docs = table(spark, SMALL, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    rows = rows_of(docs)
    assert sum(r["length"] for r in pieces) == sum(len(e) for e in encoded([r[1] for r in rows], 2))
    per_sequence = defaultdict(int)
    for r in pieces:
        per_sequence[r["sequence_id"]] += r["length"]
    assert max(per_sequence.values()) <= 4096
    once = docs.dropDuplicates(["doc_id"])
    check_packing([r.asDict() for r in pipeline.packed(spark, once, SMALL).collect()], {r.doc_id: r.text for r in once.collect()})


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/none")
    none = spark.read.parquet(f"{tmp_path}/none")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_stages_keep_other_columns(spark, tmp_path):
    """Columns named as the stages name theirs, and maps, which can be neither sorted nor joined by."""
    names = ("row", "at", "words", "size", "doc", "key", "_key", "_nth", "_id", "_kept", "text_key")
    docs = table(spark, SMALL, "documents")
    more = docs.withColumns({k: F.lit(k) for k in names}).withColumn("tags", F.create_map(F.lit("k"), F.col("n_chars")))
    more.write.parquet(f"{tmp_path}/more")
    more = spark.read.parquet(f"{tmp_path}/more")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, more, SMALL)
        assert kept.columns == more.columns
        other = stage(spark, more.unionByName(more.limit(0)), SMALL)  # rows that have no place in a file
        assert Counter(rows_of(other)) == Counter(rows_of(kept))
        assert {(*(r[k] for k in names), r.tags == {"k": r.n_chars}) for r in kept.collect()} == {(*names, True)}


def test_stages_on_many_repeats_of_a_row(spark, tmp_path):
    """10,000 times one document, beside others: one stays, and the mix takes no more than twice each row."""
    once = table(spark, SMALL, "documents").where("doc_id < 20")
    hot = once.where("doc_id = 7").join(spark.range(10_000).select(F.lit(1)))
    once.unionByName(hot.select(*once.columns)).repartition(4).write.parquet(f"{tmp_path}/hot")
    docs = spark.read.parquet(f"{tmp_path}/hot")
    for stage in (pipeline.distinct, pipeline.without_near):
        kept = rows_of(stage(spark, docs, SMALL))
        assert Counter(r[0] for r in kept)[7] <= 1 and len({r[1] for r in kept}) == len(kept)
    taken = Counter(r[0] for r in rows_of(pipeline.mixed(spark, docs, SMALL)))
    assert 0 < taken[7] <= 2 * 10_001
