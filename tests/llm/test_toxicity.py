"""Features that few labelled documents have."""

from tidebar.llm import toxicity


def test_rare_words_are_learned(spark):
    """A word of 3 of 3,000 labelled documents, all toxic, rejects a document that carries nothing else."""
    rows = [(k, f"word{k % 50} said{k % 20}", 0) for k in range(2700)]
    rows += [(2700 + k, f"slur{k % 5} word{k % 50}", 1) for k in range(297)] + [(2997 + k, f"zorp w{k}", 1) for k in range(3)]
    docs = spark.createDataFrame([(k, text) for k, text, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, toxic) for k, _, toxic in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic")
    probes = spark.createDataFrame([(1, "zorp"), (2, ""), (3, "word1")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(probes, model).collect()}
    assert scores[1] > 0.3 > max(scores[2], scores[3])
