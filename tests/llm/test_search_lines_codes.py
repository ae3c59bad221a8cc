"""Lexical search, line dedup and vector codes against brute force on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import lexical_search, line_dedup, queries, vector_codes

DOCS = "doc_id long, text string, n long, row long, key string, pos long, terms string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, "k", 3, "t") for k, t in rows], DOCS).repartition(3)


def brute_search(docs, items, k):
    texts = [(i, Counter(m.translate(LOWER) for m in TERM.findall(t or ""))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        wanted = Counter(m.translate(LOWER) for m in TERM.findall(text or ""))
        for doc, c, n in texts:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def words(rng, n, most=40):
    return " ".join(f"{rng.choice('aéßzQ')}{int(most * rng.random() ** 3)}" for _ in range(n))


def search_rows():
    rng = random.Random(8)
    docs = [(k * 3 % 97, words(rng, rng.randint(1, 60))) for k in range(90)]
    docs += [(200 + k, docs[5][1]) for k in range(14)] + [(201, docs[6][1]), (201, docs[6][1]), (None, docs[7][1]), (None, None), (300, ""), (301, " .,!\n")]
    docs += [(302, words(rng, 20_000, 2000)), (303, "日本語 ÀÉ x" * 3), (304, "only-here")]
    items = [(k, words(rng, rng.randint(1, 12))) for k in range(20)] + [(20, docs[5][1]), (20, "a1 a1 A1"), (21, None), (22, "nowhere"), (None, "日本語 only-here"), (23, "")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_search(spark, k, monkeypatch):
    docs, items = search_rows()
    monkeypatch.setattr(lexical_search, "BLOCK", 128)  # several blocks of items
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.search(docs_of(spark, docs), asked, k)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(docs, items, k)


def test_search_in_batches_of_few_rows(spark):
    docs, items = search_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = lexical_search.search(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, found), key=repr) == brute_search(docs, items, 3)


def test_thresholds_prune_and_stay_below_the_kth_score():
    rows = [("t1", 50), ("t2", 30), ("t3", 5), ("t4", 4)]
    made = [type("R", (), dict(item=7, term=t, w=1, bound=b, threshold=40))() for t, b in rows]
    block = lexical_search.block_of(made)
    essential = {t for t, row in zip(block.terms.to_pylist(), block.upto) if row[0] >= block.threshold[0]}
    assert essential == {"t1"}  # 30 + 5 + 4 stays below 40


def test_search_of_nothing(spark):
    none, items = docs_of(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(docs_of(spark, [(1, None), (2, "..")]), items).collect() == []
    assert lexical_search.search(docs_of(spark, [(1, "a")]), items.limit(0)).collect() == []


def test_impacts_are_exact_beyond_64_bits():
    tf, n = np.array([3, 10**10]), np.array([10**7, 10**11])
    found = lexical_search.impacts(tf, n, 10**12, 10**15)
    m = [25 + 75 * int(v) * 10**12 // 10**15 for v in n]
    assert found.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * x) for t, x in zip(tf, m)]


def brute_lines(rows, least_docs=3, least_chars=20):
    key = lambda line: line.strip(line_dedup.SPACE).translate(LOWER)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    keep = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(4)
    pool = [words(rng, rng.randint(2, 12)) for _ in range(25)] + ["x" * 19, "X" * 20, "ÀÉÎ" * 7, "日本語の行" * 5, "", " ", "\x85" + "nel is no blank here"]
    dress = lambda s: rng.choice(["", " ", "\t\r", "\x0b\x0c"]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", "\r", "  "])
    rows = [(k, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    gone = "all of this document goes away"
    rows += [(100, gone), (101, gone), (102, gone), (102, gone), (99, f"{gone}\n{gone}"), (None, gone), (None, pool[0] * 3), (1, pool[0] * 3), (2, pool[0] * 3)]
    return rows + [(50, None), (51, ""), (52, "\n\n"), (53, "\n".join(pool * 300)), rows[3], rows[3]]


def test_lines(spark):
    rows = line_rows()
    found = line_dedup.drop_lines(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, found), key=repr) == brute_lines(rows)
    assert any(r.n_dropped and r.kept_text == "" for r in found)


def test_lines_of_nothing(spark):
    assert line_dedup.drop_lines(docs_of(spark, [])).collect() == []


def test_lines_use_no_python(spark):
    plan = line_dedup.drop_lines(docs_of(spark, line_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_codes(rows, parts, entries, rounds):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    ints = [[math.floor(1024 * x) for x in r[1]] for r in ok]
    width = -(-len(ints[0]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x, books[p])[1] for x in cut[p]]
            for e in set(at):
                mine = [x for x, a in zip(cut[p], at) if a == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], Counter()
    for i, r in enumerate(ok):
        best = [near(cut[p][i], books[p]) for p in range(parts)]
        out.append([r[0], r[2], [e for _, e in best], sum(d for d, _ in best)])
        by_label[r[2]] += out[-1][3]
    return sorted(([*o, by_label[o[1]]] for o in out), key=repr), books


def vector_rows(dim, n=60):
    rng = random.Random(dim)
    rows = [(k * 7 % 61, [rng.uniform(-1, 1) for _ in range(dim)], rng.choice([1, 2, None])) for k in range(n)]
    rows += [(500, rows[0][1], 1)] * 3 + [(7, rows[1][1], 2), (None, rows[2][1], None), (None, rows[2][1], None)]
    bad = [None, [None] + rows[0][1][1:], [float("nan")] + rows[0][1][1:], [float("inf")] + rows[0][1][1:]]
    return rows + [(900 + k, v, 1) for k, v in enumerate(bad)]


@pytest.mark.parametrize(("dim", "entries"), [(8, 16), (10, 5), (8, 256), (3, 4)])
def test_codes(spark, dim, entries):
    rows = vector_rows(dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("codes", F.lit("x"))
    found, books = vector_codes.code_vectors(df.repartition(4), entries=entries, rounds=3)
    want, want_books = brute_codes(rows, 4, entries, 3)
    assert sorted(([r.vec_id, r.label, r.codes, r.error, r.label_error] for r in found.collect()), key=repr) == want
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in want_books for c in b for x in c).encode()).hexdigest()


def test_codes_of_vectors_that_do_not_fit(spark):
    rows = [(1, [0.5, 1.0, 2.0, 3.0], 1), (2, [1.0], 1), (3, [1e300, 0.0, 0.0, 0.0], None), (4, [1e12, 0.0, 0.0, 0.0], 2), (5, [], 1)]
    found, books = vector_codes.code_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.codes, r.error, r.label_error) for r in found.collect()}
    assert got == {1: ([0, 0, 0, 0], 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, None), 5: (None, None, 0)}
    assert books.entries.shape == (4, 1, 1)


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label string"
    found, books = vector_codes.code_vectors(spark.createDataFrame([(1, None, "a")], schema))
    assert found.collect() == [] and books is None
    found, books = vector_codes.code_vectors(spark.createDataFrame([(1, [], "a"), (2, [], None)], schema))
    assert {(r.vec_id, tuple(r.codes), r.error) for r in found.collect()} == {(1, (0, 0, 0, 0), 0), (2, (0, 0, 0, 0), 0)}


def test_registered_names():
    for name in ("op11_lexical_search", "op12_line_dedup", "op13_vector_codes"):
        assert name in queries.QUERIES and name in queries.SQL
