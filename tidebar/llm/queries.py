"""One query for each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import (
    chat,
    exact_dedup,
    id_store,
    jaccard_join,
    lexical_search,
    line_dedup,
    media,
    mixing,
    packing,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from tidebar.llm.common import Scratch, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()), "toxic")
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(toxicity.held_out(), F.lit(False)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    found = chat.chat_digests(chat.written_chats(turns))
    return found.drop("n_tokens", "loss_tokens")


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "store").path("ids")
    id_store.write_store(table(spark, sf_dir, "documents"), root)
    id_store.verify(spark, root)
    return id_store.read_back(spark, root)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_media": op6_media,
    "op7_chat": op7_chat,
    "op8_id_store": op8_id_store,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

def _vector_codes_sql(rounds: int = 4) -> str:
    """Each round as a table of assignments and a table of new codebooks; doubles hold these integers exactly."""
    sql = """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, len(embedding) // 4 AS w,
                   list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS MATERIALIZED (
            SELECT i, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, range(4) AS parts(p)
        ), book0 AS MATERIALIZED (
            SELECT p, i - 1 AS e, x AS c FROM cut WHERE i <= 256
        )"""
    for k in range(rounds + 1):
        sql += f""", far{k} AS MATERIALIZED (
            SELECT i, cut.p, min([list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e]) AS best
            FROM cut JOIN book{k} AS b ON cut.p = b.p GROUP BY 1, 2
        )"""
        if k < rounds:
            sql += f""", sums{k} AS (
            SELECT p, e, list(m ORDER BY nth) AS c
            FROM (SELECT p, e, nth, floor(sum(y) / count(*)) AS m
                  FROM (SELECT f.p, best[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS nth FROM far{k} AS f JOIN cut ON f.i = cut.i AND f.p = cut.p)
                  GROUP BY 1, 2, 3)
            GROUP BY 1, 2
        ), book{k + 1} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{k} AS b LEFT JOIN sums{k} AS s ON b.p = s.p AND b.e = s.e
        )"""
    return sql + f""", coded AS (
            SELECT vec_id, label, string_agg(lower(format('{{:02x}}', best[2]::BIGINT)), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
            FROM kept JOIN far{rounds} AS f ON kept.i = f.i GROUP BY kept.i, vec_id, label
        ), named AS (
            SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, nth)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS nth FROM book{rounds})
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, named
    """


SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
                   2.0::DOUBLE * source_size AS cap
            FROM sources
        ), levels AS (
            SELECT *, cap / weight AS ratio,
                   (1.5::DOUBLE * sum(source_size) OVER ()
                    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
            FROM weighed
        ), chosen AS (
            SELECT (SELECT unit FROM levels WHERE ratio > unit ORDER BY ratio, unit LIMIT 1) AS level
        ), aims AS (
            SELECT source, source_size,
                   CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE weight * level END::DOUBLE AS target
            FROM levels, chosen
        ), queued AS (
            SELECT d.doc_id, d.size, a.source_size, a.target,
                   (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY sha256('mix' || d.doc_id), d.doc_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
            FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
        )
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, floor(target)::BIGINT - before))
                + greatest(0, least(size, floor(target)::BIGINT - before - source_size)))::BIGINT AS taken
        FROM queued
    """,
    "op7_chat": r"""
        WITH said AS (
            SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), escaped AS (
            SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS t,
                   replace(regexp_replace(replace(role, '\', '\\'), '(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g'),
                           chr(10), '\' || chr(10)) AS r
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(8 + length(r) + length(t))::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE classes AS (
            SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY 1
        ), words AS (
            SELECT rep, list_filter(string_split_regex(text, '[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'),
                                    lambda x: x <> '') AS w
            FROM classes
        ), grams AS (
            SELECT DISTINCT rep, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM words
        ), sizes AS (
            SELECT rep, count(*) AS n FROM grams GROUP BY 1
        ), pairs AS (
            SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM pairs JOIN sizes p ON x = p.rep JOIN sizes q ON y = q.rep WHERE c * 9 >= 4 * (p.n + q.n)
        ), walk AS (
            SELECT rep AS node, rep AS root FROM classes
            UNION SELECT l.y, w.root FROM walk w JOIN links l ON l.x = w.node
        ), named AS (
            SELECT node, min(root) AS class_id FROM walk GROUP BY 1
        ), degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY 1)
        SELECT d.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies
        FROM documents d JOIN classes c ON coalesce(d.text, '') = c.text JOIN named ON c.rep = node LEFT JOIN degrees ON c.rep = x
    """,
    "op11_lexical_search": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ), sized AS (
            SELECT doc_id, t, len(t)::BIGINT AS n FROM docs WHERE len(t) > 0
        ), total AS (
            SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sized
        ), asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY 1, 2
        ), held AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) GROUP BY 1, 2, 3
        ), spread AS (
            SELECT term, count(*) AS df FROM held GROUP BY 1
        ), scores AS (
            SELECT item_id, doc_id,
                   sum(times * floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                       * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
            FROM asked JOIN spread USING (term) JOIN held USING (term), total GROUP BY 1, 2
        )
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
        WHERE rank <= 10
    """,
    "op12_line_dedup": """
        WITH rows AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), lines AS (
            SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM rows
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), shared AS (
            SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3
        ), judged AS (
            SELECT r, doc_id, line, pos, s.key IS NOT NULL AND doc_id IS DISTINCT FROM keep AS gone
            FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r
    """,
    "op13_vector_codes": _vector_codes_sql(),
}
