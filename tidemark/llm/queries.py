"""The registered queries of this subpackage, each an operator over a whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: Vocabulary that the registered queries encode with; operators take its path as a parameter.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Vocabulary of the binary files of ids.
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op1_quality as op

    docs = table(spark, sf_dir, "documents")
    return op.score(docs, op.fit(docs, table(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op2_html as op

    return op.main_text(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op3_decontaminate as op

    return op.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op4_simhash as op

    return op.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op5_bpe as op

    return op.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op6_neighbours as op

    return op.nearest(table(spark, sf_dir, "embeddings"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op7_substring as op

    return op.remove_repeats(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op8_secrets as op

    return op.scan(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op9_chat as op

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return op.read_back(op.windows(turns, public_tokenizers.path(VOCABULARY)))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op10_lm as op

    return op.score(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op11_audit as op

    return op.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op12_search as op

    folder = op.new_folder(spark)
    op.build(table(spark, sf_dir, "documents"), folder)
    return op.search(spark, folder, table(spark, sf_dir, "benchmark"))


def op13_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op13_ids as op

    folder = op.new_folder(spark)
    op.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), folder)
    return op.digest(spark, folder)


OP3_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, low),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT r, n, ws, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, lens)),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i+34], ' ') AS s FROM d, unnest(range(1, len(ws) - 33)) AS t(i)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + j AS p FROM win JOIN rep USING (s), range(0, 35) AS k(j)),
word AS (SELECT r, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN g USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k::INT AS step, filter_order[k] AS x, CASE WHEN k = 1 THEN '0' ELSE filter_order[1:k-1] END AS earlier FROM o, range(1, 6) AS r(k)),
c AS (SELECT part, filter_order, step, x, n, n_good, n_toxic, fails, contains(fails, x) AS bad, regexp_matches(fails, '[' || earlier || ']') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
             coalesce(sum(n_good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""

OP12_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents, low),
s AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS big_n, sum(len(ws))::BIGINT AS big_l FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, low) GROUP BY ALL),
t AS (SELECT r, doc_id, len(ws)::BIGINT AS n, w.term, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) w SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term),
c AS (SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
      FROM t JOIN f USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op1_quality": op1_quality, "op2_html": op2_html, "op3_decontaminate": op3_decontaminate, "op4_simhash": op4_simhash, "op5_bpe": op5_bpe, "op6_neighbours": op6_neighbours, "op7_substring": op7_substring, "op8_secrets": op8_secrets, "op9_chat": op9_chat, "op10_lm": op10_lm, "op11_audit": op11_audit, "op12_search": op12_search, "op13_ids": op13_ids}
ORACLE: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op7_substring": OP7_SQL, "op11_audit": OP11_SQL, "op12_search": OP12_SQL}
