"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, debruijn, fst, hnsw, kdtree, minhash, mixing, packing, phrases, quality, records, repair, toxicity

from .common import ship


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"), 4096, 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "lang", "threshold", "rejected")


#: One more conversation, whose texts hold the template's marks.
MARKED = r"\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat.read_back(chat.format_table(rows.unionByName(extra)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def noisy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 on embeddings with a noisy copy of each, by rule: cosines from 0.8 to 1, so that links exist and end near 0.9."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    far = (F.col("vec_id") % 10) / 10.0
    noisy = F.transform("embedding", lambda x, i: x * (1 + far * ((F.col("vec_id") + i) % 3 - 1)))
    copies = own.select("vec_id", noisy.alias("embedding")).withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return hnsw.near_vectors(own.unionByName(copies), 0.9)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), 50, 256, 5)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=7, exponent=0.5, budget=1.0).select("doc_id", "text", "lang", "source", "n_chars", "copy")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fst.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_words")


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.read_records(spark, records.write_records(docs, tokenizer("byte_bpe_50k.json"), 2))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"), 30, 2000)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_toxicity, op3_chat, op4_embedding_dedup, op5_topk, op6_substring_dedup, op7_mixing, op8_minhash, op9_token_counts, op10_records, op11_phrases, op12_repair, op13_quality, noisy_vectors, pipeline)
    return {f.__name__: f for f in own}


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + 2 * 0 + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '<', '')))
    + length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '#', ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, ':', '')))
    + 4 + 2 + 8 AS shown
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT vec_id, v FROM u
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), walk(a, b) AS (
  SELECT vec_id, vec_id FROM ok UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b
), low AS (SELECT a, min(b) AS c FROM walk GROUP BY a), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT u.vec_id, coalesce(n, 0) AS n_links, coalesce(c, u.vec_id) AS component_id, coalesce(c, u.vec_id) = u.vec_id AS kept
FROM u LEFT JOIN low ON low.a = u.vec_id LEFT JOIN deg ON deg.a = u.vec_id
"""

NOISY_SQL = OP4_SQL.replace("FROM embeddings\n", """FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings
    UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + (vec_id % 10) / 10.0 * ((vec_id + i - 1) % 3 - 1))) FROM embeddings)
""")

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM pos WHERE i + 49 <= len(ws)
), low AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE doc_id > first_doc),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM bad, (SELECT unnest(range(0, 50)) AS k)),
kept AS (
  SELECT pos.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN ws[pos.i] END, ' ' ORDER BY pos.i) AS t, count(gone.i) AS n
  FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.i = pos.i GROUP BY pos.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = """
WITH sized AS (
  SELECT source, CAST(sum(greatest(coalesce(n_chars, 0), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, sqrt(size) AS weight, sum(size) OVER () AS all_size, sum(sqrt(size)) OVER () AS all_weight FROM sized
), rated AS (
  SELECT source, CASE WHEN size > 0 THEN weight / all_weight * all_size / size ELSE 0 END AS rate FROM weighted
), drawn AS (
  SELECT d.*, rate, CAST(ceil(rate + 12 * sqrt(rate)) AS BIGINT) + 16 AS most,
    CAST(CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source WHERE rate > 0
), counted AS (
  SELECT *, unnest(list_filter(range(1, most), lambda n: u >= list_sum(list_transform(range(0, n), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1)))))) AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy FROM counted
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
walk(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT v.a, l.b FROM walk v JOIN links l ON l.a = v.b),
low AS (SELECT a, min(b) AS c FROM walk GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN low ON low.a = doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d
), g AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS ph, count(*) AS c
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m) GROUP BY ALL
), f AS (SELECT *, string_split(ph, ' ') AS w FROM g WHERE c >= 30),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
cut AS (
  SELECT q.lang, q.ph, q.m, a, k, x.c AS l, y.c AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.c + y.c) AS BIGINT) AS score
  FROM (SELECT lang, ph, m, c AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM f)) q
  JOIN f x ON x.lang = q.lang AND x.ph = lp JOIN f y ON y.lang = q.lang AND y.ph = rp
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS ph, max(c) AS most
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM f WHERE m > 2)) GROUP BY ALL
), ok AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.ph = b.ph WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM ok)
SELECT lang, rank, ph AS phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), ruled AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM told, crc
), r AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM ruled)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS x,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS is_cut FROM r
), f AS (
  SELECT *, CASE WHEN is_blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN is_cut THEN 'truncated' ELSE '' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM o
), ins(a, b, c, e) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')
), step(x, a, b) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), op AS (
  SELECT x.x, fault, a, a AS b, 3 AS c, 'D' AS e FROM (VALUES ('s'), ('u'), ('a'), ('o')) x(x), (VALUES ('blank'), ('duplicate'), ('truncated'), ('')) y(fault), range(4) z(a)
  UNION ALL SELECT x, fault, a, b, c, 'K' FROM step, (VALUES ('truncated', 1), ('', 0)) y(fault, c)
  UNION ALL SELECT x.x, fault, a, b, c, 'R' FROM step, (VALUES ('truncated', 3), ('', 2)) y(fault, c), (VALUES ('s'), ('u'), ('a'), ('o')) x(x) WHERE step.x <> 's'
), move AS (SELECT op.x, fault, ins.a, op.b, ins.c + op.c AS c, ins.e || op.e AS e FROM ins JOIN op ON ins.b = op.a
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, '00000000' AS v FROM o
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, CAST(move.b AS BIGINT), min(lpad(CAST(CAST(substr(v, 1, 8) AS BIGINT) + move.c AS VARCHAR), 8, '0') || substr(v, 9) || move.e)
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i JOIN move ON move.a = dp.a AND move.x = f.x AND move.fault = f.fault GROUP BY ALL
), told_by AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id
), won AS (
  SELECT d.conv_id, min(lpad(CAST(CAST(substr(v, 1, 8) AS BIGINT) + ins.c AS VARCHAR), 8, '0') || substr(v, 9) || ins.e) AS v
  FROM told_by t JOIN dp d ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.i = t.n JOIN ins ON ins.a = d.a AND ins.b IN (0, 3) GROUP BY d.conv_id
), letters AS (
  SELECT conv_id, k, substr(v, 8 + k, 1) AS e, count(*) FILTER (substr(v, 8 + k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS ri FROM (SELECT *, unnest(range(1, length(v) - 7)) AS k FROM won)
), outs AS (
  SELECT l.conv_id, k, e, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) - 1 AS p
  FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.ri - 1 AND e <> 'I' WHERE e <> 'D'
), sys AS (SELECT conv_id, max(CASE WHEN p = 0 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) AS s FROM outs GROUP BY conv_id),
said AS (
  SELECT outs.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS h
  FROM outs JOIN sys ON sys.conv_id IS NOT DISTINCT FROM outs.conv_id GROUP BY outs.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(substr(v, 1, 8), '0') AS BIGINT) AS cost, coalesce(substr(v, 9), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told_by t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS i FROM again, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
f AS (
  SELECT doc_id, ws, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(ls)
    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) < 8 * n_words
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[•●▪*-]|(\.\.\.|…)[ \t\r]*$'))) > 9 * len(ls)) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "noisy_vectors": NOISY_SQL, "op5_topk": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op8_minhash": OP8_SQL,
        "op11_phrases": OP11_SQL, "op12_repair": OP12_SQL, "op13_quality": OP13_SQL,
    }
