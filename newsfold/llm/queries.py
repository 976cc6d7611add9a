"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, exact_dedup, filter_audit, langid, line_dedup, minhash, mixing, phrases, quality, secrets, sharding, url_filter

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), langid.read_pieces(public_tokenizers.path(PIECES)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_links(_table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_minhash, op3_secrets, op4_exact_dedup, op5_mixing, op6_quality, op7_langid, op8_sharding, op9_url_filter, op10_embedding_dedup,
        op11_line_dedup, op12_filter_audit, op13_phrases,
    )
}

#: Only results that SQL can give from the same tables; the others are tested against brute force.
ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op2_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id WHERE a.sh IN (SELECT sh FROM c) GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r(id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.comp FROM r JOIN b ON b.x = r.id)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.comp) AS component_id, d.doc_id = min(r.comp) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(id, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.id),
        k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
        SELECT m.vec_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links, min(r.comp) AS component_id, m.vec_id = min(r.comp) AS kept
        FROM embeddings m JOIN r ON r.id = m.vec_id LEFT JOIN k ON k.x = m.vec_id GROUP BY m.vec_id
    """,
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.doc_id, line, pos, c.key IS NOT NULL AND k.doc_id <> c.keeper AS goes FROM k LEFT JOIN c ON c.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        f AS (
            SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
                + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
        c AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
            FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, mask),
        x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a JOIN x b ON b.bit <> a.bit
            JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
        s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit, unnest([CAST(list_sum(bits[1:i]) - bits[i] AS INT) FOR i IN [1, 2, 3, 4, 5]]) AS before FROM o),
        r AS (
            SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
                sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
            FROM s CROSS JOIN c GROUP BY ALL)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
            CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
            CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r
    """,
    "op13_phrases": r"""
        WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (
            SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
        n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
        c AS (
            SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        s AS (
            SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        h AS (
            SELECT lang, pair, max(a) AS most FROM (SELECT lang, a, unnest([split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3)]) AS pair FROM b WHERE k = 3)
            GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(phrase)) AS rank, phrase, b.a, l, r, n.n, score
        FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON h.lang = b.lang AND h.pair = b.phrase WHERE h.most IS NULL OR 100 * h.most < 50 * b.a QUALIFY rank <= 2000
    """,
}
