"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify, learn

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curriculum_mix import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.orderBy("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binpack import pack

    return pack(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle_manifest import audited

    return audited(_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_qda import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_secret_scan, op4_language_id, op5_toxicity, op6_pii, op7_exact_dedup, op8_suffix_array_dedup, op9_curriculum_mix, op10_best_fit_packing, op11_filter_audit, op12_merkle_manifest, op13_quality_classifier)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram
            FROM w WHERE len(words) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        pairs AS (
            SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE c >= 0.8 * (x.n + y.n - c)
        ), reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen),
        parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n, min(b) FILTER (WHERE same) AS twin FROM pairs GROUP BY a)
        SELECT d.doc_id, least(d.doc_id, coalesce(c.twin, d.doc_id)) AS class_id, p.component_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, d.doc_id = p.component_id AS kept
        FROM documents d LEFT JOIN counts c ON c.a = d.doc_id LEFT JOIN parts p ON p.node = d.doc_id
    """,
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id AS node, vec_id AS seen FROM embeddings
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
        ), parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
        FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN parts p ON p.node = e.vec_id
    """,
    "op8_suffix_array_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        s AS (SELECT doc_id, unnest(list_transform(range(0, len(words) - 49), lambda i: {'place': i, 'said': array_to_string(words[i + 1:i + 50], ' ')}), recursive := true) FROM w),
        h AS (SELECT said, min(doc_id) AS holder FROM s GROUP BY said HAVING min(doc_id) <> max(doc_id)),
        m AS (SELECT doc_id, place, holder = doc_id AS is_first FROM s JOIN h USING (said)),
        o AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id, is_first ORDER BY place) + 50 THEN 0 ELSE 1 END AS opens FROM m),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, is_first ORDER BY place) AS island FROM o)
        SELECT doc_id, CAST(min(place) AS INT) AS start_word, CAST(max(place) + 50 AS INT) AS end_word, CAST(max(place) + 50 - min(place) AS INT) AS n_words, is_first AS "first"
        FROM i GROUP BY doc_id, is_first, island
    """,
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS words FROM d),
        firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
        f AS (
            SELECT w.doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
                + (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
                + (CASE WHEN w.doc_id > firsts.first THEN 16 ELSE 0 END) AS fails
            FROM w JOIN firsts ON firsts.t = w.t
        ), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad
            FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, fails
        ), letters AS (SELECT substr('ABCDE', CAST(i AS INT) + 1, 1) AS x, CAST(1 << i AS INT) AS bit FROM range(0, 5) t(i)),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), steps AS (
            SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS gone FROM orders, range(1, 6) t(s)
        ), played AS (SELECT *, fails & bit > 0 AS failed, fails & gone > 0 AS earlier FROM c, steps),
        said AS (
            SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE NOT failed AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE failed AND NOT earlier), 0) AS removed,
                coalesce(sum(n) FILTER (WHERE failed AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
                coalesce(sum(good) FILTER (WHERE failed AND NOT earlier), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE failed AND NOT earlier), 0) AS toxic_lost
            FROM played GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM said
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, text,
                list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(1, 9) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) AS crc,
                concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS front
            FROM documents
        ), h AS (
            SELECT doc_id, tree, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(bare) || ':' || bare, '-')) AS altered
            FROM (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS bare FROM d)
        ), leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h),
        n AS (
            SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM leaves
            UNION ALL
            SELECT tree, any_value(level) + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(width) + 2) // 3
            FROM n WHERE width > 1 GROUP BY tree, place // 3
        ), tops AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM n WHERE width = 1),
        u AS (
            SELECT 0 AS level, place, subroot AS digest, (SELECT count(*) FROM tops) AS width FROM tops
            UNION ALL
            SELECT any_value(level) + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(width) + 2) // 3 FROM u WHERE width > 1 GROUP BY place // 3
        ), s AS (
            SELECT tree, level, place, coalesce(string_agg(digest, '' ORDER BY place) OVER before, '') AS before, coalesce(string_agg(digest, '' ORDER BY place) OVER after, '') AS after
            FROM n WHERE width > 1 WINDOW before AS (PARTITION BY tree, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (PARTITION BY tree, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        ), v AS (
            SELECT level, place, coalesce(string_agg(digest, '' ORDER BY place) OVER before, '') AS before, coalesce(string_agg(digest, '' ORDER BY place) OVER after, '') AS after
            FROM u WHERE width > 1 WINDOW before AS (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        ), up AS (
            SELECT tree, place AS origin, 0 AS level, place, altered AS digest, '' AS said FROM leaves
            UNION ALL
            SELECT p.tree, origin, p.level + 1, p.place // 3, sha256(before || digest || after), said || before || after
            FROM up p JOIN s ON s.tree = p.tree AND s.level = p.level AND s.place = p.place
        ), middle AS (SELECT p.tree, origin, t.place, digest, said FROM up p JOIN tops t ON t.tree = p.tree AND t.height = p.level),
        high AS (
            SELECT tree, origin, 0 AS level, place, digest, said FROM middle
            UNION ALL
            SELECT p.tree, origin, p.level + 1, p.place // 3, sha256(before || digest || after), said || before || after FROM high p JOIN v ON v.level = p.level AND v.place = p.place
        ), root AS (SELECT digest AS root, level FROM u WHERE width = 1)
        SELECT l.doc_id, l.leaf, t.subroot, r.root, sha256(p.said) AS proof_sha256, p.digest AS folded_root, p.digest = r.root AS verified
        FROM high p JOIN root r ON r.level = p.level JOIN leaves l ON l.tree = p.tree AND l.place = p.origin JOIN tops t ON t.tree = p.tree
    """,
}
