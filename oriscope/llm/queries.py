"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.llm import bpe, collocations, conversations, exact_dedup, langid, mixing, ngram_join, nn_descent, secret_scan, sharding, substrings, url_rules, warc

#: The explicit URL rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARD_BYTES = 4 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of toxic or poor quality are the labelled bad ones, by their id."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(bad, "block").when(F.col("toxic").isNotNull(), "allow").alias("label"))
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_read(spark, sf_dir, "documents"), size=3, threshold=0.9)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_neighbours(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0).drop("copies")


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"), least_revisit=0, with_payload=False).drop("url")


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), tokenizer_path(), fields=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op8_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_read(spark, sf_dir, "documents"))


def op9_secret_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents")).drop("found")


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op11_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=30, top=2000, subsumed=80)


def op12_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_spans(_read(spark, sf_dir, "documents"), window=50, with_text=False)


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_rules, op2_ngram_join, op3_nn_descent, op4_pivotal_mix, op5_warc_normaliser, op6_trie_bpe, op7_extendible_shards, op8_rank_order_langid, op9_secret_lexer, op10_bloom_dedup, op11_stripes_collocations, op12_relative_lz, op13_hirschberg_repair)}


ORACLE = {
    "op5_warc_normaliser": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS h FROM p),
        g AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST))
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN nth = 1 THEN NULL ELSE first END AS refers_to
        FROM g""",
    "op7_extendible_shards": f"""
        WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
            CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
        x AS (SELECT k.*, d, h >> (60 - d) AS prefix FROM k, (SELECT CAST(range AS BIGINT) AS d FROM range(0, 60))),
        s AS (SELECT doc_id, n_bytes, d, prefix, sum(n_bytes) OVER (PARTITION BY d, prefix) AS b FROM x),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS nth FROM s WHERE b <= {SHARD_BYTES})
        SELECT doc_id, n_bytes, CAST(d AS INTEGER) AS shard_depth, prefix AS shard_prefix, CAST(0 AS BIGINT) AS page, CAST(b AS BIGINT) AS shard_bytes
        FROM f WHERE nth = 1""",
    "op10_bloom_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS nth FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM g""",
    "op11_stripes_collocations": r"""
        WITH p AS (SELECT lang, d, row_number() OVER () AS piece, list_filter(string_split(x, ' '), lambda w: w <> '') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, phrase, a, k AS size, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        x AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score, c.k FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, c.k), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, c.k + 1, size), ' ')),
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        t AS (SELECT c.lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < size) c GROUP BY ALL),
        k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase WHERE most IS NULL OR 100 * most < 80 * a)
        SELECT k.lang, CAST(rank AS BIGINT) AS rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000""",
    "op12_relative_lz": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        h AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN sha256(array_to_string(list_slice(w, i, i + 49), ' ')) END AS h FROM x),
        m AS (SELECT h, min(doc_id) AS least FROM h WHERE h IS NOT NULL GROUP BY h),
        g AS (SELECT h.r, h.i, h.word, max(CASE WHEN least < coalesce(h.doc_id, 9223372036854775807) THEN 1 ELSE 0 END) OVER (PARTITION BY h.r ORDER BY h.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN m ON m.h = h.h),
        k AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY r)
        SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r""",
    "op13_hirschberg_repair": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        c AS (SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))) % 20 AS kind FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        o AS (SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM n),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'ok' ELSE 'truncated' END AS fault FROM o),
        g AS (SELECT *, fault IN ('ok', 'truncated') AS can, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more,
            chr(10) || role || ':' || text AS keep, chr(10) || 'user:' || text AS usr, chr(10) || 'assistant:' || text AS asst, chr(10) || 'user:' AS iu, chr(10) || 'assistant:' AS ia FROM f),
        walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 't': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1,
            CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t},
                list_min(list_filter([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, CASE WHEN can AND r = 's' THEN {'c': s0.c + more, 'a': s0.a || 'K', 't': s0.t || keep} END], lambda x: x.c IS NOT NULL)),
                list_min(list_filter([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}, CASE WHEN can THEN {'c': s2.c + 6 + more, 'a': s2.a || 'IR', 't': s2.t || ia || usr} END,
                    CASE WHEN can AND r = 'u' THEN {'c': s2.c + 3 + more, 'a': s2.a || 'IK', 't': s2.t || ia || keep} END]
                    || list_transform([s0, s1, s3], lambda x: CASE WHEN can THEN {'c': x.c + 3 + more, 'a': x.a || 'R', 't': x.t || usr} END)
                    || list_transform([s0, s1, s3], lambda x: CASE WHEN can AND r = 'u' THEN {'c': x.c + more, 'a': x.a || 'K', 't': x.t || keep} END), lambda x: x.c IS NOT NULL)),
                list_min(list_filter([{'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t}, CASE WHEN can THEN {'c': s2.c + 3 + more, 'a': s2.a || 'R', 't': s2.t || asst} END,
                    CASE WHEN can AND r = 'a' THEN {'c': s2.c + more, 'a': s2.a || 'K', 't': s2.t || keep} END]
                    || list_transform([s0, s1, s3], lambda x: CASE WHEN can THEN {'c': x.c + 6 + more, 'a': x.a || 'IR', 't': x.t || iu || asst} END)
                    || list_transform([s0, s1, s3], lambda x: CASE WHEN can AND r = 'a' THEN {'c': x.c + 3 + more, 'a': x.a || 'IK', 't': x.t || iu || keep} END), lambda x: x.c IS NOT NULL))
            FROM (SELECT w.conv_id, g.i, w.s0, w.s1, w.s2, w.s3, g.r, g.can, g.more, g.keep, g.usr, g.asst, g.iu, g.ia FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1)),
        last AS (SELECT conv_id, list_min(list_filter([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
            {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) AS best
            FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
            CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
        FROM last l LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM l.conv_id""",
}
