"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, lexical, minhash, mixing, pii, quality, sharding, suffix_dedup, topk, toxicity, warc
from .common import table


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op2_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, d, "documents")).drop("kept")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixture: (doc_id, domain) of labelled documents, their language as the domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = mixing.mix_rates(docs, labelled_domains(docs, table(spark, d, "labels")))
    return found.withColumn("posterior", F.array_join(F.transform("posterior", lambda x: F.format_number(x, 6)), ","))


def op4_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"))


def op5_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


def op6_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the compacted store returns it: doc_id, its size in bytes and the digest of its text."""
    _, rows = sharding.shard(table(spark, d, "documents"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source")


def op7_decontam(spark: SparkSession, d: str) -> DataFrame:
    return decontam.report(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("longest_match")


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"))


def op11_lexical(spark: SparkSession, d: str) -> DataFrame:
    return lexical.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(table(spark, d, "documents"))


def op13_langid(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_mixing, op4_topk, op5_minhash, op6_sharding, op7_decontam, op8_toxicity, op9_quality, op10_pii, op11_lexical, op12_alignment, op13_langid)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": """
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            b AS (SELECT rid, h, unnest(generate_series(0, length(h) // 2 - 1, 1000)) AS base FROM d WHERE length(h) >= 400),
            k AS (SELECT rid, base, substr(h, (2 * base + 1)::BIGINT, 2400) AS part FROM b),
            p AS (SELECT rid, base + i AS pos, md5(substr(part, (2 * i + 1)::BIGINT, 400)) AS g FROM (SELECT rid, base, part, unnest(generate_series(0, least(1000, length(part) // 2 - 199) - 1)) AS i FROM k WHERE length(part) >= 400)),
            r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
            q AS (SELECT rid, pos FROM p SEMI JOIN r ON p.g = r.g),
            o AS (SELECT rid, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS new FROM q),
            z AS (SELECT rid, pos, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM o),
            s AS (SELECT rid, run, min(pos) AS a, max(pos) + 200 AS e FROM z GROUP BY rid, run),
            g AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
            t AS (SELECT g.rid, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head FROM g JOIN d ON g.rid = d.rid GROUP BY g.rid)
            SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
             sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN t ON d.rid = t.rid""",
        "op5_minhash": rf"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
                  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
            c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
            l AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * x.n >= 85 * (ca.n + cb.n - x.n)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
            k AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
            SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
            FROM documents d JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
        "op7_decontam": rf"""
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
            bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
            di AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
            m AS (SELECT rid, bw.n, i, item_id FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = bw.win),
            h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY rid),
            t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid""",
        "op1_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM s)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
            FROM m""",
        "op4_topk": """
            WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
                         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
                  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0 AND len(q.v) = len(c.v)),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op11_lexical": rf"""
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
            s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, coalesce(sum(len(w)), 0)::BIGINT AS l FROM d),
            p AS (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
            f AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
            g AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term),
            k AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM g, s),
            a AS (SELECT DISTINCT qid, item_id, term FROM (SELECT qid, item_id, unnest(w) AS term FROM q)),
            r AS (SELECT qid, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * f.n * s.n) // s.l)))))::BIGINT AS score
                  FROM a JOIN f USING (term) JOIN k USING (term), s GROUP BY qid, item_id, rid, doc_id),
            o AS (SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
            SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
        "op6_sharding": """
            SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256, lang, source FROM documents""",
    }
