"""The registered queries ``opN_<name>`` and, where SQL can express them, their SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, bpe_fst, exact_dedup, langid, license_scan, merkle, near_dedup, packing, periodic, pii, quality, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), size=bpe.count("text", public_tokenizers.path("byte_bpe_50k.json")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return license_scan.scan_licences(_table(spark, sf_dir, "documents")).select(*columns)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_language": op1_language, "op2_warc": op2_warc, "op3_quality": op3_quality, "op4_exact_dedup": op4_exact_dedup, "op5_neighbours": op5_neighbours, "op6_pii": op6_pii, "op7_near_dedup": op7_near_dedup, "op8_packing": op8_packing, "op9_bpe": op9_bpe, "op10_licences": op10_licences, "op11_periodic": op11_periodic, "op12_byte_bpe": op12_byte_bpe, "op13_merkle": op13_merkle}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of an id's digits, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR) || ':' || ({column})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN last END AS refers_to
        FROM m""",
    "op7_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLDED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_exact_dedup": f"""
        WITH folded AS (SELECT doc_id, {_FOLDED} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY body)""",
    "op13_merkle": f"""
        WITH RECURSIVE l AS (
            SELECT doc_id, source, row_number() OVER () AS id, {_leaf("text")} AS leaf,
                   CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
            FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        u AS (
            SELECT 0 AS level, source, pos, leaf AS d, n FROM p
            UNION ALL
            SELECT level + 1, source, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, source, pos // 16, n),
        s AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM u WHERE n = 1),
        t AS (
            SELECT 0 AS level, pos, subroot AS d, n FROM s
            UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY level, pos // 16, n),
        f AS (
            SELECT 0 AS level, id, source, pos, n, coalesce(changed, leaf) AS d, '' AS proof FROM p
            UNION ALL
            SELECT f.level + 1, f.id, f.source, f.pos // 16, (f.n + 15) // 16,
                   sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.d ELSE u.d END, '' ORDER BY u.pos)),
                   f.proof || coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos <> f.pos), '')
            FROM f JOIN u ON u.level = f.level AND u.source IS NOT DISTINCT FROM f.source AND u.pos // 16 = f.pos // 16
            WHERE f.n > 1 GROUP BY f.level, f.id, f.source, f.pos, f.n, f.d, f.proof),
        g AS (
            SELECT 0 AS level, f.id, s.pos, s.n, f.d, f.proof FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
            UNION ALL
            SELECT g.level + 1, g.id, g.pos // 16, (g.n + 15) // 16,
                   sha256(string_agg(CASE WHEN t.pos = g.pos THEN g.d ELSE t.d END, '' ORDER BY t.pos)),
                   g.proof || coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos <> g.pos), '')
            FROM g JOIN t ON t.level = g.level AND t.pos // 16 = g.pos // 16
            WHERE g.n > 1 GROUP BY g.level, g.id, g.pos, g.n, g.d, g.proof)
        SELECT l.doc_id, l.leaf, s.subroot, r.d AS root, sha256(g.proof) AS proof_sha256, g.d AS folded_root, g.d = r.d AS verified
        FROM l JOIN g ON g.id = l.id AND g.n = 1 JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT d FROM t WHERE n = 1) r""",
}
