"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, importance, kneser, mixing, near, pieces, pii, rarity, ring, secrets, suffixes, topk, turns, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality(table(spark, sf_dir, "documents"))


def op3_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), root)
    return warc.read_index(spark, root)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ring.bounded_ring(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_mix(table(spark, sf_dir, "documents")).drop("row_key")


def op10_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents")).drop("ids")


def op11_rarity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity.fingerprints(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_bootstrap, op2_kneser_ney, op3_topk_histogram, op4_warc_archive, op5_suffix_dedup, op6_bounded_ring, op7_secret_ownership, op8_minmax_dedup, op9_temperature_mix, op10_viterbi_pieces, op11_rarity_digest, op12_turn_repair, op13_importance_resample)
}

# CRC-32 by its definition: the table of its 256 remainders, and macros that fold a value's bytes through it.
CRC = """
        remainders(i, k, v) AS (
          SELECT i, 0, i FROM range(256) AS r(i)
          UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM remainders WHERE k < 8),
        crc_table AS (SELECT list(v ORDER BY i) AS t FROM remainders WHERE k = 8)"""


def crc(value: str) -> str:
    """SQL for the unsigned CRC-32 of a string's bytes; crc_table's t must be in scope."""
    data = f"list_transform(range(0, octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def up(state: str, cost: int | str, letter: str, allowed: str = "true") -> str:
    """SQL for a state (its cost in nine digits, then its audit) after one more edit, null where that isn't allowed."""
    return f"CASE WHEN {allowed} THEN lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}' END"


ORACLE: dict[str, str] = {
    "op3_topk_histogram": """
        WITH whole AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op4_warc_archive": """
        WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        named AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM rows)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM named""",
    "op12_turn_repair": f"""
        WITH RECURSIVE {CRC},
        source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        fated AS (SELECT *, {crc("name")} % 20 AS fate FROM source, crc_table),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, sha256(text) AS place, copy,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM fated, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS c(copy) WHERE fate <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, place, copy) AS pos, role[1] AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged),
        flagged AS (
          SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
          FROM placed),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
          FROM flagged GROUP BY conv_id),
        folded(conv_id, pos, s0, s1, s2, s3) AS (
          SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM flagged
          UNION ALL
          SELECT conv_id, pos, {up("s0", 4, "D")}, least({up("s1", 4, "D")}, {up("s0", "more", "K", "live AND initial = 's'")}),
            least({up("u", 4, "D")}, {up("s0", "more", "K", "live AND initial = 'u'")}, {up("s1", "more", "K", "live AND initial = 'u'")}, {up("a", "more", "K", "live AND initial = 'u'")}, {up("s0", "more + 3", "R", "live")}, {up("s1", "more + 3", "R", "live")}, {up("a", "more + 3", "R", "live")}),
            least({up("a", 4, "D")}, {up("u", "more", "K", "live AND initial = 'a'")}, {up("u", "more + 3", "R", "live")})
          FROM (
            SELECT *, least(s3, {up("u", 3, "I")}) AS a
            FROM (
              SELECT f.conv_id, f.pos, f.initial, s0, s1, s3, f.fault NOT IN ('b', 'd') AS live, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END AS more,
                least(s2, {up("s0", 3, "I")}, {up("s1", 3, "I")}, {up("s3", 3, "I")}) AS u
              FROM folded p JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1))),
        best AS (
          SELECT conv_id, least(s0, s3, {up("least(s2, " + up("s0", 3, "I") + ", " + up("s1", 3, "I") + ")", 3, "I")}) AS b
          FROM folded JOIN counts USING (conv_id) WHERE pos = n),
        letters AS (SELECT conv_id, k, substr(b, 9 + k::INT, 1) AS letter FROM (SELECT conv_id, b, unnest(range(1, length(b) - 8)) AS k FROM best)),
        numbered AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM letters),
        matched AS (
          SELECT n.conv_id, n.k, n.letter, f.role, f.text, count(*) FILTER (n.letter <> 'D' AND NOT (n.letter = 'K' AND f.initial = 's')) OVER (PARTITION BY n.conv_id ORDER BY n.k) AS spoken
          FROM numbered n JOIN flagged f ON f.conv_id = n.conv_id AND f.pos = greatest(n.pos, 1)),
        lines AS (SELECT conv_id, k, CASE WHEN letter = 'K' THEN role WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM matched WHERE letter <> 'D'),
        texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS repaired FROM lines GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(substr(b, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(b, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN texts USING (conv_id)""",
    "op13_importance_resample": f"""
        WITH RECURSIVE {CRC},
        texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS key, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
        listed AS (SELECT side, doc_id, key, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
        each AS (SELECT side, key, i, k, array_to_string(ws[i : i + k - 1], ' ') AS feature FROM listed, unnest(range(1, len(ws) + 1)) AS a(i), unnest([1, 2, 3]) AS b(k) WHERE i + k - 1 <= len(ws)),
        named AS (SELECT feature, {crc("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM each), crc_table),
        found AS (SELECT side, key, bucket, count(*) AS n FROM each JOIN named USING (feature) GROUP BY ALL),
        totals AS (SELECT b AS bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) AS r(b) LEFT JOIN found ON bucket = b GROUP BY b),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM totals),
        weighed AS (SELECT key, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY key),
        scored AS (
          SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM listed LEFT JOIN weighed USING (key) WHERE side = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM ranked""",
}
