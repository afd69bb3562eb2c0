"""Queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.linedup import drop_boilerplate

    found = drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.octet_length("kept_text").cast("long").alias("kept_bytes"), F.md5("kept_text").alias("kept_md5"))


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.neardup import Rule, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Rule(words=4, percent=80))


def op6_fuzzy_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("notices")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.substrings import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyhouse.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op9_tiktoken_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallyhouse.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhouse.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op3_line_site_spread": """
WITH l AS (SELECT doc_id, source, p, trim(line) AS line FROM (
       SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) x),
s AS (SELECT line, min(struct_pack(d := doc_id, p := p)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
r AS (SELECT doc_id, l.p, l.line, s.line IS NOT NULL AND NOT (first.d = doc_id AND first.p = l.p) AS gone FROM l LEFT JOIN s USING (line))
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(strlen(kept) AS BIGINT) AS kept_bytes, md5(kept) AS kept_md5
FROM (SELECT d.doc_id, a.n_lines, a.n_removed, array_to_string(list_transform(list_filter(generate_series(1, len(string_split(text, chr(10)))), lambda i: NOT list_contains(coalesce(cut, []), i)), lambda i: string_split(text, chr(10))[i]), chr(10)) AS kept
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, list(p) FILTER (gone) AS cut FROM r GROUP BY doc_id) a USING (doc_id)) d""",
        "op5_hyperminhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = d.doc_id""",
        # the checksum byte by byte, by a table of 256
        "op10_byte_sharding": """
WITH b(k, c) AS (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
t AS (SELECT list(c ORDER BY k) AS t FROM b),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM z),
p AS (SELECT doc_id, size, text_crc32, CAST(least(39, before * 40 // total) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    }
