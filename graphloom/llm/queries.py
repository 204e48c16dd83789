"""The registered queries of the training-data operators; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import films

    return films(table(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of the films."""
    from .media import clips

    return clips(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def exact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persisted index that takes the table in two batches, documents with an even doc_id first; every row is then resolved."""
    from pyspark.sql import functions as F

    from .exact import DigestIndex, own_name

    docs = table(spark, sf_dir, "documents")
    name = own_name()
    early = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    DigestIndex(spark, name).admit(docs.where(early))
    later = DigestIndex(spark, name)  # as another run would open it
    later.admit(docs.where(~early))
    return later.resolve(docs)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")  # the CRC stands for them


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise
    from .substring import cut_passages, digests

    return digests(materialise(cut_passages(table(spark, sf_dir, "documents")), "cut-passages"))  # spans and kept texts are written


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise
    from .suffix import cut_strings, digests

    return digests(materialise(cut_strings(table(spark, sf_dir, "documents")), "cut-strings"))  # spans and kept texts are written


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import RULES, judge, rules_frame

    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, media_clips, op2_minhash, op3_exact, exact_batches, op4_bpe, op5_quality, op6_packing, op7_substring, op8_suffix, op9_pii, op10_urls)}

ORACLE: dict[str, str] = {
    "op3_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "exact_batches": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id % 2 = 0, FALSE) AS early FROM documents),
        k AS (SELECT t, early, max(doc_id) AS keep_id, count(*) AS group_size, row_number() OVER (PARTITION BY t ORDER BY early DESC) AS n FROM d GROUP BY t, early)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN k ON d.t = k.t AND k.n = 1""",
    "op7_substring": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
        h AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM s),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM h) WHERE m < doc_id),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r),
        e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        k AS (SELECT e.doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.j) FILTER (g.j IS NULL) AS kept
              FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op10_urls": """
        WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
                                             ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
        c AS (SELECT b.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS k
              FROM b LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c WHERE k = 1""",
}
