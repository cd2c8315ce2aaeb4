"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm.common import table
from prosemill.llm.exact import exact_groups
from prosemill.llm.minhash import near_duplicates
from prosemill.llm.mixing import mix_sources
from prosemill.llm.packing import pack_documents
from prosemill.llm.quality_rules import apply_quality_rules
from prosemill.llm.ranking import learn, score_documents
from prosemill.llm.secrets import find_secrets
from prosemill.llm.sstable import token_tables
from prosemill.llm.token_counts import count_tokens
from prosemill.llm.url_rules import judge_urls

#: The rule list of the query op5.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return apply_quality_rules(table(spark, sf_dir, "documents"), trusted)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pack_sequences": op2_pack_sequences,
    "op3_token_counts": op3_token_counts,
    "op4_mix_sources": op4_mix_sources,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_ranking": op7_quality_ranking,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_tables": op10_token_tables,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM placed),
        sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS content FROM sets GROUP BY doc_id),
        meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM meet JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node AND r.root < e.b),
        lowest AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept,
               CASE WHEN n IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY content) END AS class_id
        FROM documents JOIN lowest ON node = doc_id LEFT JOIN sizes USING (doc_id)
    """,
    "op4_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
                   md5('17' || coalesce(':' || doc_id, '')) AS h
            FROM documents
        ),
        per AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
        weighed AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS weight FROM per),
        -- The level at which everything is shared is the highest that any set of capped sources gives.
        levels AS (SELECT ((SELECT sum(source_size) FROM per) - coalesce(sum(o.cap) FILTER (o.cap / o.weight < w.cap / w.weight), 0)) / sum(o.weight) FILTER (o.cap / o.weight >= w.cap / w.weight) AS level
            FROM weighed w, weighed o GROUP BY w.skey),
        targets AS (SELECT skey, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target, CAST('0x' || substr(md5('17:' || skey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS o FROM weighed),
        classed AS (SELECT d.*, source_size, target, o, size * 100 > source_size AS heavy, floor(ln(size + 1) * 6) AS cls FROM d JOIN targets USING (skey)),
        celled AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY skey, heavy, cls) / 1000) AS BIGINT) AS bucket FROM classed),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY skey, heavy ORDER BY cls, bucket, size, h, doc_id) AS k FROM celled),
        drawn AS (
            SELECT skey, sum(size) AS size, sum((floor(k * (target / source_size) + o) - floor((k - 1) * (target / source_size) + o)) * size) AS words FROM ranked WHERE heavy GROUP BY skey
        ),
        rated AS (
            SELECT r.*, CASE WHEN heavy THEN target / source_size
                ELSE coalesce(least(3, greatest(0, (target - coalesce(words, 0)) / nullif(source_size - coalesce(n.size, 0), 0))), 0) END AS rate
            FROM ranked r LEFT JOIN drawn n USING (skey)
        ),
        copied AS (SELECT *, CAST(least(3, floor(k * rate + o) - floor((k - 1) * rate + o)) AS BIGINT) AS copies FROM rated)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
    """,
    "op5_url_filter": r"""
        WITH parsed AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '[0-9]+', '#', 'g') AS query,
                   regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://[^#]*#(.*)', 1), ''), '[0-9]+', '#', 'g') AS fragment
            FROM pages
        ),
        listed(site, below, rule, says) AS (
            VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
                   ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')
        ),
        fits AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM parsed JOIN listed ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, below)
            GROUP BY page_id
        ),
        base AS (SELECT parsed.*, rule, says, string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.') AS labels FROM parsed LEFT JOIN fits USING (page_id)),
        raw AS (
            SELECT page_id, 'tld=' || labels[-1] AS token FROM base WHERE labels[-1] <> ''
            UNION SELECT page_id, 'host=' || x FROM (SELECT page_id, unnest(labels[:-2]) AS x FROM base) WHERE x <> ''
            UNION SELECT page_id, 'dir=' || x FROM (SELECT page_id, unnest(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')) AS x FROM base) WHERE x <> ''
            UNION SELECT page_id, 'arg=' || split_part(x, '=', 1) FROM (SELECT page_id, unnest(string_split_regex(query, '[&;]')) AS x FROM base) WHERE split_part(x, '=', 1) <> ''
            UNION SELECT page_id, 'fragment=' || fragment FROM base WHERE fragment <> ''
        ),
        pages_of AS (SELECT token, list(page_id ORDER BY page_id) AS ids FROM raw GROUP BY token),
        total AS (SELECT count(DISTINCT page_id) AS n, greatest(5, ceil(0.0005 * count(DISTINCT page_id))) AS least FROM raw),
        stands AS (SELECT min(token) AS token FROM pages_of, total WHERE len(ids) >= least GROUP BY ids),
        bags AS (SELECT page_id, list(token ORDER BY token) AS own FROM raw JOIN stands USING (token) GROUP BY page_id),
        masks AS (SELECT page_id, own, unnest(range(1, 1 << len(own))) AS mask FROM bags),
        subsets AS (SELECT page_id, list_filter(own, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM masks),
        counted AS (SELECT items, count(*) AS n FROM subsets GROUP BY items),
        mined AS (
            SELECT items, says AS said, count(*) AS k, count(*) / any_value(n)::DOUBLE AS confidence FROM subsets JOIN base USING (page_id) JOIN counted USING (items) WHERE says IS NOT NULL GROUP BY items, says
        ),
        rules AS (SELECT mined.* FROM mined, total WHERE k >= least AND confidence >= 0.6),
        best AS (
            SELECT page_id, said, array_to_string(items, ' ') AS mined_rule FROM subsets JOIN rules USING (items)
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, k DESC, len(items) DESC, array_to_string(items, ' ') DESC) = 1
        )
        SELECT page_id, host, path, rule, coalesce(says, said, 'allow') AS verdict, CASE WHEN rule IS NULL THEN mined_rule END AS mined_rule FROM base LEFT JOIN best USING (page_id)
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
