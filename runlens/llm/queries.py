"""The ten operators as queries over whole tables, and the SQL that checks them.

Operators without SQL here (tokenizers, learned weights, suffix names, hash placement) are
checked against brute force in the tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    conversation_repair,
    decontamination,
    jaccard_join,
    merkle,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
    url_filters,
)
from runlens.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

SHARDS = [f"shard-{i:03d}" for i in range(256)]
URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_shared_folder(spark: SparkSession) -> None:
    """Give a local session without a shared folder one of its own; a cluster has to set it."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))


def query(sql: str | None = None):
    def register(job: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with_shared_folder(spark)
            return job(spark, sf_dir)

        QUERIES[job.__name__] = run
        if sql:
            CHECKS[job.__name__] = sql
        return job

    return register


@query(
    r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL),
links AS (
    SELECT a, b, c = s.n AND c = t.n AS same FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 10 * c >= 8 * (s.n + t.n - c)),
reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links,
       least(d.doc_id, coalesce((SELECT min(b) FROM links WHERE a = d.doc_id AND same), d.doc_id)) AS copy_of
FROM documents d"""
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, files)


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed_on_shards(table(spark, sf_dir, "documents"), SHARDS)


@query(
    r"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
item_windows AS (
    SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
        lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM item_words WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_words AS (
    SELECT doc_id, regexp_extract_all(coalesce(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
doc_windows AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2),
        lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM doc_words, sizes),
found AS (SELECT DISTINCT doc_id, d.i, d.n, item FROM doc_windows d JOIN item_windows t ON t.n = d.n AND t.g = d.g),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names, list(item ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS at FROM doc_words),
windows AS (
    SELECT row_number() OVER () AS wid, item, w[i:i + n - 1] AS ts, n, len(list_distinct(w[i:i + n - 1])) AS n_terms FROM (
        SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
window_terms AS (SELECT wid, item, n, unnest(ts) AS t, unnest(range(n)) AS k FROM windows),
together AS (
    SELECT doc_id, wid FROM (
        SELECT p.doc_id, u.wid, u.n_terms FROM (SELECT DISTINCT doc_id, t FROM places) p
        JOIN (SELECT wid, n_terms, unnest(list_distinct(ts)) AS t FROM windows) u ON u.t = p.t)
    GROUP BY doc_id, wid, n_terms HAVING count(*) = n_terms),
shifted AS (
    SELECT DISTINCT g.doc_id, u.item, u.wid, u.n, u.k, unnest(range(p.at - u.k - 2, p.at - u.k + 3)) AS start
    FROM together g JOIN window_terms u ON u.wid = g.wid JOIN places p ON p.doc_id = g.doc_id AND p.t = u.t),
near AS (
    SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item, wid, start FROM shifted GROUP BY doc_id, item, wid, start HAVING count(*) = any_value(n))
    UNION SELECT DISTINCT doc_id, item FROM found),
near_items AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names FROM near GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near_names, '')) AS near_items_sha256
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)"""
)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    near = F.sha2(F.array_join(F.array_sort("near_items"), ","), 256).alias("near_items_sha256")
    return found.select("*", near).drop("items", "near_items")


@query(
    r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
           unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM words),
repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows
        WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM windows GROUP BY doc_id, g HAVING count(*) > 1)) GROUP BY doc_id),
base AS (
    SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines
    FROM words LEFT JOIN repeated USING (doc_id)),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
           OR 5 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > n_words
           OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars AS broken
    FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT broken AS kept FROM judged"""
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A session that names a cache does not encode again what it holds. Without one a run starts cold, so that
    # what is measured of it includes the encoding.
    cache = spark.conf.get("spark.runlens.tokenCache", None) or f"{shared_folder(spark)}/llm/token-counts-{uuid.uuid4().hex}"
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache)


@query(
    r"""
WITH RECURSIVE tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(<(?:link|meta)\s[^>]*>)', 1, 'is')) AS tag FROM pages WHERE url IS NOT NULL),
found AS (
    SELECT url, tag,
           regexp_extract(tag, '[\s"'']rel\s*=\s*["'']?([^\s"''>]*)', 1, 'is') AS rel,
           regexp_extract(tag, '[\s"'']href\s*=\s*["'']?([^\s"''>]*)', 1, 'is') AS href,
           regexp_extract(tag, '[\s"'']http-equiv\s*=\s*["'']?([^\s"''>]*)', 1, 'is') AS equiv,
           regexp_extract(tag, '[\s"'']content\s*=\s*["'']?\s*\d+\s*[;,]\s*url\s*=\s*["'']?([^"''>]+)', 1, 'is') AS target FROM tags),
raw AS (
    SELECT url, CASE WHEN regexp_matches(tag, '^<link', 'i') THEN CASE WHEN lower(rel) = 'canonical' THEN href END
                     WHEN lower(equiv) = 'refresh' THEN trim(target) END AS link FROM found),
edges AS (
    SELECT DISTINCT url AS a, CASE WHEN contains(link, '://') THEN link
        WHEN starts_with(link, '//') THEN concat(regexp_extract(url, '^([^:]*):', 1), ':', link)
        WHEN starts_with(link, '/') THEN concat(regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's'), link) END AS b
    FROM raw WHERE link <> ''),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (
    SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
urls AS (SELECT url FROM pages UNION SELECT a FROM both_ways),
places AS (
    SELECT url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM urls),
rules(rule, verdict, rhost, rpath) AS (
    VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
           ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
own AS (
    SELECT url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM places LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY url, host, path),
passed AS (
    SELECT r.a AS url, CASE WHEN bool_or(o.verdict = 'allow') THEN 'allow' WHEN bool_or(o.verdict = 'block') THEN 'block' END AS v,
           min(r.b) AS alias_of FROM reach r JOIN own o ON o.url = r.b GROUP BY r.a)
SELECT page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule, coalesce(o.verdict, v, 'allow') AS verdict, alias_of
FROM pages p LEFT JOIN own o ON o.url = p.url LEFT JOIN passed a ON a.url = p.url"""
)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"), url_filters.rules_from(URL_RULES))


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"), damage=True).report


@query(
    r"""
WITH RECURSIVE rows AS (
    SELECT doc_id, n_chars, coalesce('=' || lang, '') AS tree, concat(
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
        xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, c:
            list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(s, c)), 4294967295), 4294967295) AS crc
    FROM documents),
hashed AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed, crc FROM rows),
leaves AS (
    SELECT doc_id, tree, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS start,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
levels AS (
    SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY tree
    UNION ALL
    SELECT tree, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM levels WHERE len(nodes) > 1),
subroots AS (
    SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM levels WHERE len(nodes) = 1),
top_levels AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM top_levels WHERE len(nodes) > 1),
steps AS (
    SELECT l.tree, l.place, v.level, l.place >> v.level AS own, v.nodes FROM leaves l JOIN levels v ON v.tree = l.tree AND len(v.nodes) > 1
    UNION ALL
    SELECT l.tree, l.place, 1000 + v.level, s.place >> v.level, v.nodes
    FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top_levels v ON len(v.nodes) > 1),
path AS (
    SELECT tree, place, row_number() OVER (PARTITION BY tree, place ORDER BY level) AS k, own % 2 = 1 AS sibling_first,
           coalesce(nodes[xor(own, 1) + 1], '') AS sibling FROM steps),
proofs AS (SELECT tree, place, string_agg(sibling, '' ORDER BY k) AS proof, count(*) AS n FROM path GROUP BY tree, place),
folds AS (
    SELECT tree, place, 0 AS k, start AS h FROM leaves
    UNION ALL
    SELECT f.tree, f.place, f.k + 1, sha256(CASE WHEN sibling_first THEN sibling || h ELSE h || sibling END)
    FROM folds f JOIN path p ON p.tree = f.tree AND p.place = f.place AND p.k = f.k + 1)
SELECT l.doc_id, l.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.nodes[1] AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top_levels r ON len(r.nodes) = 1
LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.place
JOIN folds f ON f.tree = l.tree AND f.place = l.place AND f.k = coalesce(p.n, 0)"""
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=tampered).drop("proof")
