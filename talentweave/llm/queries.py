"""Registered queries of the corpus operators, with reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import content_sort, divergence, extraction, fixity, mixing, outliers, packing, quality, retrieval, scoring, sharding, simhash, urls
from talentweave.llm.columns import id_remainder, table
from talentweave.plans.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; it is installed wherever tasks run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_simhash_components")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_groups(docs, keep_text=False)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


@query("op7_attention_scores")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scoring.scored(docs, vocabulary("word_bpe_49k.json"), id_remainder("doc_id", 5) != 1)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


@query("op8_content_sort", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.content_groups(table(spark, folder, "documents"))


@query("op2_lookup_table_sharding", """
    WITH RECURSIVE shards AS (
        SELECT i, printf('shard-%02d', i) AS shard, ('0x' || substr(md5('offset ' || printf('shard-%02d', i)), 1, 15))::BIGINT % 4093 AS start,
               ('0x' || substr(md5('skip ' || printf('shard-%02d', i)), 1, 15))::BIGINT % 4092 + 1 AS step
        FROM range(32) t(i)
    ), turns AS (
        SELECT 0 AS turn, NULL::BIGINT AS slot, NULL::BIGINT AS shard_no, list_transform(range(4093), lambda x: false) AS used
        UNION ALL
        SELECT turn + 1, chosen, i, used[:chosen] || [true] || used[chosen + 2:]
        FROM (
            SELECT turn, used, i, list_filter(list_transform(range(4093), lambda j: (start + j * step) % 4093), lambda s: NOT used[s + 1])[1] AS chosen
            FROM turns JOIN shards ON i = turn % 32 WHERE turn < 4093
        )
    ), slots AS (SELECT slot, shard FROM turns JOIN shards ON i = shard_no)
    SELECT doc_id, slot::INT AS slot, shard
    FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 4093 AS slot FROM documents)
    JOIN slots USING (slot)
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents").select("doc_id"))


@query("op3_url_trust", r"""
    WITH RECURSIVE parsed AS (
        SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
               list_distinct(list_transform(
                   regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1),
                   lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS linked
        FROM pages
    ), rules(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), ruled AS (
        SELECT *, (SELECT max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': verdict}) FROM rules
                   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS won
        FROM parsed
    ), seeds AS (
        SELECT host, kind, avg((coalesce(won.verdict, '') = verdict)::INT) AS score
        FROM ruled, (VALUES ('trust', 'allow'), ('distrust', 'block')) k(kind, verdict) WHERE host <> '' GROUP BY host, kind
    ), edges AS (
        SELECT src, dst, count(*) AS pages FROM (SELECT host AS src, unnest(linked) AS dst FROM parsed)
        WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
    ), ways AS (
        SELECT src AS a, dst AS b, 'trust' AS kind, 0.85 * pages / sum(pages) OVER (PARTITION BY src) AS share FROM edges
        UNION ALL SELECT dst, src, 'distrust', 0.85 * pages / sum(pages) OVER (PARTITION BY dst) FROM edges
    ), rounds AS (
        SELECT 0 AS n, host, kind, score FROM seeds WHERE score > 0
        UNION ALL
        SELECT n + 1, b, kind, sum(share * score)
        FROM (SELECT *, sum(score) OVER (PARTITION BY kind) * 0.85 / (1 - 0.85) AS rest FROM rounds) r JOIN ways USING (kind)
        WHERE a = host AND rest > 1e-6 GROUP BY n, b, kind
    ), scores AS (
        SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
        FROM rounds GROUP BY host
    )
    SELECT page_id, r.host, path, won.rule AS rule,
           coalesce(won.verdict, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled r LEFT JOIN scores s ON r.host = s.host
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judged(table(spark, folder, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


#: The second replica of the audit: of each record a hash of its url decides whether it is whole, altered or lost.
DAMAGE = "substr(md5(coalesce(url, '')), 1, 2)"


@query("op5_merkle_fixity", f"""
    WITH damaged AS (
        SELECT *, CASE WHEN {DAMAGE} = '00' THEN replace(html, '<p>', '<q>') ELSE html END AS altered, {DAMAGE} = '01' AS lost FROM pages
    ), records AS (
        SELECT page_id, 'pages-' || floor(page_id / 512)::BIGINT AS warc_file, lost,
               ['WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(body, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(body, '') || chr(13) || chr(10) || chr(13) || chr(10) FOR body IN [html, altered]] AS record
        FROM damaged
    ), placed AS (
        SELECT *, strlen(record[1]) AS length_a, strlen(record[2]) AS length_b, sha256(record[1]) AS digest_a, sha256(record[2]) AS digest_b,
               coalesce(sum(strlen(record[1])) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
        FROM records
    )
    SELECT warc_file, place::BIGINT AS "offset", CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status, length_a,
           CASE WHEN NOT lost THEN length_b END AS length_b, digest_a, CASE WHEN NOT lost THEN digest_b END AS digest_b
    FROM placed WHERE lost OR digest_a <> digest_b
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    mark = F.expr(DAMAGE)
    # The replica is what a second site holds: the same offsets, with some records altered in place and some lost.
    altered = F.when(mark == "00", F.replace("html", F.lit("<p>"), F.lit("<q>"))).otherwise(F.col("html"))
    here, there = (fixity.warc_record(F.col("url"), html) for html in (F.col("html"), altered))
    records = pages.select(
        fixity.file_of(F.col("page_id"), "url", "html").alias("warc_file"), F.col("page_id").alias("record_id"),
        F.octet_length(here).cast("long").alias("length"), F.sha2(here, 256).alias("digest"),
        F.octet_length(there).cast("long").alias("length_b"), F.sha2(there, 256).alias("digest_b"), (mark == "01").alias("lost"))
    placed = materialize(fixity.with_offsets(records), "replicas")
    first = placed.select("warc_file", "offset", "length", "digest")
    second = placed.where("NOT lost").select("warc_file", "offset", F.col("length_b").alias("length"), F.col("digest_b").alias("digest"))
    return fixity.audit(first, second)


@query("op6_robust_outliers")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = outliers.counted(table(spark, folder, "documents"))
    return outliers.judged(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_low_discrepancy_mix", r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               lpad(((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT) % 256)::VARCHAR, 6, '0')
                   || md5(coalesce(doc_id::VARCHAR, '')) AS hash
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
        FROM sized GROUP BY source
    ), levels AS (
        SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER earlier, 0)) / sum(weight) OVER onward AS level
        FROM sources
        WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               onward AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), water AS (
        SELECT arg_min(level, source_size / weight) AS level FROM levels WHERE level * weight <= 2.0 * source_size
    ), targets AS (
        SELECT s.source, source_size, least(2.0 * source_size, coalesce(w.level * weight, 2.0 * source_size)) AS target
        FROM sources s CROSS JOIN water w
    ), placed AS (
        SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (
                   PARTITION BY d.source ORDER BY hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
           (greatest(0, least(size, round(target) - place)) + greatest(0, least(size, round(target) - source_size - place)))::BIGINT AS taken
    FROM placed
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = materialize(mixing.mixed(docs, keep_text=False), "mixed")
    sizes = materialize(found.select("source", F.col("_target").alias("target")).distinct(), "mix-targets")
    mix = mixing.pieces(found, materialize(mixing.schedule(sizes), "mix-slots"))
    taken = mix.groupBy(F.col("_row").alias("_of")).agg(F.sum("length").alias("_taken"))
    return found.join(taken, F.col("_row") == F.col("_of"), "left").select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


@query("op9_concatenate_and_cut")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = packing.packed(docs, vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begins", "ends")


@query("op10_factorisation_machine")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fitted(docs, table(spark, folder, "labels"), id_remainder("doc_id", 5) != 0)
    return quality.scored(docs, machine).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op11_source_divergence", r"""
    WITH rows AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), groups AS (SELECT DISTINCT lang, source FROM rows), found AS (
        SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
    ), kept AS (
        SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
    ), counts AS (
        SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
    ), langs AS (
        SELECT lang, count(*) AS terms, sum(total) AS size FROM kept GROUP BY lang
    ), sized AS (
        SELECT g.lang, g.source, coalesce(terms, 0) AS terms, coalesce(sum(n), 0) AS size
        FROM groups g LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
    ), points AS (
        SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n,
               (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (s.size + s.terms))::BIGINT AS p,
               (1 + 1000000000::HUGEINT * (k.total + 1) // (l.size + l.terms))::BIGINT AS q
        FROM sized s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
        LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
        FROM points a JOIN points b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), valued AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON a.lang = p.lang AND a.source = p.source AND b.source = p.item
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM points WHERE n > 0 AND p > q
    )
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM valued QUALIFY part = 'pair' OR rank <= 200
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op12_ball_tree_search", r"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), items AS (
        SELECT row_number() OVER () AS query, item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), size AS (
        SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM docs
    ), found AS (
        SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(s.docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, size s GROUP BY term
    ), scored AS (
        SELECT query, item_id, row, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 12 * (100 - 25 + 25 * len(d.terms) * s.docs // s.terms))))::BIGINT AS score
        FROM items JOIN found USING (term) JOIN weights USING (term) JOIN docs d USING (row), size s GROUP BY query, item_id, row, doc_id
    )
    SELECT item_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_dom_marginals")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extracted(table(spark, folder, "pages").select("page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
