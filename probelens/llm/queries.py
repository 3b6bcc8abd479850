"""The registered queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import decontam, langid, mixing, phrases, pii, quality, simhash, substring, tandem, templates, topk_hamming, toxicity, urlfilter
from probelens.llm.common import fold

#: the rules of op5, by the contract (fixed values)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors by sign code of every vector whose id is divisible by 100, against all vectors."""
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", topk_hamming.sign_code().alias("code"))
    return topk_hamming.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 9).alias("first_position"))


def _held(docs: DataFrame, mod: int, out: int) -> tuple[DataFrame, DataFrame]:
    """(all rows with held_out, the rows to learn from). A null id is neither held out nor learnt from."""
    return docs.withColumn("held_out", F.coalesce(fold("doc_id", mod) == out, F.lit(False))), docs.where(fold("doc_id", mod) != out)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _held(_read(spark, sf_dir, "documents", "doc_id", "text"), 3, 1)
    return toxicity.score(rows, toxicity.learn(train, _read(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 3) != 1)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or a public one, so that the query's reruns agree."""
    key = spark.conf.get("spark.probelens.pii.key", None) or "public"
    return pii.replace_pii(_read(spark, sf_dir, "documents", "doc_id", "text"), key=key, count="n_replaced")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _held(_read(spark, sf_dir, "documents", "doc_id", "text"), 5, 0)
    return quality.score(rows, quality.learn(train, _read(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 5) != 0)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = _held(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"), 5, 0)
    return langid.identify(rows.select("doc_id", "held_out", "text"), langid.learn(train))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents", "text", "lang"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return templates.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts of op13: where h = crc32(doc_id) is divisible by 10, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    some = docs.withColumn("_h", h).withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), words))
    some = some.withColumns({"_n": F.size("_w").cast("long"), "_g": F.expr("_h div 10")}).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    some = some.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_w", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int")))
    return some.withColumn("text", F.when(F.col("_n") > 0, F.array_join(drawn, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_periods(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return tandem.described(tandem.periodic_runs(docs)).select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_topk_hamming, op2_mix_sources, op3_toxicity, op4_simhash, op5_url_rules, op6_substring_dedup, op7_pii_surrogates, op8_quality, op9_langid, op10_decontaminate, op11_phrases, op12_main_text, op13_periodic_runs)}

W = r"[^\x20\x09-\x0D]+"
SQL = {
    "op1_topk_hamming": """
        WITH b AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
        p AS (SELECT q.vec_id AS query_id, r.vec_id, len(list_filter(list_zip(q.bits, r.bits), lambda z: z[1] <> z[2])) AS distance
              FROM b q JOIN b r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
        SELECT query_id, rank::INT AS rank, vec_id, distance::INT AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "op2_mix_sources": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
        w AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
        r AS (SELECT *, cap / weight AS ratio FROM w),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER u, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS level
              FROM r WINDOW u AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        e AS (SELECT arg_min(level, (ratio, place)) AS even FROM l WHERE level <= ratio),
        t AS (SELECT source, place, source_size, CASE WHEN even IS NULL OR ratio <= even THEN cap ELSE even * weight END AS target FROM r, e),
        a AS (SELECT d.doc_id, d.size, t.*, floor(target + 1e-6) AS quota,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        n AS (SELECT *, start / target AS used, [1.5, 1.0, 0.5][(place % 3 + 1)::INT]::DOUBLE AS w0, [-1.0, 0.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS slope FROM a)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) END)::BIGINT AS taken,
               CASE WHEN size > 0 AND start < quota THEN round(least(CASE WHEN used <= 0 THEN 0 ELSE 2 * used / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * used, 0))) END, 1), 9) END AS first_position
        FROM n""",
    "op5_url_rules": r"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT page_id, host, path, h || q AS rule, coalesce(v, 'allow') AS verdict FROM (
            SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST, length(h) DESC) AS k
            FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) WHERE k = 1""",
    "op6_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{W}'), []) AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d),
        w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM s),
        m AS (SELECT k, min(doc_id) AS low FROM w GROUP BY k),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (k) WHERE doc_id > low),
        a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
        g AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS gone FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op11_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
              FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
        s AS (SELECT c.lang, c.k, c.phrase, a, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score, cut
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') AND l.k = cut
              JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:c.k], ' ') AND r.k = c.k - cut),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * b.a) JOIN n USING (lang) WHERE rank <= 2000""",
    "op10_decontaminate": r"""
        WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
        si AS (SELECT DISTINCT item_id, least(5, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
        sd AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS g FROM d WHERE len(ws) >= 5),
        q AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
        SELECT doc_id, item_id, count(*)::INT AS n_shared, any_value(n_item)::INT AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
        FROM si JOIN sd USING (g) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)""",
}
