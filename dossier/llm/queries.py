"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table
from .sharding import ROUNDS, SEED

SHARDS = 24
TOKENIZERS = ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")


def tokenizer_files() -> tuple[str, str, str]:
    """Paths of the ranks and of the JSON form of the vocabulary, and the pre-tokenizer's pattern."""
    import public_tokenizers

    return *(public_tokenizers.path(name) for name in TOKENIZERS), public_tokenizers.PATTERN


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicate_classes

    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    ranks, _, pattern = tokenizer_files()
    return encode_decode(table(spark, sf_dir, "documents"), ranks, pattern)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    # a tree of files: source / thousand / hundred / document
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return scan(docs).select("doc_id", "path", "licence", "origin", "score", "governed_by")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k, integer_components

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", integer_components("embedding").alias("v"))
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0)


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, rewrite=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_boilerplate

    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", F.col("n_lines").cast("bigint"), F.col("n_dropped").cast("bigint"), F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import ACCEPT, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "quality_score", "content_score", "metadata_score", (F.col("quality_score") >= ACCEPT).alias("keep"))


def op11_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    text = F.coalesce("text", F.lit(""))
    size, crc = F.octet_length(text).cast("bigint") + 8, F.crc32(text.cast("binary"))
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents, words from the a-th on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.col("g") % F.nullif(F.size("words"), F.lit(0)))
    docs = docs.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    return docs.select("doc_id", F.when(F.size("words") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    found = periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    run = {"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period"), "exponent_milli": F.expr("(1000 * best.length) div -best.period")}
    return found.select("doc_id", "n_runs", *(c.alias(n) for n, c in run.items()), "runs_sha256", "collapsed_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _license_sql() -> str:
    """The licence scan in DuckDB's SQL, with the templates' weights as values."""
    from .licenses import STOPWORDS, THRESHOLD, template_weights

    idf, unknown, units = template_weights()
    terms = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    weights = ", ".join(f"('{w}', '{n}', {x!r}::DOUBLE)" for n, unit in sorted(units.items()) for w, x in sorted(unit.items()))
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"""
        WITH i(word, idf) AS (VALUES {terms}), u(word, licence, unit) AS (VALUES {weights}), files AS (
            SELECT doc_id, source || '/' || doc_id // 1000 || '/' || doc_id // 100 AS folder, text FROM documents
        ), paths AS (
            SELECT doc_id, folder, folder || '/' || doc_id || '.txt' AS path, text FROM files
        ), s AS (
            SELECT path, length(text) AS chars, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS sentence FROM paths
        ), n AS (
            SELECT path, row_number() OVER () AS place, length(sentence) / chars AS share, sentence FROM s WHERE regexp_matches(lower(sentence), '{"|".join(sorted(idf))}')
        ), t AS (
            SELECT path, place, share, unnest(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({stop}))) AS word FROM n
        ), c AS (
            SELECT path, place, share, word, count(*) AS tf FROM t GROUP BY ALL
        ), norms AS (
            SELECT path, place, share, sqrt(sum(pow(tf * coalesce(idf, {unknown!r}), 2))) AS norm FROM c LEFT JOIN i USING (word) GROUP BY ALL
        ), dots AS (
            SELECT path, place, licence, sum(tf * idf * unit) AS dot FROM c JOIN i USING (word) JOIN u USING (word) GROUP BY ALL
        ), scored AS (
            SELECT path, licence, round(dot / norm, 6) AS score, share FROM dots JOIN norms USING (path, place) WHERE round(dot / norm, 6) >= {THRESHOLD}
        ), own AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence, share DESC) = 1
        ), heads AS (
            SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, licence AS inherited FROM own WHERE share >= 1 / 3.0
            QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY score DESC, licence) = 1
        ), chain AS (
            SELECT folder, unnest(['', split_part(folder, '/', 1), array_to_string(string_split(folder, '/')[1:2], '/'), folder]) AS above FROM (SELECT DISTINCT folder FROM paths)
        ), nearest AS (
            SELECT folder, above AS governed_by, inherited FROM chain JOIN heads USING (above) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1
        )
        SELECT p.doc_id, p.path, coalesce(own.licence, inherited) AS licence, CASE WHEN own.licence IS NOT NULL THEN 'notice' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               own.score, CASE WHEN own.licence IS NULL THEN governed_by END AS governed_by
        FROM paths p LEFT JOIN own USING (path) LEFT JOIN nearest USING (folder)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_language_id,
        op3_bpe_coding,
        op4_best_fit_packing,
        op5_license_scan,
        op6_exact_topk,
        op7_merkle_fingerprint,
        op8_substring_dedup,
        op9_line_dedup,
        op10_quality_classifier,
        op11_feistel_sharding,
        op12_periodic_runs,
        op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op5_license_scan": _license_sql(),
    "op11_feistel_sharding": sql.sharding(SEED, ROUNDS, SHARDS),
    "op12_periodic_runs": sql.PERIODIC_RUNS,
    "op13_lexical_search": sql.LEXICAL_SEARCH,
    "op8_substring_dedup": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), g AS (
            SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
        ), f AS (
            SELECT k, min(doc_id) AS first_doc FROM g GROUP BY k
        ), x AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE first_doc < doc_id
        ), e AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
        ), k AS (
            SELECT e.doc_id, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE x.p IS NULL) AS kept
            FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.p = e.p GROUP BY e.doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op9_line_dedup": """
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at
            FROM documents
        ), f AS (
            SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL
        ), t AS (
            SELECT source, count(*) AS total FROM documents GROUP BY source
        ), b AS (
            SELECT f.source, f.line FROM f JOIN t USING (source) WHERE pages >= 5 AND pages / total > 0.1
        )
        SELECT l.doc_id, l.source, count(*) AS n_lines, count(b.line) AS n_dropped,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.line IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line, ' ') = b.line
        GROUP BY l.doc_id, l.source
    """,
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
