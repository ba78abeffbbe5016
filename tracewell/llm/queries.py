"""The operators of this package bound to the test tables, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, chunk_dedup, grace_dedup, html_crf, jaccard_join, line_dedup, mixing, orchard, ppm, quality
from tracewell.llm import suffix_dedup, toxicity, whitening
from tracewell.llm.common import documents
from tracewell.llm.spans import removed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Words of the contracts, in DuckDB: white space is [\x20\x09-\x0D].
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.without_repeated_strings(documents(spark, folder).select("doc_id", "text"), keep_first=False)
    return out.select(
        "doc_id", "cut.n_bytes", removed("cut.spans").alias("n_removed"),
        F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard_join.similar_documents(documents(spark, folder).select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUALITY_SQL = f"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
    SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)
), repeated AS (
    SELECT doc_id, unnest(generate_series(i, i + 4)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM repeated GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE trim(line, {SPACE}) <> '' GROUP BY doc_id
), measured AS (
    SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
           coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
           length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
    FROM words LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
), rated AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbols,
           CASE WHEN word_chars > 0 THEN 10000 * n_capitals // word_chars ELSE 0 END AS capitals,
           CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS repeated_lines,
           CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length
    FROM measured
), long AS (
    UNPIVOT (SELECT lang, source, symbols::BIGINT AS symbols, capitals::BIGINT AS capitals,
             repeated_lines::BIGINT AS repeated_lines, word_length::BIGINT AS word_length FROM rated WHERE NOT base_failed)
    ON symbols, capitals, repeated_lines, word_length INTO NAME rate VALUE v
), bucketed AS (
    SELECT lang, source, rate,
           CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)::INT) END AS b FROM long
), levels AS (
    SELECT 0 AS level, lang, source, rate, b FROM bucketed
    UNION ALL SELECT 1, lang, NULL, rate, b FROM bucketed
    UNION ALL SELECT 2, NULL, NULL, rate, b FROM bucketed
), counted AS (
    SELECT level, lang, source, rate, b, count(*) AS n FROM levels GROUP BY ALL
), ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto,
           sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM counted
), quartiles AS (
    SELECT level, lang, source, rate, max(total) AS texts,
           min(b) FILTER (4 * upto >= total) AS b1, min(b) FILTER (4 * upto >= 3 * total) AS b3 FROM ranked GROUP BY ALL
), decoded AS (
    SELECT *, CASE WHEN b1 < 64 THEN b1 ELSE ((b1 % 32) + 32) << (b1 // 32 - 1)::INT END AS q1,
           CASE WHEN b3 < 64 THEN b3 ELSE ((b3 % 32) + 32) << (b3 // 32 - 1)::INT END AS q3 FROM quartiles
), fenced AS (
    SELECT level, lang, source, max(texts) AS texts,
           max(f) FILTER (rate = 'symbols') + 200 AS symbols, max(f) FILTER (rate = 'capitals') + 2000 AS capitals,
           max(f) FILTER (rate = 'repeated_lines') + 3000 AS repeated_lines,
           max(f) FILTER (rate = 'word_length') + 150 AS word_length
    FROM (SELECT *, q3 + 3 * (q3 - q1) AS f FROM decoded) GROUP BY ALL
), chosen AS (
    SELECT o.lang, o.source, CASE WHEN o.texts >= 200 THEN o WHEN l.texts >= 200 THEN l ELSE a END AS t
    FROM (SELECT * FROM fenced WHERE level = 0) o
    JOIN (SELECT * FROM fenced WHERE level = 1) l ON l.lang IS NOT DISTINCT FROM o.lang
    JOIN (SELECT * FROM fenced WHERE level = 2) a ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r.symbols <= t.symbols AND r.capitals <= t.capitals
           AND r.repeated_lines <= t.repeated_lines AND r.word_length <= t.word_length, false) AS kept
FROM rated r LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source
"""


@query("op4_quality_rules", QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(docs, keep_text=False).select("doc_id", *[f"quality.{m}" for m in measures])


LINE_DEDUP_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS drop FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", LINE_DEDUP_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    out = line_dedup.without_repeated_lines(docs, counts="counts")
    return out.select(
        "doc_id", "counts.n_lines", "counts.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


# The query's tree: four domains by the number in the source's name, then the
# language, then the source. Names that are not listed weigh 1.
DOMAIN = "concat('domain', try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)"
MIX_WEIGHTS = ({"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, {"en": 4, "de": 2, "fr": 2}, {})
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 1


def _level_sql(level: int) -> str:
    """One level's shares, from the level above."""
    path = [f"k{i}" for i in range(level)]
    by = ", ".join(["root", *path])
    weights = " ".join(f"WHEN '={n}' THEN {w}" for n, w in MIX_WEIGHTS[level].items())
    weight = f"CASE k{level} {weights} ELSE 1 END" if weights else "1"
    return f"""
c{level} AS (
    SELECT {by}, k{level}, sum(tokens * {MIX_EPOCHS})::BIGINT AS cap, {weight}::BIGINT AS weight FROM leaves GROUP BY ALL
), o{level} AS (
    SELECT c.*, budget, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS onward
    FROM c{level} c JOIN b{level} USING ({by}) WINDOW w AS (PARTITION BY {by} ORDER BY cap::DOUBLE / weight, k{level})
), f{level} AS (
    SELECT *, cap * onward <= weight * (budget - before) AS is_full FROM o{level}
), b{level + 1} AS (
    SELECT {by}, k{level}, CASE WHEN is_full THEN cap ELSE (weight *
               (budget - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {by}), 0)::HUGEINT)
               // (sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {by}))::HUGEINT)::BIGINT END AS budget
    FROM f{level}
)"""


MIXING_SQL = f"""
WITH rows AS (
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, 1 AS root,
           coalesce('=domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '?') AS k0,
           coalesce('=' || lang, '?') AS k1, coalesce('=' || source, '?') AS k2 FROM documents
), leaves AS (
    SELECT root, k0, k1, k2, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL
), b0 AS (
    SELECT 1 AS root, floor(sum(tokens) * {MIX_PERCENT} / 100)::BIGINT AS budget FROM leaves
), {",".join(_level_sql(i) for i in range(3))}, plan AS (
    SELECT l.*, b.budget, CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS whole,
           CASE WHEN l.tokens > 0 THEN b.budget % l.tokens ELSE 0 END AS rest
    FROM leaves l JOIN b3 b USING (root, k0, k1, k2)
), ordered AS (
    SELECT r.*, p.budget, p.whole, p.rest, sum(r.tokens) OVER (
        PARTITION BY r.k0, r.k1, r.k2 ORDER BY md5('{MIX_SEED}:' || (p.whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')), r.tokens) AS upto
    FROM rows r JOIN plan p USING (root, k0, k1, k2)
)
SELECT doc_id, tokens AS n_tokens, budget AS leaf_budget,
       CASE WHEN budget > 0 THEN whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies
FROM ordered
"""


@query("op9_source_mixing", MIXING_SQL)
def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    out = mixing.mixed(
        docs, [F.expr(DOMAIN), F.col("lang"), F.col("source")], MIX_WEIGHTS, MIX_PERCENT,
        max_epochs=MIX_EPOCHS, seed=MIX_SEED, keep_text=False,
    )
    return out.select("doc_id", F.col("mix.tokens").alias("n_tokens"), F.col("mix.budget").alias("leaf_budget"), "mix.copies")


def vocabulary() -> bytes:
    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    out = bpe.digests(bpe.encoded_and_decoded(docs, vocabulary(), public_tokenizers.PATTERN, keep_text=False))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


EXACT_SQL = f"""
WITH bare AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, sha256(translate(coalesce(text, ''), {SPACE}, '')) AS text_sha256 FROM documents
), ranked AS (
    SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM bare WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""


@query("op6_exact_dedup", EXACT_SQL)
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = grace_dedup.duplicates(documents(spark, folder).select("doc_id", "text"))
    return out.withColumnRenamed("doc", "doc_id")


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = chunk_dedup.without_repeated_chunks(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        "doc_id", "cut.n_bytes", removed("cut.spans").alias("n_removed"), F.size("cut.spans").cast("long").alias("n_spans"),
        F.coalesce("cut.n_shared", F.lit(0)).cast("long").alias("n_shared"), F.sha2("cut.kept", 256).alias("kept_sha256"),
        F.coalesce("cut.sources", F.array().cast("array<bigint>")).alias("sources"),
    )


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    out = ppm.scored(documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", "lm.held_out", "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return html_crf.main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.scored(documents(spark, folder).select("doc_id", "text"), labels)
    return out.select("doc_id", "toxicity.held_out", "toxicity.score", "toxicity.predicted")


def _rounds_sql(rounds: int) -> str:
    """The assignments and moves, one after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
    SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT x.id, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM x JOIN m{i} m USING (i) GROUP BY x.id, m.c) GROUP BY id
)""")
        if i < rounds:
            steps.append(f"""
m{i + 1} AS MATERIALIZED (
    SELECT c, i, coalesce(n.v, m.v) AS v FROM m{i} m LEFT JOIN (
        SELECT c, i, floor(sum(v)::HUGEINT / count(*))::BIGINT AS v FROM x JOIN a{i} USING (id) GROUP BY c, i) n USING (c, i)
)""")
    return ",".join(steps)


CLUSTER_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS id, vec_id, embedding AS e FROM embeddings
    WHERE len(embedding) = {orchard.DIMS} AND list_count(embedding) = {orchard.DIMS} AND isfinite(list_sum(embedding::DOUBLE[]))
), x AS MATERIALIZED (
    SELECT id, unnest(range(1, {orchard.DIMS} + 1)) AS i, floor({orchard.SCALE} * unnest(e)::DOUBLE)::BIGINT AS v FROM kept
), m0 AS MATERIALIZED (
    SELECT c, i, v FROM x JOIN (
        SELECT id, row_number() OVER (ORDER BY sha256('{orchard.SEED}:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS c
        FROM kept) USING (id) WHERE c < {orchard.CENTROIDS}
), {_rounds_sql(orchard.ROUNDS)}, digests AS (
    SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{orchard.ROUNDS} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{orchard.ROUNDS} JOIN kept USING (id) JOIN digests USING (c)
"""


@query("op12_centroid_clustering", CLUSTER_SQL)
def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    out = orchard.clustered(vectors)
    return out.select("vec_id", *[f"near.{c}" for c in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")])


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    each = whitening.whitened(vectors).select("vec_id", "white", F.posexplode(F.arrays_zip("white.whitened", "white.explained")).alias("i", "v"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), "white.n", "white.deviation",
        F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "white.identity_error",
    )
