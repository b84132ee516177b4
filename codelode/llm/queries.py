"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import classifier, encode, exact_dedup, jaccard, lines, lm, merkle, neighbours, packing, pii, runs, simhash, token_counts

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query(
    "op2_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("keep_rows")


@query("op3_bpe_encode_decode")
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.digests(encode.encode(table(spark, sf_dir, "documents"), byte_bpe()))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.fit(documents, labels.where(classifier.fold(F.col("doc_id"), 3) != 1))
    scored = classifier.score(documents, model)
    return scored.select("doc_id", (classifier.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), byte_bpe(), limit=1024)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), end_id=1, window=2048))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = lm.score(documents, documents.where(classifier.fold(F.col("doc_id"), 10) != 0))
    return scored.select("doc_id", (classifier.fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(embeddings, embeddings.where("vec_id % 20 = 0"), k=20)


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), words=lines.TOKENS)
    return kept.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def planted(documents: DataFrame) -> DataFrame:
    """The documents whose id has a crc32 divisible by ten get a periodic end."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    listed = documents.select("doc_id", "text", F.expr("crc32(CAST(doc_id AS STRING)) DIV 10").alias("_g"), F.when(crc % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")).alias("_words"))
    cut = listed.where("_words IS NOT NULL AND size(_words) > 0").withColumn("_a", F.expr("CAST(_g % size(_words) AS INT)")).withColumn("_p", F.expr("CAST(1 + (size(_words) - _a) DIV (3 + _g % 8) AS INT)"))
    block = "slice(_words, _a + 1, _p)"
    tail = f"slice(flatten(array_repeat({block}, CAST(ceil((size(_words) - _a) / _p) AS INT))), 1, size(_words) - _a)"
    ended = cut.select("doc_id", F.expr(f"array_join(concat(slice(_words, 1, _a), {tail}), ' ')").alias("text"))
    return listed.where("_words IS NULL OR size(_words) = 0").select("doc_id", "text").unionByName(ended)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted(table(spark, sf_dir, "documents")))
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_merkle_manifest",
    r"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
    ), hashed AS (
        SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                  lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)])), 4294967295) % 2 = 0 AS cut
        FROM documents, crc
    ), leaves AS (
        SELECT doc_id, source AS grp, cut, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS short
        FROM hashed
    ), own AS (
        SELECT doc_id, grp, place, len(list_filter(range(30), lambda k: pow(3, k) < n)) AS deep, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN cut THEN sha256(head || coalesce(strlen(short) || ':' || short, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
        FROM leaves
    ), nodes(level, grp, place, deep, h) AS (
        SELECT 0, grp, place, deep, leaf FROM own
        UNION ALL
        SELECT level + 1, grp, place // 3, any_value(deep), sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE level < deep GROUP BY level, grp, place // 3
    ), subroots AS (
        SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, len(list_filter(range(30), lambda k: pow(3, k) < count(*) OVER ())) AS deep FROM nodes WHERE level = deep
    ), tops(level, place, deep, h) AS (
        SELECT 0, place, deep, h FROM subroots
        UNION ALL
        SELECT level + 1, place // 3, any_value(deep), sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE level < deep GROUP BY level, place // 3
    ), walk(level, id, grp, place, deep, h, proof) AS (
        SELECT 0, doc_id, grp, place, deep, changed, '' FROM own
        UNION ALL
        SELECT w.level + 1, w.id, w.grp, w.place // 3, w.deep, sha256(string_agg(CASE WHEN n.place = w.place THEN w.h ELSE n.h END, '' ORDER BY n.place)),
               w.proof || coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (WHERE n.place <> w.place), '')
        FROM walk w JOIN nodes n ON n.level = w.level AND n.grp IS NOT DISTINCT FROM w.grp AND n.place // 3 = w.place // 3
        WHERE w.level < w.deep GROUP BY w.level, w.id, w.grp, w.place, w.deep, w.h, w.proof
    ), onward(level, id, place, deep, h, proof) AS (
        SELECT 0, w.id, s.place, s.deep, w.h, w.proof FROM walk w JOIN subroots s ON w.grp IS NOT DISTINCT FROM s.grp WHERE w.level = w.deep
        UNION ALL
        SELECT w.level + 1, w.id, w.place // 3, w.deep, sha256(string_agg(CASE WHEN n.place = w.place THEN w.h ELSE n.h END, '' ORDER BY n.place)),
               w.proof || coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (WHERE n.place <> w.place), '')
        FROM onward w JOIN tops n ON n.level = w.level AND n.place // 3 = w.place // 3
        WHERE w.level < w.deep GROUP BY w.level, w.id, w.place, w.deep, w.h, w.proof
    )
    SELECT o.doc_id, o.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
    FROM own o JOIN subroots s ON o.grp IS NOT DISTINCT FROM s.grp JOIN onward w ON w.id = o.doc_id AND w.level = w.deep JOIN tops t ON t.level = t.deep
    """,
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    whole = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    tampered = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.regexp_replace("text", "\\n", ""))
    cut = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(documents.select("doc_id", F.col("source").alias("group"), whole.alias("leaf"), F.when(cut, tampered).alias("replacement")))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
