"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, cotraining, grammar, infill, merkle, mixing, packing, periods, perplexity, sharding, suffixes, superminhash, toxicity
from .common import WORD, read, stage

SEQUENCE = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.round_trip(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 1).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op2_splitting_tree_mix(spark: SparkSession, folder: str) -> DataFrame:
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return mixing.plan(read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken")
    )


def op3_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, pages, labels = (read(spark, folder, t) for t in ("documents", "pages", "labels"))
    return cotraining.classify(docs, pages, labels).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", (F.col("predicted") == 1).alias("kept")
    )


def op4_convolutional_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    net = toxicity.train(docs, read(spark, folder, "labels"))
    return toxicity.classify(docs, net).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "lang", "toxic"
    )


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 0, SEQUENCE)


def op6_differencing_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, folder, "documents"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_superminhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.groups(read(spark, folder, "documents"), 4)


def op8_schema_chat(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    formatted = stage(chat.render(chat.turns(rows.select(record.alias("record")))), "formatted")
    return chat.digests(formatted)


def op9_perplexity_rules(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judge(read(spark, folder, "documents"))


def op10_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_edited(read(spark, folder, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a checksum of doc_id, with a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return docs.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_tiled_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.described(with_planted_periods(read(spark, folder, "documents")))
    best = found.withColumn("runs", F.coalesce("runs", F.expr("cast(array() as array<struct<start: bigint, period: bigint, length: bigint>>)")))
    best = best.withColumn("best", periods.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exception_index_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.transform(read(spark, folder, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


def op13_interval_expansion_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return suffixes.without_repeats(read(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_repair_token_files": op1_repair_token_files,
    "op2_splitting_tree_mix": op2_splitting_tree_mix,
    "op3_cotraining_quality": op3_cotraining_quality,
    "op4_convolutional_toxicity": op4_convolutional_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_differencing_shards": op6_differencing_shards,
    "op7_superminhash_groups": op7_superminhash_groups,
    "op8_schema_chat": op8_schema_chat,
    "op9_perplexity_rules": op9_perplexity_rules,
    "op10_merkle_fingerprints": op10_merkle_fingerprints,
    "op11_tiled_periods": op11_tiled_periods,
    "op12_exception_index_infill": op12_exception_index_infill,
    "op13_interval_expansion_dedup": op13_interval_expansion_dedup,
}

#: The mix in plain SQL: targets by running sums, words by a document's place in its permuted source.
MIX_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
           ('0x' || substr(md5('mixing:' || doc_id), 1, 15))::BIGINT AS place
    FROM documents
), each AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, 3 * source_size AS cap,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM each
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
           row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn
    FROM weighed
), goals AS (
    SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT arg_min(level, turn) FROM levels
           WHERE cap > level * weight), cap::DOUBLE)) AS target, cap
    FROM levels
), laid AS (
    SELECT doc_id, size, source_size, target, least(cap, floor(target + 0.5)::BIGINT) AS quota,
           sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - first)) + greatest(0, least(size, quota - source_size - first))
        + greatest(0, least(size, quota - 2 * source_size - first)))::BIGINT AS taken
FROM laid
"""

#: The transformation in plain SQL: substrings by code points.
INFILL_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), numbers AS (
    SELECT doc_id, text, length(text) AS n,
           ('0x' || digest[1:8])::BIGINT % (length(text) + 1) AS one, ('0x' || digest[9:16])::BIGINT % (length(text) + 1) AS two,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR ('0x' || digest[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || digest[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT *, least(one, two) AS a, greatest(one, two) AS b FROM numbers
), parts AS (
    SELECT *, substring(text, 1, a) AS head, substring(text, a + 1, b - a) AS moved, substring(text, b + 1) AS tail FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form != 'plain' THEN a END AS prefix_chars,
       CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || moved
                        WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || moved ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op2_splitting_tree_mix": MIX_SQL, "op12_exception_index_infill": INFILL_SQL}
