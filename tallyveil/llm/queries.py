"""The queries ``opN_<name>`` over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concatenation
from .chat import format_conversations, read_back
from .decontamination import benchmark_matches
from .fill_in_middle import fill_in_middle, restored
from .fingerprint import edited_fingerprints
from .jaccard import jaccard_join
from .language import predict_languages
from .licenses import scan_licenses
from .packing import pack, token_pieces
from .quality import predict_quality
from ..functions.folders import new_folder
from ..functions.sizes import bounded_broadcast
from .components import saved
from .structure_repair import Repair
from .token_counts import TokenCounts, bpe_count, count_tokens, lettered_word_count, word_count
from .substring_dedup import substring_dedup

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op2_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL.format("text")} AS ws FROM documents),
    n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM n),
    m AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM w JOIN m USING (k), range(13) t(j) WHERE first_id < doc_id),
    every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op8_jaccard_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
    r(id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op5_fingerprint")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_chat")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns))


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: counts by two tokenizers are inserted, later copies of equal
    texts are deleted, and ``words`` counts are revised; the second batch is applied twice."""
    docs = table(spark, sf_dir, "documents")
    counts = saved(count_tokens(docs, {"words": word_count, "words-revised": lettered_word_count, "word_bpe_49k": bpe_count()}), "counts")
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.octet_length("text"))
    classes = docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = docs.select("doc_id", digest.alias("digest")).join(bounded_broadcast(saved(classes, "classes")), "digest").filter("doc_id > first_id").select("doc_id").distinct()
    ledger = TokenCounts(spark, new_folder(spark, "token-counts"))
    ledger.apply("load", counts.filter("version != 'words-revised'").withColumn("op", F.lit("insert")))
    deletes = counts.filter("version != 'words-revised'").join(copies, "doc_id", "left_semi").withColumn("op", F.lit("delete"))
    for _ in range(2):
        ledger.apply("copies", deletes)
    ledger.apply("revised", counts.filter("version = 'words-revised'").withColumn("version", F.lit("words")).withColumn("op", F.lit("revise")))
    return ledger.totals()


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by checksum of id and turn: rows dropped, emptied, cut short, repeated or given to
    the user. Null roles and texts, and nulls in the checksum's text, are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies)).drop("col")


@query("op11_structure_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(turns))
    known = repair.conversations().withColumnRenamed("conv_id", "_conv")
    digests = repair.digests().withColumnRenamed("conv_id", "_digest_conv")
    every = turns.select("conv_id").distinct()
    out = every.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_digest_conv")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op12_concatenate")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenation.pieces(table(spark, sf_dir, "documents"))


_DRAW_SQL = "('0x' || substr(d, {0}, 8))::BIGINT"


@query(
    "op13_fill_in_middle",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
    h AS (SELECT *, {_DRAW_SQL.format(1)} % (n + 1) AS a, {_DRAW_SQL.format(9)} % (n + 1) AS b, {_DRAW_SQL.format(17)} % 100 AS c, {_DRAW_SQL.format(25)} % 100 AS e FROM d),
    f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q] ELSE '<S>' || t[q + 1:] || '<P>' || t[1:p] || '<M>' || t[p + 1:q] END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM f
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.withColumnRenamed("text", "restored").select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
