"""The named queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import (
    bpe,
    chat,
    conversation_repair,
    conversation_trie,
    decontaminate,
    jaccard,
    language_id,
    line_dedup,
    neighbours,
    oracle,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
)
from pagequarry.llm.common import checkpointed, crc_remainder, read
from pagequarry.llm.ordering import digests


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    remainder = crc_remainder("doc_id", 3)
    learned = language_id.fit(docs.filter(F.coalesce(remainder, F.lit(-1)) != 1).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), learned)
    held_out = F.coalesce(remainder, F.lit(-1)) == 1
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def fit_toxicity(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> toxicity.Model:
    """Fit on the labelled documents outside the held-out fifth."""
    docs = read(spark, folder, "documents") if docs is None else docs
    labels = read(spark, folder, "labels").filter(crc_remainder("doc_id", 5) != 0)
    return toxicity.fit(
        docs.select(F.col("doc_id").alias("key"), "text"),
        labels.select(F.col("doc_id").alias("key"), "toxic"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, fit_toxicity(spark, folder))
    return scored.select(
        "doc_id",
        (F.coalesce(crc_remainder("doc_id", 5), F.lit(-1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def word_bpe() -> str:
    """The vocabulary file of the queries, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return bpe_digest(bpe.encode_and_decode(docs, word_bpe()))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return jaccard.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), "class_id", "n_links"
    )


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(read(spark, folder, "conversations"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    gone = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]
    )
    return substring_dedup.dedup_substrings(docs).select(
        "doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = decontaminate.overlaps(docs.withColumnRenamed("doc_id", "id"), items)
    none = F.array().cast("array<long>")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("print"))
        .join(
            found.withColumnRenamed("id", "found_id").withColumnRenamed("print", "found_print"),
            F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("print") == F.col("found_print")),
            "left",
        )
        .select(
            "doc_id",
            F.col("items").isNotNull().alias("contaminated"),
            F.coalesce("items", none).alias("item_ids"),
            F.size(F.coalesce("starts", none)).cast("long").alias("n_windows"),
        )
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents").select("text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN)
    counts = checkpointed(token_counts.histogram(counted.select("n_tokens")))
    return token_counts.limits(counts)


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings")
    return neighbours.nearest(table, table.filter("vec_id % 20 = 0"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    before = docs.withColumn(
        "n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    )
    return line_dedup.dedup_lines(before, removed="removed").select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a hash of conversation and turn deals."""
    known = turns.select(
        "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(name) % 20
    return known.withColumn("fault", fault).filter("fault != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = read(spark, folder, "conversations")
    turns = damaged(given)
    audits, repaired = conversation_repair.repair(turns)
    lines = repaired.withColumn("line", F.concat("role", F.lit(":"), "text"))
    digest = digests(lines, ["conv_id"], ["at", "place"], "line", "\n")
    gaps = (
        turns.groupBy("conv_id", "turn").agg(F.lit(1))
        .groupBy("conv_id")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    )
    found = given.select("conv_id").distinct()
    for part in (gaps, audits, digest):
        part = part.withColumnRenamed("conv_id", "its_id")
        found = found.join(part, F.col("conv_id").eqNullSafe(F.col("its_id")), "left").drop("its_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "lang", "text")
    measured = quality_rules.measured(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return quality_rules.judged(measured, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *quality_rules.MEASURES,
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations of ``turns`` and their sequences, the first turns taken from another.

    Conversation c begins with the first h turns of conversation c - c % 20, where h is the
    crc32 of c modulo 4, and goes on with its own after the first h.
    """
    turn = ("h1", "h2", "words")
    own = conversation_trie.sequences(turns)
    heads = own.filter("depth <= 3").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", *turn))).alias("head")
    )
    heads = checkpointed(heads)
    convs = (
        heads.select(
            "conv_id",
            (F.col("conv_id") - F.col("conv_id") % 20).alias("base_id"),
            (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"),
        )
        .join(heads.select(F.col("conv_id").alias("base_id"), F.col("head").alias("lent")), "base_id", "left")
        .select(
            "conv_id", "h",
            F.slice(F.coalesce("lent", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")).alias("lent"),
        )
    )
    convs = checkpointed(convs)
    lent = convs.select("conv_id", F.explode("lent").alias("x")).select("conv_id", "x.*")
    rest = (
        own.join(convs.select("conv_id", "h", F.size("lent").alias("n_lent")), "conv_id")
        .filter("depth > h")
        .select("conv_id", (F.col("depth") - F.col("h") + F.col("n_lent")).alias("depth"), *turn)
    )
    return convs.select("conv_id"), lent.union(rest)


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(*rebuilt(read(spark, folder, "conversations")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    # Imported here, as that module takes its helpers from this one.
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_jaccard": op4_jaccard,
    "op5_chat": op5_chat,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_neighbours": op9_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_trie": op13_conversation_trie,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id,
         list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
                    || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS whole
  FROM t GROUP BY conv_id
),
firsts AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(whole) AS whole
  FROM c GROUP BY turns
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       whole AS text
FROM firsts a
WHERE NOT EXISTS (
  SELECT 1 FROM firsts b
  WHERE b.turns[1] = a.turns[1] AND len(b.turns) > len(a.turns)
    AND b.turns[1:len(a.turns)] = a.turns
)""",
    "op6_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS words FROM starts),
repeated AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, min(doc_id) OVER (PARTITION BY words) AS first FROM windows
  ) WHERE doc_id > first
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM repeated),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(
         CASE WHEN ps IS NULL THEN w
              ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END,
         ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id""",
    "op11_conversation_repair": oracle.CONVERSATION_REPAIR,
    "op13_conversation_trie": oracle.CONVERSATION_TRIE,
}
