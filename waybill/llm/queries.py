"""The operators of this subpackage as queries over the given tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import chat, filter_audit, hard_negatives, pseudo_likelihood, rollups, suffix_dedup
from waybill.llm.decontaminate import find_phrases
from waybill.llm.html_text import extract_pages
from waybill.llm.jaccard import jaccard_components
from waybill.llm.packing import pack_documents
from waybill.llm.sharding import assign_shards
from waybill.llm.storage import new_folder, stored
from waybill.llm.syncmers import compare_edited
from waybill.llm.toxicity import score_documents, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, their ids as a checksum."""
    packed = pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


OP3_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrase AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[k : k + 9], ' ') AS g
  FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(k)
  WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrase),
place AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM plain, lengths, unnest(generate_series(1, len(w) - n + 1)) AS s(k)),
found AS (SELECT doc_id, p.n, k, item FROM place p JOIN phrase USING (n, g)),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT DISTINCT doc_id, n, k FROM found), unnest(generate_series(k, k + n - 1)) AS s(pos)
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM plain LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark."""
    found = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree to 80 percent."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, those the model could not learn from marked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_closed_syncmers")
def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return compare_edited(table(spark, sf_dir, "documents"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op1_pseudo_likelihood")
def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = pseudo_likelihood.Vocabulary.of(docs)
    return pseudo_likelihood.score_documents(docs, vocabulary, pseudo_likelihood.train(docs, vocabulary))


OP6_SQL = r"""
WITH counted AS (
  SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z\x20\x09-\x0D]')) AS pieces
  FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(words) AS BIGINT) AS tokens
FROM counted WHERE words >= 5 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1' AS tokenizer, count(*) AS docs, CAST(sum(pieces) AS BIGINT) AS tokens
FROM counted WHERE words >= 5 GROUP BY source, lang
"""


@query("op6_token_rollups", OP6_SQL)
def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after documents were added under two tokenizers, short ones deleted, one tokenizer's counts revised (every
    digit a token), and two of the batches committed again."""
    text = F.col("text")
    counted = stored(
        table(spark, sf_dir, "documents").select(
            "source", "lang", rollups.words(text).alias("words"), rollups.pieces(text).alias("pieces"),
            rollups.pieces_by_digit(text).alias("revised"),
        ),
        "token-counts",
    )
    by_word = counted.withColumn("tokenizer", F.lit("words-1")).withColumn("tokens", F.col("words"))
    by_piece = counted.withColumn("tokenizer", F.lit("pieces-1")).withColumn("tokens", F.col("pieces"))
    short, kept = F.col("words") < 5, F.col("words") >= 5
    store = rollups.Rollup(spark, new_folder(spark, "rollup"))
    store.commit("load-words", rollups.inserts(by_word))
    store.commit("load-pieces", rollups.inserts(by_piece))
    store.commit("retire-short", rollups.deletes(by_word.where(short).unionByName(by_piece.where(short))))
    store.commit("revise-pieces", rollups.revisions(by_piece.where(kept), "pieces", "revised"))
    store.commit("load-words", rollups.inserts(by_word))
    store.commit("retire-short", rollups.deletes(by_word.where(short).unionByName(by_piece.where(short))))
    return store.totals()


# How a role is marked in each style of transcript; the last style marks no turn of an assistant.
MARKER_STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instruction\n", "user": "### Human:\n", "assistant": "### Answer:\n"},
    {"system": "[SYSTEM] ", "user": "[USER] ", "assistant": "[BOT] "},
    {"system": "<|system|> ", "user": "<|user|> ", "assistant": "<|assistant|> "},
    {"system": "**Context**: ", "user": "Q: ", "assistant": ""},
)


@query("op8_chat_formatting")
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as transcripts in one of five styles, and their roles recovered from the lines alone.

    The model is learned from conversations whose crc32(conv_id as text) is even; ``held_out`` marks the others.
    """
    rows = table(spark, sf_dir, "conversations")
    style = F.pmod(F.crc32(F.concat(F.lit("style"), F.col("conv_id").cast("string")).cast("binary")), F.lit(len(MARKER_STYLES)))
    marker = F.coalesce(*[
        F.when((style == k) & (F.col("role") == role), F.lit(text)) for k, marks in enumerate(MARKER_STYLES) for role, text in marks.items()
    ], F.lit(""))
    parts = rows.select("conv_id", F.col("turn").alias("part"), "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))
    even = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0
    parsed = chat.parse_transcripts(parts, chat.learn(parts.where(even)))
    return parsed.withColumn("held_out", ~F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)))


OP9_LIMIT = 1 << 20
OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS bits,
    CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes
  FROM documents),
p AS (SELECT doc_id, bytes, CAST(g AS INTEGER) AS depth, bits >> (32 - CAST(g AS INTEGER)) AS prefix FROM d, generate_series(0, 32) AS s(g)),
size AS (SELECT depth, prefix, count(*) AS shard_rows, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM p GROUP BY depth, prefix),
fit AS (
  SELECT p.*, shard_rows, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS n
  FROM p JOIN size USING (depth, prefix) WHERE shard_bytes <= {OP9_LIMIT} OR p.depth = 32)
SELECT doc_id, bytes, depth, prefix, right(lpad(bin(prefix), 32, '0'), depth) AS shard, shard_rows, shard_bytes,
  shard_bytes > {OP9_LIMIT} AS oversized
FROM fit WHERE n = 1
"""


@query("op9_extendible_sharding", OP9_SQL)
def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, none above one MiB of text unless a single document is."""
    return assign_shards(table(spark, sf_dir, "documents"), OP9_LIMIT)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
first AS (SELECT t, min(doc_id) AS smallest FROM d GROUP BY t),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > smallest THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, CAST(s AS INTEGER), 1) AS letter,
    substr(filter_order, 1, CAST(s AS INTEGER) - 1) AS before
  FROM orders, generate_series(1, 5) AS g(s)),
applied AS (
  SELECT *, contains(failed, letter) AS fails, length(translate(before, failed, '')) < length(before) AS gone
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE failed = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
    coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM applied GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from all documents, by source, in all orders of the filters."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all, some labels changed first."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of passages of 200 bytes that occur at two places."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
