"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import alignment, chat, decontaminate, digests, langid, mixing, quality, repeats, simhash, tokens, urls, vector_codes, warc
from reviewloom.llm.common import read, written

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_fingerprints(spark, sf_dir):
    return digests.neighbours(read(spark, sf_dir, "documents"))


@query
def op4_warc(spark, sf_dir):
    """Written and read back; what is said of a response comes from its payload, of a revisit from its headers."""
    folder = warc.archive(read(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    whole = warc.load(spark, folder).where("warc_type = 'response'").select(
        number(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = warc.load(spark, folder, payload=False).where("warc_type = 'revisit'").select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )
    return whole.unionByName(again)


@query
def op5_suffix_array_dedup(spark, sf_dir):
    return repeats.report(read(spark, sf_dir, "documents"))


@query
def op6_url_filters(spark, sf_dir):
    return urls.url_filter(read(spark, sf_dir, "pages"))


@query
def op7_source_mix(spark, sf_dir):
    sizes = mixing.sized(read(spark, sf_dir, "documents"))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.classes(read(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query
def op9_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.predict(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


@query
def op10_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


@query
def op11_alignment(spark, sf_dir):
    found = alignment.align(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


@query
def op12_vector_codes(spark, sf_dir):
    found = vector_codes.compress(read(spark, sf_dir, "embeddings"), carried=("label",))
    digest = hashlib.sha256(vector_codes.codebook_text(found.books).encode()).hexdigest()
    rows = vector_codes.label_errors(written(found.rows))
    return rows.select(
        F.col("vec_id").cast("long"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


#: A conversation whose texts are control strings of the template.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op13_chat_formatting(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    chosen = chat.paths(chat.from_turns(turns.unionByName(more)))
    return chat.read_back(chat.formatted(chosen)).drop("leaf").withColumnRenamed("tree", "conv_id")


PAGES_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM q"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": PAGES_SQL,
        "op6_url_filters": urls.filter_sql(),
        "op7_source_mix": mixing.mix_sql(),
        "op12_vector_codes": vector_codes.codes_sql(),
        "op13_chat_formatting": chat.turns_sql(" UNION ALL ".join(f"SELECT {i}, {n}, '{role}', '{text}'" for i, n, role, text in CONTROL)),
    }
