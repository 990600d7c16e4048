"""The contract queries opN_<name> over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.fingerprint import compare_with_edit
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.html_text import extract_text
from tessera.llm.licenses import scan_licenses
from tessera.llm.merkle_manifest import leaf_digest, manifest
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.oracles import SQL
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.sharding import shard
from tessera.llm.token_files import through_files
from tessera.llm.toxicity import fit_toxicity, score_toxicity
from tessera.llm.url_filter import judge_urls

#: Similarity of near duplicates, and the scores from which a text counts as toxic or good.
NEAR, TOXIC, GOOD = 0.85, 0.3, 0.7
#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """True for the rows whose labels no model may see; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows. Null texts have no words; a document without hits has the hash of the empty string; repeated rows each count."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Fitted on labels that are not held out; without any the score is 0.5."""
    return fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each whole text; null and empty texts get the score of a text without terms, repeated rows equal scores."""
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, toxicity_model(spark, sf_dir, docs), carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null texts have size 0, null sources are one source, repeated rows are each mixed."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and labels of each whole text; null texts are empty, repeated rows each scanned."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, sizes near equal; null texts count 8 bytes, rows of equal text follow one another."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document; texts without words are linked with nothing, rows without an id are kept and have no component."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=NEAR)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page; empty for null, empty and contentless pages, equal for equal pages."""
    return extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each whole text; null and empty texts are scored by their statistics, repeated rows equally."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score_quality(docs, model, carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each url; null urls have empty host and path and the template's verdict, equal urls equal ones."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edit; null texts are empty, equal ids are ordered by a hash of the text."""
    out = compare_with_edit(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and the root that a leaf of altered values leads to. A row without an id comes first in its
    language and is never altered, rows of equal id are ordered by their leaf, repeated rows are each a leaf; without rows there is no root."""
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = leaf_digest([F.col(v) + 1 if v == "n_chars" else F.col(v) for v in values])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.unhex(altered))
    m = manifest(table(spark, sf_dir, "documents"), values, "lang", "doc_id", {"doc_id": F.col("doc_id"), "claimed": claimed})
    out = m.rows.withColumn("root", F.lit(m.root)).withColumn("folded_root", m.folded_root(F.coalesce(F.lower(F.hex("claimed")), "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(m.proof(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of each document's token ids, read from files; null texts have the end id alone, null ids come first, repeated rows are each written."""
    import public_tokenizers

    out = through_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors, whose ids 100 divides; rows with nulls or other than finite components take no part, vectors of fewer
    dimensions end in zeros, repeated anchors are one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_toxicity, op3_mixing, op4_licenses, op5_sharding, op6_near_dedup, op7_html, op8_quality, op9_urls, op10_fingerprint, op11_manifest, op12_token_files, op13_hard_negatives]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
