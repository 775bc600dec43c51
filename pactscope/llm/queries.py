"""The operators as queries over whole tables, with reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.llm.common import freeze, held_out, read
from pactscope.llm.decontamination import contamination
from pactscope.llm.extraction import extract_text
from pactscope.llm.fingerprints import edited_fingerprints, likeness, within_radius
from pactscope.llm.language_id import identify_language, learn_languages
from pactscope.llm.line_quality import line_verdicts
from pactscope.llm.merkle import folded, merkle_manifest, row_digest
from pactscope.llm.near_dedup import near_duplicates
from pactscope.llm.oracles import ORACLES
from pactscope.llm.packing import pack_documents
from pactscope.llm.periods import plain_words, summarised
from pactscope.llm.quality_bayes import score_quality
from pactscope.llm.sharding import shard_documents
from pactscope.llm.suffix_dedup import repeated_bytes
from pactscope.llm.toxicity import learn_lexicon, score_toxicity

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards; counts differ by one at most."""
    placed = shard_documents(read(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, and whether it is kept once lines that its host repeats are removed."""
    found = line_verdicts(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "left_words",
    )


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items found."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a lexicon learnt from labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), lexicon)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by classifiers learnt from documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = identify_language(docs, learn_languages(docs))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of at most 4096 tokens."""
    packed = pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


@query
def op8_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size")


@query
def op7_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that start anywhere else."""
    found = repeated_bytes(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op5_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, from its text and from its site's and section's shrunken rates."""
    found = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "score",
        F.col("kept").cast("int").alias("predicted"),
        "kept",
        "evidence",
        "site_rate",
    )


@query
def op12_time_forward_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a Merkle tree of the dataset, its proof, and whether a changed row is found out."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(changed, F.col("n_chars").cast("long") + 1)
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        row_digest(*fields).alias("leaf"),
        F.when(changed, row_digest(*[more if c == "n_chars" else c for c in fields])).alias("changed"),
    )
    found = merkle_manifest(docs, "lang", ["doc_id"])
    siblings = F.transform("proof", lambda step: F.substring(step, 2, 64))
    found = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text, and how like they are.

    Documents whose id is divisible by 20 are searched for among all: ``n_near`` counts the others within the radius.
    """
    found = edited_fingerprints(read(spark, sf_dir, "documents"))
    found = found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        likeness("fingerprint", "edited").alias("near_edited"),
        likeness("fingerprint", "following").alias("near_next"),
    )
    found = freeze(found, "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    members = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.bool_or(asked).alias("asked"))
    members = freeze(members.withColumn("fingerprint", F.unhex("fingerprint")), "members")
    pairs = within_radius(members, members.where("asked"))
    sizes = members.select(F.col("fingerprint").alias("member"), "n")
    near = pairs.join(sizes, "member").groupBy("query").agg(F.sum("n").alias("n"))
    near = freeze(near.select(F.lower(F.hex("query")).alias("fingerprint"), (F.col("n") - 1).alias("n_near")), "near")
    rest = found.where(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return found.where(asked).join(near, "fingerprint").select(*rest.columns).unionByName(rest)


def with_planted_run(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; in every tenth document, by the checksum of its id, the last words repeat a period."""
    words = plain_words(doc_id, text)
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and the text without repeated periods."""
    found = summarised(read(spark, sf_dir, "documents"), with_planted_run)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
