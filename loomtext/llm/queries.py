"""The registered query of each operator: production parameters over a whole table, digests for comparing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, secret_scan
from . import manifest as merkle
from .alignment import alignment
from .bitsliced import top_k
from .decontaminate import contamination
from .language_id import held_out, identify
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .quotations import conversations, in_reply_order
from .token_counts import section_tokens
from .token_files import read_token_files, write_token_files


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotes, in reply order; reply_to is -1 where there is none."""
    linked = conversations(_read(spark, sf_dir, "conversations"))
    return in_reply_order(linked.withColumn("reply_to", F.coalesce("reply_to", F.lit(-1))))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at three-word shingles and a similarity of 0.85."""
    out = near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def _vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line; a token across a boundary counts where most of its characters lie."""
    return section_tokens(_read(spark, sf_dir, "documents"), _vocabulary(), rule="majority")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them back."""
    return read_token_files(write_token_files(_read(spark, sf_dir, "documents"), _vocabulary()))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters that aren't held out."""
    out = identify(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; hosts are sources, paths the languages within them."""
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every twentieth vector id."""
    vectors = _read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark windows."""
    out = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.drop("key")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(_read(spark, sf_dir, "documents"), _vocabulary())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings and owner-specific bare tokens of every document; one owner's values look live in however many documents."""
    out = secret_scan.scan(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of a byte-level vocabulary against those of a sentencepiece model."""
    return alignment(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and that of the document with its second half replaced."""
    out = fingerprints.edits(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("own")).alias("fingerprint"), fingerprints.as_text(F.col("altered")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document in the manifest; a seventh of them are shown with one character more than they have."""
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(*more)).otherwise(merkle.leaf(*own))
    out = merkle.manifest(_read(spark, sf_dir, "documents"), shown=tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotations": op1_quotations,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_alignment": op11_alignment,
    "op12_fingerprints": op12_fingerprints,
    "op13_manifest": op13_manifest,
}

from .oracles import ORACLES  # noqa: E402, F401
