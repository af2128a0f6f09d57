"""The queries of this subpackage: name -> (spark, folder of tables) -> result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    from .lm_score import fit, score

    docs = _table(spark, folder, "documents")
    return score(docs, fit(docs, _table(spark, folder, "labels")))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    found = near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", hex_of(found.fp).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .packing import pack, token_pieces

    pieces = token_pieces(_table(spark, folder, "documents"))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .secret_scan import digest, scan

    return digest(scan(_table(spark, folder, "documents")))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix, words_taken

    return words_taken(mix(_table(spark, folder, "documents")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, folder, "documents")
    return score(docs, fit(docs, _table(spark, folder, "labels")))


def op8_audio(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no audio: each embedding is rendered as a recording, and a noisy clip of every 20th is searched for among all."""
    from pyspark.sql import functions as F

    from .audio import align, fingerprint_column, render_vector

    media = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("media"))
    clips = fingerprint_column(media.filter("rec_id % 20 = 0"), render_vector(noise=0.3, part=0.75))
    return align(fingerprint_column(media, render_vector()), clips)


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .repeats import remove_repeats

    found = remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .license_scan import scan

    found = scan(_table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .collocations import mine

    return mine(_table(spark, folder, "documents"))


def op12_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_model import fit, score

    docs = _table(spark, folder, "documents")
    return score(docs, fit(docs, _table(spark, folder, "labels")))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from .ranked_search import search

    return search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_score, op3_simhash, op4_packing, op5_secret_scan, op6_mixing, op7_toxicity, op8_audio, op9_repeats, op10_license_scan, op11_collocations, op12_quality_model, op13_ranked_search)}
ORACLES: dict[str, str] = oracles.ORACLES
