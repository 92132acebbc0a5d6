"""The queries of problems 8 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import label, table
from tidemark.llm import language, mixing, tokens
from tidemark.session import staged


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document turned back into its text, as a hash."""
    back = tokens.decode_corpus(p8_ids(spark, sf))
    return back.select("doc_id", F.md5("text").alias("text_hash"), F.length("text").alias("characters"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    sized = staged(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "source"), "token-counts")
    return mixing.mix(sized, targets), targets


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed, _ = _mix(spark, sf)
    return mixed.select("doc_id", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    aliases = {r[0]: r[1] for r in table(spark, sf, "lang_aliases").select(label("alias"), label("lang")).collect() if r[0] and r[1]}
    filters = language.fit_filters(table(spark, sf, "lang_samples"), documents, aliases)
    return language.identify(documents, filters, aliases)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.when(F.col("lang").isNotNull() & ~F.col("named").eqNullSafe(F.col("lang")), F.array(F.struct(F.lit(0).alias("seg_no"), F.col("lang"))))
    lines = F.when(F.col("mixed"), F.transform("lines", lambda x: F.struct(x["seg_no"].alias("seg_no"), x["lang"].alias("lang"))))
    empty = F.array().cast("array<struct<seg_no:int,lang:string>>")
    found = _identified(spark, sf).select("doc_id", F.explode(F.concat(F.coalesce(whole, empty), F.coalesce(lines, empty))).alias("c"))
    return found.select("doc_id", "c.seg_no", "c.lang")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language and confidence of each document, and of each line of a mixed one (seg_no from 1)."""
    return _identified(spark, sf).select(
        "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("seg_no"), "lang", F.round("confidence", 4).alias("confidence"))), F.when(F.col("mixed"), F.transform("lines", lambda x: F.struct(x["seg_no"].alias("seg_no"), x["lang"].alias("lang"), F.round(x["confidence"], 4).alias("confidence")))).otherwise(F.array().cast("array<struct<seg_no:int,lang:string,confidence:double>>")))).alias("c")
    ).select("doc_id", "c.*")


def queries() -> dict:
    return {f.__name__: f for f in (p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_languages)}


def oracle_sql() -> dict[str, str]:
    """The way back from ids is text again; the other queries cannot be said in SQL, and tests check them against brute force."""
    return {"p8_round_trip": "SELECT doc_id, md5(coalesce(\"text\", '')) AS text_hash, CAST(length(coalesce(\"text\", '')) AS INTEGER) AS characters FROM documents"}
