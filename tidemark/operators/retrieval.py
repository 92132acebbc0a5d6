"""Chunking and hybrid retrieval, and how well it did.

Keyword search is BM25 over term counts, vector search is cosine; both are equi joins on
query terms or a scan against a stated query set, fused by reciprocal ranks (k = 60).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship

LIMIT, GLUE = 1200, "\n\n"


def chunk_text(text: Column, limit: int = LIMIT) -> Column:
    """Greedy paragraphs: a chunk takes paragraphs while they fit, and never splits one."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + len(GLUE) + F.length(p) <= limit
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(GLUE), p).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))
        )

    return F.aggregate(parts, empty, take, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunks(documents: DataFrame, doc_id: str, text: str, limit: int = LIMIT) -> DataFrame:
    """``chunk_id`` (``<doc>_chunk_001`` on), ``doc_id``, ``chunk_ordinal`` and ``chunk_text``."""
    rows = documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(chunk_text(F.col(text), limit)).alias("p", "chunk_text"))
    n = F.col("p") + 1
    return rows.select(F.format_string("%s_chunk_%03d", F.col("doc_id").cast("string"), n).alias("chunk_id"), "doc_id", n.alias("chunk_ordinal"), "chunk_text")


def source_contract(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """What a search source must be: non-empty, with its columns, its key filled and unique."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"))
    missing = [c for c in required if c not in df.columns]
    ok = (F.col("rows") > 0) & (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0) & F.lit(not missing)
    return one.withColumn("missing_columns", F.lit(",".join(missing))).withColumn("is_valid", ok)


def terms(df: DataFrame, id_column: str, text: str) -> DataFrame:
    word = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("term")
    return df.select(F.col(id_column).alias("id"), word).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score``.  ``queries``: id, text; ``corpus``: id, text.

    Postings meet query terms by an equi join on the term; a document's score is a sum of
    its postings, so nothing pairs all documents with all queries.
    """
    postings = terms(corpus, "id", "text")
    length = postings.groupBy("id").agg(F.sum("tf").alias("dl"))
    stats = length.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"] or 0.0, stats["avgdl"] or 1.0
    wanted = terms(queries, "id", "text").select(F.col("id").alias("query_id"), "term")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    used = postings.join(wanted.select("term").distinct(), "term", "left_semi").join(df, "term").join(length, "id")
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = used.select(F.col("id").alias("doc_id"), "term", part.alias("part"))
    return scored.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25_top_k(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, block: int = 5000, bucket: int = 8192) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best ``k`` other documents of each query by ``bm25``, for many queries.

    Both sides: id (a unique long), text.  A task has one bucket of documents and one block of
    queries, so common terms meet no more than those; it multiplies their weights as dense
    matrices, adds rare terms posting by posting, and returns its best ``k`` alone.  Terms are
    compared by their 64-bit hashes.  Scores have six decimals.
    """
    ship(corpus.sparkSession)
    docs = corpus.select("id", _words("text").alias("words")).filter(F.size("words") > 0)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(_words("text"))).alias("term")).join(df, "term")
    asked = wanted.groupBy("query_id").agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list(idf).alias("idf"))
    parts, blocks = max(1, -(-n // bucket)), max(1, -(-queries.count() // block))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = docs.select(spread("id", parts).alias("p"), every(blocks).alias("q"), F.col("id").alias("doc_id"), F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    right = asked.select(every(parts).alias("p"), spread("query_id", blocks).alias("q"), "query_id", "terms", "idf")

    def best(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if d.empty or a.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        d, a = d.sort_values("doc_id"), a.sort_values("query_id")
        ids, asks, nq = d["doc_id"].to_numpy(), a["query_id"].to_numpy(), len(a)
        at = np.repeat(np.arange(nq), [len(t) for t in a["terms"]])
        value = np.concatenate([np.asarray(v, dtype="float64") for v in a["idf"]])
        known, code = np.unique(np.concatenate([np.asarray(t, dtype="int64") for t in a["terms"]]), return_inverse=True)
        count = np.bincount(code, minlength=len(known))
        hot = count > nq // 64
        column = np.cumsum(hot) - 1
        dense = np.zeros((int(hot.sum()), nq))
        common = hot[code]
        dense[column[code[common]], at[common]] = value[common]
        order = np.argsort(code, kind="stable")
        at, value, start = at[order], value[order], np.cumsum(count) - count
        found = []
        for low in range(0, len(ids), 1000):
            some = ids[low : low + 1000]
            words = [np.asarray(w, dtype="int64") for w in d["words"].iloc[low : low + 1000]]
            size = np.array([len(w) for w in words])
            flat, row = np.concatenate(words), np.repeat(np.arange(len(some)), size)
            near = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[near] == flat
            pair, tf = np.unique(row[hit] * len(known) + near[hit], return_counts=True)
            row, term = pair // len(known), pair % len(known)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / avgdl))
            wide = np.zeros((len(some), dense.shape[0]))
            h = hot[term]
            wide[row[h], column[term[h]]] = weight[h]
            score = wide @ dense
            row, term, weight = row[~h], term[~h], weight[~h]
            times = count[term]
            post = np.repeat(start[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            score += np.bincount(np.repeat(row, times) * nq + at[post], np.repeat(weight, times) * value[post], len(some) * nq).reshape(len(some), nq)
            score[score == 0] = -np.inf
            score = np.round(score, 6)
            same = np.minimum(np.searchsorted(asks, some), nq - 1)
            own = np.flatnonzero(asks[same] == some)
            score[own, same[own]] = -np.inf
            for _ in range(min(k, len(some))):
                top = score.argmax(axis=0)  # the lowest document of a tie
                s = score[top, np.arange(nq)]
                held = s > -np.inf
                found.append((asks[held], some[top[held]], s[held]))
                score[top, np.arange(nq)] = -np.inf
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "doc_id", "score"))})

    scored = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, "query_id long, doc_id long, score double")
    return top_k(scored, k)


def cosine(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` of a stated query set against all rows.

    Both sides: id, vec.  The query set is broadcast only up to MAX_QUERIES rows; a larger
    one is run in blocks by the caller.
    """
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: run them in blocks")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), norm(F.col("vec")).alias("qn"))
    d = corpus.select(F.col("id").alias("doc_id"), F.col("vec").alias("dv"), norm(F.col("vec")).alias("dn"))
    pairs = d.join(F.broadcast(q))
    return pairs.select("query_id", "doc_id", (dot(F.col("qv"), F.col("dv")) / F.nullif(F.col("qn") * F.col("dn"), F.lit(0.0))).alias("score"))


MAX_QUERIES = 10_000


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = 5000, bucket: int = 8192, digits: int = 9) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` nearest other rows of each query, for any number of queries.

    Both sides: id (a unique long), vec.  A task has one bucket of rows and one block of
    queries, multiplies them as matrices, and returns its best ``k`` alone.  Null vectors and
    those of no length have no neighbours.
    """
    ship(corpus.sparkSession)
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    usable = lambda df: df.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("id is not null and vec is not null").filter(square > 0)
    rows, asked = usable(corpus), usable(queries)
    sizes = rows.agg(F.count(F.lit(1)).alias("n")).unionByName(asked.agg(F.count(F.lit(1)).alias("n"))).collect()
    parts, blocks = (max(1, -(-r[0] // m)) for r, m in zip(sizes, (bucket, block), strict=True))
    spread = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select(spread(parts).alias("p"), every(blocks).alias("q"), F.col("id").alias("doc_id"), "vec")
    right = asked.select(every(parts).alias("p"), spread(blocks).alias("q"), F.col("id").alias("query_id"), "vec")

    def best(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if d.empty or a.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        d, a = d.sort_values("doc_id"), a.sort_values("query_id")
        unit = lambda vs: (lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None])(np.stack(vs.to_list()))
        ids, asks, wanted = d["doc_id"].to_numpy(), a["query_id"].to_numpy(), unit(a["vec"]).T
        found = []
        for low in range(0, len(ids), 1000):
            some = ids[low : low + 1000]
            score = np.round(unit(d["vec"].iloc[low : low + 1000]) @ wanted, digits)
            same = np.minimum(np.searchsorted(asks, some), len(asks) - 1)
            own = np.flatnonzero(asks[same] == some)
            score[own, same[own]] = -np.inf
            for _ in range(min(k, len(some))):
                top = score.argmax(axis=0)  # the lowest row of a tie
                s = score[top, np.arange(len(asks))]
                held = s > -np.inf
                found.append((asks[held], some[top[held]], s[held]))
                score[top, np.arange(len(asks))] = -np.inf
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("query_id", "doc_id", "score"))})

    scored = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, "query_id long, doc_id long, score double")
    return top_k(scored, k)


def hashed_vectors(texts: DataFrame, size: int = 64) -> DataFrame:
    """``id, vec`` of texts (id, text): counts of words, each added to one of ``size`` places by the hash of the word."""
    counted = terms(texts, "id", "text")
    place = F.pmod(F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int"), F.lit(size))
    summed = counted.groupBy("id", place.alias("place")).agg(F.sum("tf").cast("double").alias("v"))
    held = F.map_from_entries(F.collect_list(F.struct("place", "v")))
    return summed.groupBy("id").agg(held.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))



def top_k(scored: DataFrame, k: int) -> DataFrame:
    """``rank`` 1..k per query; ties fall to the lower document."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(rankings: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several top lists."""
    both = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", "doc_id", "rank"))
    summed = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(summed, k)


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """Hit@1, Recall@k, MRR and the share of empty results; ``expected``: query_id, doc_id."""
    hit = ranked.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    seen = ranked.select("query_id").distinct().withColumn("seen", F.lit(1))
    per = expected.select("query_id").distinct().join(hit, "query_id", "left").join(seen, "query_id", "left")
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return per.agg(F.count(F.lit(1)).alias("queries"), rate(F.col("rank") == 1).alias("hit_at_1"), rate(F.col("rank") <= k).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), rate(F.col("seen").isNull()).alias("empty_rate"))


def context(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Per query its passages in rank order, each after a ``[SOURCE id]`` marker."""
    part = F.concat(F.lit("[SOURCE "), F.col("doc_id").cast("string"), F.lit("]\n"), F.col("text"))
    rows = ranked.join(texts, "doc_id").select("query_id", F.struct("rank", part.alias("part")).alias("p"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("context"))


def citations_valid(answer: Column, retrieved: Column) -> Column:
    """At least one ``[SOURCE id]`` cited, and none that was not retrieved."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[SOURCE ([^\]]+)\]"), F.lit(1)))
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, retrieved)) == 0)
