"""Queries that do the whole job where the query of the SQL does a part: checked against the tables by hand."""

import hashlib

from compare import connect
from conftest import DATA

from tidemark.operators import retrieval
from tidemark.queries import base, core, flows, platform


def test_rag_passages_hold_whole_texts(spark):
    texts = dict(connect(DATA).execute("SELECT doc_id, \"text\" FROM documents").fetchall())
    ranked = {}
    for r in core.keyword_topk(spark, DATA).orderBy("query_id", "rank").collect():
        ranked.setdefault(r["query_id"], []).append(r["doc_id"])
    want = {q: "\n\n".join(f"[SOURCE {d}]\n{texts[d]}" for d in docs) for q, docs in ranked.items()}
    got = platform.rag_passages(spark, DATA).collect()
    assert {r["query_id"]: r["context"] for r in got} == want
    assert all(r["context_length"] == len(want[r["query_id"]]) and r["context_hash"] == hashlib.sha256(want[r["query_id"]].encode()).hexdigest() for r in got)
    assert any(len(texts[d]) > 40 for docs in ranked.values() for d in docs)


def test_every_transaction_is_scored_by_the_champion(spark):
    ids = [r[0] for r in base.transactions(spark, DATA).select("transaction_id").collect()]
    got = flows.transaction_scores(spark, DATA).collect()
    assert len(ids) > 100 and sorted(r["transaction_id"] for r in got) == sorted(ids)
    assert {(r["model_version"], r["model_alias"]) for r in got} == {("1", "Champion")}
    assert all(0 <= r["fraud_probability"] <= 1 and r["predicted_fraud"] in (0, 1) for r in got)
    tested = {r["transaction_id"]: (r["fraud_probability"], r["predicted_fraud"], r["model_name"]) for r in flows.fraud_model(spark, DATA).collect()}
    scored = {r["transaction_id"]: (r["fraud_probability"], r["predicted_fraud"], r["model_name"]) for r in got}
    assert tested and {t: scored[t] for t in tested} == tested


def test_every_twentieth_document_is_a_question(spark):
    words = "list_filter(regexp_split_to_array(lower(\"text\"), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    want = connect(DATA).execute(f"""WITH po AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({words}) AS term FROM documents WHERE "text" IS NOT NULL) GROUP BY ALL),
        dl AS (SELECT id, sum(tf) AS dl FROM po GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
        s AS (SELECT a.id AS q, po.id AS d, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
              FROM po a JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id, st WHERE a.id % 20 = 0 AND a.id <> po.id GROUP BY ALL)
        SELECT q, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s) WHERE rank <= 3""").fetchall()
    assert len({q for q, _, _ in want}) == 5
    assert sorted(map(tuple, core.keyword_search(spark, DATA).collect())) == sorted(want)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").selectExpr("doc_id AS id", "text")
    cut = retrieval.bm25_top_k(rows.filter("id % 20 = 0"), rows, 3, block=2, bucket=30).select("query_id", "doc_id", "rank")
    assert sorted(map(tuple, cut.collect())) == sorted(want)
