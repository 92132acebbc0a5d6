import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark import build_session

    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: Names that operators use inside, to clash with.
CLASHING = ["entity", "key", "value", "state", "lo", "hi", "lo_us", "hi_us", "at_us", "grp", "pos", "ord", "msg_id", "period", "epoch", "outcome", "b", "c", "r", "n", "table", "parts", "chunk", "ids", "__key", "__row", "__block"]


def write_tables(spark, to, change):
    """The small tables, changed by ``change(name, df)``."""
    for f in sorted(os.listdir(DATA)):
        name = f.removesuffix(".parquet")
        change(name, spark.read.parquet(f"{DATA}/{f}")).coalesce(1).write.parquet(f"{to}/{name}.parquet")
    return str(to)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    """All tables without rows, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    to = tmp_path_factory.mktemp("empty")
    return write_tables(spark, to, lambda name, df: df.limit(0).withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}))


@pytest.fixture(scope="session")
def dirty_tables(spark, tmp_path_factory):
    """The small tables with every row of every table twice or with nulls, and clashing columns."""
    from pyspark.sql import functions as F

    keep = {
        "payment_events": ["batch_id", "kafka_partition", "kafka_offset", "kafka_timestamp"], "payment_transactions_enriched": ["transaction_id"], "master_data_cdc": ["feed_position"], "merchant_history": ["__start_at"],
        "merchant_snapshots": ["snapshot_at", "record_version"], "documents": ["doc_id"],
    }
    payments = {*keep, "accounts", "customer_behavior_features", "merchant_behavior_features"}

    def change(name, df):
        if name not in payments:
            return df
        fixed = keep.get(name, [])
        nulls = df.limit(7)
        if name == "payment_events":
            nulls = nulls.withColumns({"kafka_offset": F.col("kafka_offset") + 10_000_000})
        if name == "master_data_cdc":
            nulls = nulls.withColumn("feed_position", F.col("feed_position") + 10_000_000)
        if name == "documents":
            nulls = nulls.withColumn("doc_id", F.col("doc_id") + 10_000_000)
        if name == "payment_transactions_enriched":
            nulls = nulls.withColumn("transaction_id", F.concat(F.lit("null-"), F.monotonically_increasing_id().cast("string"), F.lit("-1")))
        nulls = nulls.select(*[F.col(c) if c in fixed else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        again = df if name in ("payment_transactions_enriched", "merchant_history", "merchant_snapshots", "customer_behavior_features", "merchant_behavior_features") else df.limit(0)
        return df.unionByName(nulls).unionByName(again).withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})

    return write_tables(spark, tmp_path_factory.mktemp("dirty"), change)
