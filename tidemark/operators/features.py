"""Point-in-time features: what was known strictly before each event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof

DAY = 86_400
HORIZONS = {"1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def one_hot(column: str, names: Mapping[str, str]) -> dict[str, Column]:
    return {flag: F.col(column) == value for value, flag in names.items()}


def transaction_features(rows: DataFrame, home: str = "AU", keep: Sequence[Column] = ()) -> DataFrame:
    """Features of the transaction itself; nothing here comes from its outcome.  ``keep`` are columns to carry along."""
    amount, day = F.col("amount").cast("double"), F.dayofweek("event_timestamp")
    made = {
        "amount": amount, "amount_log1p": F.when(amount > -1, F.log1p(amount)), "hour_of_day": F.hour("event_timestamp"), "day_of_week": day, "is_weekend": day.isin(1, 7),
        "is_cross_border": F.upper("country") != home, "is_card_not_present": ~F.coalesce("card_present", F.lit(False)),
        **one_hot("channel", {"POS": "is_pos", "ECOMMERCE": "is_ecommerce", "MOBILE": "is_mobile", "ATM": "is_atm"}),
        **one_hot("payment_method", {"DEBIT_CARD": "is_debit_card", "CREDIT_CARD": "is_credit_card", "DIGITAL_WALLET": "is_digital_wallet", "BANK_TRANSFER": "is_bank_transfer"}),
    }
    ids = ["transaction_id", "customer_id", "account_id", "merchant_id"]
    return rows.select(*ids, F.col("event_timestamp").alias("transaction_event_timestamp"), *[c.alias(n) for n, c in made.items()], *keep)


def behaviour(rows: DataFrame, entity: str, prefix: str, home: str = "AU") -> DataFrame:
    """Nine trailing features per entity and second, over the time strictly before it.

    A trailing sum is the difference of two running sums: what came before t, less what came
    before t - w.  Each observation asks for its running sums at four instants; a running sum
    is the sum of the entity's days before plus a running sum inside the day.  That is linear
    where a sliding frame would be quadratic, and no task holds more than a day of an entity.
    """
    flags = {"declined": F.col("transaction_status") == "DECLINED", "foreign": F.upper("country") != home, "absent": ~F.coalesce("card_present", F.lit(False))}
    seen = rows.filter(F.col(entity).isNotNull() & F.col("event_timestamp").isNotNull()).groupBy(entity, F.col("event_timestamp").alias("feature_timestamp")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()]
    )
    values = ["n", "total", *flags]
    seen = seen.withColumn("s", F.unix_seconds(F.col("feature_timestamp").cast("timestamp")))
    # At equal seconds a question comes before the observation: peers do not see each other.
    asks = {"now": 0, **HORIZONS}
    nothing = [F.lit(0).cast(seen.schema[v].dataType).alias(v) for v in values]
    points = F.array(F.struct(F.lit("seen").alias("kind"), F.col("s").alias("x"), *values), *[F.struct(F.lit(h).alias("kind"), (F.col("s") - w).alias("x"), *nothing) for h, w in asks.items()])
    long = seen.select(entity, "feature_timestamp", F.explode(points).alias("p")).select(entity, "feature_timestamp", "p.*").withColumn("day", F.expr(f"cast(floor(x / {DAY}) as int)"))
    inside = Window.partitionBy(entity, "day").orderBy("x", F.col("kind") == "seen").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumns({f"in_{v}": F.sum(v).over(inside) for v in values}).filter("kind != 'seen'")
    per_day = seen.groupBy(entity, F.expr(f"cast(floor(s / {DAY}) as int)").alias("day")).agg(*[F.sum(v).alias(v) for v in values])
    asked_days = per_day.select(entity, F.explode(F.array(*[F.col("day") - w // DAY for w in asks.values()])).alias("day"), *nothing)
    before = Window.partitionBy(entity).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.unionByName(asked_days).groupBy(entity, "day").agg(*[F.sum(v).alias(v) for v in values])
    days = days.select(entity, "day", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"to_{v}") for v in values])
    sums = long.join(days, [entity, "day"]).select(entity, "feature_timestamp", "kind", *[(F.col(f"in_{v}") + F.col(f"to_{v}")).alias(v) for v in values])
    at = lambda v, h: F.max(F.when(F.col("kind") == h, F.col(v)))
    wide = sums.groupBy(entity, "feature_timestamp").agg(*[(at(v, "now") - at(v, h)).alias(f"{v}_{h}") for v in values for h in HORIZONS])
    share = lambda c: F.when(F.col("n_30d") > 0, F.col(c).cast("double") / F.col("n_30d")).otherwise(F.lit(0.0))
    return wide.select(
        entity, "feature_timestamp", *[F.col(f"n_{h}").cast("long").alias(f"{prefix}_txn_count_{h}") for h in HORIZONS], *[F.col(f"total_{h}").cast("double").alias(f"{prefix}_amount_sum_{h}") for h in ("1d", "7d")],
        share("total_30d").alias(f"{prefix}_avg_amount_30d"), share("declined_30d").alias(f"{prefix}_decline_rate_30d"), share("foreign_30d").alias(f"{prefix}_foreign_rate_30d"), share("absent_30d").alias(f"{prefix}_card_not_present_rate_30d"),
    )


def label_transactions(enriched: DataFrame) -> DataFrame:
    """Usable labels: a decided outcome and both entities known."""
    decided = F.coalesce(F.col("fraud_outcome") != "UNDETERMINED", F.lit(True))
    ok = decided & F.col("customer_id").isNotNull() & F.col("merchant_id").isNotNull()
    return enriched.filter(ok).select("transaction_id", "customer_id", "merchant_id", "event_timestamp", F.coalesce(F.col("fraud_outcome") == "CONFIRMED_FRAUD", F.lit(False)).cast("int").alias("is_confirmed_fraud"))


def training_set(labels: DataFrame, own: DataFrame, customer: DataFrame, merchant: DataFrame) -> DataFrame:
    """Labels with exact transaction features and the last behaviour known at or before the event."""
    drop = {"feature_timestamp", "customer_id", "merchant_id"}
    rows = labels
    for key, table in (("customer_id", customer), ("merchant_id", merchant)):
        rows = asof(rows, table, [key], "event_timestamp", "feature_timestamp", [c for c in table.columns if c not in drop]).drop("asof_timestamp")
    exact = own.drop("customer_id", "merchant_id", "account_id", "transaction_event_timestamp")
    return rows.join(exact, "transaction_id", "left").drop("customer_id", "merchant_id")


def temporal_split(rows: DataFrame, at: str, tie: str, shares: Sequence[float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """``split`` by position in time: train, validation, test; no row is ever later than one of the next split.

    Only the two rows at the cuts are looked for: minutes are counted, combined map-side; the
    minute that holds a cut is sorted.  All rows are then compared with the cuts where they
    are, without any shuffle.  Rows without time belong to the earliest part.
    """
    usable = rows.filter(F.col(at).isNotNull() & F.col(tie).isNotNull())
    us = F.unix_micros(F.col(at).cast("timestamp"))
    minute = F.expr(f"cast(floor(unix_micros(cast(`{at}` as timestamp)) / 60000000) as bigint)")
    per = usable.groupBy(minute.alias("m")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(F.lit(0)).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # one row per minute of the time span
    held = per.select("m", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    last = [F.floor(F.col("n") * sum(shares[: i + 1])) for i in range(2)]
    found = held.select("m", "c", "upto", *[w.alias(f"p{i}") for i, w in enumerate(last)]).filter(" or ".join(f"(p{i} <= upto and p{i} > upto - c)" for i in range(2))).collect()  # at most two minutes
    cuts = []
    for i in range(2):
        hit = next((r for r in found if r["upto"] - r["c"] < r[f"p{i}"] <= r["upto"]), None)
        if hit is None:
            cuts.append(None)
            continue
        k = hit[f"p{i}"] - (hit["upto"] - hit["c"])
        cuts.append(usable.filter(minute == hit["m"]).select(us.alias("u"), F.col(tie).alias("t")).orderBy("u", "t").offset(k - 1).limit(1).first())
    before = lambda c: F.lit(False) if c is None else (us < c["u"]) | ((us == c["u"]) & (F.col(tie) <= c["t"]))
    which = F.when(F.col(at).isNull() | F.col(tie).isNull() | before(cuts[0]), "train").when(before(cuts[1]), "validation").otherwise("test")
    return rows.withColumn("split", which)


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and infinities become 0.0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in columns})
