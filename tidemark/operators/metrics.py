"""Aggregates at several grains, and a metric layer that evaluates measures at the grain asked for.

Conditional counts are ``count_if``: one pass, combined map-side, and null counts as no.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"


def total(amount: Column | str) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY).cast("double")


def mean(amount: Column | str) -> Column:
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(c).cast(MONEY).cast("double") / F.count(c)


def status_is(value: str) -> Column:
    return F.count_if(F.col("transaction_status") == value)


def _fraud() -> dict[str, Column]:
    return {"transactions_with_fraud_case": F.count_if("has_fraud_case"), "confirmed_fraud_transactions": F.count_if(F.col("fraud_outcome") == "CONFIRMED_FRAUD")}


def _grain(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def daily(enriched: DataFrame) -> DataFrame:
    return _grain(enriched, ["event_date", "currency"], {
        "transaction_count": F.count(F.lit(1)), "total_payment_amount": F.sum("amount").cast(MONEY).cast("double"), "average_payment_amount": mean("amount"),
        "minimum_payment_amount": F.min("amount").cast("double"), "maximum_payment_amount": F.max("amount").cast("double"),
        **{f"{s.lower()}_transactions": status_is(s) for s in ("AUTHORIZED", "DECLINED", "SETTLED", "REVERSED", "REFUNDED")}, **_fraud(),
        "high_risk_customer_transactions": F.count_if(F.col("customer_risk_rating") == "HIGH"), "high_risk_merchant_transactions": F.count_if(F.col("merchant_risk_rating") == "HIGH"),
    })


def by_merchant(enriched: DataFrame) -> DataFrame:
    keys = ["merchant_id", "merchant_name", "merchant_category_code", "merchant_risk_rating", "merchant_status", "currency"]
    return _grain(enriched, keys, {
        "transaction_count": F.count(F.lit(1)), "distinct_customers": F.count_distinct("customer_id"), "total_payment_amount": F.sum("amount").cast(MONEY).cast("double"), "average_payment_amount": mean("amount"),
        "maximum_payment_amount": F.max("amount").cast("double"), "declined_transactions": status_is("DECLINED"), **_fraud(), "confirmed_fraud_amount": total(F.when(F.col("fraud_outcome") == "CONFIRMED_FRAUD", F.col("amount"))),
    })


def by_channel(enriched: DataFrame) -> DataFrame:
    absent = ~F.coalesce(F.col("card_present"), F.lit(False))
    return _grain(enriched, ["event_date", "channel", "payment_method", "currency"], {
        "transaction_count": F.count(F.lit(1)), "total_payment_amount": F.sum("amount").cast(MONEY).cast("double"), "average_payment_amount": mean("amount"),
        "card_present_transactions": F.count_if("card_present"), "card_not_present_transactions": F.count_if(absent), "declined_transactions": status_is("DECLINED"), **_fraud(),
    })


def fraud_operations(enriched: DataFrame) -> DataFrame:
    case = lambda v: F.count_if(F.col("fraud_case_status") == v)
    outcome = lambda v: F.count_if(F.col("fraud_outcome") == v)
    return _grain(enriched, ["event_date", "currency"], {
        "transaction_count": F.count(F.lit(1)), "fraud_case_transactions": F.count_if("has_fraud_case"), "open_fraud_cases": case("OPEN"), "investigating_fraud_cases": case("INVESTIGATING"), "closed_fraud_cases": case("CLOSED"),
        "confirmed_fraud_transactions": outcome("CONFIRMED_FRAUD"), "legitimate_transactions": outcome("LEGITIMATE"), "undetermined_transactions": outcome("UNDETERMINED"),
        "payment_amount_under_investigation": total(F.when(F.col("has_fraud_case"), F.col("amount"))), "confirmed_fraud_amount": total(F.when(F.col("fraud_outcome") == "CONFIRMED_FRAUD", F.col("amount"))),
    })


@dataclass(frozen=True)
class MetricView:
    """Named dimensions and measures over one source.

    A measure is an aggregate expression, evaluated from base rows at the grain of each
    query: ratios and distinct counts are right at every grain, and nothing is rolled up.
    """

    source: DataFrame
    dimensions: Mapping[str, Column | str]
    measures: Mapping[str, Column]
    filter: Column | None = field(default=None)

    def query(self, dims: Sequence[str], measures: Sequence[str], where: Column | None = None, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        unknown = [d for d in dims if d not in self.dimensions] + [m for m in measures if m not in self.measures]
        if unknown:
            raise KeyError(f"not in the metric view: {unknown}")
        rows = self.source if self.filter is None else self.source.filter(self.filter)
        made = {d: (F.col(c) if isinstance(c, str) else c) for d, c in self.dimensions.items()}
        rows = rows.withColumns({d: c for d, c in made.items() if not (isinstance(self.dimensions[d], str) and self.dimensions[d] == d)})
        if where is not None:
            rows = rows.filter(where)
        out = rows.groupBy(*dims).agg(*[self.measures[m].alias(m) for m in measures])
        if order:
            out = out.orderBy(*[F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order])
        return out if limit is None else out.limit(limit)

    def sql(self, text: str) -> DataFrame:
        """A query in which ``MEASURE(m)`` is put in as its aggregate; Spark parses all of it.

        The view is registered, with its dimensions as columns, under the name behind FROM.
        """
        source = re.search(r"(?is)\bfrom\s+(`?\w+`?)", text)
        if not source:
            raise ValueError("expected SELECT ... FROM view")
        rows = self.source if self.filter is None else self.source.filter(self.filter)
        rows = rows.withColumns({d: (F.col(c) if isinstance(c, str) else c) for d, c in self.dimensions.items()})
        rows.createOrReplaceTempView(source[1].strip("`"))
        # What the analyser makes of a measure over these rows, as SQL.
        said = lambda m: rows.agg(self.measures[m[1]].alias("m"))._jdf.queryExecution().analyzed().aggregateExpressions().head().child().sql()
        full = re.sub(r"(?i)\bmeasure\s*\(\s*`?(\w+)`?\s*\)", lambda m: f"({said(m)})", text)
        return rows.sparkSession.sql(full.strip().rstrip(";"))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient that is null where nothing was counted."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
