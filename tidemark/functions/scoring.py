"""The loyalty score in its three forms: column expression, SQL function and Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Multiplier per tier; any other tier counts once.
TIERS = {"BRONZE": 1, "SILVER": 2, "GOLD": 3}


def score(amount: Column, tier: Column) -> Column:
    factor = F.lit(1)
    for name, times in TIERS.items():
        factor = F.when(tier == name, times).otherwise(factor)
    return F.floor(amount / 100).cast("int") * factor


def register_score(spark: SparkSession, name: str = "calculate_score") -> None:
    """The same score as a SQL function; Spark inlines it, so nothing leaves the JVM."""
    cases = " ".join(f"WHEN '{tier}' THEN {times}" for tier, times in TIERS.items())
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(amount DOUBLE, tier STRING) RETURNS INT
            RETURN CAST(floor(amount / 100) AS INT) * CASE tier {cases} ELSE 1 END"""
    )


@F.pandas_udf(IntegerType())
def score_batches(amount: pd.Series, tier: pd.Series) -> pd.Series:
    return (amount // 100 * tier.map(TIERS).fillna(1)).astype("Int32")  # a NULL amount has no score
