"""Linear churn scorers as column expressions.

``LinearScorer`` turns ``intercept + sum(w * x)`` into a probability with the
logistic link, inside one projection (no Python on the data path). It serves
two uses: the coefficients of a fitted ``LogisticRegressionModel`` and the
fixed reference scorer below, which gives a deterministic probability so that
the rule and metric operators can be checked apart from model training.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sigmoid


@dataclass
class LinearScorer:
    coefficients: dict[str, float]   # feature -> weight, in evaluation order
    intercept: float = 0.0
    digits: int | None = 6           # round probabilities (None: keep all bits)

    def margin(self) -> Column:
        m = F.lit(float(self.intercept))
        for f, w in self.coefficients.items():
            m = m + F.lit(float(w)) * F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))
        return m

    def probability(self) -> Column:
        p = sigmoid(self.margin())
        return F.bround(p, self.digits) if self.digits is not None else p

    def transform(self, df: DataFrame, out: str = "churn_prob") -> DataFrame:
        return df.withColumn(out, self.probability())


# FIXED VALUES: the deterministic stand-in scorer on client-mart columns
RULE_SCORER = LinearScorer(
    coefficients={"days_since_last_order": 0.01, "total_orders": -0.05, "return_rate": 2.0},
    intercept=-2.0, digits=6)


def rule_score_sql(prefix: str = "") -> str:
    """SQL of :data:`RULE_SCORER` over columns ``prefix<name>``."""
    m = f"{float(RULE_SCORER.intercept)!r}"
    for f, w in RULE_SCORER.coefficients.items():
        m = f"({m} + {float(w)!r} * coalesce(CAST({prefix}{f} AS DOUBLE), 0.0))"
    return f"round_even(1.0 / (1.0 + exp(-({m}))), {RULE_SCORER.digits})"
