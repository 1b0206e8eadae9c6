"""Whether the result of a rule's query makes it fire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.functions.numbers import number


def met(result: DataFrame, condition: dict) -> bool:
    """``count_gt``/``count_ge`` N: the number of rows, or any row's ``count``, is above
    (or at least) N; any other condition: there is a row.  One job, and for the
    latter only as much of it as the first row takes."""
    for name, test in (("count_gt", lambda x, n: x > n), ("count_ge", lambda x, n: x >= n)):
        if name in condition:
            n = int(condition[name])
            top = F.max(number(F.col("count"), dict(result.dtypes)["count"])) if "count" in result.columns else F.lit(None).cast("double")
            r = result.agg(F.count(F.lit(1)).alias("rows"), top.alias("top")).first()
            return test(r.rows, n) or (r.top is not None and test(r.top, n))
    return not result.limit(1).isEmpty()
