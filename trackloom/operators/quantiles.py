"""Exact quantiles of a whole column without bringing its values together.

`percentile` keeps every distinct value in one buffer, which for a column of a whole cloud is the cloud. Here each pass counts the values in buckets, at
most BUCKETS of them, and looks closer only at the buckets that hold the ranks asked for, until these hold few values (FINISH) or a single one. Buckets
follow the values, so bounds are values of the column, and nothing is rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, FINISH = 4096, 20_000


def _ranked(df: DataFrame, ranks: list[int], low: float, high: float, n: int) -> dict[int, float]:
    """The values at ranks (from 0) of a column `v` of finite values from low to high."""
    out: dict[int, float] = {}
    todo = [(low, high, 0, n, ranks)]  # values from low to high, so many before them, so many in them, and the ranks that fall there
    while todo:
        for a, _, _, _, own in [x for x in todo if x[0] == x[1]]:
            out |= dict.fromkeys(own, a)
        todo = [x for x in todo if x[0] < x[1]]
        few = [x for x in todo if x[3] <= FINISH]
        if few:
            inside = F.explode(F.filter(F.array(*(F.when(F.col("v").between(a, b), F.lit(k)) for k, (a, b, *_) in enumerate(few))), lambda x: x.isNotNull()))
            values: dict[int, list[float]] = {}
            for r in df.select("v", inside.alias("k")).collect():
                values.setdefault(r["k"], []).append(r["v"])
            for k, (_, _, before, _, own) in enumerate(few):
                some = sorted(values[k])
                out |= {rank: some[rank - before] for rank in own}
        todo = [x for x in todo if x[3] > FINISH]
        if not todo:
            break
        # Half of each bound, as their difference may be more than a double holds.
        at = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BUCKETS)).cast("int").alias("bucket"))) for k, (a, b, *_) in enumerate(todo)]
        rows = df.select("v", F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("at"))
        found = rows.groupBy("at.k", "at.bucket").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k", "bucket").collect()
        closer = []
        for k, (_, _, before, _, own) in enumerate(todo):
            for r in (x for x in found if x["k"] == k):
                here = [rank for rank in own if before <= rank < before + r["n"]]
                if here:
                    closer.append((r["a"], r["b"], before, r["n"], here))
                before += r["n"]
        todo = closer
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The quantiles of a column, straight between the two values at either side of the rank, as `percentile` gives them; None without a value.

    Nulls do not count. NaN is above all numbers. Each pass reads the column once; one pass of 4096 buckets is enough for most columns.
    """
    v = F.col(f"`{column}`").cast("double")
    rows = df.select(v.alias("v")).filter("v is not null")
    under, over = F.col("v") == -math.inf, (F.col("v") == math.inf) | F.isnan("v")
    finite = F.when(~under & ~over, F.col("v"))
    r = rows.agg(F.count("*").alias("n"), F.count_if(under).alias("under"), F.count_if(over).alias("over"), F.count_if(F.isnan("v")).alias("nan"), F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    if not r["n"]:
        return None
    places = [share * (r["n"] - 1) for share in shares]
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    middle = r["n"] - r["over"]
    known = {k: -math.inf if k < r["under"] else math.nan if k >= r["n"] - r["nan"] else math.inf for k in wanted if k < r["under"] or k >= middle}
    inner = [k - r["under"] for k in wanted if k not in known]
    if inner:
        known |= {k + r["under"]: x for k, x in _ranked(rows.filter(~under & ~over), inner, r["low"], r["high"], middle - r["under"]).items()}
    out = []
    for p in places:
        a, b = known[math.floor(p)], known[math.ceil(p)]
        out.append(a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out
