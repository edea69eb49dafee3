"""Greedy choice of rows under soft quotas and a cap on rows of a subject.

Each step takes the row that helps most quotas that are still open (by their weights), of equal ones that with the least hash,
among rows of subjects below the cap; if none is left, the cap falls and rows follow by their hash alone. Only rows that this
can ever take go to the task that replays it: of rows alike in all quota columns at most 2 n, since n may be taken and the
rows skipped before them belong to capped subjects, and of all rows the first 2 n for the end. Both are cut by ranks that Spark
limits before its shuffle, so no task gets more than 2 n rows for each combination of quota values, whatever the table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(rows: list[tuple], quotas: list[dict], weights: list[float], n: int, cap: int) -> list[int]:
    """Positions of rows (subject, hash, values of the quota columns) in the order in which they are taken."""
    left = sorted(range(len(rows)), key=lambda i: rows[i][1])
    subjects: dict = {}
    open_ = [dict(q) for q in quotas]
    out: list[int] = []
    while len(out) < n and left:
        best, most = None, -1.0
        for i in left:
            if subjects.get(rows[i][0], 0) < cap:
                score = sum(w for q, w, v in zip(open_, weights, rows[i][2:], strict=True) if q.get(v, 0) > 0)
                if score > most:
                    best, most = i, score
        if best is None:
            out += left[: n - len(out)]
            break
        left.remove(best)
        out.append(best)
        subjects[rows[best][0]] = subjects.get(rows[best][0], 0) + 1
        for q, v in zip(open_, rows[best][2:], strict=True):
            if v in q:
                q[v] -= 1
    return out


def candidates(df: DataFrame, key: str, subject: str, columns: list[str], n: int, cap: int) -> DataFrame:
    """The rows that a greedy choice of n can take: (key, subject, hash, quota columns)."""
    rows = df.select(key, subject, F.md5(F.col(key).cast("string")).alias("_hash"), *columns)
    by = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy("_hash", key))
    own = rows.withColumn("_r", by(*columns, subject)).where(F.col("_r") <= cap).withColumn("_r", by(*columns)).where(F.col("_r") <= 2 * n).drop("_r")
    last = rows.orderBy("_hash", key).limit(2 * n)
    return own.union(last).distinct()


def quota_sample(df: DataFrame, key: str, subject: str, quotas: dict[str, dict], weights: dict[str, float], n: int, cap: int = 2) -> DataFrame:
    """(key, subject, quota columns, step) of the n rows taken, fewer if there are not as many; keys must differ."""
    columns = list(quotas)
    pool = candidates(df, key, subject, columns, n, cap)
    kept = [key, subject, *columns]
    schema = ", ".join(f"{c} {dict(pool.dtypes)[c]}" for c in kept) + ", step int"

    def take(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group[[subject, "_hash", *columns]].itertuples(index=False, name=None))
        taken = replay(rows, [quotas[c] for c in columns], [weights[c] for c in columns], n, cap)
        return group.iloc[taken][kept].assign(step=range(1, len(taken) + 1))

    return pool.groupBy().applyInPandas(take, schema)
