import hashlib
import random

from gazeflow.operators import quota


def test_pool_gives_what_all_rows_give(spark):
    rng = random.Random(4)
    for n, cap, people, size in ((20, 2, 60, 600), (12, 1, 5, 300), (30, 3, 4, 200), (50, 2, 10, 20)):
        rows = [(i, rng.randrange(people), rng.choice("aab"), rng.choice(["x", "y", None])) for i in range(size)]
        quotas, weights = {"kind": {"a": n // 3, "b": n // 2}, "mark": {"x": n // 4}}, {"kind": 5.0, "mark": 10.0}
        df = spark.createDataFrame(rows, "id long, who long, kind string, mark string").selectExpr("*", "1 as step", "2 as _r")
        got = quota.quota_sample(df, "id", "who", quotas, weights, n, cap).orderBy("step").collect()
        plain = [(w, hashlib.md5(str(i).encode()).hexdigest(), k, m) for i, w, k, m in rows]
        assert [r.id for r in got] == [rows[i][0] for i in quota.replay(plain, list(quotas.values()), list(weights.values()), n, cap)]
        assert len(got) == min(n, size)
        pool = quota.candidates(df, "id", "who", list(quotas), n, cap).count()
        assert pool <= 2 * n * (2 * 3 + 1)
    assert quota.quota_sample(df.limit(0), "id", "who", quotas, weights, n, cap).count() == 0
