import random

import corpus_pipeline
from gazeflow.llm import queries

from . import brute
from .test_operators import sentence


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    passage = sentence(rng, 60)
    for i in range(120):
        good = rng.random() < 0.8
        words = sentence(rng, rng.randint(20, 60)).split()
        if not good:
            words = [w + "###" for w in words]
        elif i % 6 == 0:
            words += passage.split()
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)] + [(300, ""), (301, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    step = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, read, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        step[name] = read = spark.read.parquet(f"{tmp_path}/{name}")
    good = {i: t for i, t in rows if "###" not in (t or "")}
    kept = {r.doc_id: r.text for r in step["quality_filter"].collect()}
    assert kept == good and step["quality_filter"].columns == docs.columns
    label = brute.jaccard(list(kept.items()), 5, 4, 5)
    one = {r.doc_id: r.text for r in step["near_duplicates"].collect()}
    assert one == {i: t for i, t in kept.items() if label[i][1] == i}
    left = {r.doc_id: (r.text, r.n_chars) for r in step["repeated_passages"].collect()}
    cut = {i: x[4].decode("utf-8", "ignore") for i, x in brute.repeats(list(one.items()), 100).items()}
    assert left == {i: (None if one[i] is None else t, len(t)) for i, t in cut.items() if t or not one[i]}
    packed = step["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == set(left)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.ids_crc32 for r in run) == sorted(r.ids_crc32 for r in packed)


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
