"""Nearest neighbours where ids repeat: every row asks and is found as itself."""

import numpy as np

from lexmill.llm import ann


def test_repeated_ids_are_rows_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i // 2 * 20 if i < 8 else i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(120)]  # ids 0, 20, 40, 60 twice
    rows += [(0, rows[0][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    m = np.array([v for _, v in rows])
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-s, rows[j][0]) for j, s in enumerate(m @ np.array(v)) if j != i)[:20]
            want += [(q, r + 1, n, round(-s, 9)) for r, (s, n) in enumerate(near)]
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.op7_ann(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want)
