"""Cluster files are read in file order, without sorting their lines."""

import random

from seqlab.sources import files


def test_members_keep_their_header_over_splits_and_batches(spark, tmp_path):
    rng, expected = random.Random(2), []
    for f in range(3):
        lines = []
        for cluster in range(40):
            lines.append(f">Cluster {cluster}")
            for i in range(rng.choice((0, 1, 3, 900))):
                expected.append((str(cluster), f"f{f}_{cluster}_{i}"))
                lines.append(f"{i}\t12aa, >f{f}_{cluster}_{i}... *")
        (tmp_path / f"{f}.clstr").write_text("\n".join(lines) + "\n")
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        df = files.read_clusters(spark, str(tmp_path))
        assert sorted((r.cluster_id, r.member_id) for r in df.collect()) == sorted(expected)
        assert df._jdf.queryExecution().executedPlan().toString().count("Window") <= 2  # the one over splits, planned and adaptive
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
