"""Hand-checked fixtures for curation, matching, metrics and descriptors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.functions import composition as Q, descriptors as D, scalars as S
from seqlab.operators import curation as C, features as FE, frames, matching as M, metrics as ME, ranking as RK, resampling as RS
from seqlab.sources import files, sinks

RECORD = "sequence string, label string, source_db string, source_split string, source_file string, record_id string, record_name string, raw_label string, doc_id long, frag_no long"


def records(spark):
    return spark.createDataFrame([
        ("S1", "positive", "db1", "x", "f1", "r1", "", "p", 1, 1), ("S1", "negative", "db2", "x", "f1", "r2", "n", "q", 2, 1),
        ("S2", "positive", "db1", "x", "f1", "r3", "", "p", 3, 1), ("S2", "positive", "db2", "x", "f3", "r4", "late", "p", 4, 1)], RECORD)


def test_conflicts_and_dedup(spark):
    df = records(spark)
    assert [r.sequence for r in C.conflict_report(df).collect()] == ["S1"]
    row, = C.conflict_free(C.deduplicate(df)).collect()
    assert (row.sequence, row.support_count, row.source_dbs, row.example_name) == ("S2", 2, ["db1", "db2"], "late")
    assert sorted(r.record_id for r in C.drop_conflicting_records(df).collect()) == ["r3", "r4"]


def test_activity_audit(spark):
    rows = [("Monomer", "kwklfkkigi gkflhsak", "Gram+,Gram-"), ("Multimer", "KWKLFKKIGIGKFLHSAK", "Gram+"), ("Monomer", "KWKLFKKIGIGKFLHSAK", "Cancer"),
            ("Monomer", "KWKXBFKKIGIGK", "Fungus"), ("Monomer", "KWK", "Virus"), ("Monomer", " ", "Virus")]
    df = spark.createDataFrame(rows, "kind string, raw string, target string").withColumn("clean", S.normalise(F.col("raw")))
    reason = S.strict_rejection(F.col("clean"))
    rules = [("skip_non_monomer", F.trim("kind") != "Monomer"), ("skip_missing_positive_label", ~S.has_keyword(F.col("target"), S.ACTIVITY_KEYWORDS)),
             ("skip_empty_after_clean", F.col("clean") == ""), ("skip_non_standard_sequence", reason.isNotNull()), ("skip_length_filter", ~S.length_ok(F.col("clean")))]
    got = [r.outcome for r in C.charge_first_failure(df, rules).collect()]
    assert got == ["kept_rows", "skip_non_monomer", "skip_missing_positive_label", "skip_non_standard_sequence", "skip_length_filter", "skip_empty_after_clean"]
    assert df.select(reason.alias("r")).collect()[3].r == "contains_non_standard_residue:BX"


def test_relocation_and_quotas():
    served, moves = M.relocate_to_nearest({10: 2, 11: 1, 12: 1}, {10: 1, 11: 1, 12: 5})
    assert served == {10: 1, 11: 1, 12: 2} and moves == [(10, 12, 1, 2)]
    with pytest.raises(ValueError):
        M.relocate_to_nearest({10: 5}, {10: 1, 11: 1})
    assert M.relocate_to_nearest({}, {}) == ({}, [])
    assert M.capped_proportional([(10, 1, 5), (11, 1, 5), (12, 2, 9)], 6) == {10: 1, 11: 2, 12: 3}
    assert M.capped_proportional([(10, 0, 5)], 3) == {}
    assert M.capped_proportional([(10, 3, 1), (11, 1, 9)], 8) == {10: 1, 11: 7}
    assert M.capped_proportional([(10, 3, 1), (11, 1, 2)], 8) == {10: 1, 11: 2}


def test_relocation_and_quotas_keep_their_laws():
    rng = np.random.default_rng(5)
    for _ in range(300):
        lengths = range(10, 10 + int(rng.integers(1, 9)))
        available = {k: int(rng.integers(0, 9)) for k in lengths}
        wanted = {k: int(rng.integers(0, 6)) for k in lengths}
        if sum(wanted.values()) <= sum(available.values()):
            served, moves = M.relocate_to_nearest(wanted, available)
            assert sum(served.values()) == sum(wanted.values()) and all(n <= available[k] for k, n in served.items())
            left = {k: max(available[k] - wanted[k], 0) for k in lengths}
            for target, donor, n, distance in moves:  # nobody nearer had room when this donor was asked
                assert distance == abs(target - donor) and 0 < n <= left[donor]
                assert not any(left[k] for k in lengths if (abs(k - target), k) < (distance, donor))
                left[donor] -= n
        hist = [(k, int(rng.integers(0, 6)), available[k]) for k in lengths]
        total, positives = int(rng.integers(0, 40)), sum(p for _, p, _ in hist)
        quotas = M.capped_proportional(hist, total)
        assert set(quotas) == {k for k, p, _ in hist if p}
        if positives:
            floors = {k: min(int(p / positives * total), n) for k, p, n in hist if p}
            assert all(floors[k] <= q <= available[k] for k, q in quotas.items())
            assert sum(quotas.values()) == max(min(total, sum(available[k] for k in quotas)), sum(floors.values()))
            extra = {k: quotas[k] - floors[k] for k in quotas}
            most = max(extra.values())
            assert all(e >= most - 1 or quotas[k] == available[k] for k, e in extra.items())


def test_feature_labels(spark):
    names = {
        "AAC_C": ("AAC: Cys frequency", True), "ASDC_AC": ("ASDC: Ala-Cys pair", True), "DDE_AK": ("DDE: Ala-Lys deviation", False),
        "CKSAAP_CW.gap3": ("CKSAAP: Cys-Trp (gap 3)", True), "CTDD_charge.1.residue25": ("CTDD: Charge (25%)", False),
        "CTDD_some_key.2.residue100": ("CTDD: some key (100%)", False), "APAAC_Pc1.C": ("APAAC: Amphiphilicity (Cys)", True),
        "DP_C": ("DistancePair: Cys spacing", True), "APAAC_Pc1.W": ("APAAC1:W", False), "AAC_Z": ("AAC: Z frequency", False), "other": ("other", False),
    }
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: (r.label, r.about) for r in df.select("name", FE.feature_label(F.col("name")).alias("label"), FE.about_residue(F.col("name"), "C").alias("about")).collect()}
    assert got == {**names, None: (None, None)}


def test_greedy_runs_match_one_by_one():
    histogram = [(5, 2, 3, 2), (3, 1, 2, 4), (2, 2, 0, 7), (1, 1, 0, 40), (1, 0, 1, 55)]
    totals = [sum(h[i] * h[3] for h in histogram) for i in range(3)]
    filled = [[0, 0, 0] for _ in M.RATIOS]
    expected = {}
    for size, pos, neg, count in sorted(histogram, reverse=True):
        for _ in range(count):
            costs = [round(sum(
                (abs(filled[s][k] + x - totals[k] * r) - abs(filled[s][k] - totals[k] * r)) / max(totals[k] * r, 1)
                for k, x in enumerate((size, pos, neg))), 9) for s, r in enumerate(M.RATIOS)]
            best = costs.index(min(costs))
            for k, x in enumerate((size, pos, neg)):
                filled[best][k] += x
            runs = expected.setdefault((size, pos, neg), [])
            if runs and runs[-1][0] == best:
                runs[-1] = (best, runs[-1][1] + 1)
            else:
                runs.append((best, 1))
    assert M.assign_shapes(histogram) == expected


def test_balanced_strata_and_bins(spark):
    rows = [("M", 1)] * 3 + [("M", 0)] + [("A", 1)] * 2 + [("A", 0)] * 4
    df = spark.createDataFrame([(str(i), s, y) for i, (s, y) in enumerate(rows)], "uid string, s string, label_id int")
    got = {(r.s, r.label_id): r["count"] for r in M.balance_classes(df, ["s"], 1, "uid").groupBy("s", "label_id").count().collect()}
    assert got == {("M", 1): 1, ("M", 0): 1, ("A", 1): 2, ("A", 0): 2}
    bins = spark.createDataFrame([(0.0,), (0.05,), (0.051,), (1.0,)], "x double").select(M.frequency_bin(F.col("x"), F.lit(20)).alias("b"))
    assert [r.b for r in bins.collect()] == [-1, 0, 1, 19]


def test_rank_and_draw_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ranked = RK.global_position(df, [F.col("k").desc(), F.col("id").asc()], "p")
        quotas = spark.createDataFrame([(k, 5) for k in range(7)], "k long, quota long")
        drawn = RK.draw_by_quota(df, ["k"], quotas, S.unit_hash(1, "t", F.col("id")), ["id"])
        seen.append((sorted((r.id, r.p) for r in ranked.collect()), sorted((r.id, r.k) for r in drawn.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]
    assert sorted(p for _, p in seen[0][0]) == list(range(1, 1001)) and len(seen[0][1]) == 35


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, .9), (0, .8), (1, .7), (0, .1)], "label int, prob double")
    out = ME.ranking_metrics(df, []).first()
    assert math.isclose(out.roc_auc, 0.75) and math.isclose(out.pr_auc, 5 / 6)
    row = ME.threshold_metrics(ME.confusion(df, [], F.col("prob") >= 0.5)).first()
    assert (row.tp, row.fp, row.tn, row.fn) == (2, 1, 1, 0) and math.isclose(row.mcc, 2 / math.sqrt(12))
    tied = ME.ranking_metrics(df.withColumn("prob", F.lit(0.5)), []).first()
    assert tied.roc_auc == 0.5 and tied.pr_auc == 0.5
    squashed = ME.ranking_metrics(df.withColumn("prob", F.pow("prob", F.lit(3))), [], bounds=[0.1, 0.4, 0.5]).first()
    assert math.isclose(squashed.roc_auc, 0.75) and math.isclose(squashed.pr_auc, 5 / 6)


def test_mcnemar(spark):
    df = spark.createDataFrame([(3, 0), (0, 0), (5, 2), (0, 4)], "a_only long, b_only long")
    got = [r.p_value for r in RS.with_mcnemar_p(df).collect()]
    exact = sum(math.comb(7, k) for k in range(5, 8)) / 2**7
    assert [round(x, 12) for x in got] == [0.125, 1.0, round(exact, 12), 1.0]


def test_descriptors_by_hand(spark):
    df = spark.createDataFrame([("AAAA",), ("ACAC",), ("",)], "sequence string")
    rows = {r.sequence: r for r in Q.with_qc(df).collect()}
    a = rows["AAAA"]
    assert (a.entropy_norm, a.longest_run, a.top1_fraction, a.low_complexity, a.homopolymer, a.qc_pass) == (0.0, 4, 1.0, True, True, False)
    dpc = {r.feature: r.mean_frequency for r in D.occurrence_profile(df.where("sequence = 'ACAC'"), [], D.pairs(D.chars(F.col("sequence")))).collect()}
    assert dpc == {"AC": 2 / 3, "CA": 1 / 3}
    empty = D.with_phys8(df).where("sequence = ''").first()
    assert all(empty[f"phys8_{n}"] == 0.0 for n in D.PHYS8)


def test_state_fractions(spark):
    rows = [(f, f * 10.0, r, "H" if r < 3 - f else "C") for f in range(3) for r in range(4)]
    df = spark.createDataFrame(rows, "frame int, time_ns double, residue int, state string")
    fractions = frames.state_fractions(df, ["time_ns"], F.col("state") == "H")
    out = frames.fraction_summary(fractions, "time_ns", 10.0, 20.0).first()
    assert (out.initial, out.final, out.window_mean) == (0.75, 0.25, 0.375)


def test_integrity_checks_raise(spark):
    df = spark.createDataFrame([("a", "ACDEFGHIKL"), ("a", "ACDEFGHIKL")], "id string, sequence string")
    with pytest.raises(ValueError):
        files.load_candidates(df, "id", "sequence")
    with pytest.raises(ValueError):
        C.require_columns(df, ["label_id"])
    with pytest.raises(Exception, match="unknown label"):
        df.select(S.label_id(F.lit("maybe"))).collect()
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="missing v"):
        C.left_join_complete(left, spark.createDataFrame([(1, 5)], "k int, v int"), "k", "v").collect()


def test_file_sources(spark, tmp_path):
    fasta = tmp_path / "a.fa"
    fasta.write_text("note\n>a|1\nACDEFGHIKL\nMNPQ\n\n>b|0\nGGGGGGGGGGGG\n>c\nACDEFGHIKLMN\n")
    rows = {r.header: (r.raw_sequence, r.label) for r in files.read_labelled_fasta(spark, str(fasta)).collect()}
    assert rows == {"a|1": ("ACDEFGHIKLMNPQ", "1"), "b|0": ("GGGGGGGGGGGG", "0"), "c": ("ACDEFGHIKLMN", None)}
    ids = {r.header: r.record_id for r in files.with_file_ordinal(files.read_fasta(spark, str(fasta))).collect()}
    assert ids == {"a|1": "a.fa:1", "b|0": "a.fa:2", "c": "a.fa:3"}
    clusters = tmp_path / "c.clstr"
    clusters.write_text(">Cluster 0\n0\t18aa, >seq_000001... *\n1\t17aa, >seq_000002... at 88.24%\n>Cluster 1\n0\t12aa, >seq_000003... *\n")
    got = sorted((r.cluster_id, r.member_id) for r in files.read_clusters(spark, str(clusters)).collect())
    assert got == [("0", "seq_000001"), ("0", "seq_000002"), ("1", "seq_000003")]
    preds = tmp_path / "p.tsv"
    preds.write_text("# comment\nID\tscore\na\t0.5\nb\tnone\n")
    got = [(r.fasta_id, r.score) for r in files.read_predictions(spark, str(preds), ["id", "ID"], ["score"], "\t", "#").collect()]
    assert got == [("a", 0.5), ("b", None)]
    names = tmp_path / "n.json"
    names.write_text('{"groups": ["x", "y"]}')
    assert [r.name for r in files.read_json_list(spark, str(names), "groups").collect()] == ["x", "y"]
    csv = tmp_path / "s.csv"
    csv.write_text("Seq\nac d\n\nKK\n")
    assert sorted(r.sequence for r in files.read_sequences_only(spark, str(csv)).collect()) == ["ACD", "KK"]
    listed = {r.file_name: r.status for r in files.list_files(spark, str(tmp_path), [".fa", ".csv"]).collect()}
    assert listed["a.fa"] == "used" and listed["p.tsv"] == "ignored"


def test_fasta_files_of_one_name(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.fa").write_text(f">{folder}1\nACD\n>{folder}2\nEFG\n")
    back = files.with_file_ordinal(files.read_fasta(spark, f"{tmp_path}/*/part.fa")).collect()
    assert sorted((r.header, r.raw_sequence, r.record_id) for r in back) == [
        ("a1", "ACD", "part.fa:1"), ("a2", "EFG", "part.fa:2"), ("b1", "ACD", "part.fa:1"), ("b2", "EFG", "part.fa:2")]


def test_clusters_cross_splits(spark, tmp_path):
    rows = [(n, f"id_{n}_{k:03d}", 10 + k) for n, size in ((0, 1), (1, 300), (2, 40), (7, 1)) for k in range(size)]
    df = spark.createDataFrame(rows, "cluster int, member string, length int")
    sinks.write_clusters(df.coalesce(1), str(tmp_path / "c"), "cluster", "member", "length")
    want = sorted((str(n), member) for n, member, _ in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # a cluster spans many splits
    try:
        back = files.read_clusters(spark, str(tmp_path / "c"))
        assert spark.read.text(str(tmp_path / "c")).rdd.getNumPartitions() > 20
        assert sorted((r.cluster_id, r.member_id) for r in back.collect()) == want
        (tmp_path / "c" / "late.txt").write_text("0\t9aa, >early... *\n>Cluster 9\n0\t9aa, >late... *\n")
        with pytest.raises(Exception, match="ahead of the first cluster"):
            files.read_clusters(spark, str(tmp_path / "c")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_clusters(spark, tmp_path):
    (tmp_path / "empty.clstr").write_text("")
    assert files.read_clusters(spark, str(tmp_path / "empty.clstr")).count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "ACDEFGHIKL", "train"), ("s2", "MNPQRSTVWY", "test")], "fasta_id string, sequence string, split string")
    sinks.write_fasta(df, str(tmp_path / "f"), F.col("fasta_id"))
    back = sorted((r.header, r.raw_sequence) for r in files.read_fasta(spark, str(tmp_path / "f")).collect())
    assert back == [("s1", "ACDEFGHIKL"), ("s2", "MNPQRSTVWY")]
    sinks.write_split_bundle(df, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "csv")).where("split = 'test'").first().fasta_id == "s2"
    sinks.write_table(df, str(tmp_path / "t"), ["split"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c.csv"))
    assert files.read_table(spark, str(tmp_path / "c.csv")).count() == 2
    sinks.write_manifest(df.agg(F.struct(F.count("*").alias("rows")).alias("totals")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().totals.rows == 2
    tagged = df.withColumn("task", F.lit("a")).withColumn("x", F.lit(1.0))
    sinks.write_feature_bundle([tagged.where("split = 'train'"), tagged.where("split = 'test'")], ["fasta_id"], ["x"], str(tmp_path / "g"))
    assert sorted(spark.read.parquet(str(tmp_path / "g")).columns) == ["fasta_id", "split", "task", "x"]
