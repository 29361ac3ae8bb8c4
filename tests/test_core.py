"""Kernels, readers, extraction and the command line on small cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import kernels as K
from sigloom.functions import scalars as S
from sigloom.operators import matrix as M
from sigloom.plans import cli
from sigloom.plans import extract as X
from sigloom.sources import catalog as C
from sigloom.streaming.catalog import streaming_counts


def test_match_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            cost = rng.random((n, m)).round(1)
            at = K.match(cost)
            got = sum(cost[i, j] for i, j in enumerate(at) if j >= 0)
            small = cost if n <= m else cost.T
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
            assert abs(got - best) < 1e-9 and len({j for j in at if j >= 0}) == min(n, m)


def test_kernels():
    rng = np.random.default_rng(1)
    w, h = rng.random((30, 3)), rng.random((3, 40)) * 100
    for init in ("random", "nndsvd", "nndsvda", "nndsvdar", "nndsvd_min"):
        a, b, n = K.nmf(w @ h, 3, np.random.default_rng(2), init, precision="double", min_iterations=100, max_iterations=3000, test_conv=100, tolerance=1e-9)
        assert np.linalg.norm(w @ h - a @ b) < (0.1 if init == 'nndsvd' else 0.02) * np.linalg.norm(w @ h) and n % 100 == 0
    for beta in (0.0, 2.0):
        before = after = (np.full((30, 3), 0.5), np.full((3, 40), 50.0) * np.arange(1, 4)[:, None])
        for _ in range(50):
            after = K.step(w @ h, *after, beta)
        assert np.linalg.norm(w @ h - after[0] @ after[1]) < np.linalg.norm(w @ h - before[0] @ before[1])
    with pytest.raises(ValueError):
        K.nmf(w @ h, 2, rng, precision="half")
    with pytest.raises(ValueError):
        K.start(w, 2, "zeros", rng)
    x = np.array([0.0, 3.0, 5.0])
    assert np.allclose(K.nnls(w, w @ x), x, atol=1e-6) and K.refit(w, w @ x).sum() == pytest.approx((w @ x).sum())
    assert (K.nnls(w, -(w @ x)) == 0).all()
    assert np.allclose(K.decompose(w @ [0.5, 0.5, 0], w), [0.5, 0.5, 0], atol=0.05)
    assert K.hyper_cutoff(np.array([100.0] * 20 + [100_000.0] * 5) + np.arange(25), 50) < 1000
    assert K.hyper_cutoff(np.array([5.0]), 96) == 96
    assert K.rank_sum_p(np.arange(10.0), np.arange(10.0)) == pytest.approx(1) and K.rank_sum_p(np.arange(10.0), np.arange(10.0) + 50) < 0.001
    assert (K.silhouette(np.zeros((3, 3)), np.zeros(3)) == 1).all()


def test_selection():
    p = X.Parameters()
    stats = [{"k": k, "min_stability": m, "avg_stability": a} for k, m, a in ((1, 1.0, 1.0), (2, 0.9, 0.95), (3, 0.8, 0.9), (4, 0.1, 0.5))]
    assert X.candidates(stats, p) == [1, 2, 3] and X.candidates(stats[3:], p) == [4]
    drop = [*stats[:2], {"k": 3, "min_stability": 0.9, "avg_stability": 0.97}]
    assert X.candidates(drop, p) == [1, 3] and X.candidates(drop, X.Parameters(allow_stability_drop=True)) == [1, 2, 3]
    assert X.walk([1, 2, 3], 1, {1: (-5.0, 60.0), 2: (-5.0, 40.0), 3: (0.0, 10.0)}, p)[0] == 3
    even = {1: (0.0, 5.0), 2: (0.0, 5.0), 3: (0.0, 5.0)}
    assert X.walk([1, 2, 3], 1, even, p)[0] == 2  # the walk ends at the lowest rank; the one above is chosen
    assert X.walk([2, 3], 1, even, p)[0] == 2 and X.walk([3], 1, even, p) == (3, {})
    assert X.walk([1, 2, 3], 1, {**even, 2: (-1.0, 6.0)}, X.Parameters(exome=True))[0] == 3


def test_choose_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    errors = {k: rng.normal(50 - 5 * k, 4, 40).round(1) for k in (1, 2, 3)}
    df = spark.createDataFrame([(k, float(x)) for k, v in errors.items() for x in v], "k int, x double")
    for r in M.compare_ranks(df, 3).collect():
        assert math.erfc(abs(r.z) / math.sqrt(2)) == pytest.approx(K.rank_sum_p(errors[3], errors[r.k])) and r.median == pytest.approx(float(np.median(errors[r.k])))
    stats = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.9, 0.95), (3, 0.8, 0.9)], "k int, min_stability double, avg_stability double")
    chosen, marks = X.choose(stats, df, X.Parameters())
    assert chosen == 3 and {(r.k, r.considered) for r in marks.collect()} == {(1, False), (2, True), (3, True)}
    assert X.choose(stats, df, X.Parameters(), select=1)[0] == 1


def test_extraction_recovers_planted(spark, tmp_path):
    rng = np.random.default_rng(5)
    w = np.repeat(np.eye(3), 8, 0) * rng.random((24, 3)) + 0.002
    w /= w.sum(0)
    v = rng.poisson(w @ (rng.random((3, 20)) ** 2 * 3000))
    cells = [(f"c{i:02}", f"s{j:02}", int(v[i, j])) for i in range(24) for j in range(20)] + [(f"c{i:02}", "zero", 0) for i in range(24)] + [("c00", "null", None)]
    cat = spark.createDataFrame(cells, "channel string, sample string, cnt long")
    p = X.Parameters(minimum_signatures=2, maximum_signatures=3, nmf_replicates=4, min_nmf_iterations=200, max_nmf_iterations=1000, nmf_test_conv=100, nmf_tolerance=1e-7, clustering_restarts=3, seed=3)
    e = X.extract(cat, p)
    assert e.chosen == 3 and e.context == "CH24"
    true = spark.createDataFrame([(f"c{i:02}", f"t{k}", float(w[i, k])) for i in range(24) for k in range(3)], "channel string, signature string, weight double")
    found = e.signatures.where("k = 3")
    assert X.match_signatures(true, found)["f1"] == 1.0
    assert found.groupBy("signature").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert {r.known for r in X.decompose(found, true).where("share > 0.8").collect()} == {"t0", "t1", "t2"}
    totals = {r.sample: r.t for r in e.activities.where("k = 3").groupBy("sample").agg(F.sum("activity").alias("t")).collect()}
    assert len(totals) == 20 and all(abs(totals[f"s{j:02}"] - v[:, j].sum()) < 1 for j in range(20))
    assert {"mean_l2_pct", "min_correlation", "p_value"} <= set(e.selection.columns) and e.signature_stats.where("k = 3").count() == 3
    e.write(str(tmp_path / "out"), known=true, all_replicates=True, export_probabilities=True)
    for name, rows in {"catalog": 480, "activity_errors": 100, "replicates": 8, "suggested_solution/signatures": 72, "suggested_solution/decomposed": 3, "suggested_solution/probabilities": 1440}.items():
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() >= rows, name
    assert {r.item for r in spark.read.parquet(str(tmp_path / "out" / "metadata")).collect()} >= {"seed", "spark", "began"}
    assert X.estimate_solution(spark, str(tmp_path / "out"), cat.where("sample like 's%'"), p) == 3
    sigs, _ = C.read_solutions(spark, str(tmp_path / "out"), "CH24", 2)
    assert sigs.select("signature").distinct().count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Mutation Types\tA\tB.1\nx\t1\t2\ny\t3\t\n")
    got = sorted(map(tuple, C.read_input(spark, "text", str(tmp_path / "m.txt")).collect()), key=repr)
    assert got == sorted([("x", "A", 1.0), ("x", "B.1", 2.0), ("y", "A", 3.0), ("y", "B.1", None)], key=repr)
    (tmp_path / "c.csv").write_text("Mutation type,Trinucleotide,S\nC>A,ACA,5\n")
    (tmp_path / "d.csv").write_text("Mutation type,Trinucleotide,T\nC>A,ACA,7\nC>G,ACA,7\n")
    assert C.read_input(spark, "csv", str(tmp_path / "c.csv")).collect()[0][:] == ("A[C>A]A", "S", 5.0)
    assert sorted(r.cnt for r in C.read_csv_folder(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")]).collect()) == [5.0, 7.0]
    (tmp_path / "v.vcf").write_text("1\t10\ts\tG\tT\n1\t11\ts\tC\tA\n1\t50\ts\tA\tG\n1\t60\ts\tAC\tA\n")
    variants = C.read_variants(spark, str(tmp_path / "v.vcf"))
    assert {(r.channel, r.cnt) for r in C.substitutions(variants).collect()} == {("C>A", 2), ("T>C", 1)}
    assert {r.channel for r in C.doublets(variants).collect()} == {"GC>TA"}
    flanks = spark.createDataFrame([("1", 10, "A", "C"), ("1", 11, "G", "T")], "chrom string, pos bigint, before string, after string")
    assert {r.channel for r in C.substitutions(variants, flanks).collect()} == {"G[C>A]T"}
    (tmp_path / "b.tsv").write_text("sample\tchrom1\tstart1\tchrom2\tstart2\tsvclass\ns\t1\t100\t1\t5100\tdeletion\ns\t1\t100\t2\t5\ttranslocation\n" + "t\t3\t5\t3\t50000005\tinversion\n" * 12)
    full = C.read_input(spark, "bedpe", str(tmp_path / "b.tsv"))
    assert full.count() == 2 * 32
    assert {(r.channel, r.cnt) for r in full.where("cnt > 0").collect()} == {("non-clustered_del_1-10Kb", 1), ("non-clustered_trans", 1), ("clustered_inv_>10Mb", 12)}
    (tmp_path / "s.tsv").write_text("sample\tchr\tstartpos\tendpos\tnMajor\tnMinor\ns\t1\t0\t50000\t0\t0\ns\t1\t0\t50000000\t2\t0\ns\t1\t0\t5000000\t1\t1\n")
    full = C.read_input(spark, "seg:ASCAT", str(tmp_path / "s.tsv"))
    assert full.count() == 48
    assert {r.channel for r in full.where("cnt > 0").collect()} == {"0:homdel:0-100kb", "2:LOH:>40Mb", "2:het:1Mb-10Mb"}
    assert C.read_input(spark, "csv", [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")]).count() == 2
    assert C.cnv_classes(spark).select("class").distinct().count() == 48
    assert C.cnv_order(spark).count() == 48 and C.sbs96_order(spark).count() == 96
    for bad in ("xml", "seg:NONE"):
        with pytest.raises(ValueError):
            C.read_input(spark, bad, str(tmp_path / "s.tsv"))
    (tmp_path / "Seeds.txt").write_text("Seed\n123456789012345678901234567890\n")
    assert C.seed_of(spark, str(tmp_path / "Seeds.txt")) == 123456789012345678901234567890
    with pytest.raises(ValueError):
        C.seed_of(spark, str(tmp_path / "none.txt"))
    assert C.parse_contexts("default") == ["SBS96", "DBS78", "ID83"] and C.parse_contexts("96, dinuc") == ["96", "DINUC"]
    assert [C.context_of(n) for n in (96, 83, 7)] == ["SBS96", "ID83", "CH7"]


def test_indels_and_contexts(spark, tmp_path):
    rows = [
        (1, "CA", "C", "GC", "AAAT", "1:Del:T:3"), (2, "C", "CA", "GC", "GGGT", "1:Ins:T:0"), (3, "CG", "C", "TC", "GGGGGGG", "1:Del:C:5"), (4, "C", "CGT", "TC", "GTGTA", "2:Ins:R:2"),
        (5, "CGTA", "C", "TTC", "GTTT", "3:Del:M:2"), (6, "CGTACCC", "C", "TTCCC", "AAAA", "5:Del:M:3"), (7, "CGTA", "C", "TTC", "CCCC", "3:Del:R:0"), (8, "C", "CGTACCC", "TTC", "GTA", "5:Ins:R:0"),
    ]
    flanks = spark.createDataFrame([("1", r[0], r[1], r[2], r[3], r[4]) for r in rows], "chrom string, pos bigint, ref string, alt string, before string, after string")
    (tmp_path / "v.vcf").write_text("".join(f"1\t{r[0]}\ts\t{r[1]}\t{r[2]}\n" for r in rows) + "1\t50\ts\tA\tG\n")
    variants = C.read_variants(spark, str(tmp_path / "v.vcf"))
    assert {r.channel for r in C.indels(variants, flanks).collect()} == {r[5] for r in rows}
    assert set(C.read_inputs(spark, "vcf", str(tmp_path / "v.vcf"), flanks=flanks)) == {"SBS96", "DBS78", "ID83"}
    assert set(C.read_inputs(spark, "vcf", str(tmp_path / "v.vcf"))) == {"SBS6", "DBS78"} and set(C.variant_contexts(variants, "id", flanks)) == {"ID83"}
    for bad in ("ID83", "SBS9", "SBS384", "SBS1536"):
        with pytest.raises(ValueError):
            C.variant_contexts(variants, bad)
    for bad in ({"flanks": flanks.drop("ref")}, {"context_type": "SBS288", "flanks": flanks}):
        with pytest.raises(ValueError):
            C.variant_contexts(variants, **bad)


def test_scalars_and_bad_norm(spark):
    r = spark.range(1).select(S.letters(F.lit(27)), S.letters(F.lit(702)), S.strip_marks(F.lit("3*")), S.plot_text("Stability", F.lit(0.97)), S.chunks_of(F.array(*map(F.lit, "abcde")), 2), S.positions_of(F.array(*map(F.lit, "abc")), F.array(F.lit("c")))).first()
    assert tuple(r) == ("AB", None, "3", "Stability: 0.97", [["a", "b"], ["c", "d"], ["e"]], [2])
    with pytest.raises(ValueError):
        M.normalise(spark.createDataFrame([("a", "b", 1)], "channel string, sample string, cnt long"), "custom")


def test_divergence_conventions(spark):
    cells = [("a", "s", 0, 1.0), ("b", "s", 4, 3.0), ("a", "t", 2, 0.0), ("b", "t", 2, 4.0), ("a", "u", 0, 0.0), ("b", "u", 0, 0.0)]
    df = spark.createDataFrame(cells, "channel string, sample string, cnt long, est double")
    kl = {r.sample: (r.kl, r.cosine) for r in M.similarity_table(df.drop("est"), df.drop("cnt")).collect()}
    assert kl["s"][0] == pytest.approx(math.log(4 / 3), abs=1e-5) and kl["t"][0] == 1000 and kl["u"][1] == 0


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("x", "s"), ("x", "s"), ("y", "t")], "kind string, who string")
    src.write.parquet(str(tmp_path / "in"))
    stream = streaming_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), F.col("kind"), F.col("who"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == [("x", "s", 2), ("y", "t", 1)]


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "m.txt").write_text("c\t" + "\t".join(f"s{i}" for i in range(6)) + "\n" + "".join(f"k{r}\t" + "\t".join(map(str, rng.integers(1, 50, 6))) + "\n" for r in range(8)))
    args = ["matrix", str(tmp_path / "out"), str(tmp_path / "m.txt"), "--maximum_signatures", "2", "--nmf_replicates", "2", "--min_nmf_iterations", "10", "--max_nmf_iterations", "20", "--nmf_test_conv", "10", "--clustering_restarts", "2", "--exome", "yes", "--get_all_signature_matrices", "yes", "--select", "1"]
    assert cli.main(args) == 0 and (tmp_path / "out" / "selection").exists() and (tmp_path / "out" / "replicates").exists()
    assert cli.parser().parse_args(args[:3]).maximum_signatures == 10
    assert cli.flag("N") is False
    with pytest.raises(SystemExit):
        cli.parser().parse_args([*args, "--resample", "maybe"])


def test_product_is_not_dealt_by_signature(spark):
    """Cells arise whole where the samples lie; signatures of one side, null and repeated ones, null factors and several solutions."""
    w = [(k, f"c{i}", s, float(i + k) if i % 3 else None) for k in (1, 2) for i in range(12) for s in ("A", "B", "D")[: 1 + i % 3]] + [(1, "c1", "A", 7.0), (1, "c1", None, 5.0)]
    h = [(k, f"s{j}", s, float(j * k)) for k in (1, 2, 3) for j in range(30) for s in ("A", "B", "C")[: 1 + j % 3]] + [(1, "s30", "C", 1.0), (1, "s1", "A", 2.0), (1, "s1", None, 5.0)]
    want = {}
    for k, c, s, x in w:
        for k2, p, s2, y in h:
            if k == k2 and s and s == s2:
                old = want.get((k, c, p))
                want[k, c, p] = old if x is None else x * y + (old or 0.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wd, hd = spark.createDataFrame(w, "k int, channel string, signature string, weight double"), spark.createDataFrame(h, "k int, sample string, signature string, activity double")
        est = M.multiply(wd, hd, ("k",))
        one = M.multiply(wd.where("k = 2").drop("k"), hd.where("k = 2").drop("k"))
        assert all("hashpartitioning(signature" not in d._jdf.queryExecution().toString() for d in (est, one))
        assert "hashpartitioning(k" not in one._jdf.queryExecution().toString()
        assert {(r.k, r.channel, r.sample): r.est for r in est.collect()} == want
        assert {(2, r.channel, r.sample): r.est for r in one.collect()} == {k: v for k, v in want.items() if k[0] == 2}
        held = one.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(held) > 2 and max(r["count"] for r in held) < 12 * 30 / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
