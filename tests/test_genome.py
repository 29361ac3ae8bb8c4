"""Sequences in blocks, strands, channel grammars and their sums, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import matrix as M
from sigloom.plans import cli
from sigloom.sources import catalog as C
from sigloom.sources import channels as H
from sigloom.sources import genome as G


def test_grammars(spark):
    sizes = {"SBS96": 96, "SBS288": 288, "SBS384": 384, "SBS1536": 1536, "SBS4608": 4608, "DBS78": 78, "ID83": 83, "CNV48": 48, "SV32": 32}
    for name, n in sizes.items():
        assert len(set(H.channel_names(name))) == n
    assert C.context_of(288) == "SBS288" and "AT>TG" not in H.channel_names("DBS78")
    with pytest.raises(ValueError):
        H.channel_names("SBS6")
    with pytest.raises(ValueError):
        H.coarser(F.lit("x"), "SBS96", "SBS384")


def test_doublets_have_78_names(spark):
    rows = [(a + b, x + y) for a in "ACGT" for b in "ACGT" for x in "ACGT" for y in "ACGT"]
    variants = [("1", 10 * i + j, f"s{i}", r[j], a[j]) for i, (r, a) in enumerate(rows) for j in (0, 1)]
    df = spark.createDataFrame(variants, "chrom string, pos bigint, sample string, ref string, alt string")
    got = C.doublets(df).groupBy("channel").agg(F.sum("cnt").alias("n")).collect()
    names = H.channel_names("DBS78")
    assert {r.channel for r in got} == set(names) and sum(r.n for r in got) == 144  # 16 references, 9 changes of both bases
    other = str.maketrans("ACGT", "TGCA")
    own = lambda n: len({n, ">".join(p.translate(other)[::-1] for p in n.split(">"))})
    assert {r.channel: r.n for r in got} == {n: own(n) for n in names}


def test_sparse_equals_dense(spark):
    """Cells that the catalogue lacks count as zeros."""
    dense = spark.createDataFrame([("a", "s", 3), ("b", "s", 0), ("a", "t", 0), ("b", "t", 2)], "channel string, sample string, cnt long")
    est = spark.createDataFrame([("a", "s", 3.0), ("b", "s", 4.0), ("a", "t", 1.0), ("b", "t", 2.0)], "channel string, sample string, est double")
    sparse = dense.where("cnt > 0")
    for f in (M.similarity_table, M.frobenius_error, M.kl_loss):
        assert sorted(map(tuple, f(dense, est).collect())) == sorted(map(tuple, f(sparse, est).collect()))
    row = M.similarity_table(sparse, est).where("sample = 's'").first()
    assert (row.cosine, row.l2_pct) == (0.6, 133.333)


def test_fasta_blocks_and_flanks(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("ACGT") for _ in range(5000))
    seqs = {"1": long, "2": "acgtNNac", "X": "GATTACA" * 40}
    text = "".join(f">{n} some text\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) + ("\n" if n == "2" else "") for n, s in seqs.items())
    (tmp_path / "g.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = G.read_fasta(spark, str(tmp_path / "g.fa")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, s in seqs.items():
        own = sorted((r.start, r.bases) for r in lines if r.chrom == name)
        assert "".join(b for _, b in own) == s.upper() and all(s.upper()[a - 1 : a - 1 + len(b)] == b for a, b in own)
    parts = spark.createDataFrame([(r.chrom, r.start, r.bases) for r in lines], "chrom string, start long, bases string")
    held = G.blocks(parts, size=100, margin=30)
    whole = spark.createDataFrame([(n, s.upper()) for n, s in seqs.items()], "chrom string, bases string")
    same = lambda df: sorted(map(tuple, df.select("chrom", "block", "first", "bases").collect()))
    assert same(held) == same(G.blocks(G.pieces(whole, 37), size=100, margin=30))
    places = [1, 2, 99, 100, 101, 102, 200, 2500, 4999, 5000, 5001, 0]
    v = spark.createDataFrame([("1", p, "s", r, a) for p in places for r, a in (("A", "C"), ("AC", "A"), ("A", "AGG"))], "chrom string, pos bigint, sample string, ref string, alt string")
    got = G.with_flanks(v, held, size=100, margin=30).collect()
    assert len(got) == 3 * 10
    for r in got:
        i = r.pos - 1 + (len(r.ref) != len(r.alt))
        rest = long[r.pos - 1 + len(r.ref) :][:30]  # the margin is counted from the block's edge
        assert r.before == long[max(0, i - 30) : i] and rest.startswith(r.after) and len(r.after) > len(rest) - len(r.ref), r
    some = G.with_flanks(v.where("pos = 101"), held, size=100, margin=30)
    assert [r.cnt for r in C.substitutions(some).collect()] == [1] and sorted(r.cnt for r in C.indels(some).collect()) == [1, 1]
    wide = C.substitutions(some, context="SBS1536").first().channel
    assert len(wide) == 9 and wide in H.channel_names("SBS1536")


def test_strands(spark):
    rng = random.Random(2)
    ranges = [("1", s, s + rng.choice([0, 5, 300, 40_000]), rng.choice("+-.")) for s in (rng.randrange(100_000) for _ in range(60))] + [("1", 50, 40, "+")]
    at = [rng.randrange(150_000) for _ in range(400)] + [0, 16_383, 16_384]
    df = spark.createDataFrame([("1", p) for p in at] + [("9", 5), (None, 5)], "chrom string, pos bigint")
    bins = G.transcribed(spark.createDataFrame(ranges, "chrom string, start long, end long, strand string"))
    for r in bins.collect():
        for side in (r.plus, r.minus):
            assert all(a.e + 1 < b.s for a, b in zip(side, side[1:], strict=False)) and all(x.s // G.BIN == x.e // G.BIN == r.bin for x in side)
    got = G.with_strand(df, bins).collect()
    assert len(got) == len(at) + 2
    for r in got:
        has = {t for c, s, e, t in ranges if c == r.chrom and s <= r.pos <= e} & {"+", "-"}
        assert r.strand == ("B" if len(has) == 2 else has.pop() if has else "N")
    told = {(s, t): spark.range(1).select(G.strand_class(F.lit(s), F.lit(t), "TUN")).first()[0] for s in "+-BN" for t in (True, False)}
    assert told == {("+", True): "T", ("+", False): "U", ("-", True): "U", ("-", False): "T", ("B", True): "N", ("B", False): "N", ("N", True): "N", ("N", False): "N"}


def test_command_line_on_variants(spark, tmp_path, capsys):
    """Variants, a reference below a volume, strands, and a decomposition of the finer context as SBS96."""
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "GRCh37.fa").write_text(">1\n" + seq + "\n")
    spark.createDataFrame([("1", 1, 1500, "+"), ("1", 1000, 2500, "-")], "chrom string, start long, end long, strand string").write.parquet(str(tmp_path / "GRCh37_transcripts.parquet"))
    spark.createDataFrame([(c, "K", 1 / 96) for c in H.channel_names("SBS96")], "channel string, signature string, weight double").write.parquet(str(tmp_path / "signatures/GRCh37_v3.4.parquet"))
    rows = [(p, f"s{i % 4}", seq[p - 1], rng.choice([b for b in "ACGT" if b != seq[p - 1]])) for i, p in enumerate(rng.sample(range(5, 2990), 800))]
    (tmp_path / "v.vcf").write_text("".join(f"1\t{p}\t{s}\t{r}\t{a}\n" for p, s, r, a in rows))
    args = ["vcf", str(tmp_path / "out"), str(tmp_path / "v.vcf"), "--context_type", "SBS288", "--volume", str(tmp_path), "--reference_genome", "hg0", "--maximum_signatures", "1", "--nmf_replicates", "2", "--min_nmf_iterations", "10", "--max_nmf_iterations", "20", "--nmf_test_conv", "10", "--export_text", "yes"]
    assert cli.main(args) == 0 and "hg0" in capsys.readouterr().out
    out = str(tmp_path / "out" / "SBS288")
    cells = spark.read.parquet(f"{out}/catalog")
    assert cells.select("channel").distinct().count() == 288 and cells.agg(F.sum("cnt")).first()[0] == 800
    assert spark.read.parquet(f"{out}/suggested_solution/decomposed").first().known == "K"
    lines = [x for f in sorted((tmp_path / "out" / "SBS288" / "text" / "signatures").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("channel")]
    assert [x.split("\t")[0] for x in lines] == H.channel_names("SBS288") and "E-0" in lines[0]
