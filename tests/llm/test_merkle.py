"""Manifest, proofs and roots against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from sigloom.llm import merkle as M
from sigloom.llm import queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """The root, and for each digest its siblings level by level as (left, right)."""
    paths, of = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, owners = [], []
        for a in range(0, len(digests), 16):
            run = digests[a : a + 16]
            for k in range(len(run)):
                for i in of[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            owners.append([i for o in of[a : a + 16] for i in o])
        digests, of = above, owners
    return digests[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((sha(*map(field, r)), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([leaf for leaf, _ in by[s]])
    root, over = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, over, strict=True):
        for (leaf, r), path in zip(by[s], trees[s][1], strict=True):
            path, now = path + top, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                now = sha(*map(field, (*r[:4], text)))
            for left, right in path:
                now = sha(left, now, right)
            out.append((r[0], leaf, trees[s][0], root, sha(*(x for p in path for x in p)), now, now == root))
    return sorted(out, key=repr)


def test_query(spark, sf):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(names).collect()]
    got = queries.op13_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert {r.verified for r in got.select("verified").distinct().collect()} == {True, False}


@pytest.mark.parametrize("many", [0, 1, 16, 17, 700])
def test_sizes_sources_and_cases(spark, tmp_path, many):
    """Hot source, lone leaves, null source, repeated rows, null fields, empty texts; sizes on both sides of full parents."""
    rows = [(i, "hot", "en", i % 7 or None, f"Text {i}") for i in range(many)]
    if many:
        rows += [(9000 + i, f"s{i}", None, 3, "ABC") for i in range(40)] + [(None, None, None, None, None), (9100, None, "de", 0, ""), (9100, None, "de", 0, ""), (-5, "ä", "ß", 2, "Ä" * 2), (9200, "Z", "x", 1, "a"), (9200, "Z", "x", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    path = str(tmp_path / "t")
    df.withColumn("tree", df.text).withColumn("size", df.n_chars).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, path)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_partial_parents_wait_for_their_children(spark):
    """Children that come in any order from any task give the parents that a sorted pass gives."""
    leaves = spark.range(0, 1000, 1, 13).selectExpr("cast(null as string) as tree", "1000L as size", "id as place", "sha2(cast(string(id) as binary), 256) as digest")
    count = lambda df: sorted((r.level, r.parent, *r.digests) for r in M.parents(df).collect())
    want = count(leaves)
    assert len(want) == 63 + 4 + 1 and count(leaves.repartition(7, "digest")) == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "s", 1, 2, 3, 4, f"t{i}") for i in range(20)], "doc_id long, source string, tree int, size int, place int, digest int, text string")
    got = M.manifest(df, ["doc_id", "text"])
    assert got.select("root").distinct().count() == 1 and got.count() == 20
