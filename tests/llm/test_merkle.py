"""The log against a plain recursion, the manifest against plain trees."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from clipgrove.llm import merkle

H = lambda parts: sha256("".join(parts).encode()).hexdigest()


def postorder(n):
    """(level, number) in the order of completion."""
    out, counts, top = [], [n], merkle.height(n)
    while len(counts) <= top:
        counts.append(-(-counts[-1] // 16))

    def visit(level, x):
        if level:
            for c in range(16 * x, min(16 * x + 16, counts[level - 1])):
                visit(level - 1, c)
        out.append((level, x))

    visit(top, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4095, 4096, 4097, 5000])
def test_positions_are_the_order_of_completion(n):
    for at, (level, x) in enumerate(postorder(n)):
        assert merkle.position(level, x, n) == at


def plain(leaves):
    """(root, per leaf its siblings) of one tree."""
    level, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for k in range(len(leaves)):
            run = runs[at[k] // 16]
            proofs[k] += run[:at[k] % 16] + run[at[k] % 16 + 1:]
            at[k] //= 16
        level = [H(r) for r in runs]
    return level[0], proofs


def check(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "id long, group string, leaf string, seen string").repartition(5)
    got = merkle.manifest(df, str(tmp_path / "m")).withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn(
        "bad", merkle.fold(F.col("seen"), F.col("proof"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(plain([r[2] for r in groups[g]]))
    root, over = plain([t[0] for t in trees])
    want = sorted(((r[0] or -1, r[2], r[3], t[0], root, "".join(t[1][k] + over[j])) for j, (g, t) in enumerate(zip(names, trees)) for k, r in enumerate(groups[g])))
    assert sorted((r["id"] or -1, r["leaf"], r["seen"], r["subroot"], r["root"], "".join(s["siblings"] for s in r["proof"])) for r in got) == want
    for r in got:
        assert r["back"] == root and (r["bad"] == root) == (r["seen"] == r["leaf"])


def test_manifest(spark, tmp_path):
    rows = []
    for g, n in ((None, 3), ("", 1), ("a", 300), ("A", 17), ("ä", 16), ("z", 4200), ("b", 2)):
        rows += [(i // 2 if i % 7 else None, g, H([str(g), str(i)]), H([str(g), str(i), "x" * (i % 5 == 0)])) for i in range(n)]
    rows += rows[5:8]
    check(spark, rows, tmp_path)


def test_many_groups_and_one(spark, tmp_path):
    check(spark, [(i, f"g{i}", H([str(i)]), H([str(i)])) for i in range(300)], tmp_path / "many")
    check(spark, [(1, "g", H(["1"]), H(["2"]))], tmp_path / "one")


def test_leaf_and_odd_tables(spark, odd, empty, tmp_path):
    rows = odd.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), merkle.leaf(a=F.col("doc_id"), b=F.col("source"), c=F.col("text")).alias("leaf"))
    rows = rows.withColumn("seen", F.col("leaf"))
    got = {r["id"]: r for r in merkle.manifest(rows, str(tmp_path / "odd")).collect()}
    assert len(got) == 8 and len({r["root"] for r in got.values()}) == 1
    assert got[1]["leaf"] == H(["1:1", "1:a", "-"]) and got[2]["leaf"] == H(["1:2", "-", "0:"])
    assert got[8]["leaf"] == H(["1:8", "1:c", "%d:é ü 日本語 \U0001f600 tail." % len("é ü 日本語 \U0001f600 tail.".encode())])
    assert merkle.manifest(rows.limit(0), str(tmp_path / "empty")).count() == 0
