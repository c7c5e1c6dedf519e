import random

from clipgrove.llm.graph import components


def test_paths_stars_and_loops(spark):
    rng = random.Random(4)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(150)] + [(ids[200], ids[i]) for i in range(201, 260)] + [(ids[300], ids[300]), (ids[1], ids[0])]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.component_id for r in components(df).collect()}
    want = {i: min(ids[:151]) for i in ids[:151]} | {i: min(ids[200:260]) for i in ids[200:260]}
    assert got == want
    assert components(df.limit(0)).count() == 0
