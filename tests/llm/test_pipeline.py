import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from clipgrove.llm import decontaminate, queries
from llm.test_decontaminate import smith_waterman
from llm.test_minhash import brute


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = docs
        assert k == 4 or docs.columns == columns
    text = {r.doc_id: r.text for r in kept[0].collect()}
    ids = lambda k: {r.doc_id for r in kept[k].select("doc_id").collect()}
    assert ids(1) == {i for i, v in brute(text.items(), 5).items() if v[2]}
    s = decontaminate.Settings()
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(c.lower() if c < "\x80" else c for c in t)).split()
    tests = [split(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = set()
    for i in ids(1):
        w = split(text[i])
        known = set(w)
        if any(sum(x in known for x in t) >= s.least * len(t) and smith_waterman(t, w, s) >= s.least * s.match * len(t) for t in tests):
            bad.add(i)
    assert bad and ids(2) == ids(1) - bad
    assert ids(3) == ids(2)
    order = queries.mixing.mix(kept[2], queries.mix_weights(kept[2]), queries.MIX_BLOCK).orderBy("slot", "offset").collect()
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(queries.TOKENS().tokenizer), 0, {}
    for r in order:
        x = [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 1]
        want[r.doc_id] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in kept[4].collect()} == want


def test_odd_rows_and_empty_table(spark, odd, empty, small, tmp_path):
    for k, (name, stage) in enumerate(P.STAGES):
        for n, df in enumerate((odd.withColumn("_slot", F.lit("x")).withColumn("_toxicity", F.lit(1)), empty)):
            df.write.parquet(f"{tmp_path}/in{k}{n}")
            out = stage(spark, spark.read.parquet(f"{tmp_path}/in{k}{n}"), small)
            assert k == 4 or out.columns == df.columns
            assert (out.count() == 0) == (n == 1)
