"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.session import cut

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"


def sample(term: str, log_weight: str, k: int) -> Column:
    """Sample ``k`` of a weighted term as a long: above 38 bits of ln a, which is to be least, below 24 bits that
    name (term, t). One hash of (term, k) gives four uniform numbers of 13 bits and one of 12; r = -ln(u1 * u2) and
    c = -ln(u3 * u4) are of Gamma(2, 1), b is uniform, t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1)."""
    h = F.xxhash64(F.col(term), F.lit(k))
    part = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(8191)).cast("double") + F.lit(0.5)
    whole = F.lit(26 * math.log(2))
    r = whole - F.log(part(51) * part(38))
    log_c = F.log(whole - F.log(part(25) * part(12)))
    b = h.bitwiseAND(F.lit(4095)).cast("double") * F.lit(2.0**-12)
    t = F.floor(F.col(log_weight) / r + b)
    log_a = log_c - r * (t.cast("double") - b + F.lit(1.0))
    name = h.bitwiseXOR(F.shiftleft(t, 5)).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(((log_a + F.lit(64.0)) * F.lit(2.0**32)).cast("long"), 24).bitwiseOR(name)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``texts`` (keys, text) to keys, sig: ``samples`` numbers of 24 bits per text with a word. Two texts agree in a sample with the
    chance of their generalised Jaccard similarity, the sum of the smaller over the sum of the larger word
    counts. Words are runs without white space, in lower case.

    If ``texts`` is already dealt by one of the keys no row moves: words are counted and sampled where they are. The
    unrolled samples stay inside generated code, a row per distinct word of a text at a time."""
    words = texts.select(*keys, F.explode(F.split(F.lower("text"), SPACE)).alias("word")).filter("word <> ''").select(*keys, F.xxhash64("word").alias("term"))
    counts = words.groupBy(*keys, "term").agg(F.count("*").alias("c")).select(*keys, "term", F.log(F.col("c").cast("double")).alias("lw"))
    least = counts.groupBy(*keys).agg(*[F.min(sample("term", "lw", k)).alias(f"s{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"s{k}").bitwiseAND(F.lit((1 << 24) - 1)).cast("int") for k in range(samples)]).alias("sig"))


def fingerprint(sig: str) -> Column:
    """Six hexadecimal digits per sample; empty without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples; two texts without words are alike (1), one such text is like no other (0)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0)).when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0)).otherwise(same)


def successors(ids: DataFrame) -> DataFrame:
    """``ids`` (id, unique, and other columns) plus id_next and the other columns of the next id with ``_next``: ascending, after the
    last the first. Ranks come from sorted ranges and a table with a row per range; no window over all rows."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    ranges = rows.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("c"))
    # ranges are as many as shuffle partitions: their sums fit one row
    starts = ranges.agg(F.array_sort(F.collect_list(F.struct("_part", "first", "c"))).alias("r"))
    starts = starts.select(F.explode(F.expr(
        "transform(r, (x, i) -> named_struct('_p', x._part, '_base', aggregate(slice(r, 1, i), 0L, (a, y) -> a + y.c) - x.first, '_n', aggregate(r, 0L, (a, y) -> a + y.c)))")).alias("s")).select("s.*")
    ranked = rows.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn("_rank", F.col("_at") + F.col("_base"))
    own = ranked.select(*ids.columns, ((F.col("_rank") + 1) % F.col("_n")).alias("_to"))
    after = ranked.select(F.col("_rank").alias("_to"), *[F.col(c).alias(f"{c}_next") for c in ids.columns])
    return own.join(after, "_to").drop("_to")


def with_edits(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document; the edited text has its last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by doc_id.

    Null texts are empty; rows with a null doc_id are dropped; of repeated ids the shortest text (then the
    smallest) counts; a single document follows itself. Only doc_id and text are read. Texts are dealt by doc_id once
    and their lent parts once more; signatures go to the two documents that need them."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    sizes = docs.groupBy("doc_id").agg(F.min(F.char_length("text")).alias("n"))
    pairs = cut(successors(sizes.withColumnRenamed("doc_id", "id")))  # numbers only
    dealt = docs.repartition(parts, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.char_length("text").alias("n"), "text")).alias("x")).select("doc_id", "x.n", "x.text")
    linked = dealt.join(pairs.select(F.col("id_next").alias("doc_id"), F.col("id").alias("to"), F.expr("n div 2").alias("half")), "doc_id")
    lent = linked.select(F.col("to").alias("doc_id"), F.substr("text", F.lit(1), F.col("half")).alias("head"))
    base = linked.join(lent, "doc_id").select("doc_id", "to", "n", "text", F.concat(F.substr("text", F.lit(1), F.expr("n - n div 2")), "head").alias("edited"))
    sides = base.select("doc_id", "to", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    sigs = signatures(sides, ["doc_id", "to", "side"], samples)
    sent = sigs.select(F.explode(F.when(F.col("side") == 0, F.array(F.struct(F.col("doc_id"), F.lit("own").alias("kind")), F.struct(F.col("to").alias("doc_id"), F.lit("next").alias("kind"))))
                                 .otherwise(F.array(F.struct(F.col("doc_id"), F.lit("edited").alias("kind"))))).alias("x"), "sig").select("x.*", "sig")
    got = sent.groupBy("doc_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("sig"))).alias(k) for k in ("own", "edited", "next")])
    facts = base.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return facts.join(got, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"))
