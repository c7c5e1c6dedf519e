"""The entries of large JSON documents, found by many tasks.

A document is one JSON object or array in one file. Its byte ranges are read apart, cut at every comma, and put together as chunks of about
``CHUNK`` bytes. What a chunk does to a reader of JSON is a step function: the number of its quotes decides whether the next chunk starts inside a
string, and for either start its brackets change the depth by a number of their own, and so many of its commas lie at each depth. One row of steps per
chunk is summed up over a document, so each chunk learns the state in which it starts and the number of the entry that is open there; commas outside
strings at depth one part entries. Only what lies at the edges of chunks is put together again; entries parse as documents with one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clipgrove.session import cut
from clipgrove.sources import documents as D

BLANK = "[ \\t\\r\\n]*"
BRACKETS = {"map": ("{", "}"), "array": ("[", "]")}
CHUNK = 1 << 20

QUOTE, COMMA, BACKSLASH = ord('"'), ord(","), ord("\\")
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
_MARKS = _DEPTH != 0
_MARKS[[QUOTE, COMMA]] = True


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, byte, quotes before, change of depth) of the quotes, brackets and commas of a chunk. Escaped quotes and brackets do not count."""
    at = np.flatnonzero(_MARKS[data])
    if (data == BACKSLASH).any():
        # how many backslashes end before each place
        other = np.maximum.accumulate(np.where(data != BACKSLASH, np.arange(len(data)), -1))
        before = np.where(at > 0, at - 1 - other[at - 1], 0)
        at = at[(before % 2 == 0) | (data[at] == COMMA)]
    byte = data[at]
    quote = byte == QUOTE
    return at, byte, np.cumsum(quote) - quote, _DEPTH[byte]


def _depths(marks: tuple[np.ndarray, ...], inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of commas outside strings, their depths, change of depth in all) of a chunk that starts outside (0) or inside (1) a string."""
    at, byte, quotes, change = marks
    outside = (quotes + inside) % 2 == 0
    depth = np.cumsum(change * outside)
    part = outside & (byte == COMMA)
    return at[part], depth[part], int(depth[-1]) if len(depth) else 0


CHUNKS = ("doc string, block bigint, chunk bigint, value binary, quotes bigint, "
          "step0 bigint, step1 bigint, commas0 map<bigint, bigint>, commas1 map<bigint, bigint>")


def _join(size: int):
    """Pieces of ranges, in the order they are read, as chunks with their steps. The comma between two chunks starts the later one."""

    def chunk(doc: str, block: int, number: int, parts: list[bytes]) -> pa.RecordBatch:
        value = (b"," if block or number else b"") + b",".join(parts)
        marks = _marks(np.frombuffer(value, np.uint8))
        row = [doc, block, number, value, int((marks[1] == QUOTE).sum())]
        steps, commas = [], []
        for inside in (0, 1):
            _, depth, step = _depths(marks, inside)
            steps.append(step)
            commas.append(list(zip(*(x.tolist() for x in np.unique(depth, return_counts=True)))))
        counts = pa.map_(pa.int64(), pa.int64())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, counts, counts]
        names = ["doc", "block", "chunk", "value", "quotes", "step0", "step1", "commas0", "commas1"]
        return pa.record_batch([pa.array([x], k) for x, k in zip([*row, *steps, *commas], kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, parts, held = None, 0, [], 0
        for batch in batches:
            if not len(batch):
                continue
            doc, block = batch.column("doc").dictionary_encode(), batch.column("block").to_numpy()
            codes = doc.indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
            edges = np.concatenate([[0], edges, [len(batch)]])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                key = (doc.dictionary[int(codes[x])].as_py(), int(block[x]))
                if key != now:
                    if parts:
                        yield chunk(*now, number, parts)
                    now, number, parts, held = key, 0, [], 0
                values = batch.column("value").slice(x, y - x)
                parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, y - x], pa.int32()), values), b",")[0].as_py())
                held += len(parts[-1])
                if held >= size:
                    yield chunk(*now, number, parts)
                    number, parts, held = number + 1, [], 0
        if parts:
            yield chunk(*now, number, parts)

    return run


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the state in which they start as parts of entries; ``inner`` ones have both their ends in the chunk, ``final`` ones belong to the last entry."""
    for batch in batches:
        for i in range(len(batch)):
            doc, block, chunk, value, base, deep, ahead, last = (batch.column(c)[i] for c in ("doc", "block", "chunk", "value", "base", "deep", "ahead", "last"))
            data = np.frombuffer(value.as_buffer(), np.uint8)
            at, depth, _ = _depths(_marks(data), base.as_py())
            at = at[depth + deep.as_py() == 1]
            n = len(at) + 1
            ends = np.append(at, len(data)) - np.arange(n)
            text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.delete(data, at))])
            entry = ahead.as_py() + np.arange(n)
            inner = np.ones(n, bool)
            inner[[0, -1]] = False
            yield pa.record_batch([pa.repeat(doc, n), pa.array(entry), pa.repeat(block, n), pa.repeat(chunk, n), pa.array(inner), pa.array(entry == last.as_py()), text],
                                  names=["doc", "entry", "block", "chunk", "inner", "final", "value"])


def pieces(spark: SparkSession, paths: list[str], size: int = CHUNK) -> DataFrame:
    """Parts of entries: doc, entry (its number in the document, from 0), block (first byte of the range), chunk (rising inside a range), inner (the part is a
    whole entry), final (of the last entry), value; the commas between entries are left out.

    Only one row per chunk is sorted by document, and a chunk moves once."""
    text = spark.read.option("lineSep", ",").text(paths)
    read = text.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    chunks = cut(read.mapInArrow(_join(size), CHUNKS))
    whole = W.partitionBy("doc")
    earlier = whole.orderBy("block", "chunk").rowsBetween(W.unboundedPreceding, -1)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    steps = chunks.drop("value").withColumn("base", total(F.col("quotes")) % 2)
    steps = steps.withColumn("deep", total(F.when(F.col("base") == 0, F.col("step0")).otherwise(F.col("step1"))))
    commas = F.when(F.col("base") == 0, F.col("commas0")).otherwise(F.col("commas1"))
    steps = steps.withColumn("opens", F.coalesce(F.try_element_at(commas, 1 - F.col("deep")), F.lit(0)))
    steps = steps.select("doc", "block", "chunk", "base", "deep", total(F.col("opens")).alias("ahead"), F.sum("opens").over(whole).alias("last"))
    placed = chunks.select("doc", "block", "chunk", "value").join(steps, ["doc", "block", "chunk"])
    return cut(placed.mapInArrow(_part, "doc string, entry bigint, block bigint, chunk bigint, inner boolean, final boolean, value binary"))


def parsed_documents(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """``split_documents`` whose good entries are parsed as well, once: (doc, entry, value, parsed)."""
    wanted = D.present(spark, [paths] if isinstance(paths, str) else paths)
    if not wanted:
        return spark.createDataFrame([], f"doc string, entry bigint, value string, parsed {schema}"), spark.createDataFrame([], "doc string")
    left, right = BRACKETS[schema.split("<")[0].strip().lower()]
    parts = pieces(spark, wanted)
    docs = parts.groupBy("doc").agg((F.sum(F.octet_length("value")) + F.max("entry")).alias("bytes"))
    text = F.col("value").cast("string")
    rows = parts.where("inner").select("doc", "entry", "final", text.alias("value"))
    edges = parts.where(~F.col("inner")).groupBy("doc", "entry", "final").agg(F.array_sort(F.collect_list(F.struct("block", "chunk", text.alias("value")))).alias("p"))
    rows = rows.unionByName(edges.select("doc", "entry", "final", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value")))
    # the reader takes a comma at the end of a file for the end of its last piece, so bytes are counted
    files = spark.read.format("binaryFile").load(wanted).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_size").alias("size"))
    docs = files.join(docs, "doc", "left").withColumn("whole", F.coalesce(F.col("bytes") == F.col("size"), F.lit(False)))
    first, last = F.col("entry") == 0, F.col("final")
    head, tail = f"\\A{BLANK}\\{left}", f"\\{right}{BLANK}\\z"
    closed = (~first | F.col("value").rlike(head)) & (~last | F.col("value").rlike(tail))
    body = F.when(first, F.regexp_replace("value", head, "")).otherwise(F.col("value"))
    rows = rows.withColumn("closed", closed).withColumn("body", F.when(last, F.regexp_replace(body, tail, "")).otherwise(body))
    closed = F.col("closed") & ((first & last) | ~F.col("body").rlike(f"\\A{BLANK}\\z"))
    boxed = F.when(closed, F.concat(F.lit(left), "body", F.lit(right)))
    rows = cut(D.parse(rows.select("doc", "entry", boxed.alias("value")), schema))
    bad = docs.where(~F.col("whole")).select("doc").unionByName(rows.where("parsed IS NULL").select("doc"))
    good = rows.where("parsed IS NOT NULL")
    if left == "{":
        keys = good.select("doc", F.explode(F.map_keys("parsed")).alias("key"))
        bad = bad.unionByName(keys.groupBy("doc", "key").count().where("count > 1").select("doc"))
    bad = cut(bad.distinct())
    return (good if bad.isEmpty() else good.join(bad, "doc", "left_anti").select(*good.columns)), bad


def split_documents(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The files under ``paths`` as documents of type ``schema`` (a map or an array): (doc, entry, value) of the good ones, where ``value`` is a document that
    holds entry number ``entry`` alone, and (doc) of the bad ones.

    Bad are exactly the documents that do not parse as a whole: one broken entry, an entry without text beside others, a map key twice, the other kind of
    bracket, text behind the end, an empty file. An empty map or array is one entry without content. Files that are absent are no documents; files are plain UTF-8, not
    compressed. An entry has to fit into a row, a document does not."""
    good, bad = parsed_documents(spark, paths, schema)
    return good.drop("parsed"), bad


def read_overlay_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``documents.read_overlay_index`` of documents that no task reads whole."""
    return D.overlay_rows(parsed_documents(spark, path, f"map<string, {D.META}>")[0])


def read_edit_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``documents.read_edit_index`` of documents that no task reads whole."""
    return D.edit_rows(parsed_documents(spark, path, f"map<string, {D.EDIT}>")[0])


def read_playlist_index(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``documents.read_playlist_index`` of documents that no task reads whole."""
    return D.playlist_rows(parsed_documents(spark, path, f"array<{D.PLAYLIST}>")[0])


def read_registry(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """``documents.read_registry`` of a document that no task reads whole."""
    rows, _ = parsed_documents(spark, path, f"array<{D.GAME}>")
    return D.registry_tables(rows.select(F.col("entry").cast("int").alias("idx"), F.explode("parsed").alias("g")))
