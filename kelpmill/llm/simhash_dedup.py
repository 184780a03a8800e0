"""Near-duplicate documents by SimHash fingerprints and deletion variants.

A fingerprint of 64 bits is cut into so few segments that two fingerprints with at most BITS differences have one segment
with at most one difference. Each segment is indexed by its variants, in each of which one of its bits is left out: two
segments with at most one difference have a variant in common. An equality join on variants finds the candidates, and the
whole fingerprints decide.

Equal fingerprints are one class from the start. First fingerprints are sorted three times, by each segment, and meet their
neighbours, which joins most near copies to components by three rows each. A bucket of variants with one component needs no look then, and one of two
members is settled where it is counted. In the others all meet a pivot, a member of the largest component there, and what this leaves is
compared in cells of bounded size, the members outside the pivot's component with all. A bucket above
SPLIT members is dealt anew for that by variants of the bits outside its segment, so that chance neighbours of a very large
corpus part. No link between different components is lost, and no bucket's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, shuffle_partitions
from .components import components
from .words import slices

SHINGLE = 4
SEED = 42
WIDTH = 64
#: Differing bits up to which fingerprints are linked, and the segments that leave one with at most one of these.
BITS = 4
SEGMENTS = BITS // 2 + 1
#: Shingles whose bits are counted at once.
AT_ONCE = 65_536
#: Places in a sorted order within which fingerprints are compared first.
NEAR = 8
#: Open buckets, three numbers each, up to which their keys are broadcast, 24 MB; beyond that all variants are shuffled to them.
KEYS_HELD = 1_000_000
#: Members on each side of a cell, and members from which a bucket is dealt by the bits outside its segment too.
CELL, SPLIT = 256, 4096


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    n, ones = len(words) - size + 1, np.zeros(WIDTH, np.int64)
    for part in batched(map(xxhash.xxh64_digest, shingles, repeat(SEED)), AT_ONCE):
        ones += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's bits as a long."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def cut(places: list[int], segments: int = SEGMENTS) -> list[list[int]]:
    """Places of bits in segments of nearly equal size."""
    edges = [len(places) * k // segments for k in range(segments + 1)]
    return [places[low:high] for low, high in zip(edges[:-1], edges[1:], strict=True)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def variants(fp: Column, places: list[int]) -> Column:
    """array<bigint>: a key for each bit of the segment that holds it, of the segment's other bits; each place is in one segment."""
    masks = [(p, sum(1 << q for q in s if q != p)) for s in cut(places) for p in s]
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(_signed(mask)).cast("long")), F.lit(p)) for p, mask in masks])


def _outside(fp: Column, place: Column, segments: list[list[int]]) -> Column:
    """Keys of the bits outside the segment of place."""
    out = F.lit(None).cast("array<bigint>")
    for s in segments:
        out = F.when(place.isin(s), variants(fp, [q for q in range(WIDTH) if q not in s])).otherwise(out)
    return out


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def links_of_neighbours(classes: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints that stand within NEAR places of each other in one of the orders that start with a segment; those that stand in two tasks are left for later."""
    places = range(WIDTH)
    turned = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", WIDTH - k)) if k else F.col("fp")
    rows = classes.select("fp", F.posexplode(F.array(*[turned(s[0]) for s in cut(list(places))])).alias("nth", "turned"))
    order = rows.repartitionByRange(shuffle_partitions(classes.sparkSession), "nth", "turned").sortWithinPartitions("nth", "turned").select("fp")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            fps, found = np.concatenate([held, batch.column(0).to_numpy()]), []
            for d in range(1, NEAR + 1):
                close = np.flatnonzero(np.bitwise_count((fps[d:] ^ fps[:-d]).view(np.uint64)) <= BITS)
                found.append((fps[close], fps[close + d]))
            left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], ["a", "b"])
            held = fps[-NEAR:]

    return order.mapInArrow(near, "a long, b long").where("a <> b").distinct()


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their fp's component; a fingerprint without links is its own."""
    return rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def open_buckets(classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): the links in buckets of two; and (place, key, fp, size, pivot): the members of larger buckets that hold several labels, with a member of the largest component there."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("weight"))
    weights = labels.join(sizes, "label").select("node", F.col("label").alias("own"), "weight")
    rows = settle(classes.join(weights, classes["fp"] == weights["node"], "left").select("fp", F.coalesce("own", "fp").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight")))
    rows = rows.select("fp", "label", "weight", F.posexplode(variants(F.col("fp"), list(range(WIDTH)))).alias("place", "key"))
    pivot = F.max(F.struct("weight", "fp")).alias("pivot")
    buckets = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("fp").alias("a"), F.min("fp").alias("b"), F.max("label").alias("high"), F.min("label").alias("low"), pivot)
    # Two members that are too far apart, as chance puts most of them together, need no second look.
    buckets = settle(buckets.where("low <> high and (size > 2 or bit_count(a ^ b) <= %d)" % BITS))
    large = settle(buckets.where("size > 2").select(F.col("key").alias("of_key"), "size", "pivot.fp").withColumnRenamed("fp", "pivot"))
    side = F.broadcast(large) if large.count() <= KEYS_HELD else large
    members = rows.select("place", "key", "fp").join(side, F.col("key") == F.col("of_key")).drop("of_key")
    return buckets.where("size = 2").select("a", "b").distinct(), settle(members)


def links_of_pivots(members: DataFrame) -> DataFrame:
    """(a, b): links of a bucket's members with its pivot."""
    close = members.where((F.col("fp") != F.col("pivot")) & _close("fp", "pivot"))
    return close.select(F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b")).distinct()


def _several(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels."""
    open_keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rows.join(open_keys.select("key"), "key", "left_semi")


def remaining_links(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): links between components in buckets, the members outside the pivot's component with all."""
    of_pivots = labels.select(F.col("node").alias("pivot"), F.col("label").alias("of_pivot"))
    rows = settle(labelled(members, labels).join(of_pivots, "pivot", "left").withColumn("top", F.coalesce("of_pivot", "pivot")).select("place", "key", "fp", "size", "label", "top"))
    large = rows.where(F.col("size") > SPLIT)
    finer = large.withColumn("finer", F.explode(_outside(F.col("fp"), F.col("place"), cut(list(range(WIDTH)))))).withColumn("key", F.xxhash64("key", "finer"))
    finer = _several(finer.select("key", "fp", "label", "top"))
    finer = finer.join(finer.groupBy("key").agg(F.count("*").alias("size")), "key")
    rows = rows.where(F.col("size") <= SPLIT).select("key", "fp", "label", "top", "size").unionByName(finer).withColumn("cells", F.ceil(F.col("size") / CELL).cast("int"))
    own, other = F.pmod(F.xxhash64("fp"), "cells").cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = rows.where("label <> top").select("key", own.alias("i"), other.alias("j"), F.col("fp").alias("a"), F.col("label").alias("of_a"))
    right = rows.select("key", own.alias("j"), other.alias("i"), F.col("fp").alias("b"), F.col("label").alias("of_b"))
    return left.join(right, ["key", "i", "j"]).where((F.col("of_a") != F.col("of_b")) & _close("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(classes: DataFrame) -> DataFrame:
    """(fp, label) of distinct fingerprints fp: the label is one of those that links reach, the same for all of them."""
    links = settle(links_of_neighbours(classes))
    labels = settle(components(links))
    pairs, members = open_buckets(classes, labels)
    links = links.unionByName(settle(links_of_pivots(members).unionByName(pairs)))
    labels = settle(components(links))
    more = settle(remaining_links(members, labels))
    if not more.isEmpty():
        labels = settle(components(links.unionByName(more)))
    return labelled(classes, labels)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id, kept (id = component_id).

    Words are lower-cased in A-Z alone. Fingerprints link at BITS or fewer differing bits; component_id is the smallest
    id that links reach. Texts without words (null, empty) have fingerprint zero, linked like any other. A null id is nobody's
    component_id unless all ids of the component are null. Repeated rows have the same result. Other columns are ignored; no rows give no rows.
    """
    rows = settle(fingerprints(docs, id_col, text_col))
    classes = settle(rows.groupBy("fp").agg(F.min("id").alias("least")))
    named = linked(classes)
    of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = rows.join(named.join(of_label, "label").select("fp", "component_id"), "fp")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps."""
    found = near_duplicates(docs, id_col, text_col)
    kept = found.where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("doc.*")


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: No SQL here knows XXH64; tests/llm/test_simhash_dedup.py has a plain version.
QUERIES = {"op11_simhash_dedup": (op11_simhash_dedup, None)}
