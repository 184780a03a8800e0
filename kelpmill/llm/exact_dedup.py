"""Exact deduplication by deterministic block naming, in DataFrame functions only.

A text without its ASCII white space is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
numbered; then adjacent names are paired, the distinct pairs sorted and numbered, and so on until one name is left of
each document. Two documents have the same name on the same level exactly when their texts are equal.

Distinct contents, not hashes, decide: blocks are grouped by (hash, content), and a hash that stands for two contents
gets a name for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, join_counted, ranked, settle

BLOCK_BYTES = 16_384


def _normal(docs: DataFrame, text: str) -> Column:
    return F.regexp_replace(F.coalesce(docs[text], F.lit("")), SPACES, "")


def _blocks(norm: str, block_bytes: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(norm) / block_bytes), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(F.col(norm).cast("binary"), i * block_bytes + 1, F.lit(block_bytes)))


def _hash(block: Column, hash_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - hash_bits)


def name_blocks(norm: DataFrame, heads: DataFrame, contents: DataFrame, hashes: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """(row, pos, cnt, name): every block of every row of heads with its integer name."""
    rows = heads.select("row", F.size("hashes").alias("cnt"), F.posexplode("hashes").alias("pos", "h"))
    shared = hashes.where("contents > 1").select("h")
    if shared.isEmpty():
        return rows.join(ranked(hashes.select("h"), [F.col("h")], "name"), "h").select("row", "pos", "cnt", "name")
    # Hashes of more than one content: their blocks themselves are sorted and joined.
    several = settle(contents.join(shared, "h", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("block"))))
    names = ranked(hashes.where("contents = 1").select("h", F.lit(1).alias("nth")).unionByName(several.select("h", "nth")), [F.col("h"), F.col("nth")], "name")
    full = norm.select("row", F.posexplode(_blocks("norm", block_bytes)).alias("pos", "block")).withColumn("h", _hash(F.col("block"), hash_bits))
    nth = full.join(several, ["h", "block"]).select("row", "pos", "nth")
    rows = rows.join(nth, ["row", "pos"], "left").withColumn("nth", F.coalesce("nth", F.lit(1)))
    return rows.join(names, ["h", "nth"]).select("row", "pos", "cnt", "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256, and raw, the text's 64-bit hash.

    Equal: identical after deleting ASCII white space; a null text counts as empty, and all empty texts are equal. The
    row with the most code points in the original text stays, then the smallest id, a null id last. Of rows repeated
    with the same id and length exactly one has kept true. Other columns are ignored; an empty table gives no rows.
    hash_bits below 64 only makes hashes of blocks meet, for tests.
    """
    norm = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), F.length(F.coalesce(docs[text_col], F.lit(""))).alias("len"), F.xxhash64(docs[text_col]).alias("raw"), _normal(docs, text_col).alias("norm"))
    contents = norm.select(F.explode(_blocks("norm", block_bytes)).alias("block")).select(_hash(F.col("block"), hash_bits).alias("h"), "block").distinct()
    hashes = settle(contents.groupBy("h").agg(F.count("*").alias("contents")))
    if not hashes.where("contents > 1").isEmpty():
        norm = settle(norm)  # read twice below, with the same row numbers
    of_row = F.transform(_blocks("norm", block_bytes), lambda b: _hash(b, hash_bits))
    heads = settle(norm.select("row", "id", "len", "raw", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), of_row.alias("hashes")))
    named = settle(name_blocks(norm, heads, contents, hashes, block_bytes, hash_bits))
    level, done = 0, []
    while True:
        done.append(named.where("cnt = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = named.where("cnt > 1")
        if rest.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("row", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("cnt") + 1, 1).alias("cnt")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = settle(pairs)
        names = ranked(pairs.select("a", "b").distinct(), [F.col("a"), F.col("b")], "name")
        named = settle(pairs.join(names, ["a", "b"]).select("row", "pos", "cnt", "name"))
        level += 1
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    full = heads.select("row", "id", "len", "raw", "sha").join(identity, "row")
    best = F.min(F.struct((-F.col("len")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = full.groupBy("level", "name").agg(best, F.count("*").alias("group_size"))
    out = full.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), "raw")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs that exact_duplicates keeps; of rows repeated with one id and text, the one whose other columns have the smallest hash."""
    found = settle(exact_duplicates(docs, id_col, text_col, **kwargs).select(F.col(id_col).alias("gone_id"), F.col("raw").alias("gone_raw"), "kept"))
    pairs = settle(found.groupBy("gone_id", "gone_raw").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("raw"))
    same = (F.col("raw") == F.col("gone_raw")) & F.col("id").eqNullSafe(F.col("gone_id"))
    out = join_counted(rows, pairs, same, "left_anti").select("doc")
    again = pairs.where("kept")
    if not again.isEmpty():
        order = F.xxhash64(*[F.col("doc")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()])
        out = out.unionByName(join_counted(rows, again, same).groupBy("id", "raw").agg(F.min_by("doc", order).alias("doc")).select("doc"))
    return out.select("doc.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("raw")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
QUERIES = {"op6_exact_dedup": (op6_exact_dedup, ORACLE_SQL)}
