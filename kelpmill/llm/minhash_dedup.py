"""Near-duplicate documents by HyperMinHash.

A document's shingles are dealt to registers by their hash; a register keeps the smallest hash of its shingles as its
count of leading zeros and some bits behind the first one. Empty registers borrow from others in a fixed order. Bands
are cut from fixed permutations of all registers, so each register is in one band of every permutation; documents that
agree on a band share a bucket.

A set of at most SMALL shingles fills few registers, and borrowing would put unlike sets that share a shingle or two into one
bucket. Such sets have buckets of their own, exactly: sorted from rare to common shingles, two sets that are alike enough share one of their
first n - ceil(percent * n) + 1, so these are its buckets. Sets a little larger, which may be like a small one, are in both kinds.

Equal texts are one class from the start, so copies never meet each other. In a bucket every class is held against one
pivot, the member that shares most buckets: first by the registers (their agreement, less what chance makes agree), then
by their full sets. What these links join needs no further look. Buckets that still hold several components are compared
further, in blocks, each member outside the largest component with all: first by registers alone, then the members that have a candidate of another component there are sent, with
their sets, to blocks of bounded size, which give only the links that join their components. A pair is looked at in the first
band on which it agrees. So no link between different texts of a bucket is lost, and no bucket's pairs are written out.

Full sets are hashes of shingles, made once for each class that is asked for. A pivot's members are dealt into slices of
bounded size, and its set goes once to each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, ranked, settle, shuffle_partitions
from .components import components
from .words import mixed, slices, windows, words_of

SHINGLE = 5
PERCENT = 80
REGISTERS = 96
ZERO_BITS, MANTISSA = 6, 10
PERMUTATIONS, BAND = 4, 6
BANDS = PERMUTATIONS * REGISTERS // BAND
BAND_MASK = (1 << (BANDS - 1).bit_length()) - 1
#: Shingles up to which a set is found by its rarest ones and not by registers.
SMALL = 40
#: Members of a bucket's block, of which a task compares two by their registers.
BLOCK = 128
#: Shingles that a slice of a pivot's members, or a block that is compared by full sets, holds on average: eight bytes each.
SET_SHINGLES = 250_000
#: Members of a block that are compared with all others at once, and elements of sets that are multiplied at once.
SLICE, COLUMNS = 128, 1024
#: Standard deviations below the threshold at which an estimate still counts.
SLACK = 5.0

_rng = np.random.default_rng(7)
_BORROW = _rng.permutation(np.arange(1, REGISTERS))
_BAND_OF = np.concatenate([_rng.permutation(REGISTERS).reshape(-1, BAND) for _ in range(PERMUTATIONS)])
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ends, sizes): the distinct shingles of each text, sorted, one text after another; and its count of words."""
    words = words_of(texts, lower=True)
    counts = np.diff(words.first)
    hashes, text = windows(words, SHINGLE)
    if len(hashes):
        inside = text == np.repeat(np.arange(len(texts)), counts)[SHINGLE - 1 :]
        hashes, text = mixed(hashes[inside]), text[inside]
    for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)):  # the whole sequence is one shingle
        own = words.hashes[words.first[k] : words.first[k + 1]]
        with np.errstate(over="ignore"):
            whole = mixed(np.array([np.sum(own * np.arange(3, 2 * len(own) + 3, 2, dtype=np.uint64)) + np.uint64(len(own))], np.uint64))
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, [k]])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1)), counts


def compressed(least: np.ndarray) -> np.ndarray:
    """32-bit minima as leading zeros and mantissa; smaller minima give larger counts of zeros."""
    exact = least.astype(np.float64)
    top = np.where(least > 0, np.floor(np.log2(np.maximum(exact, 1))), 0).astype(np.int64)
    zeros = np.where(least > 0, 31 - top, 32)
    rest = least.astype(np.int64) - np.where(least > 0, 1 << top, 0)
    mantissa = np.where(top >= MANTISSA, rest >> np.maximum(top - MANTISSA, 0), rest << np.maximum(MANTISSA - top, 0))
    return ((zeros << MANTISSA) | mantissa).astype(np.uint16)


def registers(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of registers for each text."""
    n = len(ends) - 1
    text = np.repeat(np.arange(n), np.diff(ends))
    least = np.full(n * REGISTERS, _EMPTY, np.uint32)
    place = text * REGISTERS + (((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, place, np.minimum((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), _EMPTY - np.uint32(1)))
    least = least.reshape(n, REGISTERS)
    full = least != _EMPTY
    out = least.copy()
    for step in _BORROW:
        need = (out == _EMPTY) & full.any(axis=1)[:, None]
        if not need.any():
            break
        out = np.where(need, np.roll(least, -step, axis=1), out)
    return compressed(out)


@lru_cache(4096)
def chance(left: int, right: int) -> float:
    """Probability that registers of unrelated sets agree, for 2**(left/2) and 2**(right/2) shingles."""
    zeros = np.arange(28)[:, None]
    low = (2.0**MANTISSA + np.arange(2**MANTISSA)[None, :]) / 2.0 ** (MANTISSA + 1 + zeros)
    high = low + 1 / 2.0 ** (MANTISSA + 1 + zeros)
    own = [np.power(1 - low, m) - np.power(1 - high, m) for m in (max(1.0, 2.0 ** (k / 2) / REGISTERS) for k in (left, right))]
    return float((own[0] * own[1]).sum())


def estimate(agree: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarities from counts of agreeing registers and set sizes, corrected for chance."""
    half_log = lambda n: np.round(2 * np.log2(np.maximum(1, n))).astype(np.int64)
    low, high = half_log(np.minimum(left, right)), half_log(np.maximum(left, right))
    kinds, of = np.unique(low * 256 + high, return_inverse=True)
    c = np.array([chance(*divmod(k, 256)) for k in kinds.tolist()])[of] if len(kinds) else np.zeros(0)
    return (agree / REGISTERS - c) / (1 - c)


def passes(agree: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and estimates allow a similarity of percent."""
    t = percent / 100
    spread = SLACK * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.maximum(left, right)))
    fits = 100 * np.minimum(left, right) >= percent * np.maximum(left, right)
    out = fits.copy()
    out[fits] = estimate(agree[fits], left[fits], right[fits]) >= t - spread[fits]
    return out


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, raw, n, words, key, regs, few) per row: raw is the text's hash, key one of its lower-cased words, n the size of its set, few the set if a small one may be like it."""
    most = 100 * SMALL // percent
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("raw"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            run = _bytes_of(batch.column(2))
            hashes, ends, counts = shingles(run)
            regs = registers(hashes, ends)
            keys = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in run]
            sizes = np.diff(ends)
            few = hashes[np.repeat(sizes <= most, sizes)].view(np.int64)
            few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes <= most, sizes, 0))]).astype(np.int32)), pa.array(few))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), few]
            yield pa.RecordBatch.from_arrays(columns, ["id", "raw", "n", "words", "key", "regs", "few"])

    return rows.mapInArrow(signed, f"id {id_type}, raw long, n long, words long, key binary, regs binary, few array<bigint>")


def rarest(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, bucket): of each set that few has, as many of its rarest shingles as two sets that are alike can't both miss. The bucket's last bits are no band's."""
    rows = classes.where(f"words >= {SHINGLE}").select("cid", "n", F.explode("few").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    sets = rows.join(counts, "shingle").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    chosen = sets.select("cid", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("s"))
    return chosen.select("cid", F.xxhash64("s.shingle").bitwiseAND(F.lit(~BAND_MASK)).alias("bucket"))


def buckets(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, cid, size): the buckets of at least two classes; the last bits of a bucket are its band, 0 for one of a rare shingle."""

    @F.pandas_udf("array<bigint>")
    def bands(regs):
        import pandas as pd

        rows = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
        out = np.zeros((len(rows), BANDS), np.uint64)
        for b, chosen in enumerate(_BAND_OF):
            low, high = rows[:, chosen[:3]], rows[:, chosen[3:]]
            join = lambda x: x[:, 0] | x[:, 1] << np.uint64(16) | x[:, 2] << np.uint64(32)
            out[:, b] = mixed(mixed(join(low) + np.uint64((b + 1) << 48)) ^ join(high)) & ~np.uint64(BAND_MASK) | np.uint64(b)
        return pd.Series(list(out.view(np.int64)))

    rows = classes.where(f"words >= {SHINGLE} and n > {SMALL}").select("cid", F.explode(bands("regs")).alias("bucket"))
    rows = rows.unionByName(settle(rarest(classes, percent)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return settle(rows.join(sizes, "bucket").select("bucket", "cid", "size"))


def pivot_pairs(members: DataFrame) -> DataFrame:
    """(a, b, pivot): every member of a bucket with the bucket's pivot, the member of most and largest buckets."""
    degree = members.groupBy("cid").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "cid").groupBy("bucket").agg(F.max(F.struct("degree", -F.col("cid"))).alias("best"))
    pairs = members.join(pivots.select("bucket", (-F.col("best.col2")).alias("pivot")), "bucket").where("cid <> pivot")
    return pairs.groupBy(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).agg(F.max("pivot").alias("pivot"))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, n): the pairs whose registers allow the similarity; n is the size of the set of cid."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pivot", "n_a", "n_b", "regs_a", "regs_b")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (5, 6))
                a, b, pivot, n_a, n_b = (batch.column(c).to_numpy() for c in range(5))
                good = passes((left == right).sum(axis=1), n_a, n_b, percent)
                found = [pivot[good], np.where(pivot == a, b, a)[good], np.where(pivot == a, n_b, n_a)[good]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["pivot", "cid", "n"])

    return rows.mapInArrow(kept, "pivot long, cid long, n long")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, shingles) of the wanted classes, by one of their rows: the sorted hashes of its set; perhaps again where a row is repeated, but once for each task."""
    side = settle(classes.join(wanted.distinct(), "cid", "left_semi").select("cid", F.col("row.raw").alias("of_raw"), F.col("row.id").alias("of_id")))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("raw", F.xxhash64("text"))
    found = join_counted(rows, side, (F.col("raw") == F.col("of_raw")) & F.col("id").eqNullSafe(F.col("of_id"))).select("cid", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1):
            fresh = [c not in seen and not seen.add(c) for c in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            hashes, ends, _ = shingles(_bytes_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[low:high].tobytes() for low, high in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["cid", "shingles"])

    return settle(found.mapInArrow(hashed, "cid long, shingles binary"))


def shared(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets; the left one should be the larger."""
    if not len(left) or not len(right):
        return 0
    return int((left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right).sum())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs with 100 * intersection >= percent * union of their full sets."""
    total = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / SET_SHINGLES).alias("slices"))
    members = pairs.join(total, "pivot").select("pivot", F.pmod(F.xxhash64("cid"), F.greatest("slices", F.lit(1))).alias("slice"), "cid", F.lit(1).alias("kind"))
    firsts = members.select("pivot", "slice", F.col("pivot").alias("cid"), F.lit(0).alias("kind")).distinct()
    rows = firsts.unionByName(members).join(sets, "cid")
    dealt = rows.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice", "kind").select("pivot", "slice", "kind", "cid", "shingles")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of_pivot = None, np.zeros(0, np.uint64)
        for batch in slices(batches, 4):
            found = []
            for pivot, number, kind, cid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, np.uint64)
                if kind == 0:
                    at, of_pivot = (pivot, number), own
                    continue
                if at != (pivot, number):
                    raise ValueError("a slice without its pivot")
                both = shared(of_pivot, own)
                if 100 * both >= percent * (len(of_pivot) + len(own) - both):
                    found.append((min(pivot, cid), max(pivot, cid)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(kept, "a long, b long").distinct()


def overlaps(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of some sets, by a product over the elements that several of them have."""
    n = len(ends) - 1
    values, column = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(ends))
    shared = np.bincount(column, minlength=len(values)) > 1
    at = np.cumsum(shared) - 1
    use = shared[column]
    out = np.zeros((n, n), np.float32)
    owner, column = owner[use], at[column[use]]
    for start in range(0, int(shared.sum()), COLUMNS):
        part = (column >= start) & (column < start + COLUMNS)
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[owner[part], column[part] - start] = 1
        out += matrix @ matrix.T
    return out


def cross_pairs(labels: np.ndarray, regs: np.ndarray, n: np.ndarray, halves: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different labels that pass the estimate and agree on no band before the given one; of members in different halves, or all if there is one half."""
    kinds, of = np.unique(labels, return_inverse=True)
    none = np.zeros(0, np.int64)
    if len(kinds) < 2:
        return none, none
    # One of such a pair is outside the largest component; those are the rows, a slice at a time, all members the columns.
    odd = np.flatnonzero(of != np.bincount(of).argmax())
    place = np.full(len(labels), -1)
    place[odd] = np.arange(len(odd))
    one, found = len(set(halves.tolist())) == 1, []
    for start in range(0, len(odd), SLICE):
        own = odd[start : start + SLICE]
        agree = np.zeros((len(own), len(labels)), np.uint8)
        for r in range(REGISTERS):
            agree += regs[own, r][:, None] == regs[:, r][None, :]
        ask = labels[own][:, None] != labels[None, :]
        ask &= (place[None, :] < 0) | (place[None, :] > place[own][:, None])
        if not one:
            ask &= halves[own][:, None] != halves[None, :]
        row, right = np.nonzero(ask)
        good = passes(agree[row, right], n[own[row]], n[right], percent)
        left, right = own[row[good]], right[good]
        for k in range(0, len(left), COLUMNS):
            same = regs[left[k : k + COLUMNS]] == regs[right[k : k + COLUMNS]]
            first = np.ones(len(same), bool)
            for b in _BAND_OF[:band]:
                first &= ~same[:, b].all(axis=1)
            found.append((left[k : k + COLUMNS][first], right[k : k + COLUMNS][first]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def joining(cids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs that join the members' components, by full sets."""
    n = np.array([len(s) for s in sets])
    rows = np.unique(np.concatenate([left, right]))
    place = np.searchsorted(rows, left), np.searchsorted(rows, right)
    both = overlaps(np.concatenate([sets[r] for r in rows]), np.cumsum([0, *n[rows]]))[place].astype(np.int64)
    fits = 100 * both >= percent * (n[left] + n[right] - both)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for a, b in zip(left[fits].tolist(), right[fits].tolist(), strict=True):
        x, y = root(int(labels[a])), root(int(labels[b]))
        if x != y:
            parent[y] = x
            links.append((int(cids[a]), int(cids[b])))
    return links


def _registers_in(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)


def remaining(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links between components in buckets that hold several; a bucket of two is settled by its pivot."""
    named = members.where("size > 2").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "size", F.coalesce("label", "cid").alias("label"))
    mixed_ones = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_ones = settle(named.join(mixed_ones.select("bucket"), "bucket", "left_semi").join(classes.select("cid", "n"), "cid"))
    # Of a bucket's members, those outside its largest component are held against all; the others meet only those.
    by_label = open_ones.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    totals = by_label.groupBy("bucket").agg(F.max(F.struct("m", (-F.col("label")).alias("least"), "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    blocks = lambda size, most: F.greatest(F.ceil(size / most), F.lit(1)).cast("int")
    totals = totals.select("bucket", (-F.col("top.least")).alias("top"), blocks(F.col("m") - F.col("top.m"), BLOCK).alias("odd_blocks"), blocks(F.col("top.m"), BLOCK).alias("top_blocks"), blocks(F.col("n") - F.col("top.n"), SET_SHINGLES).alias("odd_parts"), blocks(F.col("top.n"), SET_SHINGLES).alias("top_parts"))
    odd = F.col("label") != F.col("top")
    place = lambda kind: F.when(odd, F.pmod(F.xxhash64("cid"), f"odd_{kind}")).otherwise(F.col(f"odd_{kind}") + F.pmod(F.xxhash64("cid"), f"top_{kind}")).cast("int")
    rows = open_ones.join(totals, "bucket").withColumns({"own": place("blocks"), "part": place("parts")})
    last = F.when(odd, F.col("odd_blocks") + F.col("top_blocks")).otherwise(F.col("odd_blocks")) - 1
    meet = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    full = meet.join(classes.select("cid", "regs"), "cid").select("bucket", "i", "j", "cid", "label", "own", "part", "n", "regs")

    def candidates(group: pa.Table) -> pa.Table:
        """The members that have a candidate, with the blocks (i, j) of full sets where they meet it."""
        get = lambda c: group.column(c).to_numpy()
        band = int(group.column("bucket")[0].as_py()) & BAND_MASK
        left, right = cross_pairs(get("label"), _registers_in(group), get("n"), get("own"), band, percent)
        cid, part = get("cid"), get("part")
        low, high = np.minimum(part[left], part[right]), np.maximum(part[left], part[right])
        found = np.unique(np.concatenate([np.stack([low, high, k], axis=1) for k in (left, right)]), axis=0)
        bucket = np.full(len(found), group.column("bucket")[0].as_py(), np.int64)
        return pa.table({"bucket": bucket, "i": found[:, 0].astype(np.int32), "j": found[:, 1].astype(np.int32), "cid": cid[found[:, 2]]})

    # The groups are small in bytes and long in work: an explicit number of partitions isn't coalesced.
    n = shuffle_partitions(docs.sparkSession)
    asked = settle(full.repartition(n, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(candidates, "bucket long, i int, j int, cid long").distinct())
    if asked.isEmpty():
        return asked.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    sets = sets_of(docs, asked.select("cid"), classes, id_col, text_col)
    meeting = asked.join(rows.select("bucket", "cid", "label", "part"), ["bucket", "cid"]).join(classes.select("cid", "n", "regs"), "cid").join(sets, "cid").select("bucket", "i", "j", "cid", "label", "part", "n", "regs", "shingles")

    def links(group: pa.Table) -> pa.Table:
        group = group.take(np.unique(group.column("cid").to_numpy(), return_index=True)[1])
        get = lambda c: group.column(c).to_numpy()
        band = int(group.column("bucket")[0].as_py()) & BAND_MASK
        left, right = cross_pairs(get("label"), _registers_in(group), get("n"), get("part"), band, percent)
        found = joining(get("cid"), get("label"), [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()], left, right, percent) if len(left) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return meeting.repartition(n, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept, and raw, the text's 64-bit hash.

    Words are lower-cased in A-Z alone. Texts are linked if 100 * intersection >= percent * union of their sets of
    five-word shingles; component_id is the smallest id that links reach. Texts without words (null, empty) have no
    shingles and their own id. A null id is nobody's component_id unless all ids of the component are null. Rows repeated with
    one id have the same result; kept is id = component_id. Other columns are ignored; no rows give no rows.
    """
    rows = settle(signatures(docs, id_col, text_col, percent))
    own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw")).alias("row")
    some = rows.where("n > 0").groupBy("key").agg(own, F.first("n").alias("n"), F.first("words").alias("words"), F.first("regs").alias("regs"), F.first("few").alias("few"))
    ranks = ranked(some, [F.col("key")], "cid")
    members = buckets(ranks, percent)
    classes = ranks.drop("few")
    pairs = settle(estimated(pivot_pairs(members), classes, percent))
    sets = sets_of(docs, pairs.select(F.explode(F.array("pivot", "cid")).alias("cid")), classes, id_col, text_col)
    links = settle(confirmed(pairs, sets, percent))
    labels = settle(components(links))
    more = settle(remaining(members, labels, classes, docs, id_col, text_col, percent))
    if not more.isEmpty():
        labels = settle(components(links.unionByName(more)))
    named = classes.select("key", "cid", "row.id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_key = named.join(least, "label").select("key", "component_id")
    out = rows.join(of_key, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "raw")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps."""
    gone = settle(near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("gone_id"), F.col("raw").alias("gone_raw")).distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("raw"))
    return join_counted(rows, gone, (F.col("raw") == F.col("gone_raw")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").select("doc.*")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85).drop("raw")


#: Every pair that shares a shingle, and what links reach: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op1_minhash_dedup": (op1_minhash_dedup, ORACLE_SQL)}
