"""Near-duplicate annotation texts by b-bit MinHash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.llm.common import discard, stored
from mesograph.operators.graph import connected_components

# 43 bands of 8 minima: a pair at similarity 0.85 shares no band with probability (1 - 0.85^8)^43 = 1.2e-6, one at 0.80 with 3.5e-4.
# `bands_for` raises the number of bands until the probability at the asked similarity is under this bound.
MISS = 2e-6
ROWS = 8
LOW_BITS = 2
SIGMAS = 5
CHUNK = 64
BLOCK = 256
SEED = 0x9E3779B97F4A7C15
LONG_WORD = 128


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-similarity ** rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of 64-bit hashes of word shingles.  A word's hash goes through its bytes eight at a time, each eight mixed into what is there
    (words of up to eight bytes of one length can't collide); longer words than `LONG_WORD` bytes take a BLAKE2 hash."""

    def __init__(self, width: int):
        self.width = width

    def words(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
        data = np.frombuffer(raw + bytes(8), np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = (data[:-8] != 32) & ((data[:-8] < 9) | (data[:-8] > 13))
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        eights = np.ndarray(len(raw) + 1, "<u8", data.data, strides=(1,))  # the eight bytes from each place on
        sizes = ends - starts
        out = mixed(sizes.astype(np.uint64) * np.uint64(SEED))
        long_ones = np.flatnonzero(sizes > LONG_WORD)
        left = np.flatnonzero(sizes <= LONG_WORD)
        for done in range(0, LONG_WORD, 8):
            left = left[sizes[left] > done]
            if not len(left):
                break
            unused = np.maximum(8 - (sizes[left] - done), 0).astype(np.uint64) * np.uint64(8)
            piece = eights[starts[left] + done] << unused >> unused
            out[left] = mixed(out[left] * np.uint64(SEED) ^ piece)
        for i in long_ones:
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a text; a shorter text is one shingle, one without words has none."""
        if not text:
            return np.empty(0, np.uint64)
        words = self.words(text)
        width = min(self.width, len(words))
        if not width:
            return np.empty(0, np.uint64)
        count = len(words) - width + 1
        out = np.full(count, width, np.uint64)
        for i in range(width):
            out = mixed(out * np.uint64(SEED) + words[i:i + count])
        return np.unique(out)


class Signature:
    """Minima of the hashes under `bands * rows` permutations, the bucket of each band, and the packed low bits of all minima."""

    def __init__(self, bands: int, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        keys = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(SEED))
        self.flip = keys[::2].astype(np.uint32)
        self.factor = keys[1::2].astype(np.uint32) | np.uint32(1)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
        best = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), CHUNK):
            np.minimum(best, ((low[i:i + CHUNK] ^ self.flip) * self.factor).min(axis=0), out=best)
        return best

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        minima = self.minima(hashes)
        table = minima.reshape(self.bands, self.rows).astype(np.uint64)
        bucket = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in range(self.rows):
            bucket = mixed(bucket * np.uint64(SEED) + table[:, row])
        bits = (minima[:, None] >> np.arange(LOW_BITS, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return bucket.view(np.int64), packed + b"\0" * (-len(packed) % 8)


def estimate(a: np.ndarray, b: np.ndarray, slots: int) -> np.ndarray:
    """Similarity from packed signatures (last axis: 64-bit words): the share of slots that agree, corrected for chance agreement of
    `LOW_BITS` random bits."""
    differ = a ^ b
    any_ = differ
    for i in range(1, LOW_BITS):
        any_ = any_ | (differ >> np.uint64(i))
    lanes = np.uint64(sum(1 << i for i in range(0, 64, LOW_BITS)))
    unlike = np.bitwise_count(any_ & lanes).sum(axis=-1, dtype=np.int64)
    chance = 2.0 ** -LOW_BITS
    return (1 - unlike / slots - chance) / (1 - chance)


def least_estimate(similarity: float, slots: int) -> float:
    """Five standard deviations under the asked similarity: pairs with less are not looked at further."""
    chance = 2.0 ** -LOW_BITS
    agree = similarity + (1 - similarity) * chance
    return similarity - SIGMAS * math.sqrt(agree * (1 - agree) / slots) / (1 - chance)


def signatures(texts: DataFrame, width: int, bands: int) -> DataFrame:
    """(id, text) to (id, n_shingles, set_key, bands, bits); one pass without a shuffle."""
    kind = texts.schema[0].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signature = Shingles(width), Signature(bands)
        for batch in batches:
            sizes, keys, buckets, bits = [], [], [], []
            for text in batch.column(1):
                hashes = shingles.of(text.as_py())
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                found = signature.of(hashes) if len(hashes) else (np.empty(0, np.int64), None)
                buckets.append(found[0])
                bits.append(found[1])
            offsets = np.zeros(len(buckets) + 1, np.int32)
            np.cumsum([len(b) for b in buckets], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*buckets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists,
                                              pa.array(bits, pa.binary())], ["id", "n_shingles", "set_key", "bands", "bits"])

    return texts.mapInArrow(sign, f"id {kind}, n_shingles long, set_key binary, bands array<long>, bits binary")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, hashes): the full sets."""
    kind = texts.schema[0].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            found = [shingles.of(t.as_py()).view(np.int64) for t in batch.column(1)]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))], ["id", "hashes"])

    return texts.mapInArrow(sets, f"id {kind}, hashes array<long>")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _star_pairs(banded: DataFrame) -> DataFrame:
    """Each member of a bucket paired with three members that stand for it: the smallest and two drawn by hash of the id."""
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id")).alias(f"c{i}") for i in (1, 2)]
    centres = (banded.groupBy("bucket").agg(F.min("id").alias("c0"), *drawn, F.max("id").alias("last")).where("c0 < last")
               .select("bucket", F.array_distinct(F.array("c0", "c1.id", "c2.id")).alias("centres")))
    return _ordered(banded.join(centres, "bucket").select("id", F.explode("centres").alias("centre")), "id", "centre")


def _rest_links(banded: DataFrame, nodes: DataFrame, sets: DataFrame, classes: DataFrame, per_cent: int, slots: int) -> DataFrame:
    """Confirmed links between members of a bucket that lie in different classes so far.

    Buckets are dealt into blocks of about 256 members by hash; every pair of blocks is one row, compared as arrays, so that no
    bucket lies in one task.  A member comes with what its set lacks of, and has beyond, the set of the bucket's first member: from that
    the intersection of any two members follows exactly, and near copies have little of it.  Of the links found in a pair of blocks
    only those are returned that join what was not joined before, so their number grows with the members, not with the pairs.
    """
    cut = least_estimate(per_cent / 100, slots)
    at = banded.join(classes, "id")
    open_ = (at.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("id").alias("centre"),
                                      F.count(F.lit(1)).alias("n")).where("low < high"))
    members = (at.join(open_.select("bucket", "centre", F.ceil(F.col("n") / BLOCK).alias("blocks")), "bucket")
               .withColumn("block", F.pmod(F.xxhash64("id"), "blocks")))
    own = members.select("id", "centre").distinct().join(sets, "id")
    gaps = own.join(sets.select(F.col("id").alias("centre"), F.col("hashes").alias("base")), "centre").select(
        "id", "centre", F.size("base").alias("base"), F.array_except("base", "hashes").alias("lacks"), F.array_except("hashes", "base").alias("adds"))
    described = members.join(gaps, ["id", "centre"]).join(nodes.select("id", "bits"), "id")
    blocks = described.groupBy("bucket", "blocks", "block").agg(
        F.first("base").alias("base"), F.collect_list(F.struct("block", "id", "class", "bits", "lacks", "adds")).alias("rows"))
    met = (blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .groupBy("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
           .agg(F.first("base").alias("base"), F.flatten(F.collect_list("rows")).alias("rows")))
    kind = nodes.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [link for base, rows, i, j in zip(batch["base"], batch["rows"], batch["i"], batch["j"])
                     for link in _block_links(rows, int(base), i != j, per_cent, cut, slots)]
            yield pd.DataFrame(found, columns=["a", "b"])

    return _ordered(met.select("i", "j", "base", "rows").mapInPandas(compare, f"a {kind}, b {kind}"), "a", "b")


def _block_links(rows: list, base: int, across: bool, per_cent: int, cut: float, slots: int) -> Iterator[tuple]:
    """Links that join classes, among the members of one block or (`across`) between those of two."""
    ids, block = [r["id"] for r in rows], np.array([r["block"] for r in rows])
    group = pd.factorize(pd.Series([r["class"] for r in rows]))[0]
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint64).reshape(len(rows), -1)
    lacks, adds = ([np.asarray(r[c], np.int64) for r in rows] for c in ("lacks", "adds"))
    fewer, more = (np.array([len(x) for x in part]) for part in (lacks, adds))
    sizes = base - fewer + more
    marks = None
    for i in range(len(rows)):
        other = (group != group[i]) & (100 * np.minimum(sizes, sizes[i]) >= per_cent * np.maximum(sizes, sizes[i]))
        other &= (block > block[i]) if across else (np.arange(len(rows)) > i)
        where = np.flatnonzero(other)
        if len(where):
            where = where[estimate(bits[where], bits[i], slots) >= cut]
        if not len(where):
            continue
        if marks is None:  # one bit per hash that some member lacks or adds
            side = [np.repeat(np.arange(len(rows)), n) for n in (fewer, more)]
            column = [np.unique(np.concatenate([*part, np.empty(0, np.int64)]), return_inverse=True) for part in (lacks, adds)]
            width = len(column[0][0])
            flat = np.zeros((len(rows), -(-(width + len(column[1][0])) // 64) * 64), bool)
            flat[side[0], column[0][1]] = True
            flat[side[1], width + column[1][1]] = True
            marks = np.packbits(flat, axis=1).view(np.uint64)
            del flat
        both = base - fewer[i] - fewer[where] + np.bitwise_count(marks[where] & marks[i]).sum(axis=1, dtype=np.int64)
        for k in where[100 * both >= per_cent * (sizes[i] + sizes[where] - both)]:
            if group[k] != group[i]:
                group[group == group[k]] = group[i]
                yield ids[i], ids[k]


def _promising(pairs: DataFrame, nodes: DataFrame, per_cent: int, slots: int) -> DataFrame:
    """Pairs whose sizes and whose estimated similarity allow a link."""
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        left, right = (np.frombuffer(b"".join(map(bytes, x)), np.uint64).reshape(len(x), -1) for x in (a, b))
        return pd.Series(estimate(left, right, slots))

    left = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b"))
    sized = pairs.join(right, "b").join(left, "a").where(100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb"))
    return sized.where(similarity("bits_a", "bits_b") >= least_estimate(per_cent / 100, slots)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links whose full sets have 100 * intersection >= per_cent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return both.where(100 * F.col("shared") >= per_cent * (F.col("sum") - F.col("shared"))).select("a", "b")


def near_duplicates(annotations: DataFrame, ann_id: str = "ann_id", text: str = "label", width: int = 5, per_cent: int = 80) -> DataFrame:
    """Groups of text annotations (ann_id, label) whose texts are nearly the same, by b-bit MinHash.

    Words are runs of anything but space and \\t-\\r, with A-Z in lower case; the set of a text holds its distinct shingles of `width`
    words, the whole sequence if it has fewer.  Texts link when 100 * intersection >= per_cent * union of their sets.

    One row per input row: ann_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept
    (ann_id = component_id).  Texts that are null, empty or without words have no shingles and no links.  Rows that share an id
    count as one annotation.  Rows without an id are linked with nothing: component_id null, kept true.  Other columns are not used.

    Method: equal sets collapse first, to the smallest id.  Minima of 32-bit permutations are cut into bands; low bits of all
    minima are packed into a signature.  In each bucket the members are compared with three of them (estimate, then full sets), and the
    links joined to classes; buckets that still hold several classes are then compared in full, block by block, except pairs inside
    one class, which can't change the result.  So copies of one text are never expanded into pairs, and only a pair that
    shares no band (see MISS) or falls five deviations below the estimate can be lost.
    """
    work: list[str] = []
    bands = bands_for(per_cent / 100)
    slots = bands * ROWS
    texts = annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
    signed = stored(signatures(texts, width, bands), "signatures")
    known = signed.where("set_key IS NOT NULL AND id IS NOT NULL")
    firsts = known.groupBy("set_key").agg(F.min("id").alias("first"))
    nodes = stored(known.join(firsts.withColumnRenamed("first", "id"), ["set_key", "id"]), "nodes", work)

    banded = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    banded = stored(banded.join(shared, "bucket"), "buckets", work)
    wanted = banded.select("id").distinct()
    sets = stored(shingle_sets(texts.join(wanted, "id", "left_semi"), width), "sets", work)

    links = stored(_confirmed(_promising(_star_pairs(banded), nodes, per_cent, slots), sets, per_cent), "links", work)
    ids = nodes.select(F.col("id").alias("node")).distinct()
    classes = _classes(ids, links)
    more = stored(_rest_links(banded, nodes, sets, classes, per_cent, slots), "links", work)
    if not more.isEmpty():
        classes = _classes(ids, links.unionByName(more))
    discard(work)
    named = firsts.join(classes.select(F.col("id").alias("first"), "class"), "first").select("set_key", "class")
    out = signed.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select(F.col("id").alias(ann_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _classes(ids: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(ids, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return stored(found.select(F.col("node").alias("id"), F.col("component").alias("class")), "classes")
