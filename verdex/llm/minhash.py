"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.graph import connected_components
from ..plans.skew import hot_counts, hot_keys, salted_join
from .common import bound_batches, hold_cache, rows, staged, whole_texts

SHINGLE = 5
BANDS, BAND_ROWS = 32, 5
#: Minima of the packed signature of a candidate; the first BANDS * BAND_ROWS also make the bands.
MINIMA = 2048
#: Low bits kept of each minimum; MINIMA / 64 longs for each bit plane.
BITS = 2
LONGS = MINIMA // 64
#: A pair goes to the exact check when its estimate is at least the wanted similarity less so many standard errors.
SIGMAS = 5.0

#: Ids of candidates, of some 100 bytes with their class, that may go to all tasks.
BROADCAST_IDS = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = (_RNG.integers(0, 2**31, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_BAND_MIX = _RNG.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
_BLOCK = 1024

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, cls string, bands array<long>"


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = np.uint64(pow(int(_ODD), -1, 2**64))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered. A text of fewer
    than five words is one shingle; a text without words has none. The words are
    laid out with one space between them, so that a shingle is a byte range, and
    its hash comes from two prefix sums of a polynomial in the bytes.
    """
    buffer = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not buffer:
        return np.empty(0, np.uint64)
    data = np.frombuffer(buffer, np.uint8)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(data)]])
    take = min(SHINGLE, len(starts))
    starts, ends = starts[: len(starts) - take + 1], ends[take - 1 :]
    found = (sums[ends] - sums[starts]) * down[starts]
    found ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return np.unique(found)


def minima(hashes: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The first ``n`` smallest images of a non-empty set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, n, 256):
        some = _MULTIPLIERS[k : min(k + 256, n), None]
        for at in range(0, len(short), _BLOCK):
            np.minimum(low[k : k + 256], (some * short[None, at : at + _BLOCK]).min(axis=1), out=low[k : k + 256])
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """BITS planes of LONGS longs: the low bits of a mixed image of each minimum.

    A minimum's own low bits hang on those of its element alone, whatever the multiplier; with a seed
    for each function, unequal minima agree independently of each other.
    """
    low = low ^ _SEEDS
    for shift, multiplier in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        low = (low ^ (low >> np.uint32(shift))) * np.uint32(multiplier)
    low ^= low >> np.uint32(16)
    planes = [np.packbits(((low >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8), bitorder="little").view(np.int64) for bit in range(BITS)]
    return np.concatenate(planes)


def _class(hashes: np.ndarray) -> str:
    """The name of a set: texts of one set are one class."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_cache("minhash", _POWERS.__init__)
    for ids, texts in rows(batches, "doc_id", "text"):
        sizes, classes, bands = [], [], []
        for text in texts:
            hashes = shingle_hashes(text)
            sizes.append(len(hashes))
            if len(hashes):
                low = minima(hashes, BANDS * BAND_ROWS).reshape(BANDS, BAND_ROWS)
                keys = (low.astype(np.uint64) + np.uint64(1)) * _BAND_MIX
                keys ^= keys >> np.uint64(29)
                classes.append(_class(hashes))
                bands.append((keys.sum(axis=1, dtype=np.uint64) * _ODD).view(np.int64))
            else:
                classes.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "bands"]
        )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full set and packed signature of texts; a row whose text isn't of the class asked for goes."""
    for classes, texts in rows(batches, "cls", "text"):
        out: list[list] = [[], [], []]
        for cls, text in zip(classes, texts):
            hashes = shingle_hashes(text)
            if len(hashes) and _class(hashes) == cls:
                for column, value in zip(out, (cls, hashes.tobytes(), packed(minima(hashes)))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["cls", "hashes", "plane"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    good.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.drop_columns(["left", "right"]).filter(pa.array(good, pa.bool_()))

    return run


def agreeing_minima(left: Column, right: Column) -> Column:
    """Number of minima whose kept bits all agree, by bit counts of the packed planes."""
    total = F.lit(0)
    for i in range(LONGS):
        differ = left[i].bitwiseXOR(right[i])
        for bit in range(1, BITS):
            differ = differ.bitwiseOR(left[bit * LONGS + i].bitwiseXOR(right[bit * LONGS + i]))
        total = total + F.lit(64) - F.bit_count(differ)
    return total


def least_agreeing(percent: int, sigmas: float = SIGMAS) -> int:
    """Agreeing minima that a pair of the wanted similarity reaches but for so many standard errors.

    Two unequal minima agree in all kept bits with chance 2**-BITS, so a pair of
    similarity J agrees with chance p = J + (1 - J) 2**-BITS; the bound is on the
    collision-corrected estimate (p - 2**-BITS) / (1 - 2**-BITS).
    """
    chance = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return int(MINIMA * chance - sigmas * (MINIMA * chance * (1 - chance)) ** 0.5)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text, ...)``.

    Texts whose sets share at least ``percent`` hundredths of their union are
    linked; a component is what links reach, named by its smallest doc_id.

    Texts with the same set form one class and are never paired. Classes that
    share a band are candidates; in every band bucket, all members are first
    paired with the one member that meets the most others (in a family of copies,
    nearly always the original), and the links that hold are closed to components.
    What remains are the pairs of a bucket that still lie in different components.
    Each is estimated from the packed bits: those estimated as linked are checked on
    the full sets first, and of the rest, those that still lie apart after that and
    whose estimate leaves it open. So no pair that shares a band is passed over, and
    a family of n copies costs about n checks instead of n squared. Buckets, heads, parts,
    components and classes that hold many rows are dealt to several tasks in every join.

    Null or wordless texts: n_shingles 0, linked with nothing. Rows that repeat a
    doc_id are one document. A null doc_id takes no part in naming; a component of
    only such rows has a null id, and they are kept.
    """
    return _classed(docs, percent).drop("cls")


def _classed(docs: DataFrame, percent: int) -> DataFrame:
    """:func:`near_duplicates` with the class of each row's set."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = whole_texts(docs)
    n_docs = docs.count()
    signed = staged(docs.mapInArrow(_signatures, SIGNATURE_SCHEMA), "minhash-signatures", n_docs)
    classes = staged(signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "minhash-classes", n_docs)
    banded = classes.select("cls", F.posexplode("bands").alias("band", "value")).select("cls", F.xxhash64("band", "value").alias("bucket"))
    shared = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-shared", n_docs)
    in_buckets = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full_buckets = hot_counts(shared, "bucket", "n", in_buckets)
    by_bucket = lambda rows, other: salted_join(rows, other, "bucket", full_buckets, F.col("cls"))
    members = staged(by_bucket(banded, shared), "minhash-members", n_docs)
    degree = members.groupBy("cls").agg(F.sum("n").alias("degree"))
    heads = members.join(degree, "cls").groupBy("bucket").agg(F.max(F.struct("degree", "cls")).alias("head"))
    heads = staged(heads.select("bucket", F.col("head.cls").alias("head"), F.col("head.degree").alias("rank")), "minhash-heads", n_docs)
    placed = staged(by_bucket(members.select("bucket", "cls"), heads), "minhash-placed", n_docs)

    banding = staged(degree.join(classes, "cls").select("cls", "doc_id", "bands"), "minhash-candidates", n_docs)
    n_wanted = banding.count()
    # Texts of candidates alone move: their ids go to all tasks where these are few enough, else both sides meet by id.
    wanted = banding.select("cls", "doc_id")
    wanted = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    sets = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("cls", "text").mapInArrow(_candidates, "cls string, hashes binary, plane array<long>")
    sets = staged(sets.dropDuplicates(["cls"]), "minhash-sets", n_docs)
    planes = sets.select("cls", "plane")

    def linked(pairs: DataFrame, label: str, estimate: Column | None = None) -> DataFrame:
        """The pairs (a, b, ...) that hold on the full sets, of those whose estimate, if one is asked for, lets them."""
        n = pairs.count()
        side = lambda x, name: sets.select(F.col("cls").alias(x), F.col("hashes").alias(name), F.col("plane").alias(f"plane_{x}"))
        full = salted_join(pairs, side("a", "left"), "a", hot_keys(pairs, "a", n), F.col("b"))
        full = salted_join(full, side("b", "right"), "b", hot_keys(pairs, "b", n), F.col("a"))
        full = full if estimate is None else full.where(estimate)
        return staged(full.select(*pairs.columns, "left", "right").mapInArrow(_confirm(percent), pairs.schema), label, n_docs)

    agreeing = agreeing_minima(F.col("plane_a"), F.col("plane_b"))
    open_from, linked_from = least_agreeing(percent), least_agreeing(percent, sigmas=0)
    star = staged(placed.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"), "rank").distinct(), "minhash-heads-and-members", n_docs)
    links = linked(star, "minhash-star", agreeing >= open_from)

    # Parts are pieces of components that are sure to hang together: links lead to members that meet more, so there are no rings.
    up = staged(links.groupBy(F.col("b").alias("cls")).agg(F.max(F.struct("rank", "a")).alias("best")).select("cls", F.col("best.a").alias("up")), "minhash-up", n_docs)
    over = up.select(F.col("cls").alias("up"), F.col("up").alias("far"))
    top = salted_join(up, over, "up", hot_keys(up, "up", n_wanted), F.col("cls"), "left").select("cls", F.coalesce("far", "up").alias("up"))
    parts = staged(banding.select("cls").join(top, "cls", "left").select("cls", F.coalesce("up", "cls").alias("part")), "minhash-parts", n_docs)

    def set_apart(parts: DataFrame, label: str) -> DataFrame:
        """Members of buckets with their parts, and whether that is their head's."""
        head_parts = heads.join(parts.select(F.col("cls").alias("head"), F.col("part").alias("head_part")), "head").select("bucket", "head_part")
        rows_of = by_bucket(placed.select("bucket", "cls"), head_parts).join(parts, "cls")
        return staged(rows_of.select("bucket", "cls", "part", (F.col("part") == F.col("head_part")).alias("with_head")), label, n_docs)

    sides = banding.select("cls", "bands").join(planes, "cls")
    # A pair is taken in the first band it shares, and once: members beside the head's part in the order of their names.
    same_band = "int(array_position(zip_with(bands_a, bands_b, (x, y) -> x = y), true) - 1)"
    first_band = F.expr(f"xxhash64({same_band}, bands_a[{same_band}])")
    once = (F.col("part_a") != F.col("part_b")) & (F.col("with_head") | (F.col("a") < F.col("b"))) & (first_band == F.col("bucket"))

    def still_apart(apart: DataFrame, estimate: Column) -> DataFrame:
        side = lambda rows, x: rows.join(sides, "cls").select("bucket", F.col("cls").alias(x), F.col("part").alias(f"part_{x}"), F.col("plane").alias(f"plane_{x}"), F.col("bands").alias(f"bands_{x}"), *(["with_head"] if x == "b" else []))
        loose = apart.where(~F.col("with_head"))
        other = side(by_bucket(apart, loose.select("bucket").distinct()), "b")
        pairs = salted_join(other, side(loose, "a"), "bucket", full_buckets, F.col("b"))
        return staged(pairs.where(estimate & once).select("a", "b", "part_a", "part_b").distinct(), "minhash-open", n_docs)

    likely = linked(still_apart(set_apart(parts, "minhash-apart"), agreeing >= linked_from), "minhash-likely")
    # Of parts that a link joins, the one with more links gives its name to the other.
    ways = likely.select("part_a", "part_b").union(likely.select("part_b", "part_a")).toDF("part", "next")
    weight = ways.groupBy("part").agg(F.count(F.lit(1)).alias("weight"))
    best = ways.join(weight.toDF("next", "weight"), "next").groupBy("part").agg(F.max(F.struct("weight", "next")).alias("best")).join(weight, "part")
    merged = best.where(F.col("best") > F.struct("weight", F.col("part").alias("next"))).select("part", F.col("best.next").alias("into"))
    joined = salted_join(parts, merged, "part", hot_keys(parts, "part", n_wanted), F.col("cls"), "left")
    joined = staged(joined.select("cls", F.coalesce("into", "part").alias("part")), "minhash-joined", n_docs)
    unlikely = linked(still_apart(set_apart(joined, "minhash-still-apart"), agreeing.between(open_from, linked_from - 1)), "minhash-unlikely")
    links = links.select("a", "b").union(likely.select("a", "b")).union(unlikely.select("a", "b"))

    named = connected_components(links, n=n_docs).withColumnRenamed("node", "cls")
    n_classes = classes.count()
    per_class = classes.select("cls", "doc_id").join(named, "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    names = per_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = salted_join(per_class, names, "component", hot_keys(named, "component", n_classes), F.col("cls")).select("cls", "component_id")
    # Rows that repeat a doc_id with another text stay with that document's own classes.
    worded = signed.where("cls is not null").select("doc_id", "n_shingles", "cls")
    out = salted_join(worded, by_class, "cls", hot_keys(worded, "cls", n_docs), F.struct("doc_id"), "left")
    wordless = signed.where("cls is null").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"))
    out = out.unionByName(wordless)
    return out.select("doc_id", "n_shingles", "component_id", "cls").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = map(shingle_hashes, batch.column(batch.schema.get_field_index("text")).to_pylist())
        yield batch.append_column("_cls", pa.array([_class(s) if len(s) else None for s in sets], pa.string()))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns; of rows that repeat a kept doc_id, one.

    Rows with a null doc_id stay or go each by its own text.
    """
    found = staged(_classed(docs, percent).where("kept or doc_id is null").select("doc_id", "kept", "cls"), "near-dedup-kept", docs.count())
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = not kept.where("n > 1").isEmpty()
    out = docs.join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    out = out.dropDuplicates(["doc_id"]) if repeated else out
    nameless = found.where("doc_id is null")
    if nameless.where("kept").isEmpty():
        return out
    gone = nameless.where("not kept").select(F.col("cls").alias("_cls")).distinct()
    alone = docs.where("doc_id is null")
    alone = alone.mapInArrow(_with_class, StructType([*alone.schema.fields, StructField("_cls", StringType())])).join(gone, "_cls", "left_anti").drop("_cls")
    return out.unionByName(alone)
