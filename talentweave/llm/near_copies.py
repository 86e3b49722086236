"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one class, and only one text of each class is compared. SimHash fingerprints of these shingles, op1's operator, link
first: pivot tables find those within two bits, and their texts are verified on whole sets. As texts at 0.8 may be further apart than
that, classes meet too where they share a band: four of 128
minimum hashes in a row, 32 bands. A pair at 0.8 misses all bands with probability (1 - 0.8^4)^32, or 5e-8, a nearer one even less
often. A fingerprint of 512 bytes (the smallest hash of each of 512 parts of a set; of a small set that is nearly all of it)
tells which of these to verify: those whose share of equal bytes is within five standard deviations of 0.8. Verification
takes the whole sets, so no pair below 0.8 is ever linked.

Buckets of at most ``bucket_rows`` classes are paired. In a larger one each class is first compared with one class of the bucket, and components are
formed of what is linked. Then only classes of different components are compared, in blocks, without rows for pairs. Sets of at most
``SMALL`` shingles come along whole, as 32-bit hashes, and their intersections are counted by products of matrices; of the links that are found
a block returns those that join components. Larger sets compare fingerprints: a pivot table, the numbers of bytes in which they
differ from some fingerprints of the block, rules a pair out by the triangle inequality when a coordinate differs by more than near texts
do, and the rest compare their bytes. The largest component of a bucket is not compared with itself, so that
a group of copies of one text costs rows in proportion to its size. Texts that are all nearly as
similar as 0.8 cost products with the square of their number; none is left out.

Texts: A-Z lower-cased, words split at ASCII white space. NULL counts as empty, texts without words are one class, and a text of
fewer than five words is one shingle. NULL ids count as larger than all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from talentweave.llm import simhash
from talentweave.llm.columns import boxed, unboxed
from talentweave.llm.components import components
from talentweave.plans.storage import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 4
PARTS = 512  # bytes of a fingerprint
DEVIATIONS, SLACK = 5, 2  # how far below the least similarity a share of equal bytes may be
BUCKET_ROWS = 8
SMALL = 512  # shingles of a set that is compared whole in blocks
COLUMNS = 4096  # shingles of a product of matrices
BLOCK = 1024  # classes of a crowded bucket that are compared at a time
PIVOTS = 8
CHUNK = 1 << 12  # shingles hashed at a time

_random = np.random.default_rng(20240607)
_FACTORS, _SHIFTS = (_random.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype="uint64") | np.uint64(1) for _ in range(2))
_STEPS = _random.integers(0, 1 << 64, 64, dtype="uint64") | np.uint64(1)

PRINT_FIELDS = "digest binary, size int, bands array<bigint>, print binary"


def shingles(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if len(words) < shingle_words:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], "uint64")
    hashes = np.fromiter((xxh64_intdigest(w, 42) for w in words), "uint64", len(words))
    n = len(words) - shingle_words + 1
    found = np.zeros(n, "uint64")
    for i in range(shingle_words):
        found = (found ^ (found >> np.uint64(29))) * _STEPS[i] + hashes[i:i + n]
    return np.unique(found)


def short(found: np.ndarray) -> np.ndarray:
    """A set as sorted 32-bit hashes."""
    return np.unique((found >> np.uint64(32)).astype("uint32"))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """A byte for each part of the hash range: 0 where a sorted set of 32-bit hashes has nothing, else one of 1 to 255 for its smallest hash there."""
    out = np.zeros(PARTS, "u1")
    part = found >> np.uint32(32 - (PARTS - 1).bit_length())
    first = np.flatnonzero(np.diff(part, prepend=np.uint32(PARTS)))
    out[part[first]] = (found[first].astype("uint64") * _STEPS[0] >> np.uint64(48)) % np.uint64(255) + np.uint64(1)
    return out


def gaps(prints: np.ndarray) -> np.ndarray:
    """Of fingerprints the parts where a set has nothing, as bits of 64-bit words."""
    return np.packbits(prints == 0, axis=1).view("uint64")


def similar(
    ones: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, similarity: float = SIMILARITY,
    one_gaps: np.ndarray | None = None, other_gaps: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of fingerprints, one or as many on either side: the share of equal bytes, and whether sets of at least ``similarity`` may be behind."""
    empty = np.bitwise_count((gaps(ones) if one_gaps is None else one_gaps) & (gaps(others) if other_gaps is None else other_gaps)).sum(axis=1, dtype="int64")
    same = np.count_nonzero(ones == others, axis=1) - empty
    either = np.maximum(1, PARTS - empty)  # parts that one of both has
    union = (sizes + other_sizes) / (1 + similarity)  # at the least similarity; the parts are so many drawn of them
    left = np.clip((union - either) / np.maximum(1, union - 1), 0, 1)
    least = similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) * left / either)
    sized = np.minimum(sizes, other_sizes) >= similarity * np.maximum(sizes, other_sizes)
    return same / either, sized & (same + SLACK >= either * least)


def _rows(prints: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), "u1").reshape(-1, PARTS)


def _print(text: bytes | None) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    found = shingles(text)
    least = np.full(len(_FACTORS), (1 << 32) - 1, "uint64")
    for start in range(0, len(found), CHUNK):
        mixed = (found[start:start + CHUNK] * _FACTORS[:, None] + _SHIFTS[:, None]) >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=1))
    return xxh3_128_digest(found.tobytes()), len(found), least.astype("<u4"), fingerprint(short(found))


def _prints(text: Column) -> Column:
    """Of each text a digest of its set, its size, hashes of bands and the fingerprint."""

    @F.arrow_udf(PRINT_FIELDS)
    def sign(texts: pa.Array) -> pa.Array:
        rows = [_print(b.to_pybytes() if (b := v.as_buffer()) is not None else None) for v in texts]
        least = np.stack([r[2] for r in rows]) if rows else np.zeros((0, len(_FACTORS)), "<u4")
        bands = [xxh64_intdigest(part.tobytes(), 42) for part in least.reshape(-1, BAND_ROWS)]
        return pa.StructArray.from_arrays([
            pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * BANDS), pa.array(np.array(bands, "uint64").view("int64"))),
            pa.array([r[3].tobytes() for r in rows], pa.binary()),
        ], ["digest", "size", "bands", "print"])

    return sign(text)


def _likeness(one: str, size: str, other: str, other_size: str, similarity: float) -> Column:
    """The share of equal bytes of two fingerprints, -1 where the texts can't be near."""

    @F.arrow_udf("double")
    def of(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        share, near = similar(_rows(a), n.to_numpy(zero_copy_only=False), _rows(b), m.to_numpy(zero_copy_only=False), similarity)
        return pa.array(np.where(near, share, -1.0))

    return of(one, size, other, other_size)


def _sets(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(b.to_pybytes() if (b := v.as_buffer()) is not None else None).tobytes() for v in texts], pa.binary())

    return of(text)


def _carried(sets: Column) -> Column:
    """What a class takes into blocks: its fingerprint, its size, and of a small set the whole."""

    @F.arrow_udf("print binary, size int, small binary")
    def of(found: pa.Array) -> pa.Array:
        whole = [np.frombuffer(v.as_buffer(), "uint64") for v in found]
        values = [short(w) for w in whole]
        return pa.StructArray.from_arrays([
            pa.array([fingerprint(v).tobytes() for v in values], pa.binary()), pa.array([len(w) for w in whole], pa.int32()),
            pa.array([v.astype("<u4").tobytes() if len(w) <= SMALL else None for v, w in zip(values, whole)], pa.binary()),
        ], ["print", "size", "small"])

    return of(sets)


def _jaccard(one: str, other: str) -> Column:
    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            left, right = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
            common = len(np.intersect1d(left, right, assume_unique=True))
            out.append(common / max(1, len(left) + len(right) - common))
        return pa.array(out, pa.float64())

    return of(one, other)


def _beside(pairs: DataFrame, rows: DataFrame, *values: str) -> DataFrame:
    """``pairs`` with values of ``rows`` by node beside both ends: a value ``v`` as ``v_a`` and ``v_b``."""
    for end in ("a", "b"):
        named = [F.col(v).alias(f"{v}_{end}") for v in values]
        pairs = pairs.join(rows.select(F.col("node").alias(f"_{end}"), *named), F.col(end) == F.col(f"_{end}")).drop(f"_{end}")
    return pairs


def _signed(classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes with SimHash fingerprints within two bits: by pivot tables, one class for each fingerprint, and others beside it."""
    own = classes.select("node", F.col("first.fp").alias("fp"))
    led = materialize(own.groupBy("fp").agg(F.min("node").alias("lead")), "simhash-leads")
    found = simhash.links(led.select("fp"))
    for end in ("a", "b"):
        found = found.join(led.select(F.col("fp").alias(f"_{end}"), F.col("lead").alias(f"lead_{end}")), F.col(end) == F.col(f"_{end}"))
    beside = own.join(led, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return found.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")).unionByName(beside)


def met_classes(prints: DataFrame) -> DataFrame:
    """``key, n, node``: members of every bucket that several classes share, and their number."""
    listed = prints.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("key"))
    shared = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return listed.join(shared, "key")


def _paired(met: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of small buckets that may be near."""
    left = met.select("key", F.col("node").alias("a"))
    pairs = left.join(left.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b").distinct()
    return _beside(pairs, prints, "print", "size").where(_likeness("print_a", "size_a", "print_b", "size_b", similarity) >= 0).select("a", "b")


def _led(crowd: DataFrame, similarity: float) -> DataFrame:
    """Of each class in crowded buckets the pair with the likest of the buckets' first classes."""
    order = F.xxhash64("node")  # of a number this is another number for each, so the least one tells the class
    first = crowd.groupBy("key").agg(F.min(order).alias("first"))
    lead = crowd.join(first.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (order == F.col("first"))).select(
        F.col("key").alias("_key"), F.col("node").alias("lead"), F.col("print").alias("lead_print"), F.col("size").alias("lead_size"))
    beside = crowd.join(lead, F.col("key") == F.col("_key")).where("node <> lead")
    liked = beside.select("node", "lead", _likeness("print", "size", "lead_print", "lead_size", similarity).alias("share")).where("share >= 0")
    best = liked.groupBy("node").agg(F.max_by("lead", "share").alias("lead"))
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))


def common(ones: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of some sets with each of others, by products of 0-1 matrices."""
    out = np.zeros((len(ones), len(others)), "float32")
    sides = []
    for sets in (ones, others):
        sides.append((np.concatenate([*sets, np.zeros(0, "uint32")]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])  # no others are in an intersection
    placed = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        here = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[here], kind="stable")
        placed.append((at[here][order], owner[here][order]))
    for start in range(0, len(shared), COLUMNS):
        parts = []
        for (at, owner), n in zip(placed, out.shape):
            low, high = np.searchsorted(at, (start, start + COLUMNS))
            dense = np.zeros((n, min(COLUMNS, len(shared) - start)), "float32")
            dense[owner[low:high], at[low:high] - start] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _joining(pairs: list[tuple[int, int]], root: dict[int, int]) -> list[tuple[int, int]]:
    """Those pairs of nodes that join components, one after the other; ``root`` has a component of every node."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = top(root[a]), top(root[b])
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _compare(similarity: float, pivots: int):
    def compare(rows: pa.Table) -> pa.Table:
        """Pairs of a class outside the bucket's largest component and any class of another component that are near or, if large, may be."""
        node, root, size, outside = (rows[c].to_numpy() for c in ("node", "root", "size", "outside"))
        whole = [None if v is None else np.frombuffer(v, "<u4") for v in rows["small"].to_pylist()]
        small = np.array([v is not None for v in whole], bool)
        both = np.isin(node, np.unique(node[outside]))  # classes outside the largest component meet twice
        asked, against = np.flatnonzero(outside & small), np.flatnonzero(~outside & small)
        shared = common([whole[i] for i in asked], [whole[i] for i in against]).astype("float64")
        union = size[asked][:, None] + size[against][None, :] - shared
        near = (shared / np.maximum(1, union) >= similarity) & (root[asked][:, None] != root[against][None, :])
        near &= (node[asked][:, None] < node[against][None, :]) | ~both[against][None, :]
        x, y = np.nonzero(near)
        best = np.argsort(-shared[x, y] / np.maximum(1, union[x, y]), kind="stable")
        linked = zip(node[asked[x[best]]].tolist(), node[against[y[best]]].tolist())
        out = _joining(list(linked), dict(zip(node.tolist(), root.tolist())))

        asked, against = np.flatnonzero(outside), np.flatnonzero(~outside)
        if not small.all() and len(against):
            prints = _rows(rows["print"])
            empty = gaps(prints)
            # Near texts differ in no more bytes than this, whatever their sizes, so neither do their distances to a pivot.
            widest = PARTS * (1 - similarity + DEVIATIONS * np.sqrt(similarity * (1 - similarity) / PARTS)) + SLACK
            table = np.stack([np.count_nonzero(prints != prints[p], axis=1) for p in against[:pivots]], axis=1).astype("int16")
            for i in asked:
                here = against[(root[against] != root[i]) & ((node[against] > node[i]) | ~both[against]) & ~(small[against] & small[i])]
                here = here[np.abs(table[here] - table[i]).max(axis=1) <= widest]
                if len(here):
                    here = here[similar(prints[i][None], size[i], prints[here], size[here], similarity, empty[i][None], empty[here])[1]]
                    out += [(int(node[i]), int(n)) for n in node[here]]
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return compare


def _crossing(crowd: DataFrame, roots: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs ``a, b`` of crowded buckets that may be near and aren't in one component yet."""
    rooted = crowd.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "key", "node", "size", "print", "small", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "crowd-rooted")
    largest = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("_key")).agg(
        F.max_by("root", "c").alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest"))
    mixed = rooted.join(largest.where("rest > 0"), F.col("key") == F.col("_key"))
    blocks, others = (F.ceil(F.col(c) / block) for c in ("n", "rest"))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    place = lambda count: F.pmod(F.xxhash64("key", "node"), count)
    columns = ["key", "node", "root", "size", "print", "small"]
    asked = mixed.where("root <> main").select(*columns, place(others).alias("i"), upto(blocks).alias("j"), F.lit(True).alias("outside"))
    against = mixed.select(*columns, place(blocks).alias("j"), upto(others).alias("i"), F.lit(False).alias("outside"))
    met = asked.unionByName(against).groupBy("key", "i", "j")
    return met.applyInArrow(_compare(similarity, PIVOTS), "a bigint, b bigint").distinct()


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of linked texts."""
    rows, (own, text) = boxed(docs, id_col, text_col)
    made = {"_row": F.monotonically_increasing_id(), "_print": _prints(F.col(text)), "_fp": simhash.fingerprint(F.col(text), SHINGLE_WORDS)}
    stored = materialize(rows.withColumns(made), "signed")
    first = F.struct(F.col(own).isNull().alias("no_id"), F.col(own).alias("id"), F.col("_row").alias("row"), F.col("_fp").alias("fp"))
    least = stored.groupBy(F.col("_print.digest").alias("digest")).agg(F.min(first).alias("first"))
    classes = materialize(least.withColumn("node", F.col("first.row")), "classes")
    chosen = classes.select("node")
    prints = stored.select(F.col("_row").alias("node"), "_print.size", "_print.bands", "_print.print").join(chosen, "node")
    prints = materialize(prints, "class-prints")
    met = materialize(met_classes(prints), "bands-met")
    near_prints = materialize(_signed(classes), "simhash-pairs")
    meeting = met.select("node").unionByName(near_prints.select(F.col("a").alias("node"))).unionByName(near_prints.select(F.col("b").alias("node"))).distinct()
    sets = materialize(stored.select(F.col("_row").alias("node"), text).join(meeting, "node").select("node", _sets(F.col(text)).alias("found")), "shingle-sets")
    crowded = met.where(F.col("n") > bucket_rows)
    carried = sets.join(crowded.select("node").distinct(), "node").select("node", _carried(F.col("found")).alias("_c")).select("node", "_c.*")
    crowd = materialize(crowded.join(carried, "node"), "bands-crowded")

    def verified(pairs: DataFrame) -> DataFrame:
        near = materialize(pairs, "near-pairs")
        return materialize(_beside(near, sets, "found").where(_jaccard("found_a", "found_b") >= similarity).select("a", "b"), "near-links")

    paired = _paired(met.where(F.col("n") <= bucket_rows), prints, similarity)
    links = verified(near_prints.unionByName(paired).unionByName(_led(crowd, similarity)).distinct())
    found = components(links, "a", "b")
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(_crossing(crowd, found, similarity, block)))
    roots = components(links, "a", "b").withColumnRenamed("node", "_node")
    heads = classes.join(roots, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("first").alias("head"))
    kept = heads.select(F.col("head.row").alias("_head"))
    return unboxed(stored.drop("_print", "_fp").join(kept, F.col("_row") == F.col("_head")), docs)
