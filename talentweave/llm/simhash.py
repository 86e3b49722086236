"""Near-duplicate groups by SimHash fingerprints and pivot distance tables.

A fingerprint row carries its Hamming distances to a set of reference fingerprints (pivots), kept per
segment of the 64 bits. By the triangle inequality two fingerprints within ``max_distance`` differ by no
more than that in any coordinate. And as ``max_distance`` bits touch at most as many segments, their
coordinates agree exactly in at least ``segments - max_distance`` segments: rows that share the coordinates
of one such choice of segments are the candidates. Of these, pairs with a larger maximum coordinate difference
are discarded and the survivors verified on the bits.

Where more than ``bucket_rows`` different fingerprints share a choice, pairs would grow with the square of the group.
There every fingerprint is listed under each fingerprint at distance ``max_distance / 2`` or less that keeps the shared
segments; two fingerprints link exactly if they meet under one of these, and each of them keeps one edge to the
smallest of its list. No link is lost for the components, and rows grow in proportion to the group.

Texts: A-Z lower-cased, words split at ASCII white space. NULL texts count as empty; texts without words have
fingerprint zero. Equal fingerprints, so all copies, meet before any pairing. NULL ids count as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from talentweave.llm.columns import boxed, unboxed
from talentweave.llm.components import components
from talentweave.plans.storage import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
PIVOTS = 16
SEGMENTS = 4
BUCKET_ROWS = 64
CHUNK = 1 << 15  # shingles whose bits are counted at a time


def _fingerprint(text: bytes, shingle_words: int) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shifted = [words[i:] for i in range(shingle_words)] if len(words) >= shingle_words else [[w] for w in words]
    n = len(shifted[-1])
    counts = np.zeros(64, dtype="int64")
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        hashes = np.fromiter(
            (xxh64_intdigest(b" ".join(s), 42) for s in zip(*[w[start:stop] for w in shifted])), dtype="<u8", count=stop - start)
        bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """SimHash of the whole text as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def sign(texts: pa.Array) -> pa.Array:
        values = (v.as_buffer() for v in texts)
        return pa.array([_fingerprint(b"" if v is None else v.to_pybytes(), shingle_words) for v in values], pa.int64())

    return sign(text)


def _pivots(n: int) -> list[int]:
    """Reference fingerprints: n fixed pseudo-random numbers."""
    return [int(v) for v in np.random.default_rng(20240607).integers(-(1 << 63), 1 << 63, size=n, dtype="int64")]


def _masks(segments: int) -> list[int]:
    """Masks of neighbouring bits, of about equal width, that cover all 64."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(prints: DataFrame, pivots: int = PIVOTS, segments: int = SEGMENTS) -> DataFrame:
    """``fp, coords, seg_keys``: distances to the pivots over all bits, and per segment a hash of those inside it."""
    parts = [
        [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(m)))) for p in _pivots(pivots)]
        for m in _masks(segments)
    ]
    table = prints.select("fp", *[F.array(*row).alias(f"s{i}") for i, row in enumerate(parts)])
    whole = [sum((F.col(f"s{i}")[j] for i in range(1, segments)), F.col("s0")[j]).cast("tinyint") for j in range(pivots)]
    return table.select(
        "fp", F.array(*whole).alias("coords"), F.array(*[F.xxhash64(f"s{i}") for i in range(segments)]).alias("seg_keys"))


def links(
    prints: DataFrame, max_distance: int = MAX_DISTANCE, pivots: int = PIVOTS, segments: int = SEGMENTS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of different ``fp`` at most ``max_distance`` apart."""
    if not 0 < max_distance < segments or max_distance % 2:
        raise ValueError("max_distance must be even, above 0 and below the number of segments")
    choices = list(combinations(range(segments), segments - max_distance))
    keys = F.array(*[
        F.struct(F.xxhash64(F.lit(i), *[F.col("seg_keys")[s] for s in choice]).alias("key"), F.lit(i).alias("choice"))
        for i, choice in enumerate(choices)
    ])
    listed = pivot_table(prints, pivots, segments).select("fp", "coords", F.inline(keys))
    crowd = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(listed.join(crowd, "key"), "pivot-buckets")

    left = met.where(F.col("n") <= bucket_rows).select("key", F.col("fp").alias("a"), F.col("coords").alias("ca"))
    right = left.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"))
    apart = F.greatest(*[F.abs(F.col("ca")[j].cast("int") - F.col("cb")[j].cast("int")) for j in range(pivots)])
    near = left.join(right, "key").where(
        (F.col("a") < F.col("b")) & (apart <= max_distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    ).select("a", "b")

    masks = _masks(segments)
    free = [sum(m for i, m in enumerate(masks) if i not in choice) for choice in choices]
    flips = F.array(*[
        F.array(*[F.lit(_signed(sum(1 << b for b in bits))) for bits in _flips(mask, max_distance // 2)]) for mask in free
    ])
    spread = met.where(F.col("n") > bucket_rows).select(
        "key", "fp", F.explode(F.element_at(flips, F.col("choice") + 1)).alias("flip")
    ).withColumn("meet", F.col("fp").bitwiseXOR(F.col("flip")))
    least = spread.groupBy("key", "meet").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).where("a < _z")
    crowded = spread.join(least, ["key", "meet"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(crowded).distinct()


def _flips(mask: int, radius: int) -> Iterable[tuple[int, ...]]:
    bits = [b for b in range(64) if mask >> b & 1]
    return [c for r in range(radius + 1) for c in combinations(bits, r)]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with ``_fp`` (signed), ``_component`` (smallest id that can be reached) and ``_kept``.

    One row of each component has ``_kept``: that with the smallest id. Without ``keep_text`` the text is left out.
    Columns of ``docs`` with these names are replaced, others stay whatever their names.
    """
    made = ["_fp", "_component", "_kept"]
    rows, (own, text) = boxed(docs, id_col, text_col)
    signed = rows.withColumns({"_fp": fingerprint(F.col(text)), "_row": F.monotonically_increasing_id()})
    signed = materialize(signed if keep_text else signed.drop(text), "fingerprints")
    first = F.struct(F.col(own).isNull().alias("no_id"), F.col(own).alias("id"), F.col("_row").alias("row"))
    prints = materialize(signed.groupBy(F.col("_fp").alias("fp")).agg(F.min(first).alias("first")), "prints")
    roots = components(links(prints.select("fp"), **options), "a", "b")
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    named = placed.join(heads, "root").select("fp", F.col("head.id").alias("_component"), F.col("head.row").alias("_head"))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in made and (keep_text or c != text_col)]
    return signed.join(named, F.col("_fp") == F.col("fp")).select(
        *kept, "_fp", "_component", (F.col("_row") == F.col("_head")).alias("_kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with the columns of ``docs`` whatever their names."""
    rows, (own, text) = boxed(docs, id_col, text_col)
    return unboxed(near_groups(rows, own, text, **options).where("_kept"), docs)
