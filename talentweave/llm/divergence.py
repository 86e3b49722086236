"""How the sources of a language differ in their words: counts of every term, packed into integers, and a divergence of them.

Counting works on slabs of whole texts as byte arrays. A term of up to 8 bytes becomes one 64-bit word, one of up to 16
bytes two, big end first and filled up with zeros, which no term contains; these are put in order by a radix sort of 16-bit
digits and counted by runs. Longer terms go to buckets by width (32, 64, ... bytes), each sorted by bytes. The sorts are stable and
documents come in order, so that within a run of equal terms each new document number is one more document. Spark adds up the runs.

A term is a run of letters A-Z (lower-cased), a-z and of characters outside ASCII. NULL texts, languages and sources count as
empty. A language keeps the terms that at least ``min_documents`` of its rows contain. Repeated rows are documents like any others.
A language without kept terms gives every pair of its sources the value 0 and no rows of terms. Without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.spans import byte_table, spans
from talentweave.llm.words import slices
from talentweave.plans.storage import materialize

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
SLAB_BYTES = 1 << 24  # text counted at a time; a longer text is a slab of its own
CELLS = 1 << 18  # terms times sources in one block of comparisons

COUNT_FIELDS = "lang string, source string, term string, n bigint, docs bigint"
PAIR_FIELDS = "lang string, source string, item string, value bigint"

LETTERS = byte_table(digits=False)
#: By number of bytes: the bits of a word that they fill.
FILLED = np.array([((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(9)], "uint64")


def _windows(mapped: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each place on; behind the end there are zeros."""
    padded = np.concatenate([mapped, np.zeros(width, "u1")])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[at]


def _words(mapped: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms as ``words`` 64-bit words, the first one first."""
    out = []
    for k in range(words):
        whole = _windows(mapped, starts + 8 * k, 8).view(">u8").reshape(-1).astype("uint64")
        out.append(whole & FILLED[np.clip(lengths - 8 * k, 0, 8)])
    return out


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of 64-bit words, the first column deciding first, by their 16-bit digits from the last one on."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (column >> np.uint64(shift)).astype("uint16")
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit numbers this is a radix sort
    return order


def _runs(columns: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: where each run of equal rows starts, its length and its number of documents."""
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    new_doc = new.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(docs))), np.add.reduceat(new_doc.astype("int64"), first)


def _counted(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, term, occurrences and documents of each different (group, term), a bucket of lengths at a time."""
    mapped, starts, lengths, doc = spans(texts, LETTERS)
    width = 8
    while len(starts):
        here = lengths <= width
        if here.any():
            at, size, docs = starts[here], lengths[here], doc[here]
            owner = group[docs]
            if width <= 16:
                words = _words(mapped, at, size, width // 8)
                order = radix_order([owner.astype("uint64"), *words])
                sorted_words = [w[order] for w in words]
                first, n, n_docs = _runs([owner[order], *sorted_words], docs[order])
                terms = np.stack([w[first] for w in sorted_words], axis=1).astype(">u8").view(f"S{width}").reshape(-1)
            else:
                whole = _windows(mapped, at, width)
                whole[np.arange(width) >= size[:, None]] = 0
                values = np.ascontiguousarray(whole).view(f"S{width}").reshape(-1)
                order = np.argsort(values, kind="stable")
                order = order[radix_order([owner[order].astype("uint64")])]
                values = values[order]
                first, n, n_docs = _runs([owner[order], values], docs[order])
                terms = values[first]
            yield owner[order][first], terms, n, n_docs
            starts, lengths, doc = starts[~here], lengths[~here], doc[~here]
        width *= 2


def _count_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("lang", "source")], ["lang", "source"])
        of = {}
        group = np.array([of.setdefault((r["lang"], r["source"]), len(of)) for r in names.to_pylist()], "int64")
        langs, sources = (pa.array([k[i] for k in of], pa.string()) for i in (0, 1))
        for owner, terms, n, n_docs in _counted(rows["text"].combine_chunks(), group):
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(owner)), sources.take(pa.array(owner)), pa.array(terms.tolist(), pa.binary()).cast(pa.string()),
                pa.array(n), pa.array(n_docs)], ["lang", "source", "term", "n", "docs"])

    held, size = [], 0
    for batch in batches:
        filled = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text")], ["lang", "source", "text"])
        done = 0
        for part in slices(filled.column("text"), SLAB_BYTES):
            held.append(filled.slice(done, len(part)))
            done, size = done + len(part), size + pc.sum(pc.binary_length(part)).as_py()
            if size >= SLAB_BYTES:
                yield from counts(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield from counts(pa.Table.from_batches(held))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term, several rows of each to add up."""
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return rows.mapInArrow(_count_slabs, COUNT_FIELDS)


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, **columns) -> DataFrame:
    """``lang, term, source, n, total, lead``: counts of the kept terms by source and by language; one row of each term leads."""
    counts = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # Rows of a term are in one partition already, so neither the sums above nor these windows move them again.
    same = Window.partitionBy("lang", "term")
    summed = counts.withColumns({
        "total": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "lead": F.min("source").over(same) == F.col("source")})
    return summed.where(F.col("in_docs") >= min_documents).drop("in_docs", "docs")


def _points(count: Column, size: Column, terms: Column) -> Column:
    """A smoothed share of a term in parts of ``SCALE``, in exact numbers of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(SCALE), F.greatest(wide(size + terms), F.lit(1)))).cast("long")


def _compare(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of one block of terms for each pair of sources."""
    sources = groups["source"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    coded = terms["term"].combine_chunks().dictionary_encode()
    points = np.repeat(groups["p0"].to_numpy()[:, None], len(coded.dictionary), axis=1)
    points[[place[s] for s in terms["source"].to_pylist()], coded.indices.to_numpy()] = terms["p"].to_numpy()
    out = []
    for i, name in enumerate(sources):
        apart = points[i] - points
        sums = (apart * apart // points).sum(axis=1, dtype="int64")
        out += [(key[0].as_py(), name, other, int(v)) for other, v in zip(sources, sums) if other != name]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, cells: int = CELLS,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets a source apart.

    With p a source's smoothed share of a term and q the one it is compared with, a term counts (p - q)^2 / q, rounded down. Part ``pair``
    has each other source of the language, with the sum over all kept terms; part ``term`` the ``top_terms`` terms that the source has more of
    than its language. Ranks start at 1, the largest value first, equal values by the bytes of the item.
    """
    kept = materialize(kept_terms(docs, min_documents, lang_col=lang_col, source_col=source_col, text_col=text_col), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    found = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    groups = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    in_lang = Window.partitionBy("lang")
    groups = materialize(groups.withColumns({
        "p0": _points(F.lit(0), F.col("size"), F.col("terms")),
        "blocks": F.ceil(F.greatest(F.lit(1), F.col("terms") * F.count("*").over(in_lang)) / cells)}), "source-sizes")

    placed = kept.join(groups, ["lang", "source"]).withColumn("p", _points(F.col("n"), F.col("size"), F.col("terms")))
    blocks = placed.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "source", "p")
    sources = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    sums = blocks.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInArrow(_compare, PAIR_FIELDS)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = _points(F.col("total"), F.col("lang_size"), F.col("terms"))
    above = placed.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.select("lang", "source", "item", value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
