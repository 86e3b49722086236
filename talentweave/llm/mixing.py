"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources share ``share`` times all words by weight; a source stops at ``max_repeats`` times its own size and
the excess is shared anew by weight among the rest. Sources are few, so their table is solved with windows over it.

Schedule: slot i of the mix is the i-th van der Corput point, mapped through the cumulative target weights to a
source. Points below 2^m are the multiples of 2^-m in bit-reversed order, so the slots of one source are listed straight from
its interval and no range join is needed. Slots are ranked per source in schedule order.

Blocks: the words of a source, its documents in the order of a hash of their id, are cut into blocks of equal
length, one for each slot of the source, until the target is reached; the stream starts over when it ends. Slot
number r of a source takes block number r, so the words taken meet the target and a document is taken at most
``max_repeats`` times. Positions within a source come from two-level prefix sums, so one source may hold most rows.

NULL texts have no words. A NULL source is a source, the last one. Documents without words, and all documents of an
empty table, take no part in the schedule but stay in ``taken_words`` with 0. Ties of the hash go by id; rows with a NULL id come last, and rows that
repeat an id are told apart by their text's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.columns import WORD, boxed, running_total, unboxed, word_count
from talentweave.plans.storage import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2.0
BLOCK_WORDS = 1024
BUCKETS = 256  # parts in which the stream of a source is summed


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """``source, source_size, weight, target`` from rows of ``source, source_size``."""
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(listed) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    # Sources fill up in the order of size over weight. The first that does not fill at the level left for it ends the list.
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_repeats
    level = (
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    leveled = weighed.withColumn("_level", level).withColumn("_over", F.col("_level") * F.col("weight") <= cap)
    water = F.min(F.when(F.col("_over"), F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("level")))).over(everything)
    filled = leveled.withColumn("_water", water["level"])
    return filled.select(
        "source", "source_size", "weight",
        F.when(F.col("_water").isNull(), cap).otherwise(F.least(cap, F.col("_water") * F.col("weight"))).alias("target"),
    )


def _stored(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` with ``_row`` (a number), ``_size`` (words) and what orders them within a source, written once."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = docs.withColumns({
        "_row": F.monotonically_increasing_id(), "_size": word_count(text_col), "_hash": F.md5(key), "_tie": F.xxhash64(text_col)})
    return materialize(sized if keep_text else sized.drop(text_col), "sizes")


def _placed(stored: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``_row, _size, _at`` and id and source: ``_at`` counts the words before a document in the stream of its source."""
    bucket = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int") % BUCKETS
    narrow = stored.select("_row", id_col, source_col, "_size", "_tie", "_hash", bucket.alias("_bucket"))
    ordered = narrow.withColumn("_order", F.concat(F.lpad("_bucket", 6, "0"), "_hash"))
    found = running_total(ordered, source_col, "_bucket", ["_order", f"`{id_col}`", "_tie"], "_size", "_at")
    return found.select("_row", id_col, source_col, "_size", "_at")


def _with_targets(placed: DataFrame, source_col: str, weights, share, max_repeats) -> DataFrame:
    sizes = placed.groupBy(F.col(source_col).alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_repeats).withColumnsRenamed(
        {"source": "_source", "source_size": "_source_size", "target": "_target"}).drop("weight")
    return placed.join(targets, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")


def _laps(max_repeats: float):
    """Per start of the source's stream: its number and how many words of the document are taken then."""
    goal = F.round("_target").cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(int(-(-max_repeats // 1)) - 1)),
        lambda lap: F.struct(
            lap.alias("lap"),
            F.greatest(F.lit(0), F.least(F.col("_size"), goal - lap * F.col("_source_size") - F.col("_at"))).alias("words")),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``_row, _size, _at, _source_size, _target, _laps`` (array of lap and words taken in it).

    Texts are moved once, to meet what was found for their rows; without ``keep_text`` just the ids and sources of
    ``docs`` are kept. Columns of ``docs`` with the new names are replaced, others stay whatever their names.
    """
    made = ["_row", "_size", "_at", "_source_size", "_target", "_laps"]
    rows, (own, text, source) = boxed(docs, id_col, text_col, source_col)
    stored = _stored(rows, own, text, keep_text)
    found = _with_targets(_placed(stored, own, source), source, weights, share, max_repeats).withColumn("_laps", _laps(max_repeats))
    if keep_text:
        parts = found.select(F.col("_row").alias("_of"), "_at", "_source_size", "_target", "_laps")
        found = stored.join(parts, F.col("_row") == F.col("_of"))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in made and (keep_text or c in (id_col, source_col))]
    return found.select(*kept, *made)


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``source, rank, slot, n_slots``: the slots of each source with a target, ranked in schedule order.

    A source too small to be met by any point gets one slot behind the last.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(everything)
    slots = F.greatest(F.lit(1), F.ceil(total / block_words)).cast("long")
    bits = F.greatest(F.lit(1), F.ceil(F.log2(slots.cast("double")))).cast("int")
    points = F.pow(F.lit(2.0), bits)
    wanted = targets.where("target > 0").withColumns({
        "_slots": slots, "_bits": bits,
        "_from": F.ceil(F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total * points).cast("long"),
        "_to": F.when(F.row_number().over(order) == F.count("*").over(everything), points)
        .otherwise(F.ceil(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total * points)).cast("long"),
    })
    # Long intervals are cut before they are listed, so that the points of one source are made by many tasks.
    cut = wanted.withColumn("_piece", F.explode(F.when(F.col("_to") > F.col("_from"), F.sequence("_from", F.col("_to") - 1, F.lit(1 << 16)))))
    pieces = cut.repartition("source", "_piece")
    point = F.explode(F.sequence("_piece", F.least(F.col("_piece") + (1 << 16), F.col("_to")) - 1))
    reverse = F.conv(F.reverse(F.lpad(F.bin("_point"), F.col("_bits"), F.lit("0"))), 2, 10).cast("long")
    hit = pieces.withColumn("_point", point).withColumn("slot", reverse).where("slot < _slots")
    missed = wanted.join(hit.select(F.col("source").alias("_hit")).distinct(), F.col("source").eqNullSafe(F.col("_hit")), "left_anti")
    late = missed.withColumn("slot", F.col("_slots") + F.row_number().over(order) - 1)
    names = ["source", "slot", "_slots"]
    found = hit.select(*names).unionByName(late.select(*names))
    bucket = F.floor(F.col("slot") / F.greatest(F.lit(1), F.col("_slots") / BUCKETS)).cast("int")
    one = found.withColumns({"_bucket": bucket, "_one": F.lit(1)})
    ranked = running_total(one, "source", "_bucket", ["slot"], "_one", "rank")
    counts = found.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("n_slots"))
    return ranked.join(counts, F.col("source").eqNullSafe(F.col("_of"))).select("source", "rank", "slot", "n_slots")


def pieces(found: DataFrame, slots: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: ``_row, doc_id, source, slot, start, length``, a row for each piece of a document in a slot.

    Besides ``lap`` and ``words`` as in ``_laps``, and ``place``, the words before the document in the laps of its source.
    ``start`` and ``length`` count words of the document. Slot number ``rank`` of a source holds words
    ``rank * T / n`` to ``(rank + 1) * T / n`` (rounded) of its stream, T words long in n slots.
    """
    goal = F.round("_target").cast("long")
    taken = found.select(
        "_row", F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "_at", "_source_size", goal.alias("_goal"), F.inline("_laps"))
    sizes = slots.groupBy("source").agg(F.max("n_slots").alias("n_slots")).withColumnRenamed("source", "_of")
    spans = taken.where("words > 0").join(sizes, F.col("source").eqNullSafe(F.col("_of"))).withColumn(
        "_begin", F.col("lap") * F.col("_source_size") + F.col("_at")).withColumn("_end", F.col("_begin") + F.col("words"))

    def edge(rank):  # the first word of a slot
        return F.floor(rank.cast("decimal(38,0)") * F.col("_goal") / F.col("n_slots")).cast("long")

    # The division may be off by one, so one slot more is tried on either side and empty pieces fall away.
    first = F.greatest(F.lit(0), F.floor(F.col("_begin") / F.col("_goal") * F.col("n_slots")).cast("long") - 1)
    last = F.least(F.col("n_slots") - 1, F.floor(F.col("_end") / F.col("_goal") * F.col("n_slots")).cast("long") + 1)
    each = spans.withColumn("_rank", F.explode(F.sequence(first, last)))
    cut = each.withColumn("_a", F.greatest("_begin", edge(F.col("_rank")))).withColumn("_b", F.least("_end", edge(F.col("_rank") + 1)))
    joined = cut.where("_a < _b").join(
        slots.select(F.col("source").alias("_s"), "rank", "slot"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_rank") == F.col("rank")))
    return joined.select(
        "_row", "doc_id", "source", "slot", (F.col("_a") - F.col("_begin")).alias("start"), (F.col("_b") - F.col("_a")).alias("length"),
        "lap", "words", F.col("_begin").alias("place"))


def repeated_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: whole documents as often as they are taken, in schedule order.

    A document stands in the slot that its first word falls into, so up to any slot a source is ahead by less than one
    document. The rows are sorted by slot, over partitions that follow each other. A source's last document may be
    taken in part; its text is then its first words, joined by single spaces.
    """
    rows, (own, text, source) = boxed(docs, id_col, text_col, source_col)
    stored = _stored(rows, own, text, True)
    found = _with_targets(_placed(stored, own, source), source, weights, share, max_repeats).withColumn("_laps", _laps(max_repeats))
    found = materialize(found, "mixed")
    targets = materialize(found.select(F.col(source).alias("source"), F.col("_target").alias("target")).distinct(), "mix-targets")
    slots = materialize(schedule(targets, block_words), "mix-slots")
    begun = pieces(found, slots, own, source).where("start = 0").select(F.col("_row").alias("_of"), "slot", "place", "words")
    met = stored.drop("_hash", "_tie").join(begun, F.col("_row") == F.col("_of"))
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, F.col("words").cast("int")), " ")
    cut = met.withColumn(text, F.when(F.col("words") < F.col("_size"), part).otherwise(F.col(text)))
    return unboxed(cut.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"), docs)
