"""Quality rules, and robust multivariate outliers among text statistics.

Every text gets counts over its whole length; two plain rules reject the worst texts. For the others, five
statistics are transformed so that their spread hardly depends on the length of a text. Per language and source,
a minimum-covariance-determinant estimate gives their typical values and how they vary together: starting from
medians, concentration steps keep the ``CORE`` share of rows that lie closest and estimate mean and covariance anew from these, so
up to a quarter of bad texts has no say. Texts whose squared Mahalanobis distance exceeds ``CUTOFF`` are rejected.

Groups with fewer than ``MIN_ROWS`` texts are estimated together with the other small groups of their language, and
where these are still few, with those of all languages. To each variance a floor is added, the square of a
deviation that is harmless in any text, so that statistics that are zero for nearly all texts don't make any other value an outlier.

A group is only ever aggregated. Estimates are one row per group; up to ``BROADCAST_GROUPS`` of them, counted first, are
broadcast, and more are joined in ``SALTS`` parts per group, so that one group may hold most rows either way. Quantiles are exact over values on a fixed grid, so their state is bounded and reruns
agree; estimates are one row per group. NULL texts have no words. NULL languages and sources are groups of
their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.llm.columns import SPACE
from talentweave.plans.storage import materialize

WINDOW = 8  # words; a power of two
CORE = 0.75
STEPS = 4
MIN_ROWS = 200
BROADCAST_GROUPS = 50_000  # estimates; about 10 MB
SALTS = 32  # parts in which the rows of a group are joined with its estimate beyond that
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Chi-squared with five degrees of freedom: the quantile at 1 - 1e-4, and the factor by which the covariance of the
#: closest 75 % of normal rows falls short.
CUTOFF = 25.745
CONSISTENCY = 1.412
PRIOR_WORDS = 40  # words of typical text that short texts are filled up with
#: Statistics and their floors, in units of the transformed values.
FLOORS = {"word_length": 0.08, "symbols": 0.08, "same_lines": 0.15, "repeats": 0.12, "capitals": 0.08}
VECTOR = list(FLOORS)
P = len(VECTOR)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more, the first occurrence included.

    Hashes of windows are built by doubling (1, 2, 4, 8 words). Only if some are equal are they sorted with their
    positions; a word counts once, however many windows cover it.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(hashes: Column, step: int) -> Column:
        if step == WINDOW:
            return F.slice(hashes, 1, F.greatest(F.lit(0), F.size(hashes) - (WINDOW - 1)))
        return bound(doubled(hashes, step), lambda h: windows(h, 2 * step))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def repeats(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bound(placed, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])))
        return bound(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def counted(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(repeats(found))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(bound(hashes, lambda h: windows(h, 1)), counted)


def text_statistics(text: Column) -> Column:
    """A struct of counts over the whole text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        size = F.size(lines)
        return F.struct(size.cast("long").alias("n_lines"), (size - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    whole = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        bound(F.array_remove(F.split(whole, SPACE), ""), of_words).alias("words"), bound(with_word, of_lines).alias("lines"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(whole, F.lit("[A-Z]")).cast("long").alias("n_capitals"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, ``base_failed`` and the statistics vector of every row, written to the shared folder."""
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_statistics(F.col(text_col)).alias("s"))
    flat = found.select("doc_id", "lang", "source", "s.words.*", "s.lines.*", "s.n_symbols", "s.n_capitals")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n, filled = F.col("n_words"), F.col("n_words") + PRIOR_WORDS
    vector = {
        "word_length": F.log((F.col("word_chars") + 6.0 * PRIOR_WORDS) / filled),
        "symbols": F.sqrt(F.col("n_symbols") / filled),
        "same_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4)),
        "repeats": F.sqrt(F.col("n_repeat_words") / filled),
        "capitals": F.sqrt(F.col("n_capitals") / (F.col("word_chars") + 6.0 * PRIOR_WORDS)),
    }
    made = flat.withColumns({"base_failed": failed, **{k: F.round(v, 6) for k, v in vector.items()}})
    return materialize(made, "text-statistics")


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """``rows`` with ``grp``: the group that its estimate comes from."""
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("own"))
    small = F.when(F.col("own") < min_rows, F.col("own")).otherwise(0)
    by_lang = sizes.groupBy("lang").agg(F.sum(small).alias("shared"))
    levels = sizes.join(by_lang.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l"))).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        F.when(F.col("own") >= min_rows, name)
        .when(F.col("shared") >= min_rows, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).otherwise(F.lit("all")).alias("grp"))
    joined = rows.join(levels, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.drop("_lang", "_source")


def _met(rows: DataFrame, estimates: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows (with ``salt``) next to the one row of their group, which is broadcast or listed once for each part."""
    own = estimates.withColumnRenamed("grp", "_grp")
    if few:
        return rows.join(F.broadcast(own), F.col("grp") == F.col("_grp"), how).drop("_grp")
    listed = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(listed, (F.col("grp") == F.col("_grp")) & (F.col("salt") == F.col("_salt")), how).drop("_grp", "_salt")


def _start(rows: DataFrame, few: bool) -> DataFrame:
    """Per group: medians, and a diagonal matrix of median deviations."""
    cells = rows.select("grp", "salt", *[F.round(v, 3).alias(v) for v in VECTOR])
    middle = materialize(cells.groupBy("grp").agg(*[F.percentile(v, 0.5).alias(f"m{i}") for i, v in enumerate(VECTOR)]), "medians")
    apart = _met(cells, middle, few).groupBy("grp").agg(*[
        F.percentile(F.round(F.abs(F.col(v) - F.col(f"m{i}")), 3), 0.5).alias(f"d{i}") for i, v in enumerate(VECTOR)])
    square = {
        f"s{i}_{j}": F.pow(1.4826 * F.col(f"d{i}"), 2) + floor**2 if i == j else F.lit(0.0)
        for i, floor in enumerate(FLOORS.values()) for j in range(i + 1)}
    return _inverted(middle.join(apart, "grp").withColumns(square))


def _inverted(estimates: DataFrame) -> DataFrame:
    """From m0.. and the lower half of a covariance s0_0.. to ``grp, m0.., w0_0..``: the inverse of its Cholesky factor."""
    frame = estimates
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"s{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            frame = frame.withColumn(f"l{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}_{j}"))
    for j in range(P):
        for i in range(j, P):
            inside = F.lit(1.0) if i == j else -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0))
            frame = frame.withColumn(f"w{i}_{j}", inside / F.col(f"l{i}_{i}"))
    return materialize(frame.select("grp", *[f"m{i}" for i in range(P)], *[f"w{i}_{j}" for i in range(P) for j in range(i + 1)]), "estimates")


def _measured(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """``rows`` with ``distance``, the squared Mahalanobis distance from their group."""
    lines = [
        F.pow(sum(((F.col(v) - F.col(f"m{j}")) * F.col(f"w{i}_{j}") for j, v in enumerate(VECTOR[:i + 1])), F.lit(0.0)), 2)
        for i in range(P)]
    kept = [F.col(c) for c in rows.columns]
    return _met(rows, estimates, few, "left").select(*kept, sum(lines, F.lit(0.0)).alias("distance"))


def _concentrated(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """One concentration step."""
    near = _measured(rows, estimates, few).withColumn("cell", F.round(F.log(F.col("distance") + 1e-6), 2))
    edges = materialize(near.groupBy("grp").agg(F.percentile("cell", CORE).alias("edge")), "core-edges")
    core = _met(near, edges, few).where("cell <= edge")
    moments = core.groupBy("grp").agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)],
        *[F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1)])
    floors = [f**2 for f in FLOORS.values()]
    square = {
        f"s{i}_{j}": CONSISTENCY * F.col(f"c{i}_{j}") + (floors[i] if i == j else 0.0) for i in range(P) for j in range(i + 1)}
    return _inverted(moments.withColumns(square))


def judged(
    rows: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS, cutoff: float = CUTOFF, broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Rows of ``counted`` with ``distance`` and ``kept``."""
    placed = _grouped(rows, min_rows).withColumn("salt", F.pmod(F.xxhash64("doc_id", *VECTOR), F.lit(SALTS)).cast("int"))
    sound = materialize(placed.where("NOT base_failed").select("grp", "salt", *VECTOR), "sound-rows")
    few = sound.select("grp").distinct().count() <= broadcast_groups
    estimates = _start(sound, few)
    for _ in range(steps):
        estimates = _concentrated(sound, estimates, few)
    return _measured(placed, estimates, few).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
