"""Exact resolution of requested titles: directly, else through the alias table, else not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import text as X

# Bits of an identifier that are looked at together when the rows of one title are numbered.
KEY_BITS = 21
PAGE_ROWS = 20


def title_index(jd: DataFrame) -> DataFrame:
    """One row per distinct JD title with its number of JDs and its smallest id."""
    return jd.where(F.col("job_title").isNotNull()).groupBy("job_title").agg(
        F.count("*").alias("n_jds"), F.min("id").alias("first_jd_id")
    )


def title_lookup(jd: DataFrame, alias: DataFrame) -> DataFrame:
    """Everything a requested title can resolve to, one row per requested title.

    Direct titles come first; an alias counts only if its standard title has JDs and the alias is
    not itself a title. Of several standard titles of one alias the smallest counts. The (large) table of
    targets is then joined once, on one key.
    """
    titles = title_index(jd)
    direct = titles.select(
        F.col("job_title").alias("lookup_title"), F.col("job_title").alias("normalized_title"),
        F.lit("direct").alias("match_type"), "n_jds", "first_jd_id",
    )
    by_alias = (
        alias.where(F.col("alias_title").isNotNull()).join(titles, alias["standard_title"] == titles["job_title"])
        .groupBy("alias_title").agg(F.min(F.struct("standard_title", "n_jds", "first_jd_id")).alias("to"))
        .select(
            F.col("alias_title").alias("lookup_title"), F.col("to.standard_title").alias("normalized_title"),
            F.lit("alias").alias("match_type"), "to.n_jds", "to.first_jd_id",
        )
        .join(titles.select(F.col("job_title").alias("lookup_title")), "lookup_title", "left_anti")
    )
    return direct.unionByName(by_alias)


def alias_conflicts(alias: DataFrame) -> DataFrame:
    """Aliases that name several standard titles, with the one that counts and how many there are."""
    found = alias.where(F.col("standard_title").isNotNull()).groupBy("alias_title").agg(
        F.min("standard_title").alias("standard_title"), F.count_distinct("standard_title").alias("title_count"))
    return found.where(F.col("title_count") > 1)


def exact_match(targets: DataFrame, jd: DataFrame, alias: DataFrame) -> DataFrame:
    lookup = title_lookup(jd, alias)
    key = X.strip(F.col("requested_job_title"))
    return (
        targets.join(lookup, key == lookup["lookup_title"], "left")
        .drop("lookup_title")
        .withColumn("status", F.when(F.col("match_type").isNotNull(), "matched").otherwise("unresolved"))
        .withColumn("n_jds", F.coalesce("n_jds", F.lit(0)))
    )


def direct_matches(targets: DataFrame, jd: DataFrame) -> DataFrame:
    """Every (target, JD) pair with equal titles."""
    return targets.join(
        jd.select(F.col("id").alias("jd_id"), "job_title", "department"),
        X.strip(F.col("requested_job_title")) == F.col("job_title"),
    )


def alias_matches(targets: DataFrame, jd: DataFrame, alias: DataFrame) -> DataFrame:
    matched = exact_match(targets, jd, alias).where(F.col("match_type") == "alias")
    return matched.join(
        jd.select(F.col("id").alias("jd_id"), "job_title", "department"),
        F.col("normalized_title") == F.col("job_title"),
    )


def unresolved(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("status") == "unresolved")


def rank_in_group(rows: DataFrame, group: str, key: str, out: str, bits: int = KEY_BITS, levels: int = 3) -> DataFrame:
    """Number the rows of each group by a unique integer key, however large one group is.

    The key is read in pieces of ``bits`` bits, as a tree with at most 2**bits children per node. A rank
    is the sum of what stands before a row on each level, so every window holds the children of one
    node and no task sees a whole group; three levels of 21 bits cover all positive 64-bit keys.
    """
    def parent(c: Column) -> Column:
        return F.shiftright(c, bits)

    level = rows.groupBy(group, parent(F.col(key)).alias("_node")).agg(F.count("*").alias("_n"))
    offsets = None
    for depth in range(1, levels):
        up = parent(F.col("_node"))
        node = [group] if depth == levels - 1 else [group, "_up"]
        before = Window.partitionBy(*node).orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
        counted = level.withColumn("_up", up).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if offsets is None:
            offsets = counted.select(group, F.col("_node").alias("_leaf"), F.col("_up").alias("_next"), F.col("_before").alias("_offset"))
        else:
            step = counted.select(group, F.col("_node").alias("_next"), F.col("_up").alias("_after"), "_before")
            offsets = offsets.join(step, [group, "_next"]).select(
                group, "_leaf", F.col("_after").alias("_next"), (F.col("_offset") + F.col("_before")).alias("_offset")
            )
        level = level.withColumn("_up", up).groupBy(group, F.col("_up").alias("_node")).agg(F.sum("_n").alias("_n"))
    leaf = rows.withColumn("_leaf", parent(F.col(key)))
    inside = F.row_number().over(Window.partitionBy(group, "_leaf").orderBy(key))
    return (
        leaf.withColumn("_inside", inside).join(offsets.drop("_next"), [group, "_leaf"])
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_leaf", "_offset", "_inside")
    )


def exact_candidates(matches: DataFrame, jd: DataFrame) -> DataFrame:
    """All JDs of each matched target, ranked by JD id."""
    ranked = rank_in_group(
        jd.where(F.col("job_title").isNotNull()).select(F.col("id").alias("jd_id"), "job_title", "department"),
        "job_title", "jd_id", "candidate_rank",
    )
    return matches.where(F.col("status") == "matched").select(
        "resume_id", "target_id", "requested_job_title", "normalized_title", "match_type"
    ).join(ranked, F.col("normalized_title") == F.col("job_title")).drop("normalized_title")


def candidate_pages(jd: DataFrame, page_size: int = PAGE_ROWS) -> DataFrame:
    """The JDs of each title in pages of ``page_size`` by JD id: ``job_title, page, candidates``, pages counted from 0.

    Every JD is in one page of its title, so the table is as large as the JDs, however many targets ask for a title.
    """
    if page_size < 1:
        raise ValueError("a page has at least one row")
    ranked = rank_in_group(
        jd.where(F.col("job_title").isNotNull()).select(F.col("id").alias("jd_id"), "job_title", "department"),
        "job_title", "jd_id", "candidate_rank",
    )
    page = F.floor((F.col("candidate_rank") - 1) / page_size).cast("int")
    return ranked.groupBy("job_title", page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("candidate_rank", "jd_id", "department"))).alias("candidates"))


def candidate_page(matches: DataFrame, pages: DataFrame, page: int | Column = 0) -> DataFrame:
    """Each target with one page of its candidates; ``n_jds`` says how many there are in all.

    ``page`` is a number or, where targets ask for different pages, an expression over ``matches``. There is one row per target, with no
    candidates beyond the last page.
    """
    asked = matches.withColumn("_page", F.lit(page) if isinstance(page, int) else page)
    kept = pages.where(F.col("page") == page) if isinstance(page, int) else pages
    found = kept.select(F.col("job_title").alias("_title"), F.col("page").alias("_of"), "candidates")
    joined = asked.join(found, (F.col("normalized_title") == F.col("_title")) & (F.col("_page") == F.col("_of")), "left")
    none = F.array().cast(pages.schema["candidates"].dataType)
    return joined.withColumn("candidates", F.coalesce("candidates", none)).withColumnRenamed("_page", "page").drop("_title", "_of")


def listed_candidates(pairs: DataFrame, matches: DataFrame, jd: DataFrame) -> DataFrame:
    """Those (resume_id, target_id, jd_id) of ``pairs`` whose JD is an exact candidate of the target.

    The JD's own title is compared with the title the target resolved to, so the candidates of a
    popular title are never expanded.
    """
    asked = pairs.where(F.col("jd_id").isNotNull()).select(
        "resume_id", X.strip(F.col("target_id")).alias("target_id"), "jd_id"
    ).distinct()
    resolved = matches.where(F.col("status") == "matched").select("resume_id", "target_id", "normalized_title")
    titles = jd.select(F.col("id").alias("jd_id"), "job_title")
    return (
        asked.join(resolved, ["resume_id", "target_id"]).join(titles, "jd_id")
        .where(F.col("job_title") == F.col("normalized_title")).select("resume_id", "target_id", "jd_id")
    )


def lookup_by_titles(jd: DataFrame, titles: DataFrame, column: str = "job_title") -> DataFrame:
    """JDs whose title is in a (small or large) table of titles; blanks dropped, order by title, id."""
    wanted = titles.select(X.strip(F.col(column)).alias("job_title")).where(F.col("job_title") != "").distinct()
    return jd.join(wanted, "job_title", "left_semi").orderBy("job_title", "id")


def lookup_by_id(rows: DataFrame, key: str, value: int | Column) -> DataFrame:
    return rows.where(F.col(key) == value)


def lookup_ids_ordered(requests: DataFrame, jd: DataFrame) -> DataFrame:
    """For each request (``request_id``, ``ids``): the known ids once each, in the order of the list."""
    wanted = requests.select("request_id", F.posexplode(F.array_distinct("ids")).alias("pos", "id"))
    return wanted.join(jd, "id")
