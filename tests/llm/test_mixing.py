"""Mixing: targets, totals per source, the schedule and its pieces."""

import random
from collections import defaultdict

import pytest

from talentweave.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, _size string, slot string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in data], SCHEMA)


def plain_targets(sizes, share=1.5, most=2.0):
    """Share by weight; stop at the cap; share the excess anew until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def random_docs(seed):
    rng = random.Random(seed)
    data = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(400)]
    return data + [(1000, None, "a"), (1001, "", "empty"), (1002, "one two", "tiny"), (None, "a b c", "a"), (5, "again x y", "a"), (5, "again x y", "a"),
                   (1003, "w\t" * 5000, "long")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed):
    data = random_docs(seed)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    targets = plain_targets(sizes)
    found = mixing.mixed(rows(spark, data))
    got = found.collect()
    assert len(got) == len(data)
    taken = defaultdict(int)
    for r in got:
        words = [lap.words for lap in r._laps]
        assert r._size == len((r.text or "").split()) and r._source_size == sizes[r.source]
        assert abs(r._target - targets[r.source]) < 1e-6 and all(0 <= w <= r._size for w in words)
        taken[r.source] += sum(words)
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)


@pytest.mark.parametrize("block_words", [7, 1024, 10**9])
def test_pieces_cover_what_is_taken(spark, block_words):
    found = mixing.mixed(rows(spark, random_docs(3)))
    targets = found.select("source", mixing.F.col("_target").alias("target")).distinct()
    slots = mixing.schedule(targets, block_words)
    plan = slots.collect()
    by_source = defaultdict(list)
    for r in plan:
        by_source[r.source].append((r.slot, r.rank))
    assert all([k for _, k in sorted(v)] == list(range(len(v))) for v in by_source.values())
    assert len({r.slot for r in plan}) == len(plan)
    per_row, per_slot, of_slot = defaultdict(int), defaultdict(int), {r.slot: r for r in plan}
    for r in mixing.pieces(found, slots).collect():
        assert r.length > 0 and r.source == of_slot[r.slot].source
        per_row[r._row] += r.length
        per_slot[r.slot] += r.length
    total = {r.source: round(r.target) for r in targets.collect()}
    for r in found.collect():
        assert per_row[r._row] == sum(lap.words for lap in r._laps)
    for slot, words in per_slot.items():
        r = of_slot[slot]
        assert abs(words - total[r.source] / r.n_slots) <= 1


def test_schedule_is_spread_evenly(spark):
    targets = spark.createDataFrame([("a", 300000.0), ("b", 100000.0), ("c", 200000.0), ("d", 1.0), ("e", 0.0)], "source string, target double")
    plan = sorted((r.slot, r.source) for r in mixing.schedule(targets, 1000).collect())
    order = [s for _, s in plan]
    assert set(order) == {"a", "b", "c", "d"} and len(order) == 602
    for name, part in (("a", 0.5), ("b", 1 / 6), ("c", 1 / 3)):
        seen = 0
        for i, s in enumerate(order[:600], 1):
            seen += s == name
            assert abs(seen - part * i) < 8


def test_reruns_agree(spark):
    data = random_docs(4)
    first = {(r.doc_id, r.text): r._laps for r in mixing.mixed(rows(spark, data)).collect()}
    random.Random(0).shuffle(data)
    again = {(r.doc_id, r.text): r._laps for r in mixing.mixed(rows(spark, data).repartition(5)).collect()}
    assert first == again


def test_repeated_rows_and_empty_table(spark):
    docs = rows(spark, random_docs(5))
    out = mixing.repeated_rows(docs)
    assert out.schema == docs.schema
    wanted = sum(lap.words for r in mixing.mixed(docs).collect() for lap in r._laps)
    assert sum(len(r.text.split()) for r in out.collect()) == wanted
    assert mixing.repeated_rows(rows(spark, [])).count() == 0
    assert mixing.mixed(rows(spark, [(1, None, "a"), (2, " ", None)])).count() == 2


def test_other_columns_keep_their_names_and_values(spark):
    names = ["_of", "_hash", "_tie", "_bucket", "_base", "_local", "slot", "c0", "_at"]
    data = [(i, "w " * (i + 1), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for keep in (True, False):
        found = mixing.mixed(docs, keep_text=keep)
        kept = [n for n in names if n != "_at"] * keep
        assert found.columns == ["doc_id", *["text"] * keep, "source", *kept, "_row", "_size", "_at", "_source_size", "_target", "_laps"]
        got = {r.doc_id: r for r in found.collect()}
        assert all(got[i][n] == f"{n}{i}" for i in range(12) for n in kept) and all(got[i]._size == i + 1 for i in range(12))
