"""Near copies by five-word shingles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentweave.llm import near_copies

SCHEMA = "doc_id bigint, text string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def kept(found):
    return sorted(r.doc_id for r in found.collect())


def plain_kept(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k:k + 5]) for k in range(len(w) - 4)} or {b" ".join(w)}
    ids, root = sorted(sets), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted({top(i) for i in ids})


def test_stage_links_from_similarity_0_8_on(spark):
    words = [f"w{i}" for i in range(94)]  # 90 shingles
    at = words[:84] + [f"x{i}" for i in range(10)]  # 80 of 100 in common
    below = words[11:] + [f"y{i}" for i in range(11)]  # 79 of 101
    docs = frame(spark, [(3, " ".join(words)), (7, " ".join(at)), (5, " ".join(below)), (9, "\n".join(words).upper())])
    assert kept(corpus_pipeline.without_near_copies(spark, docs, "")) == [3, 5]


def test_simhash_fingerprints_link_by_pivot_tables_and_are_verified(spark, monkeypatch):
    """Without any band, op1's step alone links texts within two bits, but only at a similarity of 0.8."""
    words = [f"w{i}" for i in range(40_000)]
    near = [*words[:-1], "other"]
    rows = [(3, " ".join(words)), (7, " ".join(near)), (5, " ".join(reversed(words))), (8, "a a a a a a a b"), (9, "a a a a a a a c")]
    prints = [near_copies.simhash._fingerprint(t.encode(), 5) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    monkeypatch.setattr(near_copies, "met_classes", lambda prints: prints.select(F.lit(1).cast("long").alias("key"), F.lit(1).cast("long").alias("n"), "node").limit(0))
    assert kept(near_copies.one_of_each(frame(spark, rows))) == [3, 5, 8, 9]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("bucket_rows, block", [(1, 16), (4, 1000), (8, 1024), (1000, 5)])
def test_groups_equal_brute_force(spark, bucket_rows, block):
    rng = random.Random(bucket_rows)
    passage = [f"p{i}" for i in range(40)]  # in all texts of one base
    base = [[f"{b}v{i}" for i in range(rng.randint(4, 160))] + passage * (b % 3 == 0) for b in range(30)]
    rows = [(i, edited(rng, base[i % 30], rng.choice([0, 1, 1, 2, 4]))) for i in range(240)]
    assert kept(near_copies.one_of_each(frame(spark, rows), bucket_rows=bucket_rows, block=block)) == plain_kept(rows)


def test_links_among_many_texts_of_one_template(spark):
    """Texts of one template that are mostly just below the similarity share all bands, and few of them are linked."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, edited(rng, template, 4)) for i in range(900)]
    rows += [(1000 + i, " ".join([f"u{k}" for k in range(200)] + [f"x{i}w{k}" for k in range(4 * i)])) for i in range(40)]  # ever longer ones
    wanted = plain_kept(rows)
    assert len(rows) // 2 < len(wanted) < len(rows) - 30
    assert kept(near_copies.one_of_each(frame(spark, rows))) == wanted
    assert kept(near_copies.one_of_each(frame(spark, rows).repartition(5), block=64)) == wanted


def test_fingerprints_tell_all_near_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6, 30, 200, 3000, 20_000):
        common = rng.integers(0, 1 << 63, n, "uint64") * np.uint64(2)
        for _ in range(60):
            extra = rng.integers(0, 1 << 63, n // 4 * 2, "uint64") * np.uint64(2) + np.uint64(1)  # a similarity of 0.8 at least, half of them each
            one, two = (np.unique(np.concatenate([common, extra[k::2][:n // 8]])) for k in (0, 1))
            share, near = near_copies.similar(
                near_copies.fingerprint(near_copies.short(one))[None], np.array([len(one)]),
                near_copies.fingerprint(near_copies.short(two))[None], np.array([len(two)]))
            assert near[0]
    assert not near_copies.fingerprint(np.array([], "uint32")).any()


def test_intersections_by_products(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype("uint32") for _ in range(n)] for n in (9, 14)]
    wanted = [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]
    assert near_copies.common(*sides).tolist() == wanted
    assert near_copies.common([], sides[1]).shape == (0, 14) and near_copies.common(sides[0], []).shape == (9, 0)


@pytest.mark.parametrize("small", [0, 60])
def test_large_sets_compare_fingerprints(spark, monkeypatch, small):
    """With all sets, or some of them, above the size that goes whole into blocks, groups are the same."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = random.Random(2)
    base = [[f"{b}v{i}" for i in range(62 + b)] for b in range(4)]
    rows = [(i, edited(rng, base[i % 4], rng.choice([0, 1, 2]))) for i in range(120)]
    assert kept(near_copies.one_of_each(frame(spark, rows), bucket_rows=4, block=20)) == plain_kept(rows)


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9])), (3, "w0 " * 300_000), (4, " ".join(words[:200_000]))]
    assert kept(near_copies.one_of_each(frame(spark, rows))) == [1, 3, 4]


def test_nulls_repeated_rows_and_short_texts(spark):
    rows = [(None, "p q"), (4, "p q"), (4, "P  q"), (6, "q p"), (8, None), (9, " \n"), (None, "only one without an id")]
    found = near_copies.one_of_each(frame(spark, rows))
    assert found.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id or -1) for r in found.collect()) == [-1, 4, 6, 8]
    assert near_copies.one_of_each(frame(spark, rows).limit(0)).count() == 0
