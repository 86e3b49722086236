"""Exact and near copies against brute force."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from xxhash import xxh64_intdigest

from talentweave.llm import content_sort, simhash
from talentweave.llm.components import components
from talentweave.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, _id string, kept string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", "y") for r in rows] if schema is SCHEMA else rows, schema)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id -> smallest id reachable over fingerprints at most two bits apart."""
    ids, root = sorted(prints), {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, "Ünï ünï ÜNÏ x"),
         (9, "w " * 30_000), (10, "w " * 30_001), (11, "a b c d e f g h"), (None, "a b c d e f g h")]


def test_content_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["t" * rng.randint(0, 40) + rng.choice("ab") for _ in range(40)] + ["same"] * 3
    rows = [(i, rng.choice(texts)) for i in range(600)] + [(1000 + i, "hot") for i in range(700)]
    rows += [(5000 + (i or 0), t) for i, t in EDGES] + [(None, "hot"), (None, "only without id")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for width in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = content_sort.content_groups(frame(spark, rows)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        by_hash = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_hash[r.text_sha256]
            keep = max((i for i in ids if i is not None), default=None)
            assert r.group_size == len(ids) and r.keep_id == keep
            assert not r.kept or r.doc_id == keep


def test_drop_copies_keeps_columns_and_one_row_of_ties(spark):
    docs = frame(spark, [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")])
    kept = content_sort.drop_copies(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "b"), (3, "a"), (5, "")]
    twice = frame(spark, [(1, "a")] * 5)
    assert content_sort.drop_copies(twice).count() == 1
    assert [r.kept for r in content_sort.content_groups(twice).collect()].count(True) == 1


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert content_sort.content_groups(empty).count() == 0
    assert content_sort.drop_copies(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i * 7 % 1000, " ".join(words)))
    rows += [(2000 + (i or 99), t) for i, t in EDGES]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    wanted = plain_components(prints)
    for bucket_rows in (1, 4, 64):
        got = simhash.near_groups(frame(spark, rows), bucket_rows=bucket_rows).collect()
        assert {r.doc_id: r._fp % (1 << 64) for r in got} == prints
        assert {r.doc_id: r._component for r in got} == wanted
        assert sum(r._kept for r in got) == len(set(wanted.values()))


def test_links_of_a_crowded_neighbourhood(spark):
    """Many fingerprints within few bits of each other: components stay exact by either way of pairing."""
    rng = random.Random(3)
    values = {0}
    while len(values) < 300:
        v = rng.choice(list(values))
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    prints = {s: s % (1 << 64) for (s,) in signed}
    wanted = plain_components(prints)
    table = spark.createDataFrame(signed, "fp bigint")
    for bucket_rows in (2, 1000):
        roots = {r.node: r.root for r in components(simhash.links(table, bucket_rows=bucket_rows), "a", "b").collect()}
        assert {f: roots.get(f, f) for (f,) in signed} == wanted


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "p q r s"), (None, "p q r s"), (7, "p q r s"), (7, "p q r s"), (None, "other words here now")]
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert sorted((r._component or -1, r._kept) for r in got) == [(-1, True), (7, False), (7, False), (7, False), (7, True)]


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_a_path_and_a_star(spark, n):
    path = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(n)], "a bigint, b bigint")
    nodes = {(i * 37) % 101 for i in range(n + 1)}
    assert {r.node: r.root for r in components(path, "a", "b").collect()} == {v: min(nodes) for v in nodes if v != min(nodes)}
    star = spark.createDataFrame([(500, i) for i in range(n)], "a bigint, b bigint")
    assert {r.root for r in components(star, "a", "b").collect()} == {0}


def test_registered_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    got = QUERIES["op1_simhash_components"](spark, tables).collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


def test_other_columns_keep_their_names_and_values(spark):
    names = ["fp", "first", "_head", "root", "node", "_row", "_fp", "key", "c0"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d", "a b c d", None, "x y z"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    found = simhash.near_groups(docs)
    assert found.columns == ["doc_id", "text", *[n for n in names if n != "_fp"], "_fp", "_component", "_kept"]
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i][n] == f"{n}{i}" for i in range(4) for n in names if n != "_fp") and [got[i]._component for i in range(4)] == [0, 0, 2, 3]
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(docs).count() == 3
