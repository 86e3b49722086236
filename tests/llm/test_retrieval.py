"""Ball-tree search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import difference
from talentweave.llm import retrieval
from talentweave.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, n string, terms string, query string, score string"


def plain_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_ranked(docs, items, top=20):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    total, words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    in_docs = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            score = 0
            m = 75 + (25 * sum(bag.values()) * total) // max(1, words)
            for t in plain_terms(text):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * in_docs[t] + 1)))
                score += w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            found += [(-score, i is None, i)] if score else []
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É1", "日本", "x-y", "Zug"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([1, 5, 40, 200])))) for i in range(n)]
    rows += [(1000 + i, "w3 w3 W40, w50!") for i in range(60)]  # ties
    return rows + [(None, "w3 w50"), (None, None), (7, rows[7][1]), (5000, None), (5001, " .,- "), (5002, "w9 " * 4000)]


ITEMS = [(0, "w3 W3 w50 É1"), (1, "w40, w40 w41; 日本"), (1, "w59"), (2, None), (3, ""), (4, "unknown words"), (None, "w0 w1 w2 w3 w4 w5 w6"), (0, "w3 W3 w50 É1")]


@pytest.mark.parametrize("leaf, slab, block", [(32, 4096, 10_000), (2, 64, 3)])
def test_ranks_equal_scoring_everything(spark, monkeypatch, leaf, slab, block):
    monkeypatch.setattr(retrieval, "LEAF_ROWS", leaf)
    monkeypatch.setattr(retrieval, "SLAB_ROWS", slab)
    rows = corpus(leaf)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)
    items = spark.createDataFrame([(*r, "a") for r in ITEMS], "item_id bigint, text string, query string")
    got = [tuple(r) for r in retrieval.ranked(docs, items, block_queries=block).collect()]
    assert sorted(got, key=str) == plain_ranked(rows, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a"), (2, "c")], "item_id bigint, text string")
    assert retrieval.ranked(docs.limit(0), items).count() == 0 and retrieval.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in retrieval.ranked(docs, items).collect()] == plain_ranked([(1, "a b")], [(1, "a"), (2, "c")])


def tree_of(rng, rows, terms, clusters):
    base = [rng.choice(terms, 12, replace=False) for _ in range(clusters)]
    index, value, ends = [], [], [0]
    for _ in range(rows):
        here = np.unique(np.concatenate([base[rng.integers(clusters)], rng.choice(terms, 2)]))
        index.append(here)
        value.append(rng.integers(1, 10**6, len(here)) if clusters > 20 else 500_000 + rng.integers(0, 10, len(here)))
        ends.append(ends[-1] + len(here))
    return retrieval.BallTree(np.concatenate(index), np.concatenate(value), np.array(ends), rng.integers(1, 14_000, terms), 8)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    for clusters in (4, 200):
        tree = tree_of(rng, 600, 300, clusters)
        assert sorted(tree.rows.tolist()) == list(range(600)) and all(h - a <= 8 for (a, h), c in zip(tree.spans, tree.children) if not c)
        visited = 0
        for _ in range(30):
            terms = np.sort(rng.choice(300, 10, replace=False))
            repeats = rng.integers(1, 4, 10)
            query = np.zeros(300, "int64")
            query[terms] = repeats * tree.weight[terms].astype("int64")
            dense = np.zeros((600, 300), "int64")
            for k, row in enumerate(tree.rows):
                dense[row, tree.index[tree.ends[k]:tree.ends[k + 1]]] = tree.value[tree.ends[k]:tree.ends[k + 1]]
            scores = dense @ query
            for (low, high), bound in zip(tree.spans, tree.bounds(terms, repeats.astype("float64"))):
                assert scores[tree.rows[low:high]].max() <= bound
            best = []
            visited += tree.search(terms, repeats, list(range(600)), best, 5)
            assert best == sorted((-int(s), False, i) for i, s in enumerate(scores) if s)[:5]
        assert visited < 30 * 600 * (0.6 if clusters == 4 else 1.01)


def test_query_equals_sql(spark, con, tables):
    assert difference(spark, con, tables, QUERIES["op12_ball_tree_search"], ORACLES["op12_ball_tree_search"]) is None
