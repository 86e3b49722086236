"""Term counts and source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from compare import difference
from talentweave.llm import divergence
from talentweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], SCHEMA)


def plain_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_audit(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = plain_terms(text)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def share(g, t):
            return 1 + 10**9 * (g[t] + 1) // (sum(g.values()) + len(kept))

        for s, g in groups.items():
            pair = [(-sum((share(g, t) - share(h, t)) ** 2 // share(h, t) for t in kept), o.encode(), o) for o, h in groups.items() if o != s]
            term = [(-((share(g, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t) for t in kept if g[t] and share(g, t) > share(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


WORDS = ["a", "Zug", "straße", "abcdefgh", "abcdefghi", "q" * 16, "q" * 17, "q" * 31 + "é", "w" * 200, "日本語", "ABCDEFGH", "ñ" * 8, "x" * 5000]


@pytest.mark.parametrize("slab, cells", [(1 << 24, 1 << 21), (300, 8)])
def test_audit_equals_plain_counting(spark, monkeypatch, slab, cells):
    rng = random.Random(slab)
    rows = [
        (rng.choice(["", None, " 12 ", *[rng.choice(["\n", " ", "-", "7"]).join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(8)]]),
         rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s2", "s2", "", None, "é"])) for _ in range(150)]
    rows += [("once only", "xx", "s1"), (None, "xx", "s2"), ("", "yy", "alone")] + [("same row", "en", "s1")] * 3
    monkeypatch.setattr(divergence, "SLAB_BYTES", slab)
    got = divergence.audit(frame(spark, rows).repartition(3), cells=cells).collect()
    assert {tuple(r) for r in got} == plain_audit(rows) and len(got) == len(set(got))
    assert {r.source for r in got if r.lang == "xx"} == {"s1", "s2"} and not [r for r in got if r.lang == "yy"]


def test_few_ranks_and_empty_tables(spark):
    rows = [(t, "en", s) for s, t in (("a", "one two"), ("b", "two three three"), ("c", "one three"))] * 2
    assert {tuple(r) for r in divergence.audit(frame(spark, rows), top_terms=1, min_documents=2).collect()} == plain_audit(rows, 2, 1)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_terms_don_t_join_across_texts_or_words():
    texts = pa.array(["ab", "cd", "", "Ef1gh", "", "h" * 9])
    found = {(int(g), t): (int(n), int(d)) for owner, terms, ns, ds in divergence._counted(texts, np.array([0, 0, 0, 1, 1, 1]))
             for g, t, n, d in zip(owner, terms, ns, ds)}
    assert found == {(0, b"ab"): (1, 1), (0, b"cd"): (1, 1), (1, b"ef"): (1, 1), (1, b"gh"): (1, 1), (1, b"h" * 9): (1, 1)}


def test_radix_order_is_stable():
    rng = np.random.default_rng(5)
    one, two = rng.integers(0, 1 << 62, 500, "uint64") % 7, rng.integers(0, 1 << 63, 500, "uint64") >> np.uint64(40)
    assert divergence.radix_order([one, two]).tolist() == sorted(range(500), key=lambda i: (one[i], two[i]))


def test_query_equals_sql(spark, con, tables):
    assert difference(spark, con, tables, QUERIES["op11_source_divergence"], ORACLES["op11_source_divergence"]) is None
