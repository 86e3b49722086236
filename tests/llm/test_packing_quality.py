"""Packing round trips, and the factorisation machine on held-out documents."""

import random
import tracemalloc
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentweave.llm import packing, quality, words
from talentweave.llm.columns import id_remainder
from talentweave.llm.queries import QUERIES, vocabulary
from talentweave.llm.words import gathered, numbered, slices, subwords

ODD = [
    None, "", " \n\t", "one", "It's  they'll x1234y  #!?", "naïve café über ÉÀ ﬁ Ⅷ", "a b c　d é ́x", "x\x1cy\x85z",
    "😀 family 👨‍👩‍👧", "日本語 テキスト", "<|endoftext|> a<|startoftext|>b", "w" * 5000, "The quick. " * 4000, "İstanbul ΑΣ ΣΑΣ",
]

POOL = pa.proxy_memory_pool(pa.default_memory_pool())  # outlives what is taken from it


def plain_ids(texts):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_subwords_of_words_equal_subwords_of_texts(spark, tables):
    texts = ODD + [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").limit(100).collect()]
    for part in (pa.array(texts), pa.array(texts).slice(3, 9), pa.array([None, ""])):
        ends, word, different = numbered(part, lower=False)
        ids, after = gathered(*subwords(different, vocabulary("word_bpe_49k.json")), word)
        got = [ids[after[a]:after[b]].tolist() for a, b in zip(ends, ends[1:])]
        assert got == [x[:-1] for x in plain_ids(part.to_pylist())]
    assert sum(len(s) for s in slices(pa.array(texts))) == len(texts)


def test_words_keep_the_order_of_their_first_appearance(monkeypatch):
    texts = pa.array([*ODD, *(f"w{i % 50} Same  again, {i}!" for i in range(300)), None, *ODD])
    whole = [*numbered(texts, lower=True), *subwords(numbered(texts, lower=True)[2], vocabulary("word_bpe_49k.json"))]
    for name, size in (("SPLIT_BYTES", 64), ("STEP_WORDS", 7), ("STEP_IDS", 5)):
        monkeypatch.setattr(words, name, size)
    ends, word, different = numbered(texts, lower=True)
    ids, starts = subwords(different, vocabulary("word_bpe_49k.json"))
    for a, b in zip(whole, (ends, word, different, ids, starts)):
        assert (a.equals(b) if isinstance(a, pa.Array) else a.dtype == b.dtype and (a == b).all())
    text = [(x or "").lower() if (x or "").isascii() else x for x in texts.to_pylist()]
    for i in (2, 3, 20, 100):
        assert different.take(pa.array(word[ends[i]:ends[i + 1]])).to_pylist() == text[i].split()


def test_splitting_and_tokenising_hold_little_beside_word_numbers():
    """Arrow's and numpy's memory, above what is returned, for 16 MB of text and 20,000 different words."""
    texts = pa.array([" ".join(f"w{(i * 977 + j * 31) % 20_000}" for j in range(500)) for i in range(5000)])
    before = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        ends, word, different = numbered(texts, lower=True)
    finally:
        pa.set_memory_pool(before)
    assert len(word) == 2_500_000 and len(different) == 20_000
    assert POOL.max_memory() < 40 << 20
    starts = np.arange(len(different) + 1)
    tracemalloc.start()
    try:
        ids, _ = gathered(np.arange(len(different), dtype="uint32"), starts, word)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (ids == word).all()
    assert peak < 56 << 20


def test_pieces_join_to_the_documents(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "Gamma.", "δ"]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += ["copy of a row"] * 2
    data = [(None if i == 7 else i // 2 if i > 160 else i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, block int").repartition(5)
    rows = packing.packed(docs, vocabulary("word_bpe_49k.json"), width=64, keep_ids=True).collect()
    wanted = sorted((i is None, i or 0, tuple(x)) for (i, _, _), x in zip(data, plain_ids(texts)))
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    place, docs_found, open_doc = 0, [], None
    for r in by_place:
        assert r.sequence_id * 64 + r.offset == place and 0 < r.length <= 64 - r.offset
        place += r.length
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and crc32(r.ids) == r.ids_crc32 and r.begins == (r.start == 0)
        open_doc = list(ids) if r.begins else open_doc + list(ids)
        if r.ends:
            assert len(open_doc) == r.doc_tokens
            docs_found.append((r.doc_id is None, r.doc_id or 0, tuple(open_doc)))
    assert sorted(docs_found) == wanted
    assert packing.packed(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_query_covers_all_tokens(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    wanted = dict(zip(docs, plain_ids(docs.values())))
    rows = QUERIES["op9_concatenate_and_cut"](spark, tables).collect()
    assert sum(r.length for r in rows) == sum(map(len, wanted.values()))
    for r in rows:
        ids = wanted[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 for s, n in full.items() if s != max(full))


def test_linear_time_form_equals_all_pairs():
    machine = quality.FactorisationMachine(slots=50, rank=3)
    machine.weight[:] = np.random.default_rng(1).normal(size=50)
    index, value = np.array([3, 7, 20, 49]), np.array([0.5, -1.0, 2.0, 0.1], dtype="float32")
    pairs = sum(
        float(machine.vectors[index[i]] @ machine.vectors[index[j]]) * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    wanted = machine.bias + float(machine.weight[index] @ value) + pairs
    assert abs(machine.raw(index, value) - wanted) < 1e-5


def test_scores_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op10_factorisation_machine"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_quality_of_odd_rows(spark):
    texts = ODD + ["x | " * 50, "AAA !!" * 30]
    docs = spark.createDataFrame(
        [(None if i == 2 else i, t, None if i % 3 else i, "s", "c") for i, t in enumerate(texts)],
        "doc_id bigint, text string, n_chars bigint, _score string, _text string")
    labels = spark.createDataFrame([(0, 1), (1, None), (3, 0), (3, 1), (None, 1), (99, 0), (12, 1)], "doc_id bigint, quality int")
    anything = id_remainder("doc_id", 5) >= 0
    for given in (labels, labels.limit(0)):
        machine = quality.fitted(docs, given, anything)
        scores = [r._score for r in quality.scored(docs, machine).collect()]
        assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores)
    assert set(scores) == {0.5}
    kept = quality.accepted(docs, machine)
    assert kept.schema == docs.schema and kept.count() == len(texts)
    assert quality.accepted(docs.limit(0), machine).count() == 0
    assert quality.scored(docs.drop("n_chars"), machine).count() == len(texts)


def test_repeated_ids_leave_one_row_each(spark, monkeypatch):
    sizes = []
    fit = quality.FactorisationMachine.fit
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, rows, labels: (sizes.append(len(rows)), fit(self, rows, labels)))
    docs = spark.createDataFrame([(5 if i % 3 else i, f"text {i} of words", i) for i in range(300)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    quality.fitted(docs, labels, id_remainder("doc_id", 1) == 0, max_rows=200)
    kept = [i for i in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(200).toPandas()["doc_id"] if i == 5 or i % 3 == 0]
    assert sizes == [len(kept)]
