"""The corpus pipeline against brute force, stage by stage."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from talentweave.llm import mixing, quality
from talentweave.llm.columns import id_remainder, table
from talentweave.llm.queries import QUERIES, vocabulary
from test_near_copies import plain_kept


def test_entry_has_all_corpus_queries():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def stored(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages(spark, tables, tmp_path):
    docs = table(spark, tables, "documents")
    names, out = docs.columns, docs
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, out, tables), tmp_path / str(k))
        assert k == 4 or out.columns == names
        results.append([r.asDict() for r in out.collect()])
    rows = [r.asDict() for r in docs.collect()]

    machine = quality.fitted(docs, table(spark, tables, "labels"), id_remainder("doc_id", 5) != 0)
    good = {r["doc_id"] for r in rows if machine.score(*quality.features((r["text"] or "").encode(), r["n_chars"])) >= 0.3}
    assert {r["doc_id"] for r in results[0]} == good and len(results[0]) == len(good)

    largest = {}
    for r in results[0]:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert {r["doc_id"] for r in results[1]} == set(largest.values()) and len(results[1]) == len(largest)

    assert sorted(r["doc_id"] for r in results[2]) == plain_kept([(r["doc_id"], r["text"]) for r in results[1]])
    original = {r["doc_id"]: r for r in rows}
    assert all(r == original[r["doc_id"]] for r in results[2])

    kept = spark.read.parquet(str(tmp_path / "2"))
    taken = {r.doc_id: [lap.words for lap in r._laps if lap.words] for r in mixing.mixed(kept).collect()}
    got = {}
    for r in results[3]:
        got.setdefault(r["doc_id"], []).append(len(r["text"].split()))
    assert {i: sorted(w) for i, w in got.items()} == {i: sorted(w) for i, w in taken.items() if w}

    coder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    wanted = Counter(tuple([*coder.encode(r["text"], add_special_tokens=False).ids, 2]) for r in results[3])
    found, open_doc = Counter(), []
    for r in sorted(results[4], key=lambda r: (r["sequence_id"], r["offset"])):
        open_doc += np.frombuffer(r["ids"], "<u4").tolist()
        if r["ends"]:
            found[tuple(open_doc)] += 1
            open_doc = []
    assert found == wanted


def test_run_gives_the_packed_rows(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    full = rows.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] == 4096 for r in full if r[0] != max(x[0] for x in full))


def test_empty_documents(spark, tables):
    docs = table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0
