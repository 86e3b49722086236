import itertools
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.config import QueryConfig, RecallConfig, RerankConfig, RetryConfig
from talentweave.functions import pointers
from talentweave.functions import text as X
from talentweave.functions import vectors as V
from talentweave.functions.scorers import JaccardScorer, ModelScorer, NgramEmbedder, embed_texts, hashed_ngrams
from talentweave.operators import intents
from talentweave.sources import intake


def column(spark, expr, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


SPACED = ["　a \t\n b ", "  ", None, "x", "\x1fy  z\x85"]


def test_white_space_follows_unicode(spark):
    assert column(spark, X.collapse_ws, SPACED) == ["a b", "", None, "x", "y z"]
    assert column(spark, X.clean_optional, SPACED) == ["a \t\n b", None, None, "x", "y  z"]
    assert column(spark, X.strip, SPACED) == [None if s is None else s.strip() for s in SPACED]


def test_lists_keep_first_occurrences(spark):
    values = [[" b", "a", "b ", None, "", "　", "a  c", "a c"], [], None]
    assert column(spark, X.clean_list, values, "array<string>") == [["b", "a", "a c"], [], []]
    assert column(spark, lambda c: X.clean_list(c, collapse=False), values, "array<string>")[0] == ["b", "a", "a  c", "a c"]


def test_truncate_counts_code_points(spark):
    values = ["😀" * 5, "ab  cd", " abc "]
    assert column(spark, lambda c: X.truncate(c, 4), values) == ["😀" * 4, "ab", "abc"]


def test_numbers(spark):
    assert column(spark, X.retry_after, ["3", "-1", "inf", "nan", "soon", None, " 2.5"]) == [3.0, None, None, None, None, None, 2.5]
    assert column(spark, X.optional_int, ["7", " 8 ", "x", None]) == [7, 8, None, None]
    assert column(spark, X.http_retryable, [200, 404, 408, 409, 429, 500, 503], "int") == [False, False, True, True, True, True, True]
    delays = column(spark, lambda c: X.backoff(c, F.lit(None)), [0, 1, 2, 5, 9], "int")
    assert delays == [1.0, 2.0, 4.0, 30.0, 30.0]
    assert column(spark, lambda c: X.backoff(c, F.lit(99.0)), [1], "int") == [99.0]


def test_strip_fence(spark):
    values = ["```json\n{}\n```", "```{}```", "{}", " ``` ", "a```b"]
    assert column(spark, X.strip_fence, values) == ["{}", "{}", "{}", "", "a```b"]


@pytest.mark.parametrize("title,titles,multi", [
    (None, [], False), ("　 ", [], False), ("A、", ["A、"], False), ("A、A", ["A"], True), ("A|B；C", ["A", "B", "C"], True),
    ("Java/C++开发工程师", ["Java/C++开发工程师"], False), ("项目经理/实施工程师", ["项目经理", "实施工程师"], True),
    ("项目经理／项目经理", ["项目经理"], True), (" a  b ", ["a b"], False), ("/", ["/"], False),
])
def test_intents(spark, title, titles, multi):
    rows = spark.createDataFrame([(1, title)], "resume_id long, target_job_title string")
    got = intents.normalize_intents(rows).first()
    assert (got.job_titles, got.is_multi_intent) == (titles, multi)


def test_json_text_is_one_value(spark):
    values = ['{"k":1}', '{"k":1}}', '{"k":1}]', '{"k":1},{"k":2}', '{"k":1},', '{"k":1} x', "[1]", "null", "3", '{"k":', "", None,
              '{"k":1}],[', '{"k":1}},{"a":{', ' {"k": "}]"} ']
    assert column(spark, X.is_json, values) == [
        True, False, False, False, False, False, True, True, True, False, False, False, False, False, True]


def test_vectors(spark):
    values = [[1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [], [1.0], None]
    assert column(spark, lambda c: V.vector_problem(c, 2), values, "array<float>") == [
        None, "not_finite", "not_finite", "zero_length", "empty", "wrong_dimension", "missing"]
    pair = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in pair.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] is None


def test_pointers(spark):
    kind = T.StructType([
        T.StructField("a", T.ArrayType(T.StringType())), T.StructField("x/y~z", T.StringType()),
        T.StructField("n", T.IntegerType()), T.StructField("o", T.StructType([T.StructField("p", T.StringType())])),
    ])
    paths = ["/a/0", "/a/1", "/a/00", "/a/2", "/x~1y~0z", "/a~2b", "a", "/n", "/o/p", "/o", "/a/-1", None]
    rows = spark.createDataFrame([(["v", " "], "w", 3, ("q",))], kind).select(F.struct("*").alias("d"))
    rows = rows.select("d", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("i", "path"))
    leaf = F.try_element_at(pointers.text_leaves(F.col("d"), kind), F.col("path"))
    got = [tuple(r) for r in rows.withColumn("leaf", leaf).orderBy("i").select(
        "leaf", pointers.pointer_problem(F.col("path"), F.col("leaf"))).collect()]
    assert got == [
        ("v", None), (" ", "blank"), (None, "not_found"), (None, "not_found"), ("w", None), (None, "bad_escape"),
        (None, "bad_start"), (None, "not_found"), ("q", None), (None, "not_found"), (None, "not_found"), (None, "bad_start")]


def test_scorers_agree_on_equal_pairs(spark):
    pairs = spark.createDataFrame([(1, "a  b", "b c"), (2, "a  b", "b c"), (3, "A", "a"), (4, "x", "y")], "i int, l string, r string")

    def prepared(scorer):
        rows = pairs.select("i", scorer.prepare(F.col("l")).alias("l"), scorer.prepare(F.col("r")).alias("r"))
        return {r.i: r.s for r in scorer.score(rows, "l", "r", "s").collect()}

    assert prepared(JaccardScorer()) == {1: pytest.approx(1 / 3), 2: pytest.approx(1 / 3), 3: 1.0, 4: 0.0}

    def factory():
        def score(batch):
            return [len(set(a.lower().split()) & set(b.lower().split())) / len(set((a + " " + b).lower().split())) for a, b in batch]
        return score

    assert prepared(ModelScorer(factory, "m")) == prepared(JaccardScorer())


def test_a_pair_without_a_usable_score_has_an_error(spark):
    rows = spark.createDataFrame([(t, "b") for t in ("high", "raises", "good", "short", "nan")], "l string, r string").coalesce(1)

    def score(batch):
        if any(a == "raises" for a, _ in batch):
            raise KeyError("x")
        return [{"high": 1.5, "nan": math.nan}.get(a, 0.25) for a, _ in batch if a != "short"]

    found = ModelScorer(lambda: score, "m").score(rows, "l", "r", "s").collect()
    assert {(r.l, r.s, r.score_error) for r in found} == {
        ("high", None, "score_out_of_range"), ("raises", None, "KeyError"), ("good", 0.25, None), ("short", None, "score_count"),
        ("nan", None, "score_out_of_range")}


def test_embedding_gives_unit_vectors_once_per_text(spark):
    rows = spark.createDataFrame([(1, "data engineer"), (2, "data engineer"), (3, "cook")], "i int, text string")
    got = {r.i: r.embedding for r in embed_texts(rows, lambda: NgramEmbedder(32)).collect()}
    assert got[1] == got[2] != got[3]
    assert math.isclose(sum(x * x for x in got[3]), 1.0, rel_tol=1e-5)


def test_ingest_distinguishes_errors(spark):
    values = ['{"k": 1}', "```json\n{\"k\": 2}\n```", " ", '{"k": ', '{"k": "x"}', "[1]"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    got = [r.ingest_status for r in intake.ingest_json(rows, "t", schema, ["k"]).orderBy("i").collect()]
    assert got == ["ok", "ok", "empty_output", "invalid_json", "invalid_schema", "invalid_schema"]


@pytest.mark.parametrize("make", [
    lambda: QueryConfig(max_chars=0), lambda: QueryConfig(max_chars=1, min_chars=2), lambda: RecallConfig(top_k=0),
    lambda: RecallConfig(type_weights={"skills": float("nan")}), lambda: RecallConfig(active_penalties={1: 1.5}),
    lambda: RecallConfig(best_weight=2), lambda: RerankConfig(title_weight=0.7), lambda: RerankConfig(type_weights={"skills": 1}),
    lambda: RetryConfig(base_delay=5, max_delay=1), lambda: RetryConfig(max_retries=-1),
])
def test_parameters_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_strict_mode_fails_on_the_first_problem(spark):
    from talentweave.functions.rows import raise_on

    rows = spark.createDataFrame([(1, None), (2, "blank_title")], "id int, reason string")
    assert raise_on(rows.where("id = 1"), "reason", ["id"]).count() == 1
    with pytest.raises(Exception, match="blank_title id=2"):
        raise_on(rows, "reason", ["id"]).collect()


def test_models_are_made_once_per_worker_process(spark, tmp_path):
    log = str(tmp_path / "made")

    def factory():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[1.0, float(len(t))] for t in texts]

    rows = spark.range(200).repartition(24).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    for _ in range(2):
        assert embed_texts(rows, factory, distinct=False).select("embedding").distinct().count() == 3
    made = open(log).read().split()
    assert len(made) == len(set(made)) < 48


def test_hashed_ngrams_are_unit_vectors_of_the_text_alone():
    texts = ["", "a", "data engineer", "data engineer", "数据工程师", "x" * 500]
    many = hashed_ngrams(texts, 64)
    assert np.allclose(np.linalg.norm(many, axis=1), 1)
    for i, t in enumerate(texts):
        assert np.allclose(many[i], hashed_ngrams([t], 64)[0])
    assert np.allclose(many[2], many[3]) and not np.allclose(many[2], many[4])
    near, far = hashed_ngrams(["data engineers", "sales manager"], 256) @ hashed_ngrams(["data engineer"], 256)[0]
    assert near > 0.8 > far


def test_pointers_into_documents_of_any_shape(spark):
    docs = [
        '{"a": [{"b": "x"}, "y", {"0": "z", "c/d": {"~": "t"}}], "0": "q", "n": 1, "t": true, "e": null}', '["p", ["q"]]', "not json", '"root"', "null", None,
        json.dumps({"a.b": {"x y": "v", "": "empty", "it's": "one", '"': "two", "'" + '"': "three", "[0]": "four", "?": "five", "b\\c": "six", "00": "zeros"}})]
    tokens = ["a", "0", "1", "2", "b", "c~1d", "~0", "a.b", "x y", "", "it's", '"', "'" + '"', "[0]", "?", "b\\c", "00", "01", "n", "t", "e", "9999999999", "-1", "~2"]
    paths = ["", "x", None, *["/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(tokens, repeat=n) if n < 3 or p[0] == "a"], "/a/2/c~1d/~0"]

    def plain(doc, path):
        if path is None or not re.fullmatch("(/([^~/]|~0|~1)*)+", path) or doc in ("not json", None):
            return None
        value = json.loads(doc)
        for token in path[1:].split("/"):
            token = token.replace("~1", "/").replace("~0", "~")
            if isinstance(value, dict) and token in value:
                value = value[token]
            elif isinstance(value, list) and re.fullmatch("0|[1-9][0-9]*", token) and int(token) < len(value):
                value = value[int(token)]
            else:
                return None
        return value if isinstance(value, str) else None

    rows = spark.createDataFrame([(d, p) for d in docs for p in paths], "doc string, path string")
    got = rows.withColumn("leaf", pointers.variant_text(F.try_parse_json("doc"), F.col("path"))).collect()
    assert sum(r.leaf is not None for r in got) > 15  # those that name a text
    assert [(r.doc, r.path, r.leaf) for r in got if r.leaf != plain(r.doc, r.path)] == []
