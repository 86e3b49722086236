"""Text statistics and robust outliers against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talentweave.llm import outliers
from talentweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, words string, kept int"


def plain(text):
    words = WORD.findall(text or "")
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i:i + 8])].append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", text or "")),
    }


def failed(s):
    return s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]


def vector(s):
    filled = s["n_words"] + 40
    return [round(v, 6) for v in (
        math.log((s["word_chars"] + 240) / filled), math.sqrt(s["n_symbols"] / filled), math.sqrt(s["n_dup_lines"] / (s["n_lines"] + 4)),
        math.sqrt(s["n_repeat_words"] / filled), math.sqrt(s["n_capitals"] / (s["word_chars"] + 240)))]


def plain_verdicts(rows, min_rows):
    """kept of each row by a plain minimum-covariance-determinant estimate with the same start and steps."""
    stats = [plain(t) for _, t, _, _ in rows]
    sound = [i for i, s in enumerate(stats) if not failed(s)]
    own = Counter(rows[i][2:] for i in sound)
    shared = Counter()
    for key, n in own.items():
        shared[key[0]] += n if n < min_rows else 0
    group = {i: rows[i][2:] if own[rows[i][2:]] >= min_rows else rows[i][2] if shared[rows[i][2]] >= min_rows else ... for i in sound}
    kept = [False] * len(rows)
    floors = np.array(list(outliers.FLOORS.values()))
    for g in set(map(repr, group.values())):
        members = [i for i in sound if repr(group[i]) == g]
        x = np.array([vector(stats[i]) for i in members])
        cells = np.round(x, 3)
        middle = np.median(cells, axis=0)
        cov = np.diag((1.4826 * np.median(np.round(np.abs(cells - middle), 3), axis=0)) ** 2 + floors**2)
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov), x - middle)
            cell = np.round(np.log(d + 1e-6), 2)
            core = x[cell <= np.quantile(cell, 0.75) + 1e-9]
            middle, cov = core.mean(axis=0), 1.412 * np.cov(core.T, bias=True) + np.diag(floors**2)
        d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov), x - middle)
        for i, value in zip(members, d):
            kept[i] = bool(value <= 25.745)
    return kept


def texts(rng, n):
    made = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdeàñ") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(15, 120))]
        kind = rng.random()
        if kind < 0.05:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.1:
            words = [w + "###" for w in words]
        elif kind < 0.2:
            at = rng.randint(0, len(words) - 9)
            words += words[at:at + rng.randint(7, 9)] * rng.randint(1, 2)
        made.append(rng.choice([" ", " ", "\n", "\t"]).join(words) + "\nsame line here" * rng.choice([0, 0, 0, 1, 2, 3]))
    return made


ODD = [None, "", " \n\t\r\x0b\x0c ", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "\n\n x\n x\nx\n\n", "a\x1cb\x85c d",
       "|<>#*$%& " * 30, "w1 " * 20_000, " ".join(f"t{i % 5000}" for i in range(30_000)), "Ünïcode 😀 " * 30]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_counts_of_whole_texts(spark):
    rng = random.Random(8)
    rows = [(i, t, None, "s") for i, t in enumerate(ODD + texts(rng, 60))]
    for r in outliers.counted(frame(spark, rows)).collect():
        s = plain(rows[r.doc_id][1])
        assert {k: r[k] for k in s} == s, rows[r.doc_id][1][:80]
        assert r.base_failed == failed(s) and [r[v] for v in outliers.VECTOR] == pytest.approx(vector(s), abs=2e-6)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i, t in enumerate(texts(rng, 900))]
    rows += [(9000 + i, t, "fr", "rare") for i, t in enumerate(ODD)] + [(5, "one two three", None, None)] * 2
    wanted = plain_verdicts(rows, 60)
    counts = outliers.counted(frame(spark, rows))
    for few in (0, 1000):
        got = outliers.judged(counts, min_rows=60, broadcast_groups=few).collect()
        assert len(got) == len(rows)
        keyed = sorted((r.doc_id, r.lang or "", r.source or "", r.kept) for r in got)
        assert keyed == sorted((i, lang or "", src or "", k) for (i, _, lang, src), k in zip(rows, wanted))
    shouted = [k for (i, t, _, _), k in zip(rows, wanted) if t and (t.count("###") > 20 or t.count("!!") > 20)]
    assert sum(shouted) < 0.3 * len(shouted)


def test_empty_and_all_failed(spark):
    assert outliers.judged(outliers.counted(frame(spark, []))).count() == 0
    got = outliers.judged(outliers.counted(frame(spark, [(1, "short", "en", "a"), (None, None, None, None)]))).collect()
    assert [r.kept for r in got] == [False, False]


def test_registered_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    rows = [(d.doc_id, d.text, d.lang, d.source) for d in docs]
    wanted = {r[0]: k for r, k in zip(rows, plain_verdicts(rows, outliers.MIN_ROWS))}
    got = QUERIES["op6_robust_outliers"](spark, tables).collect()
    assert {r.doc_id: r.kept for r in got} == wanted
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), [d.text for d in sorted(docs, key=lambda d: d.doc_id)]):
        s = plain(text)
        assert all(r[k] == s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
