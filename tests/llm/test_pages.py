"""URL verdicts, sharding and the fixity audit."""

import random
from collections import Counter
from hashlib import md5, sha256

import duckdb
import pytest

from compare import difference
from talentweave.llm import fixity, sharding, urls
from talentweave.llm.queries import ORACLES, QUERIES

PAGES = "page_id bigint, url string, html string, host string, trust double"


def link(*hosts):
    return "".join(f'<a HREF = "https://{h}/x?y">t</a><a href="/in">i</a>' for h in hosts)


def judge(spark, rows, **options):
    frame = spark.createDataFrame([(i, u, h, "own", 9.0) for i, (u, h) in enumerate(rows)], PAGES)
    return {r.page_id: r for r in urls.judged(frame, **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"),
        ("HTTP://WWW.Example.COM/EN/x", "www.example.com", "/EN/x", "com/", "allow"),
        ("http://www.example.com/en/x?a=/b#c", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://a.net/es/1#://b.com/", "a.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://a.com", "a.com", "", None, "allow"), ("http://ÀB.com?q", "Àb.com", "", None, "allow"),
        ("http:///path", "", "/path", None, "allow"), ("a\nb://h.org/\np?x", "h.org", "/\np", None, "allow"),
    ]
    got = judge(spark, [(c[0], None) for c in cases])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]


def test_trust_and_distrust_follow_links(spark):
    rows = [("http://bad.net/es/1", ""), ("http://bad.net/en/2", link("victim.org")), ("http://bad.net/fr/3", ""),
            ("http://friend.org/1", link("bad.net")), ("http://victim.org/1", ""),
            ("http://good.com/1", link("liked.org", "good.com")), ("http://liked.org/2", link("bad.net")),
            ("http://far.org/1", link("friend.org"))]
    got = judge(spark, rows)
    # bad.net: two of three pages blocked, and what links to it shares that; trusted liked.org outweighs it
    assert [got[i].verdict for i in range(len(rows))] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[0].distrust == pytest.approx(2 / 3) and got[3].distrust == pytest.approx(0.85 / 3)
    assert got[7].distrust == pytest.approx(0.85**2 / 3) and got[6].trust == pytest.approx(0.85) and got[4].distrust == 0
    assert judge(spark, rows, threshold=0.25)[3].verdict == "block" and judge(spark, rows, threshold=0.25)[6].verdict == "allow"


def test_series_equals_plain_iteration(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.org" for i in range(12)]
    pages = [(f"http://{rng.choice(hosts)}{rng.choice(['/es/', '/en/'])}", link(*rng.sample(hosts, rng.randint(0, 3)))) for _ in range(60)]
    rules = [("allow", "h0.org", "/"), ("block", "org", "/es/")]
    got = judge(spark, pages, rules=rules)
    own = [u.split("/")[2] for u, _ in pages]
    edges = Counter((s, d) for s, (_, h) in zip(own, pages) for d in hosts if f"//{d}/" in h and d != s)
    fit = ["allow" if s == "h0.org" else "block" if "/es/" in u else None for s, (u, _) in zip(own, pages)]
    # the longest rule wins, and that of h0.org is longer than org/es/
    seed = {k: {h: sum(f == k for f, s in zip(fit, own) if s == h) / max(1, own.count(h)) for h in hosts} for k in ("allow", "block")}
    out, come = Counter(), Counter()
    for (s, d), n in edges.items():
        out[s] += n
        come[d] += n
    trust, distrust = dict(seed["allow"]), dict(seed["block"])
    for _ in range(200):
        t, b = dict(seed["allow"]), dict(seed["block"])
        for (s, d), n in edges.items():
            t[d] += 0.85 * trust[s] * n / out[s]
            b[s] += 0.85 * distrust[d] * n / come[d]
        trust, distrust = t, b
    for i, h in enumerate(own):
        assert got[i].trust == pytest.approx(trust[h], abs=0.05) and got[i].distrust == pytest.approx(distrust[h], abs=0.05)


def test_other_seeds_do_not_end_a_chain(spark):
    chain = [("http://x.org/", link("y.org")), ("http://y.org/", link("z.net")), ("http://z.net/es/", "")]
    got = judge(spark, chain + [(f"http://s{i}.com/", "") for i in range(3000)])
    assert [got[i].distrust for i in range(3)] == pytest.approx([0.85**2, 0.85, 1.0]) and got[0].verdict == "block"


def test_no_pages(spark):
    assert urls.judged(spark.createDataFrame([], PAGES)).count() == 0


def plain_slot(doc_id):
    return int(md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16) % 4093


def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table()
    counts = Counter(table)
    assert len(table) == sharding.SLOTS and set(counts) == set(sharding.SHARDS)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    gone = sharding.SHARDS[-1]
    moved = sum(a != b for a, b in zip(table, fewer) if a != gone)
    assert moved < 0.1 * sharding.SLOTS
    assert sharding.lookup_table(["only"], 3) == ["only"] * 3
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 9), (list("abcd"), 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_every_row_gets_its_shard(spark):
    rows = [(i, "x", i * 1.5, "y") for i in range(500)] + [(None, None, None, None), (3, "x", 4.5, "y"), (3, "x", 4.5, "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, `a.b` string, slot double, text string")
    got = sharding.sharded(frame).collect()
    table = sharding.lookup_table()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "a.b", "text", "slot", "shard"}
    assert all(r.shard == table[r.slot] and r.slot == plain_slot(r.doc_id) for r in got)
    assert sharding.sharded(frame.limit(0)).count() == 0


REPLICA = "warc_file string, offset bigint, length bigint, digest string, node string"


def replica(spark, rows):
    return spark.createDataFrame([(f, o, n, d, "x") for f, o, n, d in rows], REPLICA)


def test_audit_finds_just_the_damage(spark):
    rng = random.Random(6)
    rows = []
    for f in range(4):
        at = 0
        for i in range(rng.randint(1, 120)):
            n = rng.choice([10, 200, 5000])
            rows.append((f"f{f}", at, n, sha256(f"{f} {i}".encode()).hexdigest()))
            at += n
    rows.append(rows[-1])  # repeated record
    other, wanted = [], {}
    for i, (f, o, n, d) in enumerate(rows[:-1]):
        kind = rng.choice(["", "", "", "", "changed", "missing", "length"]) if f != "f0" else ""
        if kind == "missing":
            wanted[f, o] = "missing"
        elif kind:
            wanted[f, o] = "changed"
            other.append((f, o, n + (kind == "length"), d if kind == "length" else "0" * 64))
        else:
            other.append((f, o, n, d))
    other += [("f9", 7, 1, "e" * 64), ("f1", 10**7, 5, "f" * 64)]
    wanted |= {("f9", 7): "extra", ("f1", 10**7): "extra"}
    last = rows[-1][:2]
    found = fixity.audit(replica(spark, rows), replica(spark, other), range_bytes=1000, fan=4).collect()
    got = Counter((r.warc_file, r.offset, r.status) for r in found)
    assert got[(*last, "missing")] == 1 + (wanted.pop(last, "") == "missing")
    assert {k[:2]: k[2] for k in got if k[:2] != last} == wanted
    assert fixity.audit(replica(spark, rows), replica(spark, rows[::-1]), range_bytes=1000, fan=4).count() == 0
    assert fixity.audit(replica(spark, rows), replica(spark, [])).count() == len(rows)
    assert fixity.audit(replica(spark, []), replica(spark, [])).count() == 0


def test_only_differing_branches_are_read(spark):
    rows = [("f", i * 100, 100, sha256(str(i).encode()).hexdigest()) for i in range(300)]
    other = [*rows[:77], (*rows[77][:3], "0" * 64), *rows[78:]]
    a, b = (fixity.tree(replica(spark, r), range_bytes=200, fan=4, levels=4) for r in (rows, other))
    assert a.where("level = 4").count() == 1
    assert [(r.warc_file, r.node) for r in fixity.differing(a, b, 4, fan=4).collect()] == [("f", 38)]


def test_offsets_of_a_hot_file(spark):
    """Copies and repeated ids: offsets by brute force, and no task lists a whole file."""
    rows = [("f", 7, 10 + i % 5, sha256(str(i % 700).encode()).hexdigest()) for i in range(0, 3500)]
    rows += [("none-1", None, 9, "a" * 64)] * 3000 + [("g", i, i, sha256(str(i).encode()).hexdigest()) for i in range(20)]
    random.Random(3).shuffle(rows)
    records = spark.createDataFrame(rows, "warc_file string, record_id bigint, length bigint, digest string")
    found = fixity.with_offsets(records)
    at, wanted = Counter(), []
    for row in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[3], r[2])):
        wanted.append((*row, at[row[0]]))
        at[row[0]] += row[2]
    key = lambda r: (r[0], r[4], r[2])
    got = [(r.warc_file, r.record_id, r.length, r.digest, r.offset) for r in found.collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert fixity.with_offsets(records).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).max() < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_registered_query_on_linked_pages_equals_sql(spark, tmp_path):
    """A chain of more hops than thirty, and hosts that share their links, among many seeds without any link."""
    rng = random.Random(9)
    pages = [(f"http://seed{i}.com/", "") for i in range(300)]
    pages += [("http://bad.net/es/", ""), *[(f"http://c{i}.org/", link(f"c{i - 1}.org" if i else "bad.net")) for i in range(33)]]
    hosts = [f"m{i}.{end}" for i in range(8) for end in ("net", "org", "com")]
    for _ in range(150):
        k = rng.randrange(len(hosts))
        pages.append((f"http://{hosts[k]}/{rng.choice(['es', 'fr', 'en'])}/", link(*rng.sample(hosts[k + 1:], min(2, len(hosts) - k - 1)))))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), QUERIES["op3_url_trust"], ORACLES["op3_url_trust"]) is None
    got = {r.host: r for r in urls.judged(rows.where("url LIKE '%bad.net%' OR url LIKE 'http://c%' OR url LIKE '%seed%'")).collect()}
    # Each hop of the chain passes on 0.85 of what it gets; the fifth one is under the threshold of one half.
    assert [got[f"c{i}.org"].verdict for i in range(6)] == ["block"] * 4 + ["allow"] * 2
    assert [got[f"c{i}.org"].distrust for i in range(33)] == [pytest.approx(0.85 ** (i + 1)) for i in range(33)]


def test_very_long_urls_and_pages(spark):
    long = "http://" + "a" * 200_000 + ".net/es/" + "b" * 200_000
    got = judge(spark, [(long, link(*["x.org"] * 50_000)), ("http://x.org/", "y" * 3_000_000), (None, None)])
    assert got[0].rule == "net/es/" and got[0].verdict == "block" and got[1].verdict == "allow" and len(got[0].path) == 200_004
