"""Vectors, URLs and archives, against brute force."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellerlake.llm import ann, urls, warc
from tellerlake.llm.queries import URL_RULES


def brute_nearest(rows, every, k):
    v = {i: np.array(x) for i, x in rows}
    out = {}
    for q in (i for i in v if i % every == 0):
        s = sorted(((-float(v[q] @ v[i] / (np.linalg.norm(v[q]) * np.linalg.norm(v[i]))), i) for i in v if i != q))[:k]
        out[q] = [i for _, i in s]
    return out


def test_recall_on_the_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in emb.collect()], 10, 5)
    got = {}
    for r in ann.nearest(emb, F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values()) and got.keys() == want.keys()
    assert np.mean([len(set(got[q].values()) & set(want[q])) / 5 for q in want]) >= 0.9


def test_unusable_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (2, [4.0, 0.0, 0.0]), (5, [-1.0, 0.0, 0.1]), (6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [math.nan, 0.0, 1.0]), (10, [1.0]), (None, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, bucket int")
    got = [(r["rank"], r.vec_id, round(r.score, 3)) for r in ann.nearest(vectors, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 3, 1.0), (3, 5, -0.995)]
    assert ann.nearest(vectors.limit(0), F.col("id") == 0).collect() == []


def brute_rule(host, path):
    fit = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def test_rules_equal_brute_force(spark):
    given = ["http://a.example.net/en/1", "http://EXAMPLE.net/en/", "http://net", "http://net/", "https://x.net/fr?u=//", "http://example.com/de/x#y", "https://b.org/fr/", "http://b.org/french", "no url", "", None, "x://y://z.net/", "http://notexample.com/de/", "http://q?a/net/", "http://É.NET/a\nb?c", "http://e.com/a/b-1?x=1&y=2"]
    hosts = ["a.example.net", "example.net", "net", "net", "x.net", "example.com", "b.org", "b.org", "", "", "", "y:", "notexample.com", "q", "É.net", "e.com"]
    paths = ["/en/1", "/en/", "", "/", "/fr", "/de/x", "/fr/", "/french", "", "", "", "//z.net/", "/de/", "", "/a\nb", "/a/b-1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.url_verdicts(pages, URL_RULES).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(given))] == list(zip(hosts, paths, strict=True))
    assert [got[i].rule for i in range(len(given))] == [brute_rule(h, p) for h, p in zip(hosts, paths, strict=True)]
    assert all(got[i].verdict == URL_RULES[got[i].rule] for i in got if got[i].rule) and {r.verdict for r in got.values()} <= {"allow", "block"}


def test_entropy_and_one_class(spark):
    row = spark.createDataFrame([("aabb", ""), ("", "")], "url string, host string").select(urls.entropy(F.col("url")).alias("e")).collect()
    assert [r.e for r in row] == [pytest.approx(1.0), 0.0]
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_verdicts(pages, URL_RULES).collect()} == {1: "block", 2: "block"}
    assert urls.url_verdicts(pages.limit(0), URL_RULES).collect() == []


def test_archives_round_trip(spark):
    long = "ß" * 200_000
    given = [(4, "http://a.example.net/x", "same"), (2, "http://a.example.net/x", "same"), (9, "http://A.example.net/x", "same"), (9, "http://A.example.net/x", "same"), (5, None, None), (6, "", ""), (7, "http://b/\r\nX: y", long), (None, "http://c/", "none"), (None, "http://c/", "same")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("first", F.lit(1))
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(pages).collect())
    first = {}
    for i, _, h in given:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in given:
        data = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and to != i
        want.append((i or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else 0))
    assert got == sorted(want)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_url_keys():
    assert warc.url_key("http://A.Example.net/x?y=1") == "net,example,a)/x?y=1"
    assert warc.url_key(None) == ")" and warc.url_key("a b") == ")a%20b"
