"""Archives and URL lists, and the queries as registered."""

from __future__ import annotations

import base64
import hashlib
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from orgweft.llm import catalog, url_cascade, warc

from .plain import link_components

DATA = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, payload string"


def test_archive_round_trip():
    draw = random.Random(1)
    for n in (1, 3, 200):
        records = [
            warc.record(i, f"http://x/{i}\r\nContent-Length: 5", draw.randbytes(draw.randrange(0, 3000)), None if i % 3 else 0)
            for i in range(n)
        ]
        data, places = warc.encode(records)
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        assert list(warc.decode(data)) == records
        assert places[-1][0] + places[-1][1] == len(data)


def test_pages_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 50000, "<p>é</p>", "\r\n\r\nWARC/1.1", "x" * 50000]
    ids = [4, 9, 8, 2, 5, 30, 1, 6]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 2 else None, h, "p") for i, h in zip(ids, html, strict=True)], PAGE)
    pages = pages.union(pages.where("page_id = 2")).union(spark.createDataFrame([(None, None, "<p>é</p>", "")], PAGE))
    for least in (0, 100):
        got = warc.round_trip(pages, least).collect()
        assert len(got) == len(ids) + 2
        for r in got:
            h = "<p>é</p>" if r.page_id is None else dict(zip(ids, html, strict=True))[r.page_id]
            data = (h or "").encode()
            assert r.payload_bytes == len(data)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            first = min(i for i, x in zip(ids, html, strict=True) if (x or "") == (h or ""))
            revisit = r.page_id != first and len(data) >= least
            assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.round_trip(pages.limit(0)).collect() == []


def plain_verdict(url, rules, hosts):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda h: host == h or host.endswith("." + h)
    found = []
    for action, key in rules:
        h, _, p = key.partition("/")
        if fits(h) and path.startswith("/" + p):
            found.append((len(key), len(h), key, action))
    if found:
        _, _, key, action = max(found)
        return host, path, key, action
    return host, path, None, "block" if any(map(fits, hosts)) else "allow"


def test_urls(spark):
    hosts = ["a.net", "net", "Example.NET", "b.example.net", "example.com", "x.org", "org", "torg", "spam-farm.example.org", "q.adult-x.example.com", ""]
    urls = [None, "", "no scheme", "http://", "://x.net/", "http://u@x.net:80/", "http://a.net.", "http://" + "a." * 3000 + "net/x"]
    urls += [f"https://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/EN/", "/de/", "/fr/x?y=/en/", "?a=b://c/", "#/x", "/en")]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], PAGE)
    for rules, listed in ((url_cascade.RULES, url_cascade.BLOCKED_HOSTS), ((), ()), ((("allow", "example.net/"), *url_cascade.RULES), ("org",))):
        for r in url_cascade.judge(spark, pages, rules, listed).collect():
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules, listed), urls[r.page_id]
    assert url_cascade.judge(spark, pages.limit(0)).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{n}" for n in range(6000)]
    listed = keys[::20]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_cascade.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.where(cascade.holds(universe["key"])).collect()}
    assert got == set(listed)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    frame = catalog.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_pipeline_stages(spark, monkeypatch):
    from orgweft.llm import decontamination, packing, quality, secrets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    # What each stage gets is what the one before it returned, written and read again.
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*stage) for stage in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert list(seen) == names and "pipeline" in __spark_entry__.queries()
    assert all(frame.columns == docs.columns for frame in seen.values())
    got = [{r.doc_id: r.text for r in seen[name].collect()} for name in names]
    assert got[0] == texts
    assert got[1] == {i: texts[i] for i in kept}
    top = link_components(sorted((i, texts[i]) for i in kept), 5, 80)
    assert got[2] == {i: texts[i] for i in set(top.values())}
    found = {r.doc_id for r in decontamination.hits(docs, bench).collect()}
    assert found and got[3] == {i: t for i, t in got[2].items() if i not in found}
    assert set(got[4]) == set(got[3])
    for i, text in got[4].items():
        assert not [s for s in secrets.find(text) if s["kind"] < 3]
        if not secrets.find(texts[i]):
            assert text == texts[i]
    encode = packing.encoder()
    assert {r.doc_id for r in packed} == set(got[4])
    assert sum(r.length for r in packed) == sum(len(encode(t)) + 1 for t in got[4].values())


def test_pipeline_of_nothing(spark, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
