"""URL filters against fnmatch."""

import fnmatch
import random

import duckdb
import pyarrow as pa

from tallyloom.llm import urlfilter as uf
from tallyloom.llm.bytetext import utf8_buffers


def test_automaton_matches_like_globs():
    rng = random.Random(1)
    globs = ["*", "a*b", "*ab*", "?a*", "ab", "*.zip", "a?c*d", "", "**x", "é*"] + ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    urls = ["".join(rng.choice("abcdx.zip/") for _ in range(rng.randint(0, 20))) for _ in range(300)] + ["", "a" * 3000 + "b", "été"]
    machine = uf.Automaton.build([uf.Glob(g, "block") for g in globs])
    assert machine.step.shape[1] > 2
    hit = machine.run(*utf8_buffers(pa.array(urls)))
    for k, g in enumerate(globs):
        want = [fnmatch.fnmatchcase(u.encode().decode("latin-1"), g.encode().decode("latin-1")) for u in urls]
        assert hit[:, k].tolist() == want, g


def test_verdicts(spark):
    urls = ["http://A.Example.com/en/7x", "http://example.com/en/8", "https://b.example.net/de/81?q", "http://x.net/de/", "ftp://org/es/#a", "http://notcom/en/", None, "no scheme", "http://pills.org/a", "http://x.org?pills", "http://com/en/ " + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, urls[0], "c")], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in uf.judge_urls(pages).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(5)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert [got[i]["verdict"] for i in range(5, 10)] == ["allow", "allow", "allow", "block", "allow"]
    assert (got[6]["host"], got[6]["path"]) == ("", "") and got[0]["host"] == "a.example.com"
    assert got[10]["rule"] == "com/en/" and uf.judge_urls(pages).count() == 12
    assert uf.judge_urls(pages.limit(0)).count() == 0


def test_host_rules_fit_hosts_only(spark):
    urls = ["http://a.org/x.com/en/7", "http://a.org/go/www.example.com/en/7", "https://web.archive.org/web/1/http://www.example.net/de/8", "http://b.a.com/en/x.net/de/", "http://a.org/x.zip", "http://x.a.b.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.judge_urls(pages).collect()}
    assert [got[i] for i in range(6)] == [(None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"), (None, "block"), ("org/es/", "block")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT unnest(range(6)) AS page_id, unnest(?) AS url", [urls])
    assert {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT page_id, rule, verdict FROM ({uf.op6_sql()})").fetchall()} == got
