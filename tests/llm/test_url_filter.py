"""Rules, hosts and shrunken rates against plain arithmetic."""

import pytest

from provenspark.llm import url_filter as U

URLS = [
    (1, "https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://example.com", "example.com", "", None, "allow"),
    (4, "http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
    (5, "http://notcom/a", "notcom", "/a", None, "allow"),
    (6, "com/en/", "", "", None, "allow"),
    (7, None, "", "", None, "allow"),
    (8, "x://com/q://r", "com", "/q://r", "com/", "allow"),
    (9, "http://bad.org/a\nb", "bad.org", "/a\nb", None, "block"),
    (10, "http://fine.org/a", "fine.org", "/a", None, "allow"),
]


def pages(spark):
    return spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in URLS], "page_id long, url string, host string, rule string")


def outcomes(spark):
    rows = [("bad.org", 1)] * 60 + [("fine.org", 0)] * 60 + [("few.org", 1)] + [(f"h{i}.com", int(i % 9 == 0)) for i in range(90)] + [(None, 1), ("x.org", None)]
    return spark.createDataFrame(rows, "host string, bad int")


def test_judge(spark):
    got = {r.page_id: r for r in U.judge(pages(spark), outcomes(spark)).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_many_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(U, "COMPILED", 0)
    test_judge(spark)


def test_shrinkage(spark):
    rep = {r.host: r for r in U.host_reputation(outcomes(spark)).collect()}
    assert rep["few.org"]["mean"] < rep["bad.org"]["mean"] < 1
    assert 0 < rep["fine.org"]["mean"] < 0.1
    assert all(r.bound < r["mean"] for r in rep.values())
    # one page shrinks toward its domain, which shrinks toward its suffix
    assert rep["few.org"].bound < rep["bad.org"].bound


def test_hosts_without_outcomes_follow_domain_and_suffix(spark):
    rows = [(f"s{i}.evil.org", 1) for i in range(40) for _ in range(3)] + [(f"t{i}.good.org", 0) for i in range(40) for _ in range(3)] + [(f"u{i}.foul.bad", 1) for i in range(60)]
    urls = [(1, "http://new.evil.org/a", "block"), (2, "http://new.good.org/a", "allow"), (3, "http://www.other.bad/a", "block"), (4, "http://www.other.xyz/a", "allow")]
    asked = spark.createDataFrame([(i, u, "h", "r") for i, u, _ in urls], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in U.judge(asked, spark.createDataFrame(rows, "host string, bad int"), rules=()).collect()}
    assert {i: r.verdict for i, r in got.items()} == {i: v for i, _, v in urls}
    assert got[4].bound is None and got[1].bad_rate > got[2].bad_rate


def test_edges(spark):
    none = outcomes(spark).limit(0)
    assert {r.verdict for r in U.judge(pages(spark), none).where("rule is null").collect()} == {"allow"}
    assert U.judge(pages(spark).limit(0), outcomes(spark)).count() == 0
    assert U.host_reputation(none).count() == 0
    assert U.with_rules(U.judge(pages(spark), none).select("host", "path"), rules=()).where("rule is not null").count() == 0


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.y.org", "y.org", "org"), ("localhost", "localhost", "localhost")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    r = spark.range(1).select(U.domain_of(F.lit(host)).alias("d"), U.suffix_of(F.lit(host)).alias("s")).first()
    assert (r.d, r.s) == (domain, suffix)


def test_suffixes_from_a_table(spark):
    table = spark.createDataFrame([("com",), ("Github.io",), ("io",), ("uk",), ("co.uk",)], "suffix string")
    hosts = spark.createDataFrame([("a.b.github.io",), ("x.io",), ("www.shop.co.uk",), ("host",), ("a.b.unknown",), ("com",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in U.parents(hosts, table).collect()}
    assert got["a.b.github.io"] == ("b.github.io", "github.io") and got["x.io"] == ("x.io", "io")
    assert got["www.shop.co.uk"] == ("shop.co.uk", "co.uk") and got["a.b.unknown"] == ("b.unknown", "unknown")
    assert got["host"][0] == "host" and got["com"][0] == "com"


def test_bound_decides_rows_like_plain_arithmetic(spark):
    """Hosts that differ: the verdicts come from the posterior bound, level by level."""
    import random

    r = random.Random(5)
    outcomes = [(f"h{h}.d{h % 5}.org", int(r.random() < (0.9 if h % 5 == 0 else 0.02))) for h in range(40) for _ in range(r.randint(1, 40))]
    pages = [(i, f"https://{h}/p{i}") for i, h in enumerate(sorted({h for h, _ in outcomes}) + ["new.d0.org", "new.d1.org", "new.org", "x.unseen"])]
    got = {r.host: r for r in U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, bad int"), rules=()).collect()}

    def prior(children, up):
        ss = sum(n * (k / n - up[c]) ** 2 for c, (n, k) in children.items())
        binomial, scale = sum(up[c] * (1 - up[c]) for c in children), sum(n * up[c] * (1 - up[c]) for c, (n, k) in children.items())
        rho = max(0.0, (ss - binomial) / (scale - binomial)) if scale > binomial else 0.0
        return max(U.STRENGTH[0], min(U.STRENGTH[1], 1 / rho - 1 if rho > 0 else U.STRENGTH[1]))

    def level(name, up):
        children = {}
        for h, bad in outcomes:
            n, k = children.get(name(h), (0, 0))
            children[name(h)] = (n + 1, k + bad)
        means = {c: up(c) for c in children}
        m = prior(children, means)
        out = {}
        for c, (n, k) in children.items():
            a, b = m * means[c] + k, m * (1 - means[c]) + n - k
            out[c] = (a / (a + b), a / (a + b) - U.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
        return out

    total = (sum(b for _, b in outcomes) + 1) / (len(outcomes) + 2)
    suffix = level(lambda h: h.rpartition(".")[2], lambda c: total)
    domain = level(lambda h: ".".join(h.split(".")[-2:]), lambda c: suffix["org"][0])
    host = level(lambda h: h, lambda c: domain[".".join(c.split(".")[-2:])][0])
    for name, row in got.items():
        d = ".".join(name.split(".")[-2:])
        want = host.get(name) or domain.get(d) or suffix.get(name.rpartition(".")[2])
        assert (row.bound is None) if want is None else row.bound == pytest.approx(want[1])
        assert row.verdict == ("block" if want and want[1] > U.MOST else "allow")
    verdicts = [r.verdict for r in got.values()]
    assert verdicts.count("block") >= 5 and verdicts.count("allow") >= 5 and got["new.d0.org"].verdict == "block"
