"""The URL filter against a plain Python form and its SQL."""

import math
import os
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from nomenlink.llm import url_markov as um
from nomenlink.llm.queries import RULES

FOLDER = "/root/testdata/sf0.001"
FIELDS = ["page_id", "host", "path", "rule", "verdict"]

EDGES = [
    None, "", "no scheme", "http://", "HTTP://Example.COM", "https://EXAMPLE.com/en/x?y#z",
    "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://com/x", "http://telecom/x",
    "ftp://b.net/es/#", "http://b.net/ES/", "http://b.net?x=/es/", "http://é.net/fr/ü", "http://x.org/\n/en",
    "a://b://c.com/", "http://" + "long" * 3000 + ".org/" + "p" * 5000, "http://😀.org/", "http://\x02\x03.org",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]


def fit(host, path):
    fits = [
        r for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


class Plain:
    """The models with dictionaries and recursion."""

    def __init__(self, urls):
        self.rows = [(u or "", fit(*parts(u))) for u in urls]
        self.counts = {k: defaultdict(Counter) for k in ("allow", "block")}
        letters = set()
        for url, rule in self.rows:
            padded = um._START * um.ORDER + url + um._END
            letters.update(padded[um.ORDER :])
            if rule and not self.fold(url):
                for i in range(um.ORDER, len(padded)):
                    for k in range(um.ORDER + 1):
                        self.counts[rule.verdict][padded[i - k : i]][padded[i]] += 1
        self.uniform = 1 / (len(letters) + 1)
        self.trained = all(self.counts[k] for k in self.counts)

    @staticmethod
    def fold(url):
        return md5(url.encode()).hexdigest()[0] in um._FOLD

    def p(self, kind, context, letter):
        lower = self.p(kind, context[1:], letter) if context else self.uniform
        seen = self.counts[kind].get(context)
        if not seen:
            return lower
        return (seen[letter] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    def score(self, url):
        if not self.trained:
            return 0.0
        padded = um._START * um.ORDER + url + um._END
        places = range(um.ORDER, len(padded))
        total = sum(
            math.log(self.p("allow", padded[i - um.ORDER : i], padded[i]))
            - math.log(self.p("block", padded[i - um.ORDER : i], padded[i]))
            for i in places
        )
        return round(total / len(places), 9)

    def verdicts(self):
        held = [(self.score(u), r.verdict) for u, r in self.rows if r and self.fold(u)]
        bins = [(math.floor(s * um.BINS), v) for s, v in held]
        n = Counter(v for _, v in bins)
        best = (-1, 0)
        if n["allow"] and n["block"]:
            for edge in sorted({b for b, _ in bins}):
                passed = sum(v == "allow" and b >= edge for b, v in bins) / n["allow"]
                stopped = sum(v == "block" and b < edge for b, v in bins) / n["block"]
                if round(passed + stopped, 9) > best[0]:
                    best = (round(passed + stopped, 9), edge)
        threshold = best[1] / um.BINS
        return [r.verdict if r else ("allow" if self.score(u) >= threshold else "block") for u, r in self.rows]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def check(spark, urls):
    rows = [(i % 90, u, "h", 1.0) for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    found = [tuple(r[f] for f in FIELDS) for r in um.judge(frame, RULES).collect()]
    verdicts = Plain(urls).verdicts()
    expected = []
    for (page_id, url, *_), verdict in zip(rows, verdicts):
        rule = fit(*parts(url))
        expected.append((page_id, *parts(url), rule and rule.name, verdict))
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_edges_equal_the_plain_form(spark):
    check(spark, EDGES + EDGES)


def test_large_model_takes_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(um, "BROADCAST_ROWS", -1)
    check(spark, EDGES + [f"http://s{i}.{t}/{c}/{i}" for i in range(40) for t in ("com", "net", "org") for c in ("en", "es")])


def test_without_both_kinds_all_pass(spark):
    check(spark, ["http://a.com/x", "http://b.org/y", None])
    check(spark, [])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_its_sql_and_the_plain_form(spark):
    from nomenlink.llm.queries import ORACLES, op2_url_markov

    urls = [r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    check(spark, urls)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    cursor = connection.execute(ORACLES["op2_url_markov"])
    assert [d[0] for d in cursor.description] == FIELDS
    rows = sorted((tuple(r) for r in op2_url_markov(spark, FOLDER).collect()), key=key)
    assert rows == sorted(cursor.fetchall(), key=key)


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([("http://a.com/", 1)], "url string, page_id long")
    plan = um.judge(frame, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
