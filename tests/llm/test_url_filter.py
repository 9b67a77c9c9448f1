import re

import pytest
from pyspark.sql import functions as F

from basketry.llm import url_filter as uf

URLS = [None, "", "no scheme", "http://", "HTTP://Www.Example.NET/en/A?b#c", "https://example.net/en", "https://a.example.net/en/x", "https://net", "https://net/",
        "https://fishnet/", "https://x.org/fr/", "https://org/fr/1", "https://x.org/FR/", "https://example.com/de/1", "https://badexample.com/de/1",
        "https://u@example.com:80/de/?q", "x://y://z/", "https://ÄÖ.org/fr/é", "https://example.com?/de/", "https://" + "a" * 50_000 + ".org/fr/" + "b" * 50_000]


def _plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in uf.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2]), default=None)


@pytest.fixture(scope="module")
def model(spark):
    return uf.train(uf.default_labels(spark))


def test_rules_and_parts(spark, model):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, verdict int")
    rows = uf.judge(pages, model).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule = _plain((URLS + URLS[:2])[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1] + rule[2])
        assert r["verdict"] == (rule[0] if rule else "block" if r["p_block"] >= 0.5 else "allow")
    assert uf.judge(pages.limit(0), model).count() == 0


def _held_out(spark, by, classes=("host", "path")):
    """Share of URLs judged right whose ``by`` (host or path) was not learnt from."""
    host, path = uf.host_and_path(F.col("url"))
    part = {"host": F.regexp_replace(host, "^www\\.", ""), "path": path}[by]
    rows = uf.default_labels(spark).where(F.lit(by == "host") | (path != "/")).withColumn("fold", F.pmod(F.xxhash64(part), F.lit(4))).cache()
    right = total = 0
    for fold in range(4):
        # What is judged shares nothing with the table but the other part's words.
        m = uf.train(rows.where(F.col("fold") != fold))
        test = rows.where(F.col("fold") == fold).withColumn("page_id", F.monotonically_increasing_id())
        if by == "path":
            test = test.withColumn("url", F.concat(F.lit("https://host.example"), path))
        judged = uf.judge(test.select("page_id", "url"), m, rules=()).join(test.drop("url"), "page_id")
        got = judged.agg(F.sum(F.when((F.col("verdict") == "block") == (F.col("label") == 1), 1).otherwise(0)), F.count(F.lit(1))).first()
        right, total = right + got[0], total + got[1]
    rows.unpersist()
    return right / total


def test_held_out_hosts_and_paths(spark):
    """Hosts that were not learnt from, with paths; paths that were not learnt
    from, on a neutral host. The classes are of about one size."""
    hosts, paths = _held_out(spark, "host"), _held_out(spark, "path")
    print(f"held out: hosts {hosts:.3f}, paths {paths:.3f}")
    assert hosts >= 0.8 and paths >= 0.55


def test_scores_are_those_of_the_plain_model(spark, model):
    """p_block from the n-grams and the model's weights, by a loop."""
    import math

    from pyspark.ml.feature import HashingTF

    slots = HashingTF(numFeatures=uf.FEATURES, inputCol="g", outputCol="f")
    urls = ["https://www.bingo.test/Play/now", "http://a/b", "https://a", "https://ÄÖ.org/fr/é", "", "https://xxxxxxxx/xxxxxxxx"]
    got = {r["page_id"]: r["p_block"] for r in uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model, rules=()).collect()}
    for i, url in enumerate(urls):
        host, path, _ = _plain(url)
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in f"^{host} {path}$")
        grams = {text[k:k + n] for n in uf.SIZES for k in range(len(text) - n + 1)} if host or path else set()
        z = model.intercept + sum(model.coefficients[j] for j in {slots.indexOf(g) for g in grams})
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 2e-6


def test_large_label_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAX_LABELLED", 5)
    with pytest.raises(ValueError):
        uf.train(uf.default_labels(spark))
