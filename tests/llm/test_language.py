"""Fusion of evidence against a plain version in loops, with pages whose markup, address and host disagree with their text."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sparkeval.llm import language

WORDS = {"en": "the house and the garden were quiet when they came back from the long walk", "de": "das haus und der garten waren ruhig als sie von dem langen weg zurück kamen", "fr": "la maison et le jardin étaient calmes quand ils sont revenus de la longue marche"}


def text(lang, i, n=14):
    w = WORDS[lang].split()
    return " ".join(w[(i * 7 + k * 3) % len(w)] for k in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text(lang, i, 60), lang) for i in range(30) for lang in WORDS]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")


def pages():
    out = []
    for i in range(40):
        out.append((i, "de", "http://a.example.de/x", text("de", i)))
        out.append((100 + i, "fr-FR", "https://www.b.example.fr:80/", text("fr", i)))
        out.append((200 + i, None, "http://c.example.org", text("en", i)))
    out += [(300, "fr", "http://a.example.de/y", text("de", 1)), (301, "de", "http://a.example.de/z", "haus"), (302, "fr", "http://www.b.example.fr/", "a"), (303, "de", None, text("en", 3))]
    out += [(304, None, None, "123 ..."), (305, "", "not an address", None), (306, "zz", "http://localhost/", text("fr", 5)), (None, "de", "http://a.example.de", text("de", 9)), (301, "de", "http://a.example.de/z", "haus")]
    return out


def plain(rows, model):
    """Posteriors by the formula, one row at a time."""
    names, table = [*model[0], "und"], model[1].astype(np.float64)
    k, own = len(names), []
    for _, declared, url, body in rows:
        grams = language.trigrams((body or "").lower().encode())
        log = table[:, grams].mean(axis=1) * min(len(grams), language.EVIDENCE) if len(grams) else np.zeros(k)
        prior = np.zeros(k)
        prior[-1] = math.log(language.UNKNOWN_PRIOR)
        soft = np.exp(log + prior - (log + prior).max())
        soft = soft / soft.sum() if len(grams) else np.zeros(k)
        host = url.split("://")[1].split("/")[0].split(":")[0].lower() if url and "://" in url else None
        parts = host.split(".") if host else []
        declared = (declared or "").split("-")[0].lower() or None
        own.append((log, soft, len(grams), declared, parts[-1] if len(parts) > 1 else None, host, ".".join(parts[-2:]) if host else None))
    sums = [defaultdict(lambda: np.zeros(k)) for _ in range(4)]
    for o in own:
        for level, key in zip(sums, o[3:]):
            if key is not None:
                level[key] += o[1]
    total, out = sum(o[1] for o in own), []
    for row, (log, soft, n, declared, suffix, host, domain) in zip(rows, own):
        every = np.maximum(total - soft, 0)
        prior = (every + 1 / k) / (every.sum() + 1)
        for level, key in ((sums[3], domain), (sums[2], host)):
            if key is not None:
                have = np.maximum(level[key] - soft, 0)
                prior = (have + language.PRIOR_ROWS * prior) / (have.sum() + language.PRIOR_ROWS)
        power = log + np.log(prior)
        for level, key in ((sums[0], declared), (sums[1], suffix)):
            if key is not None:
                power = power + np.log((np.maximum(level[key] - soft, 0) + 1) / (every + len(level) + 1))
        power = np.exp(power - power.max())
        out.append((row[0], names[int(power.argmax())] if n else "und", round(float(power.max() / power.sum()), 5) if n else 0.0))
    return out


def test_fusion_against_plain_version(spark, model):
    rows = pages()
    docs = spark.createDataFrame(rows, "page_id long, declared string, url string, text string").repartition(3)
    docs = docs.selectExpr("*", "1 AS soft", "'x' AS host", "2 AS row")
    got = language.identify(docs, model, "page_id", "text", declared_col="declared", url_col="url").collect()
    want = sorted(plain(rows, model), key=repr)
    found = sorted(((r.id, r.lang, round(r.confidence, 5)) for r in got), key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want], abs=2e-5)
    by = {r.id: r for r in got}
    assert by[300].lang == "de" and by[303].lang == "en"  # the text outweighs a wrong declaration
    alone = {r.id: r.lang for r in language.identify(docs.select("page_id", "text"), model, "page_id", "text").collect()}
    assert by[301].lang == "de" and by[302].lang == "fr" and alone[302] != "fr"  # host and declaration decide what the text leaves open


def test_pages_in_markup(spark, model):
    rows = [(1, "http://a.de", '<html class="x" lang="de"><body><p>das haus und der garten</p></body></html>'), (2, None, None), (3, "", ""), (4, "http://b.fr", "<p>la maison et le jardin</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in language.identify(docs, model, "page_id", "html", url_col="url", from_html=True).collect()}
    assert got[1].declared == "de" and got[1].lang == "de" and got[4].lang == "fr"
    assert got[2].lang == got[3].lang == "und" and got[2].confidence == 0.0
    assert language.identify(docs.where("false"), model, "page_id", "html", url_col="url", from_html=True).count() == 0
