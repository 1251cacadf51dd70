import itertools
import math
import random
import re
from collections import Counter

import regex

from sigloom.llm.queries_pages import RULES
from sigloom.llm.url_filter import judge_urls, viterbi


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def brute_split(unit, counts, total):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        words, word = [], unit[0]
        for c, cut in zip(unit[1:], cuts):
            if cut:
                words.append(word)
                word = c
            else:
                word += c
        words.append(word)
        score = sum((math.log(counts[w]) if w in counts else math.log(10) * (1 - len(w))) - math.log(total) for w in words)
        if best is None or score > best[0] + 1e-9:
            best = (score, words)
    return best


def test_viterbi_is_the_best_split():
    counts = {"the": 50, "cat": 9, "at": 20, "hec": 2, "a": 30, "t": 5, "pills": 4, "cheap": 3}
    for unit in ("thecat", "cheappill", "cheappills", "x", "atat", "qzthe"):
        words = {(i, n): counts[unit[i : i + n]] for i in range(len(unit)) for n in range(1, len(unit) + 1) if unit[i : i + n] in counts and i + n <= len(unit)}
        got = viterbi(unit, words, 200)
        assert "".join(got) == unit
        score = sum((math.log(counts[w]) if w in counts else math.log(10) * (1 - len(w))) - math.log(200) for w in got)
        assert abs(score - brute_split(unit, counts, 200)[0]) < 1e-9


def brute_verdicts(urls, texts):
    letters = Counter(w for t in texts if t for w in regex.findall(r"\p{L}+", t.lower()))
    total = sum(letters.values()) or 1

    def tokens(url):
        host, path = split(url)
        out = []
        for run in regex.findall(r"\p{L}+|\p{N}+", host.lower()):
            if run[0].isalpha():
                words = {(i, n): letters[run[i : i + n]] for i in range(len(run)) for n in range(1, len(run) + 1) if letters.get(run[i : i + n]) and i + n <= len(run)}
                out += ["host " + w for w in viterbi(run, words, total)]
            else:
                out.append("host " + run)
        return out + ["path " + x for x in regex.findall(r"\p{L}+|\p{N}+", path.lower())]

    seen = {v: Counter() for v in ("allow", "block")}
    pages, vocabulary = Counter(), set()
    for url in urls:
        own, (_, verdict) = tokens(url), ruled(*split(url))
        vocabulary.update(own if verdict else [w for w in own])
        if verdict:
            pages[verdict] += 1
            seen[verdict].update(own)
    size = {v: sum(seen[v].values()) + len(vocabulary) for v in seen}
    out = []
    for url in urls:
        host, path = split(url)
        rule, verdict = ruled(host, path)
        score = None
        if verdict is None:
            score = math.log((pages["block"] + 1) / (pages["allow"] + 1))
            for t in tokens(url):
                score += math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"])
            verdict = "block" if score > 0 else "allow"
        out.append((url, host, path, rule, verdict, score))
    return out


def test_pages_and_odd_urls(spark, sf):
    odd = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "ftp://example.net/es/", "a://notcom/", "x://é.example.org/ÀB/1"]
    odd += ["http://www.example.com", "http://sub.www.example.com/en/", "http://com/", "http://" + "k" * 300 + ".org/" + "p" * 3000, "http://h.com://x/"] * 2
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(odd)], "page_id long, url string, rule string, n long")
    pages = pages.unionByName(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), allowMissingColumns=True)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    urls = [r.url for r in pages.collect()]
    want = brute_verdicts(urls, [r.text for r in docs.collect()])
    got = [(r.row.url, r.host, r.path, r.rule, r.verdict, r.score) for r in judge_urls(pages, docs, RULES).collect()]
    by = lambda x: repr(x[:5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=by), sorted(want, key=by)):
        assert a[:5] == b[:5]
        assert (a[5] is None) == (b[5] is None) and (a[5] is None or abs(a[5] - b[5]) < 1e-6)


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert judge_urls(pages, docs, RULES).count() == 0
    some = spark.createDataFrame([(1, "http://abc.org/x"), (2, None)], pages.schema)
    assert {r.verdict for r in judge_urls(some, docs, RULES).collect()} == {"allow"}


def test_words_of_any_length_are_found(spark):
    from sigloom.llm.url_filter import segmented

    long = "donaudampfschifffahrtsgesellschaft"
    units = spark.createDataFrame([(f"{long}shop",), ("x" * 60,)], "unit string")
    texts = spark.createDataFrame([(f"{long} shop " * 20,)], "text string")
    got = {r.unit: r.words for r in segmented(units, texts).collect()}
    assert got == {f"{long}shop": [long, "shop"], "x" * 60: ["x" * 60]}


def test_a_host_of_fifty_thousand_letters(spark):
    from sigloom.llm.url_filter import segmented

    name = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=50_000))
    texts = spark.createDataFrame([(f"{name} shop",), ("abcdefghijkl " * 9,)], "text string")
    units = spark.createDataFrame([(name + "shop",), ("abcdefghijklshop",), (name[5:],)], "unit string")
    got = {r.unit: r.words for r in segmented(units, texts).collect()}
    assert got[name + "shop"] == [name, "shop"] and got["abcdefghijklshop"] == ["abcdefghijkl", "shop"]
    assert "".join(got[name[5:]]) == name[5:]
