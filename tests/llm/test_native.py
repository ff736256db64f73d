"""Quality rules, URL filter and line dedup against brute force, with the awkward cases of each."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seqloom.llm import lines, quality, urls

WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def statistics(text):
    text = text or ""
    found = re.findall(WORD, text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    failed = len(found) < 20 or 100 * len(covered) > 30 * len(found)
    signs = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), signs, dup, len(covered), failed


def awkward_texts():
    rnd = random.Random(5)
    texts = [None, "", " \n\t ", "a", "é " * 30, "one two three four five six seven eight " * 5]
    texts += ["x\n\nx\n \nx\n", "w " * 3000, "##$ %% <a>|b&*\n" * 4]
    for _ in range(40):
        n = rnd.randint(1, 200)
        texts.append("".join(rnd.choice(["ab", "c", "Dé", "😀"]) + rnd.choice([" ", " ", "\n", "\t", "\x0b"]) for _ in range(n)))
    return texts


def test_statistics_match_brute_force(make_docs):
    texts = awkward_texts()
    got = {
        r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in quality.with_statistics(make_docs(list(enumerate(texts)))).select("doc.doc_id", "*").collect()
    }
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def labelled(spark, make_docs, n=400):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        found = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(40, 80))]
        junk = i % 4 == 0
        rows.append((i, " ".join(w[:-2] + "##" if junk else w for w in found)))
        labels.append((i, 0 if junk else 1))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_learned_list_separates_held_out_rows(spark, make_docs):
    docs, labels, truth = labelled(spark, make_docs)
    rules = quality.learn(docs, labels.filter("doc_id % 2 = 0 OR doc_id % 8 = 4"))
    assert rules and "symbols_per_word" in str(rules[0])
    judged = quality.judge(docs, rules).select("doc.doc_id", "kept").collect()
    assert all(r["kept"] == (truth[r["doc_id"]] == 1) for r in judged)


def test_no_use_of_bad_labels(spark, make_docs):
    docs, labels, _ = labelled(spark, make_docs, 80)
    assert quality.learn(docs, labels.limit(0)) == []
    assert quality.learn(docs, labels.filter("quality = 1")) == []
    flipped = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert quality.learn(docs, flipped) == []
    assert quality.learn(docs, labels.withColumn("quality", F.lit(None).cast("int"))) == []


def test_keep_good_returns_the_columns(spark, make_docs):
    docs, labels, truth = labelled(spark, make_docs)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, q in truth.items() if q == 1}
    assert quality.keep_good(docs.limit(0), labels).count() == 0


RULES = "('net','/','net/','block'),('example.net','/en/','example.net/en/','allow'),('org','/fr/','org/fr/','allow')"


def test_url_rules(spark):
    rules = spark.sql(f"SELECT * FROM VALUES {RULES} AS r(host, path, rule, verdict)")
    cases = {
        "http://a.Example.NET/en/x?y": ("net", "example.net/en/", "allow"),
        "http://example.net/de/": ("net", "net/", "block"),
        "http://example.net": ("net", None, "allow"),
        "http://notexample.net/en/1": ("net", "net/", "block"),
        "https://b.org/fr/1#z": ("org", "org/fr/", "allow"),
        "https://b.org/de": ("org", None, "allow"),
        "http://listed.com/page": ("com", None, "block"),
        "http://listed.com/page#part": ("com", None, "block"),
        "http://Listed.com:80/page": ("com:80", None, "block"),
        "https://listed.com.:443/page": (":443", None, "block"),
        "https://listed.com./page": ("com.", None, "block"),
        "https://listed.com:80/page": ("com:80", None, "allow"),
        "http://listed.com/page?q=1": ("com", None, "allow"),
        "http://video.com/watch?v=1": ("com", None, "block"),
        "http://video.com/watch?v=2": ("com", None, "allow"),
        "http://video.com/watch": ("com", None, "allow"),
        "http://bare.com": ("com", None, "block"),
        "http://bare.com/?": ("com", None, "allow"),
        "http://listed.com/page2": ("com", None, "allow"),
        "no url": ("", None, "allow"),
        "": ("", None, "allow"),
        None: ("", None, "allow"),
    }
    rows = [(n, u, "clash") for n, u in enumerate(cases)] + [(0, "http://a.Example.NET/en/x?y", "again"), (None, "x://net/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://listed.com/page",), ("http://video.com:80/watch?v=1#t",), ("http://bare.com/",), (None,)], "url string")
    found = urls.judge_urls(pages, rules, listed).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r for r in found}
    for n, (end, rule, verdict) in enumerate(cases.values()):
        assert by_id[n]["host"].endswith(end) and by_id[n]["rule"] == rule and by_id[n]["verdict"] == verdict
    assert by_id[None]["verdict"] == "block"
    assert urls.judge_urls(pages, rules.limit(0)).filter("verdict <> 'allow'").count() == 0
    assert urls.judge_urls(pages.limit(0), rules, listed).count() == 0


def test_no_false_positive_of_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_ENTRY", 1)
    listed = spark.range(500).select(F.concat(F.lit("http://h.com/"), F.col("id")).alias("url"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), F.col("id")).alias("url"))
    none = spark.sql(f"SELECT * FROM VALUES {RULES} AS r(host, path, rule, verdict)").limit(0)
    found = urls.judge_urls(pages, none, listed)
    assert {r["page_id"] for r in found.filter("verdict = 'block'").collect()} == set(range(500))


def dedup(rows, min_chars, min_docs):
    holders = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                key = ascii_lower(line.strip(strip))
                if len(key) >= min_chars:
                    holders[key].add(i)
    out = []
    for i, t in rows:
        kept, n = [], (t or "").split("\n")
        for line in n:
            h = holders.get(ascii_lower(line.strip(strip)), set())
            if i is None or len(h) < min_docs or max(h) == i:
                kept.append(line)
        out.append((i, len(n), len(n) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup_matches_brute_force(make_docs):
    rnd = random.Random(3)
    pool = ["", "short", "Common line of many", " common LINE of many\t", "é" * 12, "É" * 12, "another quite long line"]
    rows = [(rnd.choice([None, i, i, i, 7]), "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    rows += [(99, None), (100, ""), (3, rows[3][1]), (-5, "Common line of many\n" * 400)]
    got = lines.dedup_lines(make_docs(rows), min_chars=12)
    found = [
        (r["doc_id"], r["n_lines"], r["n_dropped"], r["sha"])
        for r in got.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("sha")).collect()
    ]
    assert Counter(found) == Counter(dedup(rows, 12, 3))
    assert lines.dedup_lines(make_docs(rows).limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for top in (400, 300, 200, 100, 0):
        runs.add(spark.range(50).select(F.col("id").alias("h1"), F.lit(1).cast("long").alias("h2"), (F.col("id") + top).alias("doc")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    folders = list(runs.paths.values())
    assert len(folders) == 2 and all(os.path.isdir(path) for path in folders)
    total = runs.totals().collect()
    assert len(total) == 50 and all(r["n_docs"] == 5 and r["holder"] == r["h1"] + 400 for r in total)
    runs.drop()
    assert not any(os.path.exists(path) for path in folders) and not runs.paths
