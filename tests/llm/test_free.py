"""The operators with work in Python tasks, against brute force or the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import bpe, components, decontaminate, html, lm, simhash, substrings, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = (
    "a b the é ç 1 23 ! 's 're 'r 'v 'l 'll ' '' 'e don't <|endoftext|> <|startoftext|> 日本 😀 %%% and ing ſ Σ ΑΣ İ Ⅷ ² ß <| |>"
).split() + [" ", "  ", "\n", "\n\n", "\t", "\xa0", "́"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def strange_texts(n, seed):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 150))) for _ in range(n)]
    return out + ["", "aaaa" * 300, "ab" * 900, " " * 700, "\n" * 50, "né" * 333, "日" * 400, "'" * 99, "'r"]


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_bpe_is_that_of_the_library(leaf):
    codec, real = bpe.Codec(BYTE_BPE), library(BYTE_BPE)
    texts = strange_texts(150, leaf)
    for text, ids in zip(texts, codec.encode_many(texts, leaf)):
        assert ids == real.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == real.decode(ids, skip_special_tokens=False)


def test_bpe_columns(make_docs):
    rows = [(1, None), (1, ""), (None, "hello  world" * 50), (4, "né")]
    docs = make_docs(rows)
    real = library(BYTE_BPE)
    for r in docs.select("text", bpe.encode(F.col("text"), BYTE_BPE).alias("ids"), bpe.digest(F.col("text"), BYTE_BPE, 16).alias("d")).collect():
        ids = real.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["d"]["n_tokens"] == len(ids)
        assert r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = docs.select("text", bpe.decode(bpe.encode(F.col("text"), BYTE_BPE), BYTE_BPE).alias("back"))
    assert all(r["back"] == (r["text"] or "") for r in back.collect())
    assert docs.limit(0).select(bpe.digest(F.col("text"), BYTE_BPE)).count() == 0


def test_token_counts_are_those_of_the_library(spark, make_docs):
    texts = strange_texts(400, 9)
    real = [len(e.ids) for e in library(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    docs = make_docs([*enumerate(texts), (-1, None)])
    counted = docs.select("doc_id", tokencount.count_tokens(spark, F.col("text"), WORD_BPE).alias("n"))
    assert {r["doc_id"]: r["n"] for r in counted.collect()} == {**dict(enumerate(real)), -1: 0}


def test_counter_survives_forgetting(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 20)
    monkeypatch.setattr(tokencount, "MAX_PIECES", 5)
    counter = tokencount.Counter(WORD_BPE, tokencount.character_classes(WORD_BPE))
    texts = strange_texts(50, 4)
    real = [len(e.ids) for e in library(WORD_BPE).encode_batch(texts, add_special_tokens=False)]
    assert [int(counter.count([t])[0]) for t in texts] == real


def fingerprint(text):
    found = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_matches_brute_force(make_docs):
    rnd = random.Random(8)
    base = [[rnd.choice("ab cd ef gh ij kl".split()) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(1, 200))] for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(base))) for i in range(60)]
    for i in range(60, 120):
        changed = list(rnd.choice(base))
        changed[rnd.randrange(len(changed))] = "X"
        rows.append((i, " ".join(changed)))
    rows += [(200, None), (201, ""), (202, " \n"), (3, rows[5][1]), (None, rows[7][1]), (None, "alone at last here")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    want = Counter((i, prints[n], least.get(find(n))) for n, (i, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.keep_one(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_links_within_two_bits_are_complete(spark):
    rnd = random.Random(6)
    points = {rnd.getrandbits(64) for _ in range(40)}
    points |= {p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for p in list(points) for _ in range(6)}
    points |= {p ^ 1 for p in list(points)[:20]}
    values = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    for a in values:
        for b in values:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2 and a != b:
                assert got[a] == got[b]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 400)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in (5, *range(200, 400))}}
    assert components.components(links.limit(0)).count() == 0


def test_substrings_match_brute_force(make_docs):
    rnd = random.Random(4)

    def some(n):
        return [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]

    shared = [some(n) for n in (34, 35, 36, 60, 200)]
    texts = [None, "", "few words", "same " * 200, " ".join(some(70) * 3)]
    for _ in range(60):
        parts = some(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            piece = rnd.choice(shared)
            cut = rnd.randint(0, 10) if rnd.random() < 0.5 else 0
            parts += piece[cut : len(piece) - rnd.choice([0, 0, 3])] + some(rnd.randint(0, 5))
        texts.append("  ".join(parts) + "\n")
    rows = list(enumerate(texts)) + [(3, texts[8]), (None, texts[9]), (None, " ".join(some(90)))]
    found = [re.findall(WORD, t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in found for i in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(rows, found):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substrings.remove_repeats(make_docs(rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert substrings.remove_repeats(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_base_scores_and_counts(make_docs, monkeypatch, head):
    monkeypatch.setattr(lm, "MAX_HEAD", head)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("The of and To b c d".split()) + str(int(rnd.expovariate(0.3))) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "The0 unseen"), (rows[4][0], rows[4][1])]
    tokens = [[*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), h, len(w), sum(counts[t] > 0 for t in w), total, round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in w), 6))
        for (i, _), w, h in zip(rows, tokens, held)
    )
    got = lm.score_documents(make_docs(rows)).collect()
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(make_docs(rows).limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_texts(make_docs):
    rnd = random.Random(2)
    follow = {w: [f"{w}{k}" for k in range(3)] for w in "abcdefgh"}
    rows = [(i, " ".join(x for _ in range(40) for x in (lambda w: (w, rnd.choice(follow[w])))(rnd.choice("abcdefgh")))) for i in range(300)]
    got = [r for r in lm.score_documents(make_docs(rows)).collect() if r["held_out"]]
    assert len(got) > 10 and all(r["score"] > r["base_score"] for r in got)


def test_filter_reads_counts_back():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = np.random.default_rng(4).integers(1, 5000, 4000).astype(np.uint64)
    bits = lm.filter_of(keys >> lm.LEFT_OUT, counts, lm.UNIGRAM)
    read = lm._middle(lm.levels_in(bits, keys >> lm.LEFT_OUT, lm.UNIGRAM))
    # False positives only ever raise a level, and seldom.
    assert (read >= counts / 1.25).all() and (read <= counts * 1.25 + 1).mean() > 0.95
    other = np.random.default_rng(5).integers(0, 1 << 63, 4000).astype(np.uint64) >> lm.LEFT_OUT
    assert (lm.levels_in(bits, other, lm.UNIGRAM) > 0).mean() < 0.05
    assert not lm.levels_in(b"", other, lm.PAIR).any()


def test_keys_and_counts_come_back_from_their_short_form():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 5000):
        keys = np.sort(rnd.integers(0, 1 << 40, n).astype(np.uint64))
        keys[: n // 10] = keys[0] if n else 0
        assert (lm.decoded(lm.coded(keys), n) == keys).all()
        counts = np.r_[np.ones(n, np.int64), [254, 255, 256, 1 << 40]]
        assert (lm._decoded_counts(lm._coded_counts(counts)) == counts).all()


def test_leaks_match_brute_force(spark, make_docs, monkeypatch):
    rnd = random.Random(7)

    def some(n):
        return [rnd.choice("the of and".split()) if rnd.random() < 0.4 else f"w{rnd.randint(0, 400)}" for _ in range(n)]

    texts = [some(rnd.randint(12, 50)) for _ in range(25)]
    items = [(n, " ".join(t)) for n, t in enumerate(texts)] + [(3, items_text := "Qq, Rr ss! tt uu"), (None, "x y z u v w"), (60, None), (61, ""), (62, "two words"), (63, items_text), (64, "what is two plus"), (65, " ".join(long_item := some(900)))]
    rows = [(i, " ".join(some(300))) for i in range(20)]
    for i in range(20, 60):
        n = rnd.randrange(25)
        rows.append((i, " ".join(some(rnd.randint(0, 200)) + [w.upper() for w in texts[n]] + some(rnd.randint(0, 200))) + "%%%"))
    rows += [(70, None), (71, ""), (None, items[0][1]), (72, "qq rr Ss tt uu")]
    rows += [(73, "so: what is, two plus more"), (74, "what two is plus two, words"), (75, " ".join(some(50) + long_item + some(700)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = [(i, " " + " ".join(re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").lower().split()) + " ") for i, t in rows]
    want = set()
    for n, t in items:
        words = re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").lower().split()
        if n is not None and words:
            want |= {(i, n) for i, p in plain if f" {' '.join(words)} " in p}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make_docs(rows), bench).collect()}
    assert want == got and len(want) > 40
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    again = decontaminate.contaminated(make_docs(rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in again.collect()} == got
    clean = decontaminate.drop_contaminated(make_docs(rows), bench)
    assert clean.columns == make_docs(rows).columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(make_docs(rows), bench.limit(0)).count() == 0


def test_edited_items_are_found_and_loose_words_are_not(spark, make_docs):
    words = [f"w{n}" for n in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(n, " ".join(["x"] * 30 + words[:n] + ["changed"] + words[n + 1 :] + ["y"] * 30)) for n in range(40)]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(make_docs(rows), bench).collect()}
    assert set(got) == set(range(40))
    assert got[35]["answer_overlap"] < 0.5 and got[5]["question_overlap"] < 0.9
    loose = [(100, " ".join(words[::-1])), (101, " ".join(words[:30])), (102, " ".join(words[:20] + ["z"] * 9 + words[32:]))]
    assert decontaminate.contaminated(make_docs(loose), bench).count() == 0


def test_wand_retrieves_all_above_the_threshold():
    rnd = random.Random(5)
    rows = [(i, [f"t{rnd.randint(0, 60)}" for _ in range(20)], [(f"t{t}", rnd.random() / 8) for t in rnd.sample(range(60), 15)]) for i in range(300)]
    block = decontaminate.Block(rows)
    for _ in range(200):
        terms = rnd.sample(range(len(block.terms)), rnd.randint(1, 30))
        scores = Counter()
        for t in terms:
            for i, x in zip(block.items[t], block.impacts[t]):
                scores[int(i)] += x
        for threshold in (0.1, 0.4, 0.8):
            want = {i for i, s in scores.items() if s >= threshold - 1e-9}
            assert {i for i, _ in block.retrieve(terms, threshold)} == want


def test_minimum_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(1, 9)
        scores = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.random()) for a in range(n) for b in range(a) if rnd.random() < 0.5]

        def cost(side):
            return sum(max(-s, 0) if c else max(s, 0) for s, c in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.min_cut(scores, edges)) == pytest.approx(best)


ARTICLE = "<h1>Head</h1><p>" + "First words of the text, and some more of them. " * 3 + "</p><p>Then a second part that goes on.</p>"
ARTICLE_TEXT = "Head\n" + ("First words of the text, and some more of them. " * 3).strip() + "\nThen a second part that goes on."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
LAYOUTS = [
    f"{NAV}<article>{ARTICLE}</article><footer>made by us</footer>",
    f'<div class="content no-sidebar">{NAV}<article>{ARTICLE}</article></div>',
    f'<div id="page" class="has-header"><article>{ARTICLE}</article></div>',
    f'<div id="page" class="with-footer is-search"><div>{ARTICLE}</div></div>',
    f'<div class="search-page"><main>{ARTICLE}</main></div><div class="search">Find things here</div>',
    f'<div class="header-wrap comments-open"><main><article>{ARTICLE}</article></main></div>',
    f'<main><div class="widget-area"><article>{ARTICLE}</article></div><div class="widget-area">Other things to see</div></main>',
    f'<article>{ARTICLE}</article><section class="comments"><article><p>I like this text a lot, thank you.</p></article></section>',
    f'<article>{ARTICLE}</article><div class="related"><article><h3><a href="/x">Another story</a></h3></article></div>',
    f'<article>{ARTICLE}<div class="share"><a href="/t">Tell a friend</a></div></article>',
    f"<body><header><p>The name of the site</p></header>{ARTICLE}<aside><p>Look at this too</p></aside>",
    f'<article>{ARTICLE}</article><form><label>Name</label><button>Send it</button></form>',
    f'<div role="navigation"><a href="/">Home page</a></div><div class="post">{ARTICLE}</div>',
    f'<article>{ARTICLE}</article><div style="display: none">Not to be seen at all</div>',
    f'<article>{ARTICLE}</article><button>Go to top</button><svg><text>drawn</text></svg>',
    f'<div class="cookie-consent"><p>We keep small files on your machine, do you agree?</p></div><article>{ARTICLE}</article>',
]


@pytest.mark.parametrize("number", range(len(LAYOUTS)))
def test_the_article_is_found_in_many_layouts(number):
    assert html.main_text(LAYOUTS[number]) == ARTICLE_TEXT


def test_text_of_formulas_and_buttons_in_a_paragraph_stays():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and press <button>Run</button> to see what comes out.</p></article>"
    assert html.main_text(page) == "Let x=2 and press Run to see what comes out."


def test_long_and_deep_pages_take_time_in_proportion():
    long_page = NAV + "<article>" + "".join(f"<p>Paragraph {n} with some words.</p>" for n in range(20000)) + "</article><footer>end</footer>"
    deep = "".join(f"<div>Level {n} has its own words." for n in range(20000))
    mixed = "".join(f'<p>Paragraph {n} with some words in it.</p><div class="ad">Buy {n}</div>' for n in range(10000))
    start = time.monotonic()
    assert html.main_text(long_page).count("\n") == 19999
    assert html.main_text(deep).count("\n") == 19999
    assert html.main_text(mixed).count("\n") == 9999
    assert time.monotonic() - start < 30


def test_html_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, html string, text string")
    assert pages.select("page_id", html.extract(F.col("html")).alias("text")).count() == 0


def test_html_extraction(spark):
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>"
        '<nav><ul><li><a href="/a">Menu one</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>Title &amp; more</h1><p>First <b>para</b>\n of&nbsp;text.<p>Second &#233; <i>one</i><br>goes on"
        '<script>var a="</p><p>x";</script></article><div class="ad banner">Buy now</div>'
        '<section id="comments"><p>Nice post, a long reader comment indeed it is.</p></section>'
        '<form><p>Your name</p><input></form><aside>Side bar</aside><footer>&copy; site</footer>'
    )
    want = "Title & more\nFirst para of text.\nSecond é one goes on"
    rows = [(1, page), (2, None), (3, ""), (4, "<nav><a>only</a></nav>"), (1, page), (None, "<p>" * 3000 + "deep text " * 500)]
    got = spark.createDataFrame(rows, "page_id long, html string").select("page_id", html.extract(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in got if r["page_id"] == 1] == [want, want]
    assert {r["t"] for r in got if r["page_id"] in (2, 3, 4)} == {""}
    assert [r["t"] for r in got if r["page_id"] is None] == [("deep text " * 500).strip()]
