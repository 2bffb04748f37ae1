"""URL rules and trees, toxicity, decontamination."""

import random
import re

import brute
import numpy as np
from pyspark.sql import functions as F

from quarry.llm import decontaminate, toxicity, url_filter
from quarry.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/1x", "http://example.org/es/a", "http://a.example.org/es/a",
        "http://notexample.org/es/", "http://x.com/de/", "http://x.com/fr", "http://x.com?/fr/", "http://x.com#/fr/", "http://com/fr/q?a=b",
        "http://xcom/fr/", "http://u:p@h.org:80/p", "a://b://c/d", "http://example.org", "http://x.net/%20?a&b=c", "http://ÄB.org/ü\n/x"]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(brute.FOLD), re.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fits = []
    for rule, verdict in URL_RULES.items():
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def test_trees_judge_held_out_urls(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        host = f"{'x' * rng.randint(1, 3)}{rng.randint(10**6, 10**8)}.top" if bad else f"{rng.choice(['news', 'blog', 'shop'])}{rng.randint(1, 99)}.net"
        path = "/" + "/".join(str(rng.randint(0, 10**9)) for _ in range(4)) + "?a=1&b=2&c=3" if bad else f"/{rng.choice(['a', 'about', 'story'])}.html"
        rows.append((i, f"http://{host}{path}", 1.0 if bad else 0.0))
    table = spark.createDataFrame(rows, "page_id long, url string, label double")
    train = table.where("page_id % 4 <> 0").select("url", "label")
    out = url_filter.judge(table.where("page_id % 4 = 0"), {}, train).join(table, "page_id")
    right = out.agg(F.avg(((F.col("verdict") == "block") == (F.col("label") == 1.0)).cast("int"))).first()[0]
    assert right > 0.95
    assert out.where("rule is not null").count() == 0


def test_urls_defined_cases(spark):
    schema = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], schema), URL_RULES).count() == 0
    rows = url_filter.judge(spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://b.org/")], schema), URL_RULES).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["horrid", "vile", "nastyish", "nastyest"]))
        if rng.random() < (0.8 if toxic else 0.1):
            w.insert(0, "muslim")
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(*r[:2], 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if got[r[0]].held_out]
    assert 40 < len(held) < 120
    assert sum(got[r[0]].predicted == r[2] for r in held) >= 0.95 * len(held)
    neutral = [(0, "a muslim lives here"), (1, "a christian lives here"), (2, None), (3, "")]
    model = toxicity.train(docs.select("doc_id", "text"), labels.selectExpr("doc_id", "cast(toxic as double) as label"))
    import pyarrow as pa
    s = model.scores(pa.array([t for _, t in neutral]))
    assert abs(s[0] - s[1]) < 0.1 and s[0] < 0.5 and s[2] == s[3] < 0.5


def test_swap_penalty_shrinks_identity_weights():
    labels = np.array([1.0] * 30 + [0.0] * 30)
    own = [np.array([0, 2])] * 30 + [np.array([1])] * 30  # 0: identity, 1: plain, 2: insult, 3: other identity
    swap = [np.array([2, 3])] * 30 + [None] * 30
    w_free, _ = toxicity.fit(labels, own, [None] * 60, 4)
    w_held, _ = toxicity.fit(labels, own, swap, 4)
    assert abs(w_held[0] - w_held[3]) < 0.5 * abs(w_free[0] - w_free[3]) and w_held[2] > 1


def test_swapped_terms_stay_in_their_group():
    assert toxicity.swapped("He met a Muslim woman; other men") == "she met a jewish man; other women"


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, odd).collect()] == [0, 0, 0]


def leak_rows():
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "nd", "mp", "x")]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = []
    for i in range(25):
        own = [f"term{i}x{k}" for k in range(rng.randint(4, 9))]
        body = prose(rng.randint(8, 25)) + own
        rng.shuffle(body)
        items.append((i, " ".join(body).capitalize() + ". " + " ".join(rng.sample(own, 3) + prose(3)).capitalize() + "."))
    docs, held = [], set()
    for d in range(160):
        words = prose(rng.randint(30, 300))
        if d % 4 == 0:
            i = rng.randrange(25)
            at = rng.randrange(len(words))
            text = items[i][1]
            if d % 8 == 0:  # a paraphrase: some words dropped, others put in
                w = text.split()
                keep = [x for k, x in enumerate(w) if k % 6 != 2]
                text = " ".join(y for x in keep for y in ([x, "really"] if rng.random() < 0.1 else [x]))
            words[at:at] = [text]
            held.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, held


def test_leaks_and_paraphrases_are_found_and_clean_documents_stay(spark):
    docs, items, held = leak_rows()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert found == held
    kept = {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in held}
    for d, text in docs:
        for i, t in items:
            if brute.holds(text, t):
                assert (d, i) in found


def quoted_rows():
    """Items of two sentences, quoted without the last one: word for word (first 25 documents), and with that
    sentence's words replaced and one more word lost (next 25)."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items, docs = [], []
    for i in range(50):
        n = rng.randint(9, 24) if i < 25 else rng.randint(18, 24)
        head = [word() for _ in range(n)]
        tail = [word() for _ in range(rng.randint(3, 6) if i < 25 else 3)]
        items.append((i, " ".join(head).capitalize() + ". " + " ".join(tail).capitalize() + "."))
        quote = head if i < 25 else head[:n // 2] + head[n // 2 + 1:]
        docs.append((i, " ".join([word() for _ in range(80)] + quote + [word() for _ in range(80)])))
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(100)]
    return docs, items


def test_quotes_without_the_last_sentence_are_leaks(spark):
    docs, items = quoted_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(found) == {(i, i) for i in range(50)}
    assert all(r.answer_common * 100 < 60 * r.answer_words for r in found.values())
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()} == set(range(100, 200))


def test_weak_paraphrases_need_the_answer():
    item, other = np.arange(30), np.arange(100, 130)
    mixed = np.where(np.arange(30) % 3 == 0, other, item)  # 20 of 30 words, in runs of two
    assert not decontaminate.sure(item, mixed, 20)
    assert decontaminate.sure(item, item[:20], 20) and decontaminate.sure(item, mixed, 24)
    assert not decontaminate.sure(item[:8], item[:5], 5)


def test_an_item_in_a_third_of_the_documents_keeps_its_terms(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    stop = ["the", "of", "and", "to", "in", "that", "is", "was"]
    say = lambda: rng.choice(stop) if rng.random() < 0.4 else word()
    items = [(i, " ".join(say() for _ in range(30)) + ".") for i in range(40)]
    docs = []
    for d in range(450):
        body = [say() for _ in range(160)]
        if d % 3 == 0 or d < 40:
            quote = items[0 if d % 3 == 0 else d][1].split()
            for k in rng.sample(range(20), 6) + rng.sample(range(20, 30), 3):
                quote[k] = say()
            body[70:70] = quote
        docs.append((d, " ".join(body)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, 0 if d % 3 == 0 else d) for d in range(450) if d % 3 == 0 or d < 40}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    docs, items, held = leak_rows()
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 9)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == held


def test_leaks_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta"), (None, "x")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, None), (2, "..."), (3, "Alpha beta gamma, delta epsilon zeta!"), (None, "alpha")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.common_words) for r in decontaminate.leaks(docs, bench).collect()] == [(3, 3, 6)]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == 3


def test_leaks_equal_a_search_of_all_passages(spark):
    docs, items, _ = leak_rows()
    docs = [(d, " ".join(t.split()[:150])) for d, t in docs[:72]]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, x in items if brute.leaked(t, x)}
    assert len(want) > 8 and {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_long_items_are_found_by_their_parts(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n)) + ".") for i, n in enumerate([500] * 10 + [97, 130, 40, 1600])]
    docs = [(i, " ".join([word() for _ in range(60)] + t.split() + [word() for _ in range(60)])) for i, t in items]
    docs += [(100 + i, " ".join(t.split()[:len(t.split()) * 7 // 10] + [word() for _ in range(90)])) for i, t in items]
    docs += [(200 + i, " ".join(t.split()[:len(t.split()) * 4 // 10] + [word() for _ in range(90)])) for i, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(h + i, i) for i, _ in items for h in (0, 100)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1200)
    assert [len(b) for b in decontaminate.blocks_of(iter(items), lambda r: r)] == [2, 2, 2, 2, 3, 2, 1]  # 500 + 500 + 97 words fit into 1200


def test_documents_without_an_id_are_judged(spark):
    leak, clean = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(None, f"so {leak} it is", 1, "a"), (None, clean, 2, "b"), (None, f"so {leak} it is", 3, "c"), (7, f"well {leak}", 4, "d"),
            (7, clean, 5, "e"), (None, None, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, __leaked string")
    bench = spark.createDataFrame([(1, leak + ".")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(docs, bench).collect()) == ["7", "None"]
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == [2, 5, 6]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == table[-1][-1]
