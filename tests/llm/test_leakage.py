import random

from tidemark.llm.leakage import Automaton, leaks, words

ITEMS = "item_id long, text string"
TEXTS = "doc_id long, text string, items string"


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t, *_ in docs for w in [words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_matches_every_window(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    docs = [(d, " ".join(rng.choice([*vocab, "other"]) for _ in range(rng.randrange(0, 60))), "x") for d in range(120)]
    docs += [(500, "W0​ W­1 ... " + items[0][1].upper(), "x"), (501, None, "x"), (502, "", "x"), (1, docs[1][1], "x")]
    items += [(99, None), (98, ""), (97, items[0][1])]
    t, i = spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, ITEMS)
    for n, share in ((5, 10**6), (4, 40)):
        got = leaks(t, i, key="doc_id", text="text", item_key="item_id", item_text="text", min_words=n, clean=True, max_words=share).collect()
        assert {(r.doc_id, x) for r in got for x in r["items"]} == brute(docs, items, n)


def test_invisible_characters_and_case():
    assert words("He​l­lo_Wörld  ﻿ÀB 12-3") == ["hello", "wörld", "àb", "12", "3"]


def test_spans_and_rest(spark):
    item = " ".join(f"x{i}" for i in range(13))
    d = spark.createDataFrame([(1, f"before {item} after", "x")], TEXTS)
    i = spark.createDataFrame([(7, item)], ITEMS)
    r = leaks(d, i, key="doc_id", text="text", item_key="item_id", item_text="text", clean=True).first()
    assert (r.spans[0].first_word, r.spans[0].last_word, r.covered_words, r.n_words, r.rest.split()) == (1, 13, 13, 15, ["before", "after"])
    assert leaks(d, i.limit(0), key="doc_id", text="text", item_key="item_id", item_text="text").count() == 0
    assert leaks(d.limit(0), i, key="doc_id", text="text", item_key="item_id", item_text="text").count() == 0


def test_cleaning_keeps_the_stored_text_and_takes_all_where_little_is_left(spark):
    item = " ".join(f"x{i}" for i in range(13))
    odd = "X0​ X\u00ad1, " + " ".join(f"X{i}" for i in range(2, 13))
    d = spark.createDataFrame([(1, f"Straße​ ẞ İ Before, {odd}! After ÉTÉ" + " more" * 20, "x"), (2, f"Vor {odd} nach", "x")], TEXTS)
    i = spark.createDataFrame([(7, item)], ITEMS)
    rows = {r.doc_id: r for r in leaks(d, i, key="doc_id", text="text", item_key="item_id", item_text="text", clean=True, max_coverage=0.5).collect()}
    assert rows[1].rest == "Straße​ ẞ İ Before, ! After ÉTÉ" + " more" * 20 and rows[1].coverage == 13 / 39
    assert rows[2].rest is None and rows[2].coverage == 13 / 15


def test_automaton_is_linear():
    a = Automaton([(0, ["a"] * 300), (1, [str(i) for i in range(300)])], 3)
    assert len(a.length) <= 2 * 600
