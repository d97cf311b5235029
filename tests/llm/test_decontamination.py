import re
from collections import defaultdict

from sparkvista.llm import decontamination as d
from sparkvista.llm.common import table


def items_in(text, items):
    """Brute force over plain words, for texts without numbers and names: ids with 6 windows of 8 words in line."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words, found = cut(text), set()
    for item_id, said in items:
        w = cut(said)
        size = min(8, len(w))
        need, lines = min(6, len(w) - size + 1), defaultdict(int)
        where = defaultdict(list)
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].append(k)
        for k in range(len(words) - size + 1):
            for i in where.get(tuple(words[k : k + size]), ()):
                lines[k - i] += 1
        if size >= 4 and any(n >= need for n in lines.values()):
            found.add(item_id)
    return sorted(found)


def test_against_brute_force(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = d.find_leaks(docs, bench).collect()
    assert len(got) == docs.count() and sum(r.contaminated for r in got) >= 20
    for r in got:
        assert r["items"] == items_in(r.text, items) and r.contaminated == bool(r["items"]), r.doc_id
    kept = {r.doc_id for r in d.without_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in got if not r.contaminated}


BENCH = [
    (1, "If a train leaves at 5 and travels with Alice for 30 km, how far does Alice get in 12 hours of travel"),
    (2, "one two three four five"), (3, "too short"), (4, None), (5, "one two three four five"), (None, "the last item has no id at all but nine words"),
]


def test_templates_and_slots(spark, make_docs):
    ask = "if a train leaves at {} and travels with {} for {}, how far does {} get in {} of travel"
    rows = [
        (1, "Well: " + ask.format(5, "Alice", "30 km", "Alice", "12 hours"), "a"),
        (2, "Well: " + ask.format("1,250.5", "Bob", "7 miles", "Bob", "3 days") + " please", "a"),  # other values, consistent
        (3, "Well: " + ask.format(9, "Bob", "7km", "Carol", "3 days"), "a"),  # Alice is both Bob and Carol
        (4, "Well: " + ask.format("five", "nobody", "a while", "anybody", "some"), "a"),
        (5, "x one, two. THREE four five!", "a"), (5, "x one, two. THREE four five!", "a"), (6, None, "a"), (7, "", None), (None, "the last item has no id at all but nine words", "b"), (8, "z " * 40_000 + "one two three four five", "b"), (9, "too short", "a"),
    ]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = make_docs(rows).selectExpr("*", "1 as items", "2 as item", "3 as hash", "4 as __cls", "5 as cls", "6 as doc")
    got = d.find_leaks(docs, bench).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.contaminated, r["items"]) for r in got}
    assert by[1] == by[2] == (True, [1]) and by[3] == by[4] == (False, [])
    assert by[5] == by[8] == (True, [2, 5]) and by[None] == (True, []) and not by[6][0] and not by[7][0] and not by[9][0]
    assert d.find_leaks(make_docs(rows), bench.limit(0)).filter("contaminated").count() == 0
    assert d.find_leaks(make_docs([]), bench).count() == 0


SHORT = [
    (1, "What is the tallest mountain in the whole wide world?"), (2, "Alice buys 5 pens and then she sells 2 of them"),
    (3, "12 + 30 = 42, 7 * 8 = 56, 9 - 4 = 5"), (4, "12 March 1999, 3 April 2004"), (5, "Name Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi"),
    (6, "What is the capital?"), (7, "If Tom has 5 apples then he keeps 3 pears"), (8, "in total Tom has 5 apples, so he keeps 3"),
]


def test_short_items_inside_sentences_and_items_of_slots(spark, make_docs):
    want = {
        "Yesterday she asked me What is the tallest mountain in the whole wide world? I did not know": [1],
        "question: what is the tallest mountain in the whole wide world": [1], "WHAT IS THE TALLEST MOUNTAIN IN THE WHOLE WIDE WORLD": [1],
        "so Carol buys 7 pens and then she sells 3 of them": [2], "Carol buys 7 pens and then she sells 3 of them": [2],
        "a sum: 12 + 30 = 42, 7 * 8 = 56, 9 - 4 = 5": [3], "a sum: 12 + 31 = 43, 7 * 8 = 56, 9 - 4 = 5": [],
        "on 12 March 1999, 3 April 2004 it was": [4], "on 12 March 1999, 4 April 2004 it was": [],
        "the list: Name Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi.": [5], "the list: Name Alan, Bert, Chris, Doris, Ernst, Fritz, Gerda, Hans.": [],
        "he said What is the capital? and left": [6], "Paris is the capital": [],
        "so if Ann has 7 apples then he keeps 2 pears": [7], "he said If Ann has 7 apples then he keeps 2 pears": [7], "In total Ann has 7 apples, so he keeps 2": [8],
    }
    bench = spark.createDataFrame(SHORT, "item_id long, text string")
    got = {r.text: r["items"] for r in d.find_leaks(make_docs([(k, t, "a") for k, t in enumerate(want)]), bench).collect()}
    assert got == want


def test_without_broadcast(spark, monkeypatch):
    docs, bench = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    want = sorted((r.doc_id, r["items"]) for r in d.find_leaks(docs, bench).collect())
    monkeypatch.setattr(d, "BROADCAST", 0)
    assert sorted((r.doc_id, r["items"]) for r in d.find_leaks(docs, bench).collect()) == want


NAMES = [
    (1, "If Alice has 9 apples and gives 3 of them to Tom, how many apples does Alice still have at home"),
    (2, "At noon Tom meets Ann at stop 3 of the blue bus line and both ride on to stop 8 near the old mill"),
]


def test_names_number_words_and_different_slots(spark, make_docs):
    first = "so If {} has {} apples and gives {} of them to {}, how many apples does {} still have at home"
    second = "there At noon {} meets {} at stop {} of the blue bus line and both ride on to stop {} near the old mill"
    want = {first.format(n, 7, 2, "Bob", n): [1] for n in ("Carol", "McDonald", "O'Neil", "O\u2019Neil", "IBM", "Zo\u00eb")}
    want |= {
        first.format("Carol", "nine", "five", "Bob", "Carol"): [1], first.format("Carol", 7, 2, "Bob", "Dora"): [], first.format("Carol", 7, 7, "Bob", "Carol"): [], first.format("Carol", 7, 2, "Carol", "Carol"): [],
        second.format("Bob", "Eve", 5, 6): [2], second.format("Bob", "Bob", 5, 5): [], second.format("Bob", "Eve", 5, 5): [], second.format("Bob", "Bob", 5, 6): [],
        first.format("Mary Jane", 7, 2, "Bob", "Mary Jane"): [],  # a name of two words, as the docstring says
        "so If \ue002 has \ue000 apples and gives \ue000 of them to \ue002, how many apples does \ue002 still have at home": [],
        "so " + NAMES[0][1].upper(): [1],
    }
    got = {r.text: r["items"] for r in d.find_leaks(make_docs([(k, t, "a") for k, t in enumerate(want)]), spark.createDataFrame(NAMES, "item_id long, text string")).collect()}
    assert got == want


def test_restated_benchmark_items(spark, make_docs):
    """Every item of the benchmark with other numbers and names, each once for each old one, by a plain rewrite."""
    bench = table(spark, "/root/testdata/sf0.01", "benchmark")
    rows = []
    for r in bench.collect():
        known = {}

        def other(m):
            return known.setdefault(m[0], str(1_000 + len(known)) if m[0][0].isdigit() else "Zan" + "abcdefghijklmnopqrstuvwxyz"[len(known) % 26])

        rows.append((r.item_id, "note: " + re.sub(r"[0-9]+|(?<=[a-z,;:] )[A-Z][a-z]+", other, r.text), "a"))
    got = {r.doc_id: r["items"] for r in d.find_leaks(make_docs(rows), bench).collect()}
    assert all(i in got[i] for i, _, _ in rows)
