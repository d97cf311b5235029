"""The trie of conversations against plain tuples of turns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from sparkvista.llm import prefix_trie
from sparkvista.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent string, len int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    convs = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            convs[r.conv_id].append((r.turn is not None, r.turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = {c: c - (abs(c) % 20) * (1 if c >= 0 else -1) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(rows):
    convs = rebuilt(rows)
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for node, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(found) - 1) * words
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()
    )


def check(df):
    got = Counter(map(tuple, prefix_trie.prefix_trie(df).collect()))
    want = brute(df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return got


def test_against_tuples(spark):
    check(table(spark, SF, "conversations"))


def test_odd_conversations(spark):
    rows = [(7, None, "user", "a"), (7, 1, None, None), (7, 1, None, None), (7, 1, "user", "x  y"), (None, 1, "user", "gone"), (None, None, None, None), (-3, 0, "user", "a"), (-3, 1, "b", "c"), (-25, 5, "q", "d")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t} of it") for c in (0, 1, 2, 20, 21) for t in range(3)]
    rows += [(40, 0, "user", "only"), (41, 0, "user", "only"), (43, 0, "u", "x"), (44, 0, "u", "x"), (45, 0, "u", "x")]  # some have no turn of their own left
    rows += [(60, 0, "ab", "c"), (61, 0, "a", "bc"), (62, 0, "", "abc"), (80, 1, "user", "long " * 20_000)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    check(df)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert check(df.filter("conv_id = 80"))


def test_long_shared_prefixes_take_few_rounds(spark, monkeypatch):
    """Copies of one conversation with many turns, others that leave it in the middle, and a hot first turn."""
    rounds = []
    monkeypatch.setattr(prefix_trie, "materialize", lambda df, tag, f=prefix_trie.materialize: rounds.append(tag) or f(df, tag))
    rows = [(c, t, "user", f"t{t}") for c in range(20, 26) for t in range(70)]
    rows += [(c, t, "user", f"t{t}" if t < c else f"own {c} {t}") for c in range(26, 40) for t in range(45)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(100, 600) for t in range(3)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    check(df)
    assert rounds.count("split") <= 9


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 8)
    rows = [(c, 0, "user", "the same") for c in range(-60, 300)]
    check(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA))
