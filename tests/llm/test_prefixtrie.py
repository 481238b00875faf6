import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheetlens.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=20, heads=4):
    """Every node's figures from the sequences themselves."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(built[c]) == len(k))))
        leaves = sum(out[x][5] for x in children[k]) or 1
        saved = (len(nodes[k]) - 1) * words + sum(out[x][6] for x in children[k])
        out[k] = (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(str, out.values()))


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 130), *range(1000, 1200, 7)]:
        if rng.random() < 0.85:
            for t in range(rng.choice((1, 2, 2, 3, 4, 7))):
                rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("hello there", "hello  there", "yes", "", None, "tab\tand\x0bline\n", "nbsp word é"))))
    rows += [(2000 + i, t, "user", "the same hot start" if t == 0 else f"turn {t}") for i in range(150) for t in range(4)]
    rows += [(3000, None, "user", "nowhen"), (3000, None, "assistant", "nowhen"), (3000, 0, "user", "b"), (3000, 0, "user", "a"), (3000, 0, "user", "a"), (None, 0, "user", "nobody"), (3001, t := 0, "user", "w " * 50_000)]
    rows += [(4000, t, "user", f"step {t}") for t in range(700)] + [(4001, t, "user", f"step {t}") for t in range(650)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({"node": F.lit(1), "base": F.lit("clash"), "depth": F.lit(0)})
    for block in (2, 100):
        got = prefixtrie.prefix_trie(turns, block=block)
        assert sorted(str(tuple(r)) for r in got.drop("node").collect()) == brute(rows)


def test_other_families_and_heads(spark):
    rows = made(5)
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), family=7, heads=3)
    assert sorted(str(tuple(r)) for r in got.drop("node").collect()) == brute(rows, 7, 3)


def test_turnless_conversations_single_ones_and_the_empty_table(spark):
    rows = [(c, 0, "user", "only turn") for c in range(21, 40)]  # their base doesn't exist
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).drop("node").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    root = next(r for r in got if r.depth == 0)
    assert root.conv_id == 21 and root.n_convs == 19 and root.parent_conv_id is None
    one = prefixtrie.prefix_trie(spark.createDataFrame([(5, 0, "user", "x")], SCHEMA)).drop("node").collect()
    assert sorted(str(tuple(r)) for r in one) == brute([(5, 0, "user", "x")])
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0


def test_roles_and_texts_are_told_apart():
    lend = prefixtrie.family_trie(0, {0: (0, [(b"a", 1)]), 3: (1, [(b"z", 2), (b"b", 5)])})
    assert [(r[3], r[5], r[6]) for r in lend] == [(0, 2, 0), (1, 2, 0), (2, 1, 3)]
