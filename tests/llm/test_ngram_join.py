"""Operator 11 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from mandi.llm import minhash, ngram_join
from tests.llm.test_operators import odd_rows, shingles

SMALL = "/root/testdata/sf0.001"


def by_hand(rows, k=3, num=90, den=100):
    sets, up = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return Counter((d, len(sets[i]), None if d is None else min(least[root(i)])) for i, (d, _) in enumerate(rows))


def near_rows():
    """Groups of copies that differ by a few words, drift away in chains, or grow; and texts that share a passage."""
    rng = random.Random(12)
    say = lambda n, v=2000: [f"v{rng.randrange(v)}" for _ in range(n)]
    rows, passage = [], say(60)
    for n in (3, 9, 12, 40, 200):
        base = say(n)
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                w[rng.randrange(n)] = f"new{rng.randrange(9)}"
            rows.append(w + say(rng.choice([0, 0, 1, n // 12])))
    chain = say(150)
    for _ in range(30):
        chain = [*chain]
        chain[rng.randrange(150)] = f"c{rng.randrange(99)}"
        rows.append(chain)
    rows += [say(50) + passage + say(50) for _ in range(40)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def told(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("small,bits,leaders,part", [(16, 20, 512, 2048), (2, 6, 2, 3)])
def test_join_of_near_copies(spark, monkeypatch, small, bits, leaders, part):
    """Also with bands that are large from three members on, few counters, and few leaders in many parts."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = near_rows()
    want = by_hand(rows)
    assert 50 < len({c for _, _, c in want}) < 400
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=bits, leaders=leaders, part=part)
    assert told(got) == want


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_join_of_odd_rows(spark, k, num):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, key string, n long, band long, component string, node long, column string").repartition(3)
    assert told(ngram_join.jaccard_join(df, k, num)) == by_hand([r[:2] for r in rows], k, num)


def test_join_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert told(entry.queries()["op11_ngram_join"](spark, SMALL)) == by_hand(rows)


def test_nothing_to_join(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_heads_of_linked_sets_share_a_column_and_pass_the_bound():
    """Any order of columns; sets of all small sizes that are just linked, by any split of what differs."""
    rng = random.Random(2)
    for _ in range(4000):
        n, extra = rng.randint(1, 60), rng.randint(0, 6)
        a = set(range(n))
        b = set(rng.sample(sorted(a), n - rng.randint(0, min(3, n - 1)))) | {1000 + i for i in range(extra)}
        both, num, den = len(a & b), 90, 100
        if den * both < num * len(a | b):
            continue
        order = {x: rng.random() for x in a | b}
        heads = [set(sorted(s, key=order.get)[: int(ngram_join.head_sizes(np.array([len(s)]), num, den)[0])]) for s in (a, b)]
        c = len(heads[0] & heads[1])
        rest = max(len(s) - len(h) for s, h in zip((a, b), heads, strict=True))
        assert c >= 1 and (num + den) * (c + rest) >= num * (len(a) + len(b))
