"""Operators 12 and 13 against brute force, and their queries as they are registered."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mandi.llm import audit, periods

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ 12


def by_hand(docs, labels):
    """Rows of the audit by playing each order, document by document."""
    least, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    parts = defaultdict(list)
    for d, t, lang in docs:
        t, w = t or "", WORDS.findall(t or "")
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    rows, removed_by = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                earlier = set(order[: step - 1])
                gone = [m for m in members if x in m[0] and not m[0] & earlier]
                removed_by[part, x] += len(gone)
                kept = sum(not m[0] & {*earlier, x} for m in members)
                rows[part, "".join(order), step] = [kept, len(gone), sum(x in m[0] and bool(m[0] & earlier) for m in members), sum(m[0] == {x} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)]
    return {(p, o, s): (*v, removed_by[p, o[s - 1]]) for (p, o, s), v in rows.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    say = lambda n, v=400: " ".join(rng.choice([f"w{rng.randrange(v)}", "Word", "THE", "x#"][: rng.choice([1, 2, 3, 4])]) for _ in range(n))
    texts = [None, "", " ", "A", "ÄÖÜ ß", *(say(rng.randint(1, 300), rng.choice([20, 4000])) for _ in range(25)), "long " * 20000]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice(["en", "fr", "", None]), "clash", 1) for _ in range(150)]
    labels = [(None, 1, 1), (1, 1, 0), (1, 0, 1), (2, None, 1), (3, 0, None), *((d, rng.randint(0, 1), rng.randint(0, 1)) for d in range(4, 9))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, part string, mask int").repartition(5)
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told(got) == by_hand([d[:3] for d in docs], labels)
    assert got.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")] and {t for _, t in got.dtypes[3:]} == {"bigint"}


def test_audit_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert told(entry.queries()["op12_filter_audit"](spark, SMALL)) == by_hand(docs, labels)


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_potentials_give_shapley_values(spark):
    """Any game of five players, not only removals."""
    rng = random.Random(8)
    worth = [0, *(rng.randrange(-(10**9), 10**9) for _ in range(31))]
    got = spark.range(1).select(audit.potentials(F.array(*(F.lit(w).cast("long") for w in worth))).alias("p")).first().p
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert 2 * (got[31] - got[31 ^ 1 << i]) == total


# ------------------------------------------------------------------ 13


def runs_by_hand(w, least=6, times=4):
    out = []
    for p in range(1, len(w) // times + 1):
        equal = [w[j] == w[j + p] for j in range(len(w) - p)] + [False]
        begin = None
        for j, e in enumerate(equal):
            if e and begin is None:
                begin = j
            elif not e and begin is not None:
                n = j - begin + p
                seg = w[begin : begin + n]
                if n >= max(least, times * p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.append((begin, n, p))
                begin = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text, plant):
    w = WORDS.findall(text or "")
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = runs_by_hand(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_periodic_runs"](spark, SMALL)
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == Counter(row_by_hand(*d, True) for d in docs)
    assert got.filter("n_runs > 0").count() >= 5


def odd_texts():
    rng = random.Random(4)
    yield from [None, "", " \n\t ", "a", "a a a a a a", "a " * 5, "a b a b a b a b", "x y " * 9, "ä ö " * 7 + "ä", "𝒳 " * 6, "long " * 3000, " ".join(f"p{i % 700}" for i in range(3000))]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            base = [f"w{rng.randrange(rng.choice([1, 2, 3, 8]))}" for _ in range(rng.randint(1, 18))]
            w += (base * 9)[: rng.randint(1, 9 * len(base))] if rng.random() < 0.7 else base
        yield rng.choice([" ", "\n", " \t"]).join(w)


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs_of_odd_rows(spark, plant):
    rng = random.Random(6)
    docs = [(rng.choice([None, 7, 10**12 + i, i]), t, f"k{i}", [i], i) for i, t in enumerate(odd_texts())] + [(7, "a b " * 5, "k", [1], 1)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, words string, runs array<int>, n long").repartition(3)
    got = periods.digests(periods.find_runs(periods.planted(df) if plant else df))
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == Counter(row_by_hand(*d[:2], plant) for d in docs)


def test_collapsed_text_and_other_limits(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "a a a a a")], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periods.find_runs(df, least=5).collect()}
    assert got == {1: ("x a b y", [(1, 8, 2)]), 2: ("a", [(0, 5, 1)])}
    with pytest.raises(ValueError):
        periods.find_runs(df, times=3)


def test_no_rows_no_runs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periods.digests(periods.find_runs(periods.planted(none))).count() == 0
