"""Each operator against brute force in plain Python, on a small table and on one of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mandi.llm import chat, common, fingerprint, langid, licenses, minhash, mixing, packing, quality, secrets, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, key string, n long, band long, component string"


def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["ä", "ö1", "𝒳y", "<|im_end|>"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, base.upper(), None, "b"),
        (5, None, "en", "a"), (6, "", None, None), (7, " \n\t ", "fr", "a"), (8, "one", "fr", "b"), (9, "One", "fr", "b"), (10, "one two", "fr", "c"),
        (None, base, "en", "a"), (None, say(50), None, None), (None, None, None, None),
        (11, say(6000) + " " + base, "de", "a"), (12, "x" * 20000, "de", "a"), (13, base[:300] + "\n" + base[:300] + "\n" + base[:300], "de", "a"),
        (14, 'api_key: "abcd1234" TOKEN=short token==aaaaaaaa AKIAABCDEFGHIJKL12 ' + "ab" * 20 + " 𝒳𝒳 secret = 0123456789abcdef0123456789abcdef password='x'", "en", "b"),
        (15, "Released under the MIT Licence!\nCopyright 2001 nobody\n\nplain line", "en", "b"),
    ]
    rows += [(100 + i, say(rng.randint(0, 90)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i in range(60)]
    return [(*r, f"k{i}", i, i % 3, "c") for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return common.materialize(spark.createDataFrame(odd_rows(), DDL).repartition(3), "odd")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(params=["odd", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_minhash(docs, k, num):
    rows = rows_of(docs)
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    want = Counter((d, len(sets[i]), None if d is None else min(least[root(i)])) for i, (d, _) in enumerate(rows))
    got = minhash.near_duplicates(docs, k, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_registers_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common_ = rng.integers(0, 2**56, 3400, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common_, rng.integers(0, 2**56, 300, dtype=np.uint64)])) for _ in range(2))
    regs = minhash.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((regs[0] == regs[1]).mean() - 3400 / 4000) < 0.08


def test_chain_of_links_is_one_component(spark):
    """A links with B, B with C, A not with C; many rows in one band."""
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(40):  # each step changes a few words more
        w = list(base)
        for j in range(i):
            w[(j * 9) % 400] = f"z{j}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t, 3) for _, t in rows]
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert linked(sets[0], sets[1]) and not linked(sets[0], sets[39])
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("leaders, part", [(3, 5), (512, 2048)])
def test_a_large_group_of_near_copies(spark, leaders, part):
    """Copies of one text, some linked with it and some not, families of edits that others share, and deletions."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(200)]

    def edited(words, n, drop=0):
        w = list(words)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        for _ in range(drop):
            del w[rng.randrange(len(w))]
        return w

    texts = [base, *(edited(base, rng.randint(1, 9)) for _ in range(60)), *(edited(base, rng.randint(0, 3), rng.randint(1, 9)) for _ in range(40))]
    for _ in range(8):
        head = edited(base, 8)
        texts += [edited(head, rng.randint(0, 4), rng.randint(0, 1)) for _ in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [shingles(t, 3) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaders=leaders, part=part).collect()
    assert len({root(i) for i in range(len(rows))}) > 20
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in range(len(rows))}


@pytest.mark.parametrize("n, m, t", [(7, 6, 0.85), (8, 7, 0.85), (5, 4, 0.8), (10, 8, 0.8)])
def test_no_linked_pair_of_small_sets_is_judged_hopeless(n, m, t):
    import numpy as np

    rng = np.random.default_rng(3)
    larger = [np.sort(rng.integers(0, 2**56, n, dtype=np.uint64)) for _ in range(2000)]
    smaller = [np.sort(rng.permutation(x)[:m]) for x in larger]
    a, b = (minhash.registers(np.concatenate(x), np.arange(len(x) + 1) * len(x[0])) for x in (larger, smaller))
    assert ((a == b).mean(axis=1) >= minhash.hopeful(np.array([float(n)]), np.array([float(m)]), t)).all()


# ------------------------------------------------------------------ 2


@pytest.mark.parametrize("text", ["", "a", chat.HOSTILE, "<\\|", "<\\\\|x|>", "<|im_start|>user\nhi<|im_end|>\n", "<<||>", "a<", "|b"])
def test_round_trip(text):
    turns = [("user", text), (text, "x"), ("assistant", text + "\n" + text)]
    block, found = chat.round_trip(turns)
    assert [x[:2] for x in found] == turns
    assert all(chat.unescape(block[a:b]) == t for (_, t, a, b) in found)
    assert block.count("<|") == 2 * len(turns)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 2, "assistant", chat.HOSTILE, 0), (2, 0, None, "", 0), (2, 0, None, "", 0), (None, None, "assistant", "ü\n", 0), (3, 0, "a\nb", "c", 1)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"{i} <| {'y' * i}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block long")
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # whole texts parse back, and masks lie on them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = chat.format_conversations(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = "".join(r.formatted for r in sorted((r for r in blocks if r.conv_id == 9), key=lambda r: r.block))
    masks = [m for r in sorted((r for r in blocks if r.conv_id == 9), key=lambda r: r.block) for m in r.mask]
    assert [(r, x) for r, x, _, _ in chat.parse(whole)] == [(r, x) for _, r, x in by[9]]
    assert "".join(chat.unescape(whole[m.start : m.end]) for m in masks) == "".join(x for _, r, x in by[9] if r == "assistant")
    assert chat.digests(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 3


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(docs):
    name = lambda s: f"{secrets.KINDS[s[1]]}:{s[0]}:{s[2]}"
    want = Counter()
    for d, t in rows_of(docs):
        found = base_spans(t or "")
        n = Counter(k for _, k, _ in found)
        want[(d, n[0], n[1], n[2], hashlib.sha256(",".join(map(name, found)).encode()).hexdigest())] += 1
    got = secrets.digests(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_random_tokens_are_told_from_names(spark):
    rng = random.Random(3)
    letters = secrets.BASE64
    rows, tokens = [], set()
    for i in range(200):
        token = "".join(rng.choice(letters[:62]) for _ in range(40))
        tokens.add(i)
        rows.append((i, f"see {token} here"))
        rows.append((1000 + i, f"see get{'User'*5}{'Name'*4}ById{i} and aaaaaaaaaaaaaaaaaaaaaa{i}bbbbbbbbbb here"))
    rows.append((5000, None))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.size("spans") > 0).collect()
    found = {r.doc_id for r in got if r.doc_id < 1000 and any(s.kind == 3 for s in r.spans)}
    assert len(found) >= 180 and not [r for r in got if r.doc_id >= 1000 and any(s.kind == 3 for s in r.spans)]


def test_redact(odd):
    spans = {r.row_id: r for r in secrets.scan(odd).collect()}
    done = secrets.redact(odd)
    assert done.columns == odd.columns and done.count() == odd.count() == len(spans)
    text = done.filter("doc_id = 14").first().text
    assert "AKIA" not in text and "0123456789abcdef" not in text and text == "[secret]\" TOKEN=short [secret] [secret] [secret] 𝒳𝒳 [secret] password='x'"


# ------------------------------------------------------------------ 4


def test_packing(docs):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] <= packing.LENGTH and ends[-1] & (ends[-1] - 1) == 0, "nothing is padded"
    want = Counter()
    for d, t in rows_of(docs):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.EOS], "<u4")
        want[(d, len(ids))] += 1
        mine = [r for r in by_doc[(d, len(ids))] if zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert sum(r.length for r in mine) >= len(ids)
    assert all(sum(r.length for r in by_doc[k]) == k[1] * n for k, n in want.items())
    assert sum(len(x) for x in by_doc.values()) == len(got)


def test_packing_merges_left_overs_of_many_tasks(spark):
    rows = spark.range(0, 3000, 1, 100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the word "), (F.col("id") % 700).cast("int")).alias("text"))
    got = packing.pack(rows, length=1024, windows=2)
    total = got.agg(F.sum("length")).first()[0]
    assert total == sum(2 * (i % 700) + 1 for i in range(3000))
    sizes = [r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 1024 for n in sizes) <= 10 and all(n & (n - 1) == 0 for n in sizes)


ENCODER_ATOMS = ["İ.", "TÜRKİ. foo", "<|ENDOFTEXT|>", "<|endoftext|>", "<|endof", "text|>", "á", "́x", "é.", "É,", "中文字", "日本。", "don't", "I'LL", "'S", "12,3", "ß", "ﬁ", "ΑΣ ", "ŉ.", "ſ", "‍", "👩‍👩", "\x1c", "\x85", "q̧.", "각", "\x00", " ", " ", "\t", "\n", "\r\n", "\x0b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name):
    """Odd texts, whole and after one another, for a tokenizer that takes parts and one that takes whole texts."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path(name)), packing.Encoder(public_tokenizers.path(name), most=300)
    assert encode.by_part == name.startswith("word")
    rng = random.Random(3)
    texts = ["".join(rng.choice([*ENCODER_ATOMS, *"abXY .,'<|>-9"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in encode(pa.array(texts), size=4000) for i in range(len(bounds) - 1)]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.EOS] for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_knows_every_latin_letter(name):
    """Each code point of U+00C0 to U+024F alone, after and before letters, in capitals, before a stop; and random words of them."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path(name)), packing.Encoder(public_tokenizers.path(name))
    rng = random.Random(5)
    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = ["İstanbul", "İzmir", "İ", "ŉĿ", "ŉ", "ISTANBUL İSTANBUL"]
    texts += [form.format(c) for c in letters for form in ("{0}", "x{0}", "{0}x", "X{0}", "{0}{0}", "a{0}.", "{0}, b", "{0}stanbul")]
    texts += ["".join(rng.choice([*letters, *"aZé.' "]) for _ in range(rng.randint(1, 12))) for _ in range(20000)]
    got = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in encode(pa.array(texts)) for i in range(len(bounds) - 1)]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.EOS] for t in texts]


# ------------------------------------------------------------------ 5


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    letters = {d for d, t in rows_of(odd) if t and any(c.isalpha() for c in t)}
    assert all((r.lang_pred == "und") == (r.doc_id not in letters) for r in got if r.doc_id is not None)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


# ------------------------------------------------------------------ 6


def test_mixing(docs):
    got = mixing.draw(docs).withColumn("taken", mixing.taken()).collect()
    want = Counter((d, len(WORDS.findall(t or ""))) for d, t in rows_of(docs))
    assert Counter((r.doc_id, r.size) for r in got) == want
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert [d.words for d in r.draws[:-1]] == [r.size] * (len(r.draws) - 1)
    # water filling, one source at a time
    order = mixing.by_code_point(list(by))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(x[0] for x in by.values()), set(by), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * by[s][0] + 1e-6]
        if not over:
            break
        free.remove(over[0])
        target[over[0]] = 2 * by[over[0]][0]
        left -= target[over[0]]
        if not over[1:]:
            continue
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s, (_, taken, t) in by.items():
        assert abs(taken - t) <= 1 and abs(target[s] - t) < 1
    again = mixing.draw(docs).withColumn("taken", mixing.taken()).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mix_rows(small):
    mixed = mixing.mix(small, shards=8)
    words = mixed.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()
    want = {r.source: r.n for r in mixing.draw(small).groupBy("source").agg(F.sum(mixing.taken()).alias("n")).collect()}
    assert {r.source: r.n for r in words} == {s: n for s, n in want.items() if n}
    assert mixed.select("mix_shard").distinct().count() <= 8


def test_splitting_tree_keeps_quotas():
    tree = mixing.splitting_tree([1000, 7, 0, 333], 13, [5])
    assert tree.sum(axis=0).tolist() == [1000, 7, 0, 333] and tree.min() >= 0
    sums = tree.sum(axis=1)
    assert sums.max() - sums.min() <= 4


def test_draws_beyond_the_generators_limit():
    import numpy as np

    colors = np.array([3 * 10**9, 10, 7 * 10**11, 0, 1])
    for n in (0, 1, 10**9 + 7, 7 * 10**11, int(colors.sum())):
        got = mixing.drawn_from(colors, n, np.random.default_rng(3))
        assert got.sum() == n and (got >= 0).all() and (got <= colors).all()
    assert abs(mixing.drawn_from(colors, 10**11, np.random.default_rng(4))[2] / 10**11 - 0.9957) < 0.001


def test_mixing_any_number_of_sources(spark, monkeypatch):
    """More sources than one task splits; targets, taken words and caps as for few."""
    monkeypatch.setattr(mixing, "GROUP", 50)
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice([None, *(f"s{j:03}" for j in range(400))])) for i in range(4000)]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "sources")
    got = mixing.draw(docs).withColumn("taken", mixing.taken()).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size >= r.size
    order = mixing.by_code_point(list(sizes))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e6  # the unit of words at which the targets sum up
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 2 * sizes[s]) for s in order) < 1.5 * sum(sizes.values()) else (lo, mid)
    assert all(abs(target[s] - min(weight[s] * lo, 2 * sizes[s])) < 1e-3 and abs(taken[s] - target[s]) <= 1 for s in order)
    mixed = mixing.mix(docs, shards=4).groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in mixed} == {s: n for s, n in taken.items() if n}


# ------------------------------------------------------------------ 7


@pytest.mark.parametrize("budget", [substring.BUDGET, 1, 3000])
def test_substring(docs, budget):
    rows = [(d, WORDS.findall(t or "")) for d, t in rows_of(docs)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = substring.remove_repeats(docs, budget=budget).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_long_words_in_a_hot_run(spark):
    """A passage in many texts, with words of 200 kB beside it, as one group, as windows, and with some windows alone."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{'x' * 200_000}{i % 3} {passage} {'y' * 1000}{i} tail") for i in range(40)] + [(99, " ".join(f"q{i}" for i in range(60)))]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "long")
    for budget in (substring.BUDGET, 1_000_000):
        got = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs, budget=budget, with_text=False).collect()}
        assert got == {i: 41 for i in range(40)} | {99: 0}


def test_equal_hashes_of_different_windows_are_told_apart():
    """Windows of one group of the longest prefix whose words differ: only those with equal words repeat."""
    import pyarrow as pa

    rows = [(1, 1, r, r, 1, k, w) for r, (k, w) in enumerate([(0, b"a"), (0, b"b"), (1, b"c"), (0, b"a"), (2, None), (0, b"d"), (0, b"c"), (0, b"a")])] + [(1, 2, 50, 0, 1, 0, b"d"), (2, 2, 60, 0, 1, 0, b"d")]
    for step in (1, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + step], strict=True), substring._GROUPED, strict=True)], schema=substring._GROUPED) for a in range(0, len(rows), step)]
        assert sorted(r for out in substring._subtrees(35)(batches) for r in out.column("row_id").to_pylist()) == [0, 2, 3, 4, 6, 7]


def test_suffixes_of_one_group_are_compared_by_words():
    """Stretches of a group whose keys collide, in batches that cut the group; equal windows only."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = []
    for key in (1, 2):
        base = [rng.choice("abc") for _ in range(60)]
        for r in range(40):
            w = [*base]
            if r % 4:
                w[rng.randrange(60)] = "z" * (1 + r % 3)
            if r % 5 == 0:
                w = [rng.choice("ab") for _ in range(60)]
            rows.append((key, 0, r, 7, 60 - 35 + 1, -1, " ".join(w).encode()))
    want = set()
    for key in (1, 2):
        seen = Counter(tuple(x[6].split()[i : i + 35]) for x in rows if x[0] == key for i in range(26))
        want |= {(x[2], 7 + i) for x in rows if x[0] == key for i in range(26) if seen[tuple(x[6].split()[i : i + 35])] > 1}
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 17], strict=True), substring._GROUPED, strict=True)], schema=substring._GROUPED) for a in range(0, len(rows), 17)]
    got = [(row, pos + i) for out in substring._subtrees(35)(batches) for row, pos, n in zip(*(c.to_pylist() for c in out.columns), strict=True) for i in range(n)]
    assert len(want) > 50 and set(got) == want


# ------------------------------------------------------------------ 8


def test_licenses(odd, small):
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert got[15].line_licenses == "MIT" and got[15].text_license is None and got[15].n_license_lines == 1
    assert got[6].text_digest == got[5].text_digest == hashlib.md5(b"").hexdigest()
    whole = licenses.scan(odd.filter("doc_id = 15").withColumn("text", F.lit("(c) 2020 me\nRELEASED under - the\nMIT licence"))).first()
    assert whole.text_license == "MIT" and whole.n_license_lines == 0
    # standard files as they are: titled, wrapped, signed; alone and inside a text
    import textwrap

    mit = "MIT License\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(x, 72) for x in licenses.KNOWN["MIT"][3].split("\n\n")) + "\n"
    texts = dict(licenses.known_texts())
    files = [(0, mit), (1, texts["Apache-2.0"]), (2, "some code\n\n" + mit + "\nmore code"), (3, "x = 1\n\n" + textwrap.fill(licenses.KNOWN["MPL-2.0"][0], 60) + "\n\nif"), (4, texts["GPL-3.0"].upper()), (5, mit.replace("Software", "software thing", 1))]
    by = {r.doc_id: r for r in licenses.scan(odd.sparkSession.createDataFrame(files, "doc_id long, text string")).collect()}
    assert [by[i].text_license for i in range(6)] == ["MIT", "Apache-2.0", None, None, "GPL-3.0", None]
    assert by[2].block_licenses == "MIT" and by[3].block_licenses == "MPL-2.0" and by[5].block_licenses == ""
    want = sum(t.count("Released under the MIT License.") for _, t in rows_of(small))
    assert licenses.scan(small).filter("line_licenses like '%MIT%'").count() <= want
    assert licenses.scan(small).count() == small.count()


# ------------------------------------------------------------------ 9


def test_quality_counts(docs):
    want = Counter()
    for d, t in rows_of(docs):
        t = t or ""
        w = WORDS.findall(t)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs).filter("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.99
    assert n[(0, False)] / (n[(0, False)] + n.get((0, True), 0)) > 0.8


def test_sketch_merges_and_ranks(spark):
    df = spark.range(10000).select(F.lit("x").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), *(F.col("id").alias(m) for m in quality.RATES))
    fine = quality.sketches(df, ["lang", "source"])
    assert sorted(map(tuple, quality.merge(fine, ["lang"]).collect())) == sorted(map(tuple, quality.sketches(df, ["lang"]).collect()))
    q = quality.quantiles(quality.merge(fine, []), [], {"q": 0.5}).first()
    assert 5000 * 31 / 32 - 1 <= q.q <= 5000 and q.total == 10000


# ------------------------------------------------------------------ 10


def test_fingerprints(docs):
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.hash, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).collect())
    want = Counter()
    for i, (none, d, _, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want[(None if none else d, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    for buckets in (1, 5):
        got = fingerprint.compare(docs, buckets).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    alone = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(docs).collect() if r.doc_id is not None}
    assert all(alone[r.doc_id] == r.fingerprint for r in got if r.doc_id is not None)
    by_text = defaultdict(set)
    texts = dict(rows_of(docs))
    for d, f in alone.items():
        by_text[texts[d]].add(f)
    assert all(len(x) == 1 for x in by_text.values())


def test_rows_without_id_spread_over_tasks(spark):
    """3000 rows without doc_id whose texts begin alike, 500 under one doc_id, and 700 that are equal."""
    rows = [(None, f"the same beginning {i}") for i in range(3000)] + [(7, f"under one id {i}") for i in range(500)] + [(None, "equal")] * 400 + [(9, "equal too")] * 300
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "spread")
    got = fingerprint.compare(docs, 8)
    sizes = [r["count"] for r in got.filter("n_chars > 9").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1200 and sum(sizes) == 3500
    equal = got.filter("n_chars < 10").groupBy("doc_id", "near_next").count().collect()
    assert {(r.doc_id, r.near_next): r["count"] for r in equal if r.near_next == 1.0} in ({(None, 1.0): 399, (9, 1.0): 299}, {(None, 1.0): 400, (9, 1.0): 299}, {(None, 1.0): 399, (9, 1.0): 300})


def test_likeness_follows_shared_text(small):
    got = fingerprint.compare(small).filter("n_chars > 1500").collect()
    assert sum(r.near_edited > r.near_next for r in got) / len(got) > 0.95
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij ") for i in range(8000))
    rows = fingerprint.fingerprints([long, "shift" + long, long[:10]])
    assert fingerprint.likeness(rows[:1], rows[1:2])[0] > 0.8 > fingerprint.likeness(rows[:1], rows[2:])[0]


# ------------------------------------------------------------------ all


def test_empty_tables(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert secrets.digests(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.draw(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert quality.judge(empty).count() == 0
    assert fingerprint.compare(empty, 3).count() == 0


def test_pipeline(spark, tmp_path):
    import os

    import corpus_pipeline

    os.mkdir(tmp_path / "t")
    sf = str(tmp_path / "t")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id = 3"))
    docs.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = common.materialize(stage(spark, now, sf), f"stage{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == columns
        seen.append(now)
    good, one, clean, mixed, packed = seen
    assert set(map(tuple, good.collect())) <= set(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").collect()))
    assert one.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert clean.count() == one.count() and clean.filter("text like '%token = \"%'").filter(F.col("text").rlike("[0-9a-f]{40}")).count() == 0
    size = mixed.agg(F.sum(common.word_count(F.col("text")))).first()[0]
    assert abs(size / one.agg(F.sum(common.word_count(F.col("text")))).first()[0] - 1.5) < 0.02
    assert packed.filter("start + length = doc_tokens").count() == mixed.count()


def test_pipeline_tells_texts_under_one_id_apart(spark):
    """One id under two texts; a failing and a passing row of one id; repeats; a group whose smallest id has another text too."""
    import corpus_pipeline

    say = lambda seed: " ".join(random.Random(seed).choices([f"word{i}" for i in range(500)], k=120))
    rows = [(1, say(1)), (1, say(2)), (2, say(3)), (2, "too short"), (3, say(1)), (3, say(1)), (4, say(1) + " more"), (5, ""), (5, None), (6, say(9)), (6, say(9)), (None, say(1)), (None, say(1))]
    docs = common.materialize(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4), "ids")
    told = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert told(good) == Counter(r for r in rows if r[1] and r[1] != "too short")
    assert told(corpus_pipeline.near_dedup(spark, docs, "")) == Counter([(1, say(1)), (1, say(2)), (2, say(3)), (2, "too short"), (5, ""), (5, None), (6, say(9)), (None, say(1)), (None, say(1))])


OURS = ["row", "row_id", "spans", "own", "key", "size", "block", "d", "share", "mix_shard", "mix_copy", "good_id", "kept_id", "a.b", "place", "bucket", "guard", "guards", "known_source", "source_id", "drawn", "take", "registers", "node", "digest", "lines", "label", "held_out", "order", "tie", "`"]


def test_columns_with_our_own_names(spark):
    """Every name that operators use inside, and a dotted one, as columns of the documents."""
    import corpus_pipeline

    text = "the cat sat on the mat and then it went away to look for some more of the fish it had seen here token = abcdef0123456789"
    rows = [(i, f"{text} {i if i % 3 else ''}", "s", "en", *range(i, i + len(OURS))) for i in range(12)] + [(None, None, None, None, *range(len(OURS)))]
    ddl = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in OURS)
    docs = common.materialize(spark.createDataFrame(rows, ddl), "ours")
    kept = {r.doc_id: tuple(r)[4:] for r in docs.collect()}

    def same(df):
        assert df.columns == docs.columns
        for r in df.collect():
            assert tuple(r)[4:] == kept[r.doc_id]
        return df

    assert same(secrets.redact(docs)).filter("text like '%[secret]%'").count() == 12
    assert same(corpus_pipeline.quality_rules(spark, docs, "")).count() == 12
    assert 1 <= same(corpus_pipeline.near_dedup(spark, docs, "")).count() < 13
    assert same(corpus_pipeline.with_length(docs)).count() == 13
    assert same(corpus_pipeline.mix_sources(spark, docs, "")).count() > 12
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard_", "mix_copy_"] and mixed.count() > 12
    for df in (minhash.near_duplicates(docs), packing.pack(docs), langid.identify(docs), mixing.draw(docs), substring.remove_repeats(docs), licenses.scan(docs), quality.judge(docs), fingerprint.compare(docs), fingerprint.fingerprint(docs), secrets.digests(docs)):
        assert df.count() >= 13


def test_lengths_are_counted_only_where_they_are(spark):
    import corpus_pipeline

    df = spark.createDataFrame([("abc", 9), (None, 9)], "text string, n_chars int")
    assert [r.n_chars for r in corpus_pipeline.with_length(df).collect()] == [3, None]
    assert corpus_pipeline.with_length(df.drop("n_chars")).columns == ["text"]


def test_languages_in_blocks(spark):
    rows = [(i, f"{w} {w}s {w} abc", w[:2]) for i, w in enumerate(("hello", "zebra", "quick", "mount", "яблоко") * 12)]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "langs")
    whole, parts = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, **how).collect()} for how in ({}, {"most": 2}))
    assert {d: lang for d, (lang, _) in whole.items()} == {d: lang for d, (lang, _) in parts.items()}
    assert all(abs(whole[d][1] - parts[d][1]) < 1e-5 for d in whole)


def test_secrets_of_every_alphabet(spark):
    """UUIDs, upper-case and prefixed keys planted among words; precision and recall of the added spans."""
    import uuid

    rng = random.Random(8)
    make = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "upper": lambda: "".join(rng.choice(secrets.UPPER36) for _ in range(28)),
        "prefixed": lambda: "sk_live_" + "".join(rng.choice(secrets.BASE36) for _ in range(32)), "base64": lambda: "".join(rng.choice(secrets.BASE64) for _ in range(44)),
    }
    rows = [(i, f"we saw {make[k]()} there", k) for i, k in enumerate(k for k in make for _ in range(150))]
    rows += [(9000 + i, f"the getUser{'Name' * 3}By{'Id' * 3}{i} of aaaaaaaaaaaaaaaa{i % 7}bbbbbbb and a_very_long_snake_case_name_{i}", "none") for i in range(300)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    found = {r.doc_id for r in got if any(s.kind == 3 for s in r.spans)}
    for kind in make:
        assert sum(1 for d, _, k in rows if k == kind and d in found) >= 120, kind
    assert len([d for d in found if d >= 9000]) <= 0.1 * len(found)
