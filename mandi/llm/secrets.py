r"""Operator 3: secret scans, native.

Base rules find assignments, access keys and long hex strings by pattern.  The method adds tokens
that look random: a battery of three tests of uniformity under the encoding inferred from the
token's characters (chi-squared on the alphabet, runs above and below its middle, lag-one serial
correlation), joined by Fisher's rule into one p-value.  Under the encoding a random token's p is
uniform; words and identifiers get small ones, the smaller the longer they are.

Length-aware false-discovery control: tokens are grouped by encoding and length (half octaves).
Each group's histogram of p (100 bins, merged by adding) gives the number of random tokens, twice
the count above 0.5, and the lowest cut at which the estimated share of others among the accepted
is at most ``rate``.  Short tokens, which the tests can't tell apart, so get a high cut or none.

Everything is DataFrame functions.  Positions come from lengths: between matches are the parts that
``split`` gives, so a match starts after all earlier parts and matches, counted in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, scratch, unboxed

# The base patterns, in the order in which kinds sort.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more: shorter runs hold no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))

LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
UPPER36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": LOWER_HEX, "upper_hex": UPPER_HEX, "base32": BASE32, "base36": BASE36, "upper36": UPPER36, "base64": BASE64}


def _found(text: Column, kind: str) -> Column:
    """(gap before, length, whether it counts, token) of each match in order; NULL-free."""
    pattern = _PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else whole
    has_digit = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    counts = (lambda v: F.length(v) >= 8) if kind == "assign" else has_digit if kind == "random" else (lambda v: F.lit(True))
    gaps = F.split(text, pattern, -1)
    each = F.transform(
        F.arrays_zip(whole.alias("w"), value.alias("v"), gaps.alias("g")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["w"]), F.lit(0)).alias("len"), F.coalesce(counts(x["v"]), F.lit(False)).alias("ok"), (F.when(has_digit(x["v"]), x["v"]) if kind == "random" else F.lit(None).cast("string")).alias("token")),
    )
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean,token:string>>")
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["len"] > 0)).otherwise(none)


def matches(docs: DataFrame) -> DataFrame:
    """row_id, text_a, text_b, doc_id and the matches of each kind in each row of docs; written once, read often."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), *_text_id(), F.col("doc_id").cast("long").alias("doc_id"), *(_found(text, k).alias(k) for k in KINDS)), "matches")


def _text_id() -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b")]


def places(found: DataFrame, kind: str) -> DataFrame:
    """row_id, kind, start, end, token of the matches of one kind that count."""
    each = found.filter(F.size(kind) > 0).select("row_id", F.posexplode(kind).alias("i", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(Window.partitionBy("row_id").orderBy("i"))
    return each.select("row_id", F.lit(KINDS.index(kind)).alias("kind"), (end - F.col("x.len")).alias("start"), end.alias("end"), F.col("x.ok").alias("ok"), F.col("x.token").alias("token")).filter("ok").drop("ok")


def normal_tail(z: Column) -> Column:
    """P(Z > z), within 1e-7, by a rational approximation."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = reduce(lambda acc, c: (acc + c) * t, (-1.821255978, 1.781477937, -0.356563782, 0.319381530), 1.330274429 * t)
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(token: Column) -> Column:
    """The narrowest encoding whose kinds of characters the token has; every token with letters has one."""
    return (
        F.when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "upper_hex").when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[0-9a-z]+$"), "base36").when(token.rlike("^[0-9A-Z]+$"), "upper36").when(token.rlike("[a-z]") & token.rlike("[A-Z]"), "base64")
    )


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (row_id, start, end, token) with encoding, n, length_class, p.

    In a token of one case, separators (as in UUIDs and prefixed keys) are no part of the encoding.
    """
    plain = F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")
    one_case = ~(F.col("token").rlike("[a-z]") & F.col("token").rlike("[A-Z]"))
    df = tokens.withColumn("token", F.when(one_case, F.translate(plain, "+/", "")).otherwise(plain)).withColumn("encoding", encoding(F.col("token"))).filter(F.col("encoding").isNotNull())
    case = lambda f: reduce(lambda acc, kv: acc.when(F.col("encoding") == kv[0], f(kv[1])), list(ALPHABETS.items())[1:], F.when(F.col("encoding") == "hex", f(LOWER_HEX)))
    half = lambda a: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)
    df = df.select("row_id", "start", "end", "token", "encoding", F.length("token").cast("double").alias("n"), case(F.lit).alias("alphabet"), case(lambda a: F.lit(float(len(a)))).alias("k"), case(lambda a: F.translate(F.col("token"), a, half(a))).alias("bits"))
    chars = F.split("token", "")
    df = df.withColumn("index", F.transform(chars, lambda c: F.call_function("locate", c, F.col("alphabet")).cast("double")))
    times = F.transform(F.array_distinct(chars), lambda c: (F.length("token") - F.length(F.call_function("replace", F.col("token"), c, F.lit("")))).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    n, k = F.col("n"), F.col("k")
    df = df.withColumns({
        "chi": total(F.transform(times, lambda c: c * c)) * k / n - n,
        "ones": F.length(F.call_function("replace", F.col("bits"), F.lit("0"), F.lit(""))).cast("double"),
        "runs": (F.regexp_count("bits", F.lit("01")) + F.regexp_count("bits", F.lit("10")) + 1).cast("double"),
        "s1": total(F.col("index")), "s2": total(F.transform("index", lambda x: x * x)),
        "s11": total(F.zip_with("index", F.concat(F.slice("index", 2, F.length("token")), F.slice("index", 1, 1)), lambda x, y: x * y)),
    })
    free = k - 1
    z_chi = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    mean = 2 * F.col("ones") * (n - F.col("ones")) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    spread = n * F.col("s2") - F.col("s1") * F.col("s1")
    ps = [
        normal_tail(z_chi),
        F.when(var > 0, 2 * normal_tail(F.abs(F.col("runs") - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(F.lit(0.0)),
        F.when(spread > 0, 2 * normal_tail(F.abs((n * F.col("s11") - F.col("s1") * F.col("s1")) / F.greatest(spread, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n))).otherwise(F.lit(0.0)),
    ]
    half_x = -sum((F.ln(F.greatest(p, F.lit(1e-12))) for p in ps), F.lit(0.0))
    p = F.exp(-half_x) * (1 + half_x + half_x * half_x / 2)
    return df.select("row_id", "start", "end", "encoding", "n", F.floor(2 * F.log2("n")).alias("length_class"), F.least(p, F.lit(1.0)).alias("p"))


def cuts(tested: DataFrame, rate: float) -> DataFrame:
    """encoding, length_class and the lowest p (in hundredths) at which others are at most ``rate`` of the accepted."""
    by = ["encoding", "length_class"]
    bins = tested.groupBy(*by, F.least(F.floor(F.col("p") * 100), F.lit(99)).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    bins = bins.withColumn("random", 2 * (F.sum(F.when(F.col("bin") >= 50, F.col("n")).otherwise(0)).over(w) + 1)).withColumn("accepted", F.sum("n").over(w.orderBy(F.desc("bin"))))
    others = 1 - F.col("random") * (1 - F.col("bin") / 100) / F.col("accepted")
    return bins.filter((F.col("bin") >= 1) & (others <= rate)).groupBy(*by).agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    """row_id, text_a, text_b, doc_id, spans of each row of docs (doc_id, text); spans: sorted array of (start, kind, end).

    Offsets are code points, end exclusive; kind indexes KINDS.  A random token inside a base span
    isn't listed again.  Null or empty text: no spans.  Null doc_id and repeated rows are rows of
    their own.  Empty table: empty result.
    """
    with scratch(docs.sparkSession) as written:
        out = materialize(_scan(docs, rate), "spans")
        written.pop()
    return out


def _scan(docs: DataFrame, rate: float) -> DataFrame:
    found = matches(docs)
    base = reduce(DataFrame.unionByName, (places(found, k).drop("token") for k in KINDS[:3]))
    tested = materialize(battery(places(found, "random")), "battery")
    cut = cuts(tested, rate)
    chosen = tested.join(cut, ["encoding", "length_class"]).filter(F.floor(F.col("p") * 100) >= F.col("cut")).select("row_id", F.lit(3).alias("kind"), "start", "end")
    cover = base.select(F.col("row_id").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    chosen = chosen.join(cover, (F.col("row_id") == F.col("r")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left_anti")
    spans = base.unionByName(chosen).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row_id", "text_a", "text_b", "doc_id").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", none))


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = 0.1) -> DataFrame:
    """docs with every span replaced by mark; all columns, and rows without a secret, stay as they are.

    A text's spans follow it by 128 bits of it, so they don't depend on how the table is read again: equal texts
    have equal spans.  Null or empty text stays; null doc_id and repeated rows are rows of their own; overlapping spans
    are covered once.  Very long texts are covered whole.  Empty table: empty result.
    """
    spans = scan(docs.withColumn("text", F.col("text").cast("string")), rate).filter(F.size("spans") > 0)
    spans = spans.select(F.col("text_a").alias("a"), F.col("text_b").alias("b"), "spans").dropDuplicates(["a", "b"])
    rows = boxed(docs.withColumn("text", F.col("text").cast("string")), text=F.col("text"), **dict(zip(("text_a", "text_b"), _text_id(), strict=True)))
    # parts between spans; overlapping spans are covered once
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out")))
    done = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    out = rows.join(spans, (F.col("text_a") == F.col("a")) & (F.col("text_b") == F.col("b")), "left")
    return out.select(*unboxed(docs.columns, text=F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)))


def span_string(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of each row of docs."""
    df = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, lambda k: k == KINDS.index(name))).cast("long").alias(f"n_{name}") for name in KINDS[:3]]
    return df.select("doc_id", *n, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))
