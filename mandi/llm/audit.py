"""Operator 12: which filter removes what, and how much that depends on the order of filters.

Filters and the documents that fail them are a *removal game*: a coalition of filters is worth the
number of documents that fail at least one of its filters.  With five filters a part of the table
has 32 coalitions, and whatever an order of filters does follows from their worths:

* a step removes the difference of the worths of two coalitions, with and without its filter;
* what a filter removes on average over all orders is its Shapley value, which the potential of the
  game gives (Hart and Mas-Colell): P of no filter is 0, and P(S) = (worth(S) + the sum over i in S of
  P(S without i)) / |S|; a filter's value is P(all) - P(all but it).

60 P(S) is a whole number for every coalition of five (P adds up dividends divided by sizes up to 5), so
the recursion is exact in whole numbers, and a filter's removals summed over all 120 orders are
2 * (60 P(all) - 60 P(all but it)).

Documents meet only to learn whether a text stands under a smaller doc_id as well: rows shrink to a digest
first, and copies are counted before they are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

NAMES = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> list[Column]:
    """Whether a text fails: under 100 words; 100 * distinct words < 80 * words; 100 * capitals > 10 * characters; a character of #$%&*|."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.regexp_count(text, F.lit(WORD))
    few_different = F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n
    capitals = F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.length(text)
    return [n < 100, few_different, capitals, text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Sequence[Column]] = text_filters) -> DataFrame:
    """part, mask, good, toxic and n: how many documents of a part (lang) fail just the filters whose bits mask has.

    Bit i is the i-th of filters, the last bit a text that also stands under a smaller doc_id.
    good: a label of the doc_id has quality 1; toxic: one has toxic 1.  See audit() for odd rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failed = filters(text)
    mask = reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)))
    rows = docs.select(F.sha2(text, 256).alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    each = rows.groupBy("text_id", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("spread"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.filter("doc_id IS NOT NULL").groupBy("doc_id", "spread").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    # rows without doc_id have no label: a second key keeps them from meeting in one task
    each = each.withColumn("spread", F.when(F.col("doc_id").isNull(), F.hash("text_id")).otherwise(0)).join(known, ["doc_id", "spread"], "left").na.fill(False, ["good", "toxic"])
    # the rows of a text's smallest doc_id don't fail the last filter, nor do rows without one
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = each.groupBy("text_id", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), first.alias("first"))
    least = texts.groupBy("text_id").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "text_id")
    stay = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + (1 << len(failed))).alias("mask"), (F.col("n") - stay).alias("n")))).alias("x")
    return texts.select("part", "good", "toxic", both).select("part", "x.mask", "good", "toxic", "x.n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def coalitions(failed: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """One row per part: documents, and arrays by coalition (the bits of its filters) of n, good and toxic: how many such documents fail one of its filters."""
    each = failed.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**filters - 1))))
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    sums = {"n": hit, "good": F.when(F.col("good"), hit).otherwise(0), "toxic": F.when(F.col("toxic"), hit).otherwise(0)}
    per = each.groupBy("part", "coalition").agg(F.sum("n").alias("documents"), *(F.sum(c).alias(k) for k, c in sums.items()))
    got = per.groupBy("part").agg(F.first("documents").alias("documents"), F.sort_array(F.collect_list(F.struct("coalition", *COUNTS))).alias("listed"))
    return got.select("part", "documents", *(F.col("listed")[k].alias(k) for k in COUNTS))


def potentials(worth: Column, filters: int = len(NAMES)) -> Column:
    """Array by coalition of its potential, times lcm(1 to filters), from the array of worths.

    Coalitions come in the order of their bits, so after all that they hold.
    """

    def after(known: Column, s: Column) -> Column:
        without = (F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(filters))
        total = reduce(lambda a, b: a + b, without, F.get(worth, s) * lcm(*range(1, filters + 1)))
        return F.array_append(known, F.call_function("div", total, F.bit_count(s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2**filters - 1)), F.array(F.lit(0).cast("long")), after)


def steps(parts: DataFrame, names: str = NAMES) -> DataFrame:
    """Rows of each part, order of all filters and step, from the arrays of coalitions()."""
    k = len(names)
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("locate", letter, F.lit(names)) - 1)
    orders = F.array(*(F.array(*map(F.lit, o)) for o in permutations(names)))
    df = parts.withColumn("potential", potentials(F.col("n"), k)).withColumn("letters", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    df = df.withColumn("own", bit(F.get("letters", F.col("step") - 1))).withColumn("before", F.aggregate(F.slice("letters", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, x: s + bit(x)))
    df = df.withColumn("with", F.col("before") + F.col("own")).withColumn("others", F.lit(2**k - 1) - F.col("own"))
    lost = lambda c: F.get(c, F.col("with")) - F.get(c, F.col("before"))
    last = lambda c: F.get(c, F.lit(2**k - 1)) - F.get(c, F.col("others"))
    return df.select(
        "part", F.array_join("letters", "").alias("filter_order"), "step", (F.col("documents") - F.get("n", F.col("with"))).alias("kept"), lost("n").alias("removed"), (F.get("n", F.col("own")) - lost("n")).alias("redundant"),
        last("n").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), (last("potential") * (factorial(k) // lcm(*range(1, k + 1)))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters does at each step of all 120 orders, for each part (lang) of docs (doc_id, text, lang).

    Filters: A to D are those of text_filters(), E is a text that also stands under a smaller doc_id, in any
    part, removed or not.  Counts: kept after the step; removed by it; redundant, failing its filter but
    removed before; unique_fails, failing its filter alone; good_lost and toxic_lost, removed with such a
    label (labels: doc_id, quality, toxic); shapley, removed by its filter summed over all orders.

    Null text: empty, equal to other empty ones.  Null lang: part ''.  Null doc_id: has no label, doesn't fail
    E, and no text fails E for it.  Repeated rows: each counts, and those of a text's smallest doc_id don't
    fail E.  A doc_id labelled more than once is good or toxic if any label says so.  Texts of any length are
    read whole; they move as SHA-256 digests, by which texts are equal.  Ties: none.  Empty table: no part, no
    row.  Other columns are ignored.
    """
    return steps(coalitions(failures(docs, labels)))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), f AS (
  SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), m AS (
  SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5
), st AS (
  SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, range(1, 6) u(k)
), g AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
    sum(n) FILTER (mask & before = 0 AND mask & own > 0 AND good) AS good_lost, sum(n) FILTER (mask & before = 0 AND mask & own > 0 AND toxic) AS toxic_lost
  FROM m, st GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM g
"""
