"""Measurement: sources, contracts, mapping, quality flags, city-days, coverage, monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandi.functions.scalar import split_of
from mandi.operators import cityday, contracts, coverage, mapping, monitor, quality, tables
from mandi.sources import files, given, sinks

from .common import DAYS_SQL, FLAGS_SQL, city_days, flagged, folder_of, market_days, out, sql

Q, SQL = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


G = given.QUOTES_SQL
# The tiers' gates in proportion to the shorter calendar (2,499 of 3,063 days).
GATES = {
    "A": {"valid_days": 300, "active_span_coverage": 0.12, "internal_gap": 120, "trailing_gap": 365, "stale_share": 0.25, "outlier_share": 0.10, "poor_day_share": 0.20},
    "B": {"valid_days": 100, "active_span_coverage": 0.03, "internal_gap": 365, "trailing_gap": 730, "poor_day_share": 0.60},
}


# ---------------------------------------------------------------- sources


def _raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as a file would have them; some fields don't parse."""
    q = given.quotes(spark, sf_dir)
    odd = lambda n, c, bad: F.when(F.col("l_orderkey") % n == 0, F.lit(bad)).otherwise(F.col(c).cast("string"))
    return q.select("product_id", odd(97, "date", "2000-13-01").alias("raw_date"), odd(89, "trace", "x1").alias("raw_index"), odd(83, "price", "n/a").alias("raw_price"), F.coalesce(F.col("previous_price").cast("string"), F.lit("0")).alias("raw_previous_price"), F.concat(F.coalesce(F.col("reported_change_pct").cast("string"), F.lit("0")), F.lit("%")).alias("raw_change"))


@query(sql(G, "SELECT product_id, count(*) AS rows, count(*) FILTER (l_orderkey % 97 = 0) AS bad_dates, count(*) FILTER (l_orderkey % 89 = 0) AS bad_integers, count(*) FILTER (l_orderkey % 83 = 0) AS bad_numbers FROM quotes GROUP BY 1"))
def parse_failures(spark, sf_dir):
    return out(files.parse_failures(files.parse_quotes(_raw_text(spark, sf_dir)), ["product_id"]))


@query(sql(G, "SELECT product_id, row_in_file, date FROM (SELECT product_id, date, row_number() OVER (PARTITION BY product_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS row_in_file FROM raw)"))
def trace_key(spark, sf_dir):
    return out(files.with_trace_key(given.raw_quotes(spark, sf_dir), "product_id", given.TIES).select("product_id", "row_in_file", "date"))


@query("SELECT l_returnflag, count(*) AS rows, min(l_quantity) AS least_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_linestatus IN ('F', 'O') AND l_returnflag = 'A' GROUP BY 1")
def scan_pushdown(spark, sf_dir):
    where = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & F.col("l_linestatus").isin("F", "O") & (F.col("l_returnflag") == "A")
    return out(files.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"], where).groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.min("l_quantity").alias("least_quantity")))


@query(sql(G, "SELECT product_id, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (price > 10000) AS dear, count(*) FILTER (mapping_status = 'mapped_existing_city') AS mapped FROM quotes JOIN mapping USING (market_id) GROUP BY 1"))
def manifest(spark, sf_dir):
    df = given.quotes(spark, sf_dir).join(given.mapping(spark, sf_dir), "market_id")
    return out(sinks.manifest(df, ["product_id"], "date", {"dear": F.col("price") > 10000, "mapped": F.col("mapping_status") == "mapped_existing_city"}))


@query(sql(DAYS_SQL, "SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS rows FROM city_day"))
def date_range(spark, sf_dir):
    """From the footers of the city-days' files: no row group is read."""
    return sinks.date_range(spark, folder_of(city_days(spark, sf_dir)), "date")


@query("SELECT count(*) AS rows, min(l_orderkey) AS first_l_orderkey, max(l_orderkey) AS last_l_orderkey, min(l_quantity) AS first_l_quantity, max(l_quantity) AS last_l_quantity, min(l_shipdate) AS first_l_shipdate, max(l_shipdate) AS last_l_shipdate FROM lineitem")
def file_statistics(spark, sf_dir):
    """A table's rows and ranges; the ship date is a timestamp, whose column is scanned."""
    return sinks.statistics(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"])


@query()
def table_fingerprint(spark, sf_dir):
    return sinks.table_fingerprint(given.table(spark, sf_dir, "lineitem"))


@query(sql(DAYS_SQL, "SELECT product_id, count(*) AS rows, sum(price) AS total, min(date) AS first_date FROM city_day GROUP BY 1", doubles="total", digits=0))
def product_json_roundtrip(spark, sf_dir):
    """The nested JSON mart, read back."""
    marts = sinks.product_json(city_days(spark, sf_dir), "product_id", ["price", "quality"], ["city_id", "date"], {"rows": F.count("*")})
    back = marts.select("product_id", F.from_json("value", "rows long, records array<struct<city_id:long,date:date,price:double,quality:string>>").alias("m"))
    each = back.select("product_id", "m.rows", F.explode("m.records").alias("r"))
    return out(each.groupBy("product_id", "rows").agg(F.sum("r.price").alias("total"), F.min("r.date").alias("first_date")).select("product_id", "rows", "total", "first_date"), 0)


# ---------------------------------------------------------------- files written and read


def _folder(spark, tag: str) -> str:
    return f"{tables.shared_dir(spark)}/mandi-{tag}-{uuid.uuid4().hex}"


@query(sql(G, "SELECT product_id, market_id::VARCHAR AS raw_market, date, price, previous_price, round_even(reported_change_pct, 2) AS reported_change_pct, count(*) AS rows, true AS numbered FROM quotes LEFT JOIN mapping USING (market_id) WHERE previous_price IS NOT NULL AND reported_change_pct IS NOT NULL GROUP BY ALL", "", "price previous_price reported_change_pct", 2))
def csv_quotes(spark, sf_dir):
    """Quotes written as CSV files, a file set for each product, and read by the quote reader: header, text, types, products, row numbers.

    Lines are moved twice to be written (once if parts can be broadcast) and once to be grouped; on disk they are text and typed rows.
    """
    products, tasks = given.products(spark, sf_dir), tables.parts(given.table(spark, sf_dir, "lineitem"))
    markets = tables.small(given.mapping(spark, sf_dir).select("market_id", "province"), mapping.MOST_MARKETS)
    df = given.numbered_quotes(spark, sf_dir, products, tasks).filter("previous_price IS NOT NULL AND reported_change_pct IS NOT NULL").join(markets, "market_id", "left")
    text = {"raw_date": F.col("date").cast("string"), "raw_index": F.col("trace").cast("string"), "raw_province": F.coalesce("province", F.lit("")), "raw_market": F.col("market_id").cast("string"), "raw_price": F.col("price").cast("string"), "raw_previous_price": F.col("previous_price").cast("string"), "raw_change": F.concat(F.bround("reported_change_pct", 2).cast("string"), F.lit("%"))}
    path = _folder(spark, "csv")
    df.select("product", *(c.alias(k) for k, c in text.items())).write.partitionBy("product").option("header", True).csv(path)
    written = [f.split("/")[-2:] for f in spark.read.text(path).inputFiles()]
    named = spark.createDataFrame([("/".join(f), products[int(f[0].removeprefix("product="))]) for f in written], "source_file string, product_id string")
    read = ["raw_market", "date", "row_index", "price", "previous_price", "reported_change_pct"]
    parsed = files.assert_parsed(files.read_quotes(spark, path, named, parsed=read, depth=2))
    parsed = parsed.join(F.broadcast(contracts.counted_up(parsed, "source_file", "row_in_file")), "source_file")
    key = ["product_id", "raw_market", "date", "price", "previous_price", "reported_change_pct"]
    # most quotes are alone in their group: they are dealt to the tasks that group them, and not grouped before
    dealt = parsed.withColumn("raw_market", F.nullif("raw_market", F.lit(""))).select(*key, "whole").repartition(tasks, "product_id", "raw_market")
    return out(dealt.groupBy(*key).agg(F.count("*").alias("rows"), F.bool_and("whole").alias("numbered")), 2)


@query("SELECT n_nationkey::BIGINT AS city_id, n_name AS city, r_name AS province FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_dimension(spark, sf_dir):
    """The city dimension as CSV, read with its key checked."""
    path = _folder(spark, "dimension")
    cities = given.table(spark, sf_dir, "nation").join(given.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    cities.write.option("header", True).csv(path)
    return out(files.read_dimension(spark, path, cities.schema, ["city_id"], rows=cities.count()))


@query(sql(DAYS_SQL, "SELECT product_id, count(*) AS rows, sum(price) AS total, product_id = (SELECT min(product_id) FROM city_day) AS replaced FROM city_day WHERE quality = 'good' OR product_id <> (SELECT min(product_id) FROM city_day) GROUP BY 1", "", "total", 0))
def partitioned_table(spark, sf_dir):
    """City-days by product; one product is written again, in its place; then each is read from its own directory."""
    days, path = city_days(spark, sf_dir), _folder(spark, "table")
    sinks.write_table(days, path, days.schema, files=2, rows=5000)
    first = days.agg(F.min("product_id").alias("p")).first().p
    sinks.write_table(days.filter((F.col("product_id") == F.lit(first)) & (F.col("quality") == "good")), path)
    whole = spark.read.parquet(path)
    one = files.scan(spark, path, ["product_id", "price"], F.col("product_id") == F.lit(first)).withColumn("replaced", F.lit(True))
    rest = files.scan(spark, path, ["product_id", "price"], F.col("product_id") != F.lit(first)).withColumn("replaced", F.lit(False))
    assert set(whole.columns) == set(days.columns)
    return out(one.unionByName(rest).groupBy("product_id", "replaced").agg(F.count("*").alias("rows"), F.sum("price").alias("total")), 0)


# ---------------------------------------------------------------- contracts


@query(sql(DAYS_SQL, "SELECT * FROM (SELECT unnest(['rows', 'price_positive', 'share_bounds', 'rows_per_market', 'high_reliability', 'split final_test', 'split train', 'split validation', 'other splits']) AS name, unnest([count(*), count(*) FILTER (NOT price > 0), count(*) FILTER (NOT (stale_share >= 0 AND stale_share <= 1)), count(*) FILTER (NOT source_rows >= markets), count(*) FILTER (NOT reliability >= 0.9), count(*) FILTER (year(date) = 2001), count(*) FILTER (year(date) BETWEEN 1995 AND 1999), count(*) FILTER (year(date) = 2000), 0]) AS found FROM city_day WHERE year(date) BETWEEN 1995 AND 2001)"))
def checks_in_flight(spark, sf_dir):
    """What the city-days' contract counts while the table is written: bounds, splits, schema; no check reads the table again."""
    df = city_days(spark, sf_dir).withColumn("split", split_of(F.col("date"), given.SPLITS)).filter("split IS NOT NULL")
    rules = {"price_positive": F.col("price") > 0, "share_bounds": F.col("stale_share").between(0, 1), "rows_per_market": F.col("source_rows") >= F.col("markets"), "high_reliability": F.col("reliability") >= 0.9}
    known = df.filter("NOT reliability >= 0.9").count()  # a rule that real tables break, as often as said
    _, found = contracts.checked(df, rules, "city-days", {"high_reliability": known}, set(given.SPLITS), df.schema)
    return spark.createDataFrame(list(found.items()), "name string, found long")


@query(sql(G, "SELECT count(*) AS rows, 0 AS missing, 0 AS repeated, count(DISTINCT city_id) AS cities FROM quotes JOIN mapping USING (market_id)", "missing repeated"))
def join_in_flight(spark, sf_dir):
    """Quotes with their mapping, many to one: keys are counted in the join that is written."""
    joined, found = contracts.joined_checked(given.quotes(spark, sf_dir), given.mapping(spark, sf_dir), ["market_id"], "mapped")
    counts = {"missing": found["missing on the right"], "repeated": found["repeated on the right"]}
    return out(joined.agg(F.count("*").alias("rows"), *(F.lit(n).cast("long").alias(k) for k, n in counts.items()), F.count_distinct("city_id").alias("cities")))


# Names as they come: full-width, bracketed, or with a letter missing; SQL knows what each one's plain form is.
@query("""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN left(s_name, 2) || substr(s_name, 4) ELSE s_name END AS plain FROM supplier),
k AS (SELECT s_suppkey, lower(s_name) AS key FROM supplier UNION ALL SELECT -1 - n_nationkey, lower(replace(n_name, ' ', '')) FROM nation),
raw AS (SELECT s_suppkey, lower(plain) AS key FROM r UNION ALL SELECT -1 - n_nationkey, lower(replace(replace(n_name, ' ', ''), 'O', '')) FROM nation)
SELECT raw.s_suppkey::BIGINT AS raw_id, k.s_suppkey::BIGINT AS known_id, levenshtein(raw.key, k.key)::BIGINT AS distance FROM raw, k WHERE levenshtein(raw.key, k.key) <= 1""")
def name_candidates(spark, sf_dir):
    s, n = given.table(spark, sf_dir, "supplier"), given.table(spark, sf_dir, "nation")
    letters = "".join(chr(c) for c in range(0x21, 0x7F))
    name, code = F.col("s_name"), F.col("s_suppkey") % 3
    odd = F.when(code == 0, F.translate(name, letters, "".join(chr(ord(c) + 0xFEE0) for c in letters))).when(code == 1, F.concat(F.lit("【"), F.lower(name), F.lit("】 "))).otherwise(F.concat(F.substring(name, 1, 2), F.substring(name, 4, 99)))
    ids = lambda x, y: s.select(F.col("s_suppkey").cast("long").alias("id"), x.alias("name")).unionByName(n.select((-1 - F.col("n_nationkey")).cast("long").alias("id"), y.alias("name")))
    raw, known = ids(odd, F.replace("n_name", F.lit("O"), F.lit(" "))), ids(name, F.col("n_name"))
    got = mapping.name_candidates(raw, known)
    return out(got.join(raw.select(F.col("id").alias("raw_id"), F.col("name").alias("raw_name")), "raw_name").join(known.select(F.col("id").alias("known_id"), F.col("name").alias("known_name")), "known_name").select("raw_id", "known_id", "distance"))


@query(sql(G, "SELECT product_id, market_id, date, count(*) AS n FROM quotes GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def key_duplicates(spark, sf_dir):
    return out(contracts.duplicates(given.quotes(spark, sf_dir), ["product_id", "market_id", "date"]))


@query("SELECT s_nationkey::BIGINT AS nation, 'left' AS only_in FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT c_nationkey::BIGINT, 'right' FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier)")
def key_completeness(spark, sf_dir):
    a = given.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    b = given.table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return out(contracts.missing(a, b, ["nation"]))


@query(sql(DAYS_SQL, "SELECT (SELECT count(*) FROM flags WHERE mapping_status = 'mapped_existing_city' AND price_valid) AS eligible_rows, (SELECT sum(source_rows)::BIGINT FROM city_day) AS aggregated_rows"))
def conservation(spark, sf_dir):
    eligible = cityday.eligible(flagged(spark, sf_dir)).agg(F.count("*").alias("eligible_rows"))
    return out(eligible.join(F.broadcast(contracts.conservation({"aggregated_rows": F.sum("source_rows")}, city_days(spark, sf_dir)))))


@query(sql(DAYS_SQL, "SELECT product_id, count(*) AS rows, count(*) FILTER (NOT price > 0) AS price_positive, count(*) FILTER (NOT (stale_share >= 0 AND stale_share <= 1)) AS share_bounds, count(*) FILTER (NOT source_rows >= markets) AS rows_per_market, count(*) FILTER (NOT reliability >= 0.9) AS high_reliability FROM city_day GROUP BY 1"))
def domain_check(spark, sf_dir):
    rules = {"price_positive": F.col("price") > 0, "share_bounds": F.col("stale_share").between(0, 1), "rows_per_market": F.col("source_rows") >= F.col("markets"), "high_reliability": F.col("reliability") >= 0.9}
    return out(contracts.broken(city_days(spark, sf_dir), rules, ["product_id"]))


@query("SELECT p_type AS product_id, count(DISTINCT p_brand) AS values FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def dependency_check(spark, sf_dir):
    return out(contracts.dependency_breaks(given.table(spark, sf_dir, "part").withColumnRenamed("p_type", "product_id"), ["product_id"], "p_brand"))


@query("SELECT s_suppkey AS market_id, CASE WHEN s_suppkey % 11 = 0 THEN 'unmapped_with_city' ELSE 'unknown_status' END AS rule FROM supplier WHERE (s_suppkey % 10 = 0 AND s_suppkey % 11 = 0) OR s_suppkey % 13 = 0 AND NOT (s_suppkey % 10 = 0 AND s_suppkey % 11 = 0) UNION ALL SELECT s_suppkey, 'unknown_status' FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey % 11 = 0 AND s_suppkey % 13 = 0 UNION ALL SELECT s_suppkey, 'unmapped_with_city' FROM supplier WHERE s_suppkey % 13 = 0 AND NOT s_suppkey % 10 = 0")
def mapping_rules(spark, sf_dir):
    m = given.mapping(spark, sf_dir)
    # markets that break a rule: unmapped ones with a city, and statuses that don't exist
    bad = m.withColumn("city_id", F.when((F.col("market_id") % 10 == 0) & (F.col("market_id") % 11 == 0), 1).otherwise(F.col("city_id")))
    bad = bad.withColumn("province", F.coalesce("province", F.lit("x"))).withColumn("mapping_status", F.when(F.col("market_id") % 13 == 0, "other").otherwise(F.col("mapping_status")))
    return out(mapping.mapping_rule_breaks(bad))


@query("SELECT s_suppkey AS market_id, CASE WHEN s_suppkey % 17 = 0 THEN 'removed' WHEN s_suppkey % 19 = 0 THEN 'added' ELSE 'changed' END AS difference, CASE WHEN s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0 THEN 'city' ELSE '' END AS columns FROM supplier WHERE (s_suppkey % 17 = 0 AND s_suppkey % 19 <> 0) OR (s_suppkey % 19 = 0 AND s_suppkey % 17 <> 0) OR (s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0 AND s_suppkey % 23 = 0)")
def mapping_diff(spark, sf_dir):
    m = given.mapping(spark, sf_dir).select("market_id", "city", "mapping_status")
    old = m.filter("market_id % 19 <> 0")
    new = m.filter("market_id % 17 <> 0").withColumn("city", F.when(F.col("market_id") % 23 == 0, "moved").otherwise(F.col("city")))
    return out(contracts.table_diff(old, new, ["market_id"]))


@query(sql(G, "SELECT CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'validation' WHEN date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' THEN 'final_test' END AS split, count(*) AS rows FROM quotes GROUP BY 1"))
def split_assign(spark, sf_dir):
    return out(given.quotes(spark, sf_dir).groupBy(split_of(F.col("date"), given.SPLITS).alias("split")).agg(F.count("*").alias("rows")))


# ---------------------------------------------------------------- mapping


@query(sql(G, "SELECT product_id, city_id, province, mapping_confidence, count(*) AS rows, sum(price) AS total FROM quotes LEFT JOIN mapping USING (market_id) GROUP BY ALL", "city_id", "total", 2))
def market_mapping_join(spark, sf_dir):
    m = mapping.map_markets(given.quotes(spark, sf_dir), given.mapping(spark, sf_dir))
    return out(m.groupBy("product_id", "city_id", "province", "mapping_confidence").agg(F.count("*").alias("rows"), F.sum("price").alias("total")), 2)


@query(sql(G + """, m AS (SELECT q.product_id, q.date, q.market_id, m.province, CASE WHEN l_orderkey % 9 < q.market_id % 4 THEN 'OTHER' ELSE m.province END AS raw_province FROM quotes q JOIN mapping m USING (market_id) WHERE m.province IS NOT NULL),
t AS (SELECT market_id, count(*) AS market_rows FROM m GROUP BY 1),
b AS (SELECT market_id, raw_province, province, count(*) AS rows, count(DISTINCT product_id) AS products, min(date) AS first_date, max(date) AS last_date FROM m WHERE raw_province <> province GROUP BY 1, 2, 3)""",
"SELECT b.*, market_rows, rows / market_rows AS share_of_market, rows / (SELECT count(*) FROM m) AS share_of_all, CASE WHEN rows / market_rows >= 0.5 THEN 'review_mapping' WHEN rows / market_rows >= 0.05 THEN 'keep_mapping_flag_source' ELSE 'keep_mapping' END AS decision, row_number() OVER (ORDER BY rows DESC, market_id, raw_province) AS conflict_id FROM b JOIN t USING (market_id)", "", "share_of_market share_of_all"))
def province_conflicts(spark, sf_dir):
    m = given.quotes(spark, sf_dir).join(given.mapping(spark, sf_dir), "market_id").filter("province IS NOT NULL")
    m = m.withColumn("raw_province", F.when(F.col("l_orderkey") % 9 < F.col("market_id") % 4, "OTHER").otherwise(F.col("province")))
    return out(mapping.province_conflicts(m))


@query(sql(G, "SELECT province, city, count(DISTINCT market_id) AS markets, 'C' || lpad(row_number() OVER (ORDER BY province, city)::VARCHAR, 3, '0') AS city_code FROM mapping WHERE city IS NOT NULL GROUP BY province, city"))
def city_dimension(spark, sf_dir):
    return out(mapping.city_dimension(given.mapping(spark, sf_dir)))


@query(sql(G + ", s AS (SELECT product_id, count(*) AS observations, count(*) FILTER (price > 0) AS valid_observations, quantile_cont(price, 0.25) AS p25, median(price) AS p50, quantile_cont(price, 0.75) AS p75 FROM quotes GROUP BY 1)", "SELECT *, CASE WHEN p50 <= (SELECT quantile_cont(p50, 1.0::DOUBLE / 3) FROM s) THEN 'low' WHEN p50 <= (SELECT quantile_cont(p50, 2.0::DOUBLE / 3) FROM s) THEN 'medium' ELSE 'high' END AS price_level FROM s", "", "p25 p50 p75"))
def product_price_level(spark, sf_dir):
    return out(mapping.product_price_level(given.quotes(spark, sf_dir)))


# ---------------------------------------------------------------- quality


_FLAGS = "product_id, market_id, date, trace, price_valid, invalid_reason, change_consistent, duplicate, zero_change, zero_run, stale, days_since_valid, outlier"


@query(sql(FLAGS_SQL, f"SELECT {_FLAGS} FROM flags", "zero_run days_since_valid"))
def quality_flags(spark, sf_dir):
    return out(flagged(spark, sf_dir).select(*_FLAGS.split(", ")))


_COARSE = given.QUOTES_SQL + """,
c1 AS (SELECT *, coalesce(abs(price - previous_price) <= 1e-12 AND date - lag(date) OVER w = 1, false) AS zero_change FROM discounts WINDOW w AS (PARTITION BY product_id, market_id ORDER BY date, trace)),
c2 AS (SELECT *, sum(CASE WHEN zero_change THEN 0 ELSE 1 END) OVER w AS island, last_value(CASE WHEN price > 0 THEN date END IGNORE NULLS) OVER w AS lv FROM c1 WINDOW w AS (PARTITION BY product_id, market_id ORDER BY date, trace)),
c3 AS (SELECT *, CASE WHEN zero_change THEN sum(zero_change::INT) OVER (PARTITION BY product_id, market_id, island ORDER BY date, trace) ELSE 0 END AS zero_run FROM c2)"""


@query(sql(_COARSE, "SELECT product_id, market_id, date, trace, price > 0 AS price_valid, CASE WHEN NOT price > 0 THEN 'not_positive' END AS invalid_reason, zero_change, zero_run, zero_run >= 2 AS stale, date - lv AS days_since_valid FROM c3", "zero_run days_since_valid"))
def stale_runs(spark, sf_dir):
    df = quality.add_quality(given.discounts(spark, sf_dir), stale_after=2)
    return out(df.select("product_id", "market_id", "date", "trace", "price_valid", "invalid_reason", "zero_change", "zero_run", "stale", "days_since_valid"))


@query(sql(FLAGS_SQL, "SELECT product_id, count(*) AS rows, count(*) FILTER (NOT price_valid) AS invalid, count(change_consistent) AS evaluable, count(*) FILTER (NOT change_consistent) AS inconsistent, count(*) FILTER (duplicate) AS duplicate_rows, count(*) FILTER (zero_change) AS zero_change_rows, count(*) FILTER (stale) AS stale_rows, count(*) FILTER (outlier) AS outlier_rows, count(*) FILTER (days_since_valid IS NULL) AS before_first_valid FROM flags GROUP BY ROLLUP (product_id)"))
def quality_summary(spark, sf_dir):
    return out(quality.quality_summary(flagged(spark, sf_dir)))


# ---------------------------------------------------------------- city-days and coverage


@query(sql(DAYS_SQL, "SELECT * FROM market_day", "city_id", "price confidence"))
def market_day(spark, sf_dir):
    return out(market_days(spark, sf_dir))


@query(sql(DAYS_SQL, "SELECT * FROM city_day", "city_id source_rows", "price trimmed_mean_price stale_share outlier_share duplicate_share mean_confidence reliability"))
def city_day(spark, sf_dir):
    return out(city_days(spark, sf_dir))


@query(sql(DAYS_SQL, "SELECT product_id, date, avg(price) AS trimmed_mean_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, date ORDER BY price, market_id) AS r, count(*) OVER (PARTITION BY product_id, date) AS m FROM market_day) WHERE r > floor(m * 0.1) AND r <= m - floor(m * 0.1) GROUP BY 1, 2", "", "trimmed_mean_price"))
def trimmed_mean(spark, sf_dir):
    return out(cityday.trimmed_mean(market_days(spark, sf_dir), ["product_id", "date"]))


@query(sql(DAYS_SQL, "SELECT product_id, count(*) AS rows, count(*) FILTER (mapping_status <> 'mapped_existing_city') AS unmapped, count(*) FILTER (mapping_status = 'mapped_existing_city' AND NOT price_valid) AS invalid_price, count(*) FILTER (mapping_status = 'mapped_existing_city' AND price_valid) AS eligible, (SELECT count(*) FROM market_day m WHERE m.product_id = f.product_id) AS market_days, (SELECT count(*) FROM city_day m WHERE m.product_id = f.product_id) AS city_days FROM flags f GROUP BY 1"))
def exclusions(spark, sf_dir):
    return out(cityday.exclusions(flagged(spark, sf_dir)))


def _tiers(spark, sf_dir) -> DataFrame:
    cities = given.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city_id"))
    products = given.table(spark, sf_dir, "part").select(F.col("p_type").alias("product_id")).distinct()
    metrics = coverage.coverage_metrics(city_days(spark, sf_dir), coverage.dense_grid(products, cities), *given.CALENDAR)
    return coverage.assign_tier(metrics, GATES)


def _gate(g: dict) -> str:
    rules = {"valid_days": "valid_days >=", "active_span_coverage": "active_coverage >=", "internal_gap": "longest_internal_gap <=", "trailing_gap": "trailing_gap <=", "stale_share": "mean_stale_share <=", "outlier_share": "mean_outlier_share <=", "poor_day_share": "poor_share <="}
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({rules[k]} {v}, false) THEN '{k}' END" for k, v in g.items()) + ")"


TIERS_SQL = DAYS_SQL + f""",
g AS (SELECT * FROM (SELECT DISTINCT p_type AS product_id FROM part), (SELECT n_nationkey AS city_id FROM nation)),
dg AS (SELECT *, date - lag(date) OVER (PARTITION BY product_id, city_id ORDER BY date) - 1 AS gap FROM city_day),
got AS (SELECT product_id, city_id, min(date) AS first_date, max(date) AS last_date, count(*) AS d, max(gap) AS gap, avg(markets) AS mean_markets, max(markets) AS mm, avg((markets = 1)::INT) AS single_market_share, avg(stale_share) AS mean_stale_share, avg(outlier_share) AS mean_outlier_share, avg(duplicate_share) AS mean_duplicate_share, avg(reliability) AS mean_reliability, avg((quality = 'good')::INT) AS good_share, avg((quality = 'caution')::INT) AS caution_share, avg((quality = 'poor')::INT) AS poor_share FROM dg GROUP BY 1, 2),
cov0 AS (SELECT g.product_id, g.city_id, first_date, last_date, mean_markets, single_market_share, mean_stale_share, mean_outlier_share, mean_duplicate_share, mean_reliability, good_share, caution_share, poor_share,
  coalesce(d, 0) AS valid_days, coalesce(d, 0) / 2499 AS coverage_rate, coalesce(last_date - first_date + 1, 0) AS active_span, coalesce(first_date - DATE '1995-01-02', 2499) AS leading_gap, coalesce(DATE '2001-11-04' - last_date, 2499) AS trailing_gap, coalesce(gap, 0) AS longest_internal_gap, coalesce(mm, 0) AS max_markets FROM g LEFT JOIN got USING (product_id, city_id)),
cov1 AS (SELECT *, CASE WHEN active_span > 0 THEN valid_days / active_span ELSE 0 END AS active_coverage, greatest(leading_gap, trailing_gap, longest_internal_gap) AS longest_gap FROM cov0),
cov AS (SELECT *, CASE WHEN valid_days = 0 THEN 0 ELSE least(1, greatest(0, 0.45 * coverage_rate + 0.2 * active_coverage + 0.15 * greatest(0, 1 - trailing_gap / 365) + 0.1 * (1 - mean_stale_share) + 0.05 * (1 - mean_outlier_share) + 0.05 * (1 - poor_share))) END AS coverage_score FROM cov1),
gated AS (SELECT *, {_gate(GATES['A'])} AS fa, {_gate(GATES['B'])} AS fb FROM cov),
tiers AS (SELECT * EXCLUDE (fa, fb), CASE WHEN fa = '' THEN 'A' WHEN fb = '' THEN 'B' ELSE 'C' END AS tier, CASE WHEN fa = '' THEN 'meets_all_tier_a_gates' WHEN fb = '' THEN 'tier_a_failed:' || fa || ';meets_all_tier_b_gates' ELSE 'tier_a_failed:' || fa || ';tier_b_failed:' || fb END AS tier_reason FROM gated)"""


@query(sql(TIERS_SQL, "SELECT *, tier = 'A' AS forecast_eligible, tier <> 'C' AS monitor_eligible FROM tiers", "city_id active_span leading_gap trailing_gap longest_internal_gap longest_gap", "mean_markets single_market_share mean_stale_share mean_outlier_share mean_duplicate_share mean_reliability good_share caution_share poor_share coverage_rate active_coverage coverage_score"))
def coverage_tiers(spark, sf_dir):
    return out(_tiers(spark, sf_dir))


@query(sql(TIERS_SQL, "SELECT product_id, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, count(*) FILTER (tier = 'C') AS tier_c, count(*) FILTER (valid_days = 0) AS no_data_cities, median(valid_days) AS median_valid_days, median(coverage_rate) AS median_coverage, max(valid_days) AS max_valid_days FROM tiers GROUP BY 1", "", "median_valid_days median_coverage"))
def tier_summary(spark, sf_dir):
    return out(coverage.tier_summary(_tiers(spark, sf_dir)))


@query(sql(DAYS_SQL, "SELECT product_id, count(*) AS transitions, avg((abs(price - before) <= 1e-12)::INT) AS unchanged_share, median(abs(ln(price / before))) AS median_abs_log_return FROM (SELECT *, lag(price) OVER w AS before, date - lag(date) OVER w AS gap FROM city_day WINDOW w AS (PARTITION BY product_id, city_id ORDER BY date)) WHERE gap = 1 GROUP BY 1", "", "unchanged_share median_abs_log_return"))
def transition_diagnostics(spark, sf_dir):
    return out(coverage.transition_diagnostics(city_days(spark, sf_dir)))


@query(sql(DAYS_SQL, "SELECT CASE WHEN year(date) < 2000 THEN 'train' WHEN year(date) = 2000 THEN 'validation' ELSE 'final_test' END AS split, count(*) AS rows, count(*) FILTER (quality = 'good') AS good, count(*) FILTER (quality = 'caution') AS caution, count(*) FILTER (quality = 'poor') AS poor FROM city_day GROUP BY 1"))
def period_counts(spark, sf_dir):
    return out(coverage.period_counts(city_days(spark, sf_dir), split_of(F.col("date"), given.SPLITS)))


# ---------------------------------------------------------------- monitor


MONTHS_SQL = TIERS_SQL + """,
months AS (SELECT product_id, city_id, province, strftime(date, '%Y-%m') AS month, count(*) AS valid_days, min(date) AS first_date, max(date) AS last_date, avg(reliability) AS mean_reliability, count(*) FILTER (quality = 'good') AS good_days, count(*) FILTER (quality = 'caution') AS caution_days, count(*) FILTER (quality = 'poor') AS poor_days, median(markets) AS median_markets, max(markets) AS max_markets, sum(source_rows) AS source_rows, quantile_cont(price, 0.25) AS p25_price, median(price) AS median_price, quantile_cont(price, 0.75) AS p75_price FROM city_day GROUP BY ALL),
ranked AS (SELECT product_id, month, city_id, province, tier, median_price, months.valid_days, row_number() OVER (PARTITION BY product_id, month ORDER BY median_price DESC, city_id) AS rank FROM months JOIN tiers USING (product_id, city_id) WHERE tier <> 'C' AND months.valid_days >= 3)"""


def _months(spark, sf_dir) -> DataFrame:
    return monitor.monthly_monitor(city_days(spark, sf_dir))


def _ranked(spark, sf_dir) -> DataFrame:
    return monitor.city_ranking(_months(spark, sf_dir), monitor.city_profiles(_tiers(spark, sf_dir)), least_days=3)


@query(sql(MONTHS_SQL, "SELECT * FROM months", "city_id source_rows", "mean_reliability median_markets p25_price median_price p75_price"))
def monthly_monitor(spark, sf_dir):
    return out(_months(spark, sf_dir))


@query(sql(MONTHS_SQL, "SELECT product_id, city_id, tier, tier <> 'C' AS monitor_eligible, tier = 'A' AS forecast_eligible, valid_days, coverage_rate, coverage_score FROM tiers", "city_id", "coverage_rate coverage_score"))
def city_profiles(spark, sf_dir):
    return out(monitor.city_profiles(_tiers(spark, sf_dir)))


@query(sql(MONTHS_SQL, "SELECT * FROM (SELECT product_id, count(*) AS records, count(DISTINCT city_id) AS observed_cities, min(month) AS first_month, max(month) AS last_month FROM months GROUP BY 1) JOIN (SELECT product_id, count(*) FILTER (tier <> 'C') AS eligible_cities, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, count(*) FILTER (tier = 'C') AS tier_c FROM tiers GROUP BY 1) USING (product_id)"))
def product_summary(spark, sf_dir):
    return out(monitor.product_summary(_months(spark, sf_dir), _tiers(spark, sf_dir)))


@query(sql(MONTHS_SQL, "SELECT * FROM ranked", "city_id", "median_price"))
def city_ranking(spark, sf_dir):
    return out(_ranked(spark, sf_dir))


@query(sql(MONTHS_SQL, "SELECT product_id, month, count(*) AS cities, first(city_id ORDER BY median_price DESC, city_id) AS highest_city, max(median_price) AS highest_price, first(city_id ORDER BY median_price, city_id) AS lowest_city, min(median_price) AS lowest_price, quantile_cont(median_price, 0.25) AS p25, median(median_price) AS median, quantile_cont(median_price, 0.75) AS p75, (max(median_price) / min(median_price) - 1) * 100 AS spread_pct FROM ranked GROUP BY 1, 2", "highest_city lowest_city", "highest_price lowest_price p25 median p75 spread_pct"))
def cross_city_spread(spark, sf_dir):
    return out(monitor.cross_city_spread(_ranked(spark, sf_dir)))


@query(sql(MONTHS_SQL, "SELECT product_id, month, province, median(median_price) AS province_median, count(*) AS cities FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 2", "", "province_median"))
def province_summary(spark, sf_dir):
    return out(monitor.province_summary(_ranked(spark, sf_dir)))


@query(sql(MONTHS_SQL + ", s AS (SELECT product_id, city_id, month[6:7]::INT AS calendar_month, count(DISTINCT month[1:4]) AS years, quantile_cont(median_price, 0.25) AS p25, median(median_price) AS median, quantile_cont(median_price, 0.75) AS p75 FROM months GROUP BY 1, 2, 3)", "SELECT *, first_value(calendar_month) OVER (PARTITION BY product_id, city_id ORDER BY median DESC, calendar_month) AS high_month, first_value(calendar_month) OVER (PARTITION BY product_id, city_id ORDER BY median, calendar_month) AS low_month, (max(median) OVER (PARTITION BY product_id, city_id) / min(median) OVER (PARTITION BY product_id, city_id) - 1) * 100 AS gap_pct FROM s", "city_id calendar_month high_month low_month", "p25 median p75 gap_pct"))
def seasonal_profile(spark, sf_dir):
    return out(monitor.seasonal_profile(_months(spark, sf_dir)))


@query(sql(MONTHS_SQL, "SELECT product_id, city_id, month, median_price, lag(month) OVER w AS previous_month, (median_price / lag(median_price) OVER w - 1) * 100 AS change_pct FROM months WINDOW w AS (PARTITION BY product_id, city_id ORDER BY month)", "city_id", "median_price change_pct"))
def month_change(spark, sf_dir):
    return out(monitor.month_change(_months(spark, sf_dir)))


@query(sql(MONTHS_SQL, "SELECT product_id, city_id, month, tier, m.valid_days, poor_days / m.valid_days AS poor_share, m.valid_days / day(last_day((month || '-01')::DATE)) AS month_coverage FROM months m LEFT JOIN tiers USING (product_id, city_id)", "city_id", "poor_share month_coverage"))
def data_quality_story(spark, sf_dir):
    return out(monitor.data_quality_story(_months(spark, sf_dir), monitor.city_profiles(_tiers(spark, sf_dir))))


@query(sql(MONTHS_SQL, "SELECT product_id, city_id, month, percent_rank() OVER (PARTITION BY product_id, month ORDER BY median_price) AS peer_percentile, cume_dist() OVER (PARTITION BY product_id, city_id, month[6:7] ORDER BY median_price) AS seasonal_percentile FROM months", "city_id", "peer_percentile seasonal_percentile"))
def peer_percentile(spark, sf_dir):
    return out(monitor.peer_percentile(_months(spark, sf_dir)))
