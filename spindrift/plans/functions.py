"""The function library over columns of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import agg, bitwise, coll, convert, date, diff, hashing, json, label, math, number, scalar, scoring, spatial, stats, temporal, text, util, vector
from spindrift.functions import map as map_
from spindrift.plans import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH b AS (SELECT o_orderkey AS id, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS xs, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity) AS qs
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT id, list_sum(qs)::DOUBLE AS total, round(list_avg(qs), 6) AS mean, list_min(qs) AS low, list_max(qs) AS high, list_sort(qs) AS sorted, list_reverse(xs) AS reversed,
  list_contains(qs, 10) AS has_ten, len(list_distinct(qs)) < len(qs) AS repeats, list_sort(list_distinct(list_concat(xs, qs))) AS either, list_sort(list_intersect(xs, qs)) AS both,
  list_sort(list_filter(list_distinct(xs), lambda x: NOT list_contains(qs, x))) AS only_left, coalesce(list_position(qs, 10), 0)::BIGINT - 1 AS at,
  list_transform(range(1, len(qs)), lambda i: [qs[i], qs[i + 1]]) AS pairs, list_transform(range(0, len(qs), 2), lambda i: qs[i + 1:i + 2]) AS chunks,
  len(list_filter(qs, lambda x: x = 10))::BIGINT AS tens, qs[2:3] AS middle
FROM b
""")
def coll_functions(spark, sf_dir):
    q = F.struct(F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    b = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(q)).alias("s"))
    b = b.select("id", F.transform("s", lambda s: s["k"]).alias("xs"), F.transform("s", lambda s: s["q"]).alias("qs"))
    return b.select(
        "id", coll.sum_("qs").alias("total"), F.round(coll.avg("qs"), 6).alias("mean"), coll.min_("qs").alias("low"), coll.max_("qs").alias("high"), coll.sort("qs").alias("sorted"),
        coll.reverse("xs").alias("reversed"), coll.contains("qs", 10).alias("has_ten"), coll.contains_duplicates("qs").alias("repeats"), coll.sort(coll.union("xs", "qs")).alias("either"),
        coll.sort(coll.intersection("xs", "qs")).alias("both"), coll.sort(coll.subtract("xs", "qs")).alias("only_left"), coll.index_of("qs", 10).alias("at"), coll.pairs("qs").alias("pairs"),
        coll.split("qs", 2).alias("chunks"), coll.occurrences("qs", 10).alias("tens"), coll.slice_("qs", 1, 3).alias("middle"))


@query(r"""
SELECT p_partkey AS id, upper(p_name[1]) || substr(p_name, 2) AS capitalized, array_to_string(string_split(p_name, ' '), '-') AS joined, replace(p_type, 'STEEL', 'IRON') AS replaced,
  levenshtein(p_name, p_type) AS distance, lpad(p_brand, 12, '*') AS left_padded, reverse(p_name) AS reversed, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS cleaned,
  regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, instr(p_type, 'A')::BIGINT - 1 AS first_a, ord(p_name[1])::BIGINT AS code,
  base64(encode(p_name)) AS encoded, lower(p_type) AS lower_case, substr(p_name, 3, 4) AS part, repeat(p_name[1], 3) AS repeated, contains(p_type, 'BRASS') AS brass
FROM part
""")
def text_functions(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.capitalize("p_name").alias("capitalized"), text.join(text.split("p_name", " "), "-").alias("joined"), text.replace("p_type", "STEEL", "IRON").alias("replaced"),
        text.distance("p_name", "p_type").cast("long").alias("distance"), text.lpad("p_brand", 12, "*").alias("left_padded"), text.reverse("p_name").alias("reversed"), text.clean("p_name").alias("cleaned"),
        text.slug("p_type").alias("slug"), text.index_of("p_type", "A").alias("first_a"), text.code("p_name").alias("code"), text.base64_encode("p_name").alias("encoded"),
        scalar.to_lower("p_type").alias("lower_case"), scalar.substring("p_name", 2, 4).alias("part"), text.repeat(F.substring("p_name", 1, 1), 3).alias("repeated"), F.contains("p_type", F.lit("BRASS")).alias("brass"))


@query("""
SELECT p_partkey AS id, round(p_retailprice, 1) AS rounded, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, round(sqrt(p_size), 6) AS root, round(ln(p_size), 6) AS log,
  round(1 / (1 + exp(-p_size / 10.0)), 6) AS sigmoid, least(greatest(p_size, 10), 20)::INTEGER AS clamped, gcd(p_partkey, p_size)::BIGINT AS gcd, lcm(p_partkey, p_size)::BIGINT AS lcm,
  factorial(p_size % 15)::BIGINT AS factorial, lower(to_hex(p_partkey)) AS hex, bin(p_partkey) AS binary, p_partkey & 255 AS low_bits, xor(p_partkey, 85) AS flipped, bit_count(p_partkey)::INTEGER AS bits,
  sign(p_size - 25)::INTEGER AS sign, p_partkey % 2 = 0 AS even, round(power(p_size, 1.5), 6) AS power
FROM part
""")
def number_functions(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), math.round_("p_retailprice", 1).alias("rounded"), math.ceil("p_retailprice").alias("up"), math.floor("p_retailprice").alias("down"), F.round(math.sqrt("p_size"), 6).alias("root"),
        F.round(math.log("p_size"), 6).alias("log"), F.round(math.sigmoid(F.col("p_size") / 10), 6).alias("sigmoid"), math.clamp("p_size", 10, 20).alias("clamped"), math.gcd("p_partkey", "p_size").alias("gcd"),
        math.lcm("p_partkey", "p_size").alias("lcm"), math.factorial(F.col("p_size") % 15).alias("factorial"), number.to_hex("p_partkey").alias("hex"), number.to_binary("p_partkey").alias("binary"),
        bitwise.and_("p_partkey", 255).alias("low_bits"), bitwise.xor("p_partkey", 85).alias("flipped"), bitwise.count_bits("p_partkey").alias("bits"), number.sign(F.col("p_size") - 25).alias("sign"),
        number.is_even("p_partkey").alias("even"), F.round(math.pow_("p_size", 1.5), 6).alias("power"))


@query("""
SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter, dayofyear(o_orderdate)::INTEGER AS day_of_year, weekofyear(o_orderdate)::INTEGER AS week, dayofweek(o_orderdate)::INTEGER AS weekday,
  strftime(o_orderdate, '%Y-%m-%d') AS formatted, date_trunc('month', o_orderdate)::TIMESTAMP AS month, (o_orderdate + INTERVAL 3 MONTH)::TIMESTAMP AS later, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::BIGINT AS days,
  dayofweek(o_orderdate) IN (0, 6) AS weekend, day(last_day(o_orderdate))::INTEGER AS month_days, epoch(o_orderdate)::BIGINT AS seconds
FROM orders
""")
def temporal_functions(spark, sf_dir):
    o, d = _t(spark, sf_dir, "orders"), F.col("o_orderdate")
    seconds = F.unix_seconds(d.cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("id"), date.field(seconds, "year").alias("year"), temporal.quarter(d).alias("quarter"), temporal.day_of_year(d).alias("day_of_year"), temporal.week_of_year(d).alias("week"),
        temporal.day_of_week(d).alias("weekday"), temporal.format_(d, "yyyy-MM-dd").alias("formatted"), temporal.start_of(d, "month").cast("timestamp_ntz").alias("month"), temporal.add(d, 3, "months").cast("timestamp_ntz").alias("later"),
        temporal.difference(F.lit("1992-01-01").cast("timestamp_ntz"), d, "days").alias("days"), temporal.is_weekend(d).alias("weekend"), temporal.days_in_month(F.year(d), F.month(d)).alias("month_days"), seconds.alias("seconds"))


@query("""
SELECT event_id AS id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first, len(json_keys(props))::INTEGER AS n, list_sort(json_keys(props)) AS keys, json_valid(props) AS valid FROM events
""")
def json_functions(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select(F.col("event_id").alias("id"), F.element_at(m, F.get(json.keys("props"), F.lit(0))).alias("first"), json.size("props").alias("n"), map_.keys(m).alias("keys"), json.validate("props").alias("valid"))


@query("""
SELECT c_custkey AS id, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, base64(unhex(md5(c_name))) AS md5_base64 FROM customer
""")
def hash_functions(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.md5("c_name").alias("md5"), hashing.sha1("c_name").alias("sha1"), hashing.sha256("c_name").alias("sha256"), util.md5_base64("c_name").alias("md5_base64"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_custkey % 170 - 85.0 AS lat1, c_custkey % 350 - 175.0 AS lon1, c_nationkey * 3.0 - 36 AS lat2, c_nationkey * 7.0 - 84 AS lon2 FROM customer)
SELECT id, round(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))) / 1000, 3) AS km,
  lat1 BETWEEN -30 AND 30 AND lon1 BETWEEN -60 AND 60 AS inside
FROM p
""")
def spatial_functions(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    p = spatial.point(F.col("c_custkey") % 170 - 85.0, F.col("c_custkey") % 350 - 175.0)
    q = spatial.point(F.col("c_nationkey") * 3.0 - 36, F.col("c_nationkey") * 7.0 - 84)
    box = F.struct(F.lit(-30.0).alias("min_lat"), F.lit(30.0).alias("max_lat"), F.lit(-60.0).alias("min_lon"), F.lit(60.0).alias("max_lon"))
    return c.select(F.col("c_custkey").alias("id"), p.alias("p"), q.alias("q"), box.alias("box")).select("id", F.round(spatial.distance("p", "q") / 1000, 3).alias("km"), spatial.within("p", "box").alias("inside"))


@query("""
SELECT c_mktsegment AS segment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_pop(c_acctbal), 4) AS deviation, round(var_pop(c_acctbal), 2) AS variance,
  round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr, round(skewness(c_acctbal), 6) AS skew, round(kurtosis(c_acctbal), 6) AS kurtosis, round(corr(c_acctbal, c_custkey), 6) AS correlation,
  round(covar_pop(c_acctbal, c_custkey), 2) AS covariance, round(max(c_acctbal) - min(c_acctbal), 2) AS spread, list_sort(list(c_acctbal))[1:3] AS least
FROM customer GROUP BY c_mktsegment
""")
def statistics(spark, sf_dir):
    x = "c_acctbal"
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        stats.count(x).alias("n"), F.round(stats.mean(x), 4).alias("mean"), F.round(stats.median(x), 4).alias("median"), F.round(stats.std_dev(x), 4).alias("deviation"), F.round(stats.variance(x), 2).alias("variance"),
        F.round(stats.iqr(x), 4).alias("iqr"), F.round(stats.skewness(x), 6).alias("skew"), F.round(stats.kurtosis(x), 6).alias("kurtosis"), F.round(stats.correlation(x, "c_custkey"), 6).alias("correlation"),
        F.round(stats.covariance(x, "c_custkey"), 2).alias("covariance"), F.round(stats.range_(x), 2).alias("spread"), agg.min_items(x, 3).alias("least"))


@query("""
WITH p AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT l_partkey)) AS a FROM lineitem GROUP BY l_suppkey), f AS (SELECT a AS b FROM p ORDER BY id LIMIT 1)
SELECT id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)), 6) AS overlap,
  round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM p, f
""")
def set_scores(spark, sf_dir):
    """Each supplier's parts against the first supplier's."""
    p = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(agg.collect_distinct("l_partkey").alias("a"))
    both = p.crossJoin(F.broadcast(p.orderBy("id").limit(1).select(F.col("a").alias("b"))))  # one row
    return both.select("id", F.round(scoring.jaccard("a", "b"), 6).alias("jaccard"), F.round(scoring.overlap("a", "b"), 6).alias("overlap"), F.round(scoring.dice("a", "b"), 6).alias("dice"))


@query("""
SELECT c_custkey AS id, map_from_entries([('name', c_name), ('segment', 'X')]) AS merged, list_sort(map_keys(map_from_entries([('name', c_name), ('segment', c_mktsegment)]))) AS keys FROM customer
""")
def map_functions(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), map_.set_key(m, "segment", "X").alias("merged"), map_.keys(m).alias("keys"))


@query("""
SELECT c_custkey AS id, try_cast(c_custkey::VARCHAR AS BIGINT) AS whole, try_cast(c_name AS DOUBLE) AS none, c_custkey % 2 = 1 AS flag, list_sort(['Party', c_mktsegment]) AS labels,
  CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class
FROM customer
""")
def conversions(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    class_ = util.case([(F.col("c_acctbal") < 0, "debt"), (F.col("c_acctbal") < 5000, "some")], "rich")
    return c.select(
        F.col("c_custkey").alias("id"), convert.to_integer(F.col("c_custkey").cast("string")).alias("whole"), convert.to_float("c_name").alias("none"), convert.to_boolean((F.col("c_custkey") % 2).cast("string")).alias("flag"),
        label.get(label.add(F.array(F.col("c_mktsegment")), "Party")).alias("labels"), class_.alias("class"))


@query("""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT e AS q FROM v ORDER BY id LIMIT 1)
SELECT id, round(list_cosine_similarity(e, q), 6) AS cosine, round(1 / (1 + list_distance(e, q)), 6) AS euclidean, round(list_inner_product(e, q), 6) AS dot FROM v, f
""")
def vector_functions(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    both = v.crossJoin(F.broadcast(v.orderBy("id").limit(1).select(F.col("embedding").alias("q"))))  # one row
    return both.select("id", F.round(vector.similarity_cosine("embedding", "q"), 6).alias("cosine"), F.round(vector.similarity_euclidean("embedding", "q"), 6).alias("euclidean"), F.round(vector.dot("embedding", "q"), 6).alias("dot"))


@query("""
SELECT n_nationkey AS id, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM (
  SELECT n_nationkey, (SELECT coalesce(list(DISTINCT c_mktsegment), []) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS a,
  (SELECT coalesce(list(DISTINCT c_mktsegment), []) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS b FROM nation)
""")
def list_differences(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    side = c.groupBy("c_nationkey").agg(F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("a"), F.collect_set(F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment"))).alias("b"))
    empty = F.array().cast("array<string>")
    both = n.join(side, F.expr("c_nationkey = n_nationkey"), "left").select(F.col("n_nationkey").alias("id"), F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    d = diff.lists("a", "b")
    return both.select("id", coll.sort(d["added"]).alias("added"), coll.sort(d["removed"]).alias("removed"))
