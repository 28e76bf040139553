"""Queries over the driver's tables that run this package's operators, each with its SQL.

None of those tables holds scanned words, so columns stand in for them: names for ids, prices for weights,
line items for boxes on a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import identify, layout, ordered, reconcile, spatial
from tidemark.plans import rollup as rollup_plans
from tidemark.plans.rollup import rollup
from tidemark.sources import sinks


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_rollup(spark, d):
    """Orders looked up by customer id, rolled up by status of the lookup."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    known = _t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    hits = identify.exact_lookup(orders, "o_custkey", known, "c_custkey")
    return hits.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def fuzzy(spark, d):
    """Supplier names within one edit of customer names, recast to one form."""
    a = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("S"), F.substring("c_name", -9, 9)).alias("cn"))
    b = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.substring("s_name", -9, 9)).alias("sn"))
    return identify.fuzzy_lookup(a, "cn", b, "sn", 1).select("c_custkey", "s_suppkey", F.col("_distance").cast("int").alias("distance"))


def exact_then_fuzzy(spark, d):
    """Damaged part keys: exact lookup first, near lookup only for those without one."""
    parts = _t(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("pid"))
    scans = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    key = F.lpad(F.col("l_partkey").cast("string"), 7, "0")
    scans = scans.withColumn("scan", F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.substring(key, 1, 6), F.lit("X"))).otherwise(key))
    line = ["l_orderkey", "l_linenumber"]
    exact = identify.exact_lookup(scans, "scan", parts, "pid").select(*line, "scan", "p_partkey", F.lit(0).alias("distance"))
    left = scans.join(exact.select(*line), line, "left_anti")
    # near ids are looked up once for each different reading
    read = left.select("scan").distinct()
    near = ordered.top_k(identify.fuzzy_lookup(read, "scan", parts, "pid", 1), "scan", [F.asc("_distance"), F.asc("p_partkey")])
    return exact.unionByName(left.join(near.select("scan", "p_partkey", F.col("_distance").cast("int").alias("distance")), "scan").select(*line, "scan", "p_partkey", "distance"))


def keep_first(spark, d):
    return ordered.keep_first(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


def keep_last(spark, d):
    return ordered.keep_last(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


def upper_median(spark, d):
    return ordered.upper_median(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "med")


def floor_percentile(spark, d):
    return ordered.floor_percentile(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "p90")


def true_median(spark, d):
    return ordered.true_median(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "med")


def first_mode(spark, d):
    return ordered.first_mode(_t(spark, d, "events"), "user_id", "event_type", "event_id", "mode")


def islands(spark, d):
    """Sessions of a user's events: runs with gaps up to six hours."""
    events = _t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    marked = ordered.islands(events, "user_id", "us", 6 * 3600 * 1_000_000, "event_id")
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def overlap_dedupe(spark, d):
    """Line items of an order as intervals of price; those that an earlier one covers drop out."""
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("lo"), (F.col("l_extendedprice") + F.col("l_quantity") * 200).alias("hi"))
    return ordered.overlap_dedupe(items, "l_orderkey", "l_linenumber", "lo", "hi").select("l_orderkey", "l_linenumber")


def nearest_below(spark, d):
    """Each error event with the user's next purchase within ten days."""
    e = _t(spark, d, "events").withColumn("day", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0))
    a = e.filter("event_type = 'error'").select("user_id", "event_id", F.col("day").alias("at"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("day").alias("then"))
    return spatial.nearest_after(a, b, ["user_id"], "at", "then", 10.0, "purchase_id", ["event_id"]).select("event_id", "purchase_id")


def containment(spark, d):
    """Orders inside price bands of their customer's segment."""
    bands = _t(spark, d, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    bands = bands.select(F.lit(1).alias("g"), "p_size", (F.col("low") * 100).alias("low"), (F.col("low") * 100 + 500).alias("high"))
    orders = _t(spark, d, "orders").select(F.lit(1).alias("g"), "o_orderkey", "o_totalprice")
    return spatial.within(orders, bands, ["g"], "o_totalprice", "low", "high", 500.0).select("o_orderkey", "p_size")


def glyph_repair(spark, d):
    """Customer names with digits turned into look-alikes, read back as numbers."""
    damaged = F.translate(F.substring("c_name", -9, 9), "018", "OIB")
    return _t(spark, d, "customer").select("c_custkey", damaged.alias("damaged"), text.repaired_digits(damaged).alias("repaired"), F.array_join(text.numeric_variants(damaged), ",").alias("variants"))


def url_digits(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(text.digit_runs(F.col("url"), 2, 4)).alias("run"))


def fuzzy_substring(spark, d):
    """Words of documents that nearly hold a word."""
    words = _t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.filter(text.holds_nearly(F.col("w"), "worthless", 1)).select("w", "n")


def status_rollup(spark, d):
    """Labels as results of a batch: good ones are ok, the rest are not."""
    status = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "ok").otherwise("unmatched")
    return rollup(_t(spark, d, "labels").select((F.col("doc_id") % 5).alias("job_id"), status.alias("status")))


def best_pair(spark, d):
    """Of each nation the two suppliers whose balances are closest."""
    s = _t(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    return spatial.closest_pair(s, "s_nationkey", "s_suppkey", "cents").select("s_nationkey", F.col("a.s_suppkey").alias("first"), F.col("b.s_suppkey").alias("second"), "gap")


def suffix_names(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return ordered.suffix_names(o, ["o_custkey"], "o_orderkey", text.safe_id_name(F.col("o_custkey").cast("string")), F.lit(".jpg")).select("o_orderkey", "output_name")


def union_distinct(spark, d):
    """Two overlapping readings of orders; one row for each customer and rounded price, of the earlier reading."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    a, b = o.filter("o_totalprice < 200000"), o.filter("o_totalprice > 100000")
    both = ordered.union_first([a, b], [F.col("o_custkey"), ordered.half_up(F.col("o_totalprice") / 10000)], "o_orderkey")
    return both.select("o_orderkey", "o_custkey")


def precision(spark, d):
    """Most decimals that a group's prices are printed with."""
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max(numbers.own_decimals(F.col("l_extendedprice"))).cast("int").alias("places"))


def topk_ties(spark, d):
    """Three best orders of each customer by size class; ties to the earlier order."""
    o = _t(spark, d, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 50000).cast("int"))
    return ordered.top_k(o, "o_custkey", [F.desc("score"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "score")


def spread_out(spark, d):
    """Line items of an order that no earlier one is close to in quantity and discount."""
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.round(F.col("l_discount") * 100)).alias("pct"))
    return ordered.spread_out(items, "l_orderkey", "l_linenumber", "l_quantity", "pct", 4.0).select("l_orderkey", "l_linenumber")


def band_join(spark, d):
    """Supplier balances nearly equal to customer balances."""
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"))
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    return spatial.band_join(s, c, "a", "b", 0.5).select("s_suppkey", "c_custkey")


#: Words of headers and words one letter from them.
HEADERS = ("WEIGHT", "weight(kg)", "FREIGHT", "ACTUAL", "xactual", "CHARGED", "Chargeable", "charger", "chargers", "WE1GHT", "netweightkg", "goods")


def header_words(spark, d):
    """Which words would head a weight column or qualify one: the documents', and for each customer a header that lost or changed a letter."""
    k = F.col("c_custkey")
    whole, at = F.element_at(F.array(*map(F.lit, HEADERS)), (k % len(HEADERS) + 1).cast("int")), (k % 7).cast("int")
    before, after = F.substring(whole, F.lit(1), at), F.substring(whole, at + 2, F.lit(20))
    damaged = F.when(k % 5 == 0, whole).when(k % 5 < 3, F.concat(before, F.chr(k % 26 + 97), after)).otherwise(F.concat(before, after))
    seen = _t(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).unionByName(_t(spark, d, "customer").select(damaged.alias("w")))
    words = seen.groupBy("w").agg(F.count("*").alias("n"))
    w = F.col("w")
    kinds = words.select(w, "n", text.is_weight_header(w).alias("header"), text.is_qualifier(w).alias("qualifier"), text.is_actual_token(w).alias("actual"), text.is_charged_token(w).alias("charged"), text.column_kind(w).alias("kind"))
    return kinds.groupBy("header", "qualifier", "actual", "charged", "kind").agg(F.count("*").alias("words"), F.sum("n").alias("places"))


def numeric_tokens(spark, d):
    """Printed prices as tokens: plain numbers, damaged ones, values."""
    shown = F.regexp_replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), "0", "O")
    t = _t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, shown).otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("t"))
    return t.groupBy(text.is_number(F.col("t")).alias("plain"), text.is_damaged_number(F.col("t")).alias("damaged")).agg(F.count("*").alias("n"), F.sum(text.number_value(F.col("t")).cast("decimal(18,2)")).cast("double").alias("total"))


def semi_request(spark, d):
    """A request list of names, in folders, against what exists."""
    asked = _t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("out/"), F.col("o_custkey").cast("string")).alias("output_name"))
    return sinks.selected(_t(spark, d, "customer").withColumn("output_name", F.col("c_custkey").cast("string")), asked).select("c_custkey", "c_name")



def durations(spark, d):
    """Days between orders and their first shipment, as job durations in milliseconds."""
    first = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("completed_at"))
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"))
    jobs = orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    return rollup_plans.durations(jobs).select("o_orderkey", "duration_ms")


def except_seen(spark, d):
    """Customers without a finished order."""
    seen = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ordered.except_seen(_t(spark, d, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


def not_covered(spark, d):
    """Line items as boxes of quantity and price that no other status' average box covers."""
    box = lambda x0, y0, x1, y1: F.struct(*[v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    q, p = F.col("l_quantity"), F.col("l_discount") * 100
    items = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("image_id"), "l_orderkey", "l_linenumber", box(q, p, q + 4, p + 4).alias("bbox"))
    heads = spark.createDataFrame([("A", 10.0), ("N", 20.0), ("R", 30.0)], "image_id string, x double").select("image_id", box(F.col("x"), F.lit(0), F.col("x") + 9, F.lit(9)).alias("bbox"))
    return spatial.not_covered(items, heads, "image_id").select("l_orderkey", "l_linenumber", "image_id")


def position_scores(spark, d):
    """Scores of line items as if they were numbers on a page of 50 by 100."""
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 1000
    score = numbers.position_score(x0, y0, x0 + 5, y0 + F.col("l_tax") * 100, F.lit(60), F.lit(100), F.lit(4.0))
    return _t(spark, d, "lineitem").select(score.alias("score")).groupBy("score").agg(F.count("*").alias("n"))


def pages_of_orders(spark, d):
    """Orders as pages: their key in the header, in one word or in parts, two headers, a printed price under each."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    key = F.lpad((F.col("o_orderkey") + 300_000_000).cast("string"), 9, "0")
    word = lambda n, t, x0, y0, x1, y1: F.struct(F.lit(n).alias("word_ord"), t.alias("text"), F.lit(90.0).alias("confidence"), F.struct(F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1")).alias("bbox"))
    price = (F.col("o_totalprice") % 1000).cast("decimal(7,2)").cast("string")
    split = F.col("o_orderkey") % 30 == 0
    words = F.array(
        word(0, F.when(split, F.substring(key, 1, 4)).otherwise(key), 500.0, 30.0, 560.0, 60.0), word(1, F.when(split, F.substring(key, 5, 5)).otherwise(F.lit("x")), 565.0, 31.0, 640.0, 61.0),
        word(2, F.lit("ACTUAL"), 200.0, 300.0, 270.0, 320.0), word(3, F.lit("CHARGED"), 320.0, 300.0, 400.0, 320.0), word(4, price, 205.0, 350.0, 255.0, 365.0), word(5, price, 325.0, 350.0, 375.0, 365.0),
    )
    image = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    pages = o.select(image.alias("image_id"), F.lit(0).alias("rotation"), F.lit("base").alias("pass"), F.explode(words).alias("w")).select("image_id", "rotation", "pass", "w.*")
    images = o.select(image.alias("image_id"), F.concat(image, F.lit(".jpg")).alias("filename"), F.lit(1000).alias("width"), F.lit(1000).alias("height"), F.lit(1).alias("orientation"))
    mapping = o.filter("o_orderkey % 70 != 0").select(F.col("o_orderkey").cast("int").alias("row_number"), key.alias("id"), F.round(F.col("o_totalprice") / 1000, 1).alias("weight"))
    return pages, images, mapping


def page_matches(spark, d):
    """Ids found on the pages, and how."""
    pages, images, mapping = pages_of_orders(spark, d)
    return identify.page_matches(pages, images, mapping).select("image_id", "id", "distance", "source")


def corrections(spark, d):
    """Proposed corrections of a whole job over the pages."""
    pages, images, mapping = pages_of_orders(spark, d)
    fixes = reconcile.proposed_corrections(reconcile.results(pages, images, mapping))
    return fixes.select("image_id", "shipment_id", "kind", "original_text", "new_text", "new_weight")


def page_results(spark, d):
    """Status of each page, rolled up."""
    pages, images, mapping = pages_of_orders(spark, d)
    return reconcile.results(pages, images, mapping).groupBy("status").agg(F.count("*").alias("n"))


def anchors(spark, d):
    """Column headers of the pages."""
    pages, images, _ = pages_of_orders(spark, d)
    return layout.anchors(pages, images).select("image_id", "anchor_ord", F.array_join("words", " ").alias("words"), "bbox.x0")


def regions(spark, d):
    """Value cells of the pages."""
    pages, images, _ = pages_of_orders(spark, d)
    return layout.regions(pages, images).select("image_id", "region_ord", "original_text", "kind")


def _nearly(target: str) -> str:
    """SQL for a stretch of column h within one edit of target."""
    sizes = range(len(target) - 1, len(target) + 2)
    return " OR ".join([f"contains(h, '{target}')", *(f"len(list_filter(range(1, len(h) - {m - 2}), lambda i: levenshtein(substr(h, i, {m}), '{target}') <= 1)) > 0" for m in sizes)])


SQL = {
    "q01_exact_lookup": "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1",
    "q02_fuzzy_lookup": "WITH a AS (SELECT c_custkey, 'S' || right(c_name, 9) AS cn FROM customer), b AS (SELECT s_suppkey, 'S' || right(s_name, 9) AS sn FROM supplier) SELECT c_custkey, s_suppkey, levenshtein(cn, sn)::INT AS distance FROM a, b WHERE levenshtein(cn, sn) <= 1",
    "q03_exact_then_fuzzy": """WITH parts AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 7, '0') AS pid FROM part),
        scans AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN substr(lpad(l_partkey::VARCHAR, 7, '0'), 1, 6) || 'X' ELSE lpad(l_partkey::VARCHAR, 7, '0') END AS scan FROM lineitem),
        ex AS (SELECT l_orderkey, l_linenumber, scan, p_partkey, 0 AS distance FROM scans JOIN parts ON scan = pid),
        readings AS (SELECT DISTINCT scan FROM scans WHERE scan NOT IN (SELECT pid FROM parts)),
        near AS (SELECT scan, p_partkey, levenshtein(scan, pid)::INT AS distance FROM readings, parts WHERE levenshtein(scan, pid) <= 1 QUALIFY row_number() OVER (PARTITION BY scan ORDER BY levenshtein(scan, pid), p_partkey) = 1)
        SELECT * FROM ex UNION ALL SELECT l_orderkey, l_linenumber, scan, p_partkey, distance FROM scans JOIN near USING (scan)""",
    "q04_keep_first": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "q05_keep_last": "SELECT o_custkey, o_orderkey, o_orderpriority, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "q06_upper_median": "SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[floor(count(*) / 2)::BIGINT + 1] AS med FROM lineitem GROUP BY 1, 2",
    "q07_floor_percentile": "SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[least(count(*) - 1, floor(count(*) * 0.9::DOUBLE)::BIGINT) + 1] AS p90 FROM lineitem GROUP BY 1, 2",
    "q07b_true_median": "SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY 1",
    "q08_mode_first": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, event_type AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) = 1",
    "q09_islands": "WITH j AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM j) SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY 1, 2",
    "q10_overlap_dedupe": "WITH i AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS lo, l_extendedprice + l_quantity * 200 AS hi FROM lineitem) SELECT l_orderkey, l_linenumber FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND (greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) >= least(a.hi - a.lo, b.hi - b.lo) * 0.55::DOUBLE OR abs((a.hi + a.lo) / 2 - (b.hi + b.lo) / 2) < greatest(a.hi - a.lo, b.hi - b.lo) * 0.6::DOUBLE))",
    "q11_nearest_below": "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 86400000000.0::DOUBLE AS day FROM events) SELECT a.event_id, b.event_id AS purchase_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.day - a.day BETWEEN 0 AND 10 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.day - a.day, b.event_id) = 1",
    "q12_containment": "WITH b AS (SELECT p_size, min(p_retailprice) * 100 AS low FROM part GROUP BY 1) SELECT o_orderkey, p_size FROM orders, b WHERE o_totalprice BETWEEN low AND low + 500",
    "q13_glyph_repair": "WITH d AS (SELECT c_custkey, translate(right(c_name, 9), '018', 'OIB') AS damaged FROM customer), r AS (SELECT c_custkey, damaged, regexp_replace(damaged, '[^A-Za-z0-9|]', '', 'g') AS compact FROM d), s AS (SELECT *, CASE WHEN len(compact) >= 7 AND len(regexp_replace(compact, '[^A-Za-z]', '', 'g')) <= 2 THEN nullif(regexp_replace(translate(upper(compact), 'OQDIL|ZSGB', '0001112568'), '[^0-9]', '', 'g'), '') END AS repaired, nullif(regexp_replace(damaged, '[^0-9]', '', 'g'), '') AS plain FROM r) SELECT c_custkey, damaged, repaired, concat_ws(',', plain, CASE WHEN repaired IS DISTINCT FROM plain THEN repaired END) AS variants FROM s",
    "q14_url_digits": "SELECT page_id, unnest(regexp_extract_all(url, '([0-9]{2,4})', 1)) AS run FROM pages",
    "q15_fuzzy_substring": "WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1), k AS (SELECT w, n, regexp_replace(translate(lower(w), '|1l', 'iii'), '[^a-z]', '', 'g') AS t FROM w), z AS (SELECT unnest([8, 9, 10]) AS m), s AS (SELECT DISTINCT w FROM (SELECT w, t, m, unnest(range(1, len(t) - m + 2)) AS i FROM k, z) WHERE levenshtein(substr(t, i, m), 'worthless') <= 1) SELECT w, n FROM k WHERE w IN (SELECT w FROM s)",
    "q16_status_rollup": "WITH s AS (SELECT doc_id % 5 AS job_id, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'ok' ELSE 'unmatched' END AS status FROM labels) SELECT job_id, count(*) AS processed_files, count(*) FILTER (WHERE status = 'ok') AS matched_files, count(*) FILTER (WHERE status <> 'ok') AS unmatched_files FROM s GROUP BY 1",
    "q17_pair_selection": "WITH s AS (SELECT s_nationkey, s_suppkey, round(s_acctbal * 100)::BIGINT AS cents FROM supplier) SELECT a.s_nationkey, a.s_suppkey AS first, b.s_suppkey AS second, abs(a.cents - b.cents) AS gap FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey QUALIFY row_number() OVER (PARTITION BY a.s_nationkey ORDER BY abs(a.cents - b.cents), a.s_suppkey, b.s_suppkey) = 1",
    "q18_suffix_names": "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, o_custkey || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.jpg' AS output_name FROM r",
    "q19_union_distinct": "WITH u AS (SELECT 0 AS p, * FROM orders WHERE o_totalprice < 200000 UNION ALL SELECT 1 AS p, * FROM orders WHERE o_totalprice > 100000) SELECT o_orderkey, o_custkey FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, floor(o_totalprice / 10000 + 0.5::DOUBLE) ORDER BY p, o_orderkey) = 1",
    "q20_precision": r"SELECT l_returnflag, max(len(regexp_extract(regexp_replace(l_extendedprice::VARCHAR, '\.?0+$', ''), '\.([0-9]+)', 1)))::INT AS places FROM lineitem GROUP BY 1",
    "q21_topk_ties": "SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000)::INT AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) <= 3",
    "q22_spread_out": "WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, round(l_discount * 100) AS y FROM lineitem) SELECT l_orderkey, l_linenumber FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND abs(a.x - b.x) < 4 AND abs(a.y - b.y) < 4)",
    "q23_band_join": "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE abs(s_acctbal - c_acctbal) < 0.5",
    "q24_header_words": f"""WITH d AS (SELECT c_custkey AS k, {list(HEADERS)}[c_custkey % {len(HEADERS)} + 1] AS s, (c_custkey % 7)::INT AS a FROM customer),
        w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents UNION ALL
          SELECT CASE WHEN k % 5 = 0 THEN s WHEN k % 5 < 3 THEN substr(s, 1, a) || chr((k % 26 + 97)::INT) || substr(s, a + 2) ELSE substr(s, 1, a) || substr(s, a + 2) END FROM d) GROUP BY 1),
        t AS (SELECT w, n, regexp_replace(translate(lower(w), '|1l', 'iii'), '[^a-z]', '', 'g') AS h, regexp_replace(lower(w), '[^a-z]', '', 'g') AS q FROM w),
        k AS (SELECT n, NOT ({_nearly("freight")}) AND (contains(lower(w), 'weight') OR {_nearly("weight")}) AS header,
          lower(w) IN ('actual', 'charged', 'chargeable') OR (q <> '' AND NOT regexp_matches(q, '^chargers?$') AND (q = 'ctual' OR levenshtein(q, 'actual') <= 1 OR (levenshtein(q, 'charged') <= 1 AND NOT starts_with(q, 'charger')) OR levenshtein(q, 'chargeable') <= 1)) AS qualifier,
          q IN ('actual', 'ctual') OR (len(q) <= 14 AND ends_with(q, 'actual')) AS actual, q IN ('charged', 'chargeable', 'chargd', 'chargeq', 'charget', 'cherged') AS charged,
          CASE WHEN contains(q, 'ctual') THEN 'actual' WHEN regexp_matches(q, 'charged|chargeable|chargd') THEN 'charged' END AS kind FROM t)
        SELECT header, qualifier, actual, charged, kind, count(*) AS words, sum(n)::BIGINT AS places FROM k GROUP BY ALL""",
    "q25_numeric_tokens": r"""WITH t AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN replace(l_extendedprice::DECIMAL(12,2)::VARCHAR, '0', 'O') ELSE l_extendedprice::DECIMAL(12,2)::VARCHAR END AS t FROM lineitem),
        k AS (SELECT t, regexp_matches(t, '^[0-9]{1,6}(\.[0-9]{1,3})?$') AS plain FROM t)
        SELECT plain, NOT plain AND len(t) BETWEEN 2 AND 10 AND regexp_matches(t, '[.,]') AND len(regexp_replace(t, '[^A-Za-z]', '', 'g')) <= 3 AS damaged, count(*) AS n, sum(CASE WHEN regexp_matches(t, '^[0-9]+(\.[0-9]+)?$') THEN t::DECIMAL(18,2) END)::DOUBLE AS total FROM k GROUP BY 1, 2""",
    "q26_semi_request": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "q27_durations": "SELECT o_orderkey, epoch_ms(min(l_shipdate)) - epoch_ms(o_orderdate) AS duration_ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate",
    "q28_except_seen": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "q29_not_covered": """WITH h(f, x) AS (VALUES ('A', 10.0::DOUBLE), ('N', 20.0::DOUBLE), ('R', 30.0::DOUBLE)), i AS (SELECT l_orderkey, l_linenumber, l_returnflag AS image_id, l_quantity AS q, l_discount * 100 AS p FROM lineitem)
        SELECT l_orderkey, l_linenumber, image_id FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE f = image_id AND greatest(0.0::DOUBLE, least(q + 4, x + 9) - greatest(q, x)) * greatest(0.0::DOUBLE, least(p + 4, 9.0::DOUBLE) - greatest(p, 0.0::DOUBLE)) / ((q + 4 - q) * (p + 4 - p)) >= 0.75::DOUBLE)""",
    "q30_position_scores": """WITH b AS (SELECT l_quantity AS x0, l_discount * 1000 AS y0, l_quantity + 5 AS x1, l_discount * 1000 + l_tax * 100 AS y1 FROM lineitem)
        SELECT (CASE WHEN (y0 + y1) / 2 <= 100 * 0.22::DOUBLE THEN 30.0 WHEN (y0 + y1) / 2 <= 100 * 0.34::DOUBLE THEN 12.0 ELSE 0.0 END + CASE WHEN (x0 + x1) / 2 >= 60 * 0.38::DOUBLE THEN 12.0 ELSE 0.0 END + CASE WHEN y1 - y0 >= 4.0::DOUBLE * 1.35::DOUBLE THEN 8.0 ELSE 0.0 END)::DOUBLE AS score, count(*) AS n FROM b GROUP BY 1""",
    "q31_page_matches": """WITH o AS (SELECT o_orderkey, lpad((o_orderkey + 300000000)::VARCHAR, 9, '0') AS k FROM orders), m AS (SELECT k AS id FROM o WHERE o_orderkey % 70 <> 0),
        exact AS (SELECT 'p' || o_orderkey AS image_id, k AS id, 0 AS distance, CASE WHEN o_orderkey % 30 = 0 THEN 'ocr_fragments' ELSE 'ocr' END AS source FROM o WHERE o_orderkey % 70 <> 0)
        SELECT * FROM exact UNION ALL
        SELECT 'p' || a.o_orderkey, m.id, levenshtein(a.k, m.id)::INT, 'ocr_fuzzy' FROM o a JOIN m ON levenshtein(a.k, m.id) = 1 WHERE a.o_orderkey % 70 = 0 QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY m.id) = 1""",
    "q32_corrections": None,
    "q33_page_results": None,
    "q34_anchors": """SELECT 'p' || o_orderkey AS image_id, a.anchor_ord, a.words, a.x0 FROM orders, (VALUES (0, 'ACTUAL', 200.0::DOUBLE), (1, 'CHARGED', 320.0::DOUBLE)) a(anchor_ord, words, x0)""",
    "q35_regions": """SELECT 'p' || o_orderkey AS image_id, a.region_ord, (o_totalprice % 1000)::DECIMAL(7,2)::VARCHAR AS original_text, a.kind FROM orders, (VALUES (0, 'actual'), (1, 'charged')) a(region_ord, kind)""",
}

SQL["q32_corrections"] = f"""WITH m AS ({SQL["q31_page_matches"]}), o AS (SELECT o_orderkey, o_totalprice, lpad((o_orderkey + 300000000)::VARCHAR, 9, '0') AS k FROM orders)
    SELECT m.image_id, m.id AS shipment_id, v.kind, (p.o_totalprice % 1000)::DECIMAL(7,2)::VARCHAR AS original_text, printf('%.2f', round(w.o_totalprice / 1000, 1)) AS new_text, round(w.o_totalprice / 1000, 1) AS new_weight
    FROM m JOIN o p ON m.image_id = 'p' || p.o_orderkey JOIN o w ON m.id = w.k, (VALUES ('actual'), ('charged')) v(kind)"""
SQL["q33_page_results"] = f"""WITH m AS ({SQL["q31_page_matches"]}) SELECT CASE WHEN m.id IS NULL THEN 'unmatched' ELSE 'ok' END AS status, count(*) AS n FROM orders LEFT JOIN m ON m.image_id = 'p' || o_orderkey GROUP BY 1"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(
    zip(
        SQL,
        (
            exact_rollup, fuzzy, exact_then_fuzzy, keep_first, keep_last, upper_median, floor_percentile, true_median, first_mode, islands, overlap_dedupe, nearest_below, containment,
            glyph_repair, url_digits, fuzzy_substring, status_rollup, best_pair, suffix_names, union_distinct, precision, topk_ties, spread_out, band_join, header_words, numeric_tokens, semi_request,
            durations, except_seen, not_covered, position_scores, page_matches, corrections, page_results, anchors, regions,
        ),
        strict=True,
    )
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}
