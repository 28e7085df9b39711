"""Region clustering: panel regions and, for larger numbers, customers as regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import hotspots, region
from ..sources import derived
from .base import BLOCKS, cleaned, featured, key, query

EPS = 0.35
# small enough that blocks are split on the smallest tables too; h03 and h04 run rounds down to FINISH edges where there are several regions
BLOCK, FINISH = 1024, 500


def customer_regions(spark, folder):
    """One region per customer: placed around its nation, two signals from its orders."""
    custkey, nation = F.col("c_custkey"), F.col("c_nationkey")
    spend = derived.read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        derived.exact_sum("o_totalprice").alias("s"), F.count("*").alias("n")
    )
    return derived.read(spark, folder, "customer").join(spend, "c_custkey", "left").select(
        custkey.cast("string").alias("zipcode"),
        (F.lit(25) + nation + (custkey * 7919 % 1000) / 2000).alias("lat"),
        (F.lit(-120) + nation * 7 % 25 * 2 + (custkey * 104729 % 1000) / 1000).alias("lon"),
        (F.col("s") / F.col("n") / 1000).alias("pharmacy_sales"),
        F.col("c_acctbal").alias("aqi"),
    )


BLOCKS["places"] = ((), """
    SELECT CAST(c_custkey AS VARCHAR) AS zipcode, 25 + c_nationkey + (c_custkey * 7919 % 1000)::DOUBLE / 2000 AS lat,
           -120 + c_nationkey * 7 % 25 * 2 + (c_custkey * 104729 % 1000)::DOUBLE / 1000 AS lon, s / n / 1000 AS pharmacy_sales, c_acctbal AS aqi
    FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1) AS o USING (c_custkey)""")


def normal(c: str, std: str, weight: float = 1.0, source: str = "places") -> str:
    return f"(coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM {source})) / ((SELECT {std}(coalesce({c}, 0)) FROM {source}) + 1e-8) * {weight}"


BLOCKS["vectors"] = (("places",), f"""SELECT zipcode, {normal('lat', 'stddev_samp', 2.0)} AS x0, {normal('lon', 'stddev_samp', 2.0)} AS x1,
    {normal('pharmacy_sales', 'stddev_pop')} AS x2, {normal('aqi', 'stddev_pop')} AS x3 FROM places""")
BLOCKS["gaps"] = (("vectors",), """SELECT p.zipcode AS a, q.zipcode AS b,
    sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2) + (p.x3 - q.x3) * (p.x3 - q.x3)) AS d
    FROM vectors AS p JOIN vectors AS q ON p.zipcode <> q.zipcode""")
BLOCKS["cores"] = (("gaps",), "SELECT a AS zipcode, list_sort(min(d, 2))[2] AS core FROM gaps GROUP BY a")
BLOCKS["reach"] = (("cores", "gaps"), """SELECT a, b, greatest(d, p.core, q.core) AS w FROM gaps JOIN cores AS p ON p.zipcode = a JOIN cores AS q ON q.zipcode = b""")


def customer_matrix(spark, folder):
    return hotspots.feature_matrix(customer_regions(spark, folder))


REGION_PARTS = (
    [f"{normal(c, 'stddev_samp', 2.0, 'summary')} AS x{i}" for i, c in enumerate(("lat", "lon"))]
    + [f"{normal(c, 'stddev_pop', 1.0, 'summary')} AS x{i + 2}" for i, c in enumerate(P.CLUSTER_COLUMNS)])
REGION_X = ", ".join(REGION_PARTS)
# among 15 regions nothing is closer than the default distance; at this one some are linked and some are noise
WIDE = 2.0


@query("h01_feature_matrix", f"SELECT zipcode, {REGION_X} FROM summary", needs=["summary"], doubles=[f"x{i}" for i in range(7)], digits=5)
def h01(spark, folder):
    matrix = hotspots.feature_matrix(region.snapshot(featured(spark, folder), 30))
    return matrix.select("zipcode", *[F.col("x")[i].alias(f"x{i}") for i in range(7)])


@query("h01_feature_matrix_customers", "SELECT * FROM vectors", needs=["vectors"], doubles=["x0", "x1", "x2", "x3"])
def h01_customers(spark, folder):
    return customer_matrix(spark, folder).select("zipcode", *[F.col("x")[i].alias(f"x{i}") for i in range(4)])


@query("h02_core_distance", "SELECT * FROM cores", needs=["cores"], doubles=["core"])
def h02(spark, folder):
    return hotspots.measure(customer_matrix(spark, folder), P.MIN_SAMPLES, BLOCK).members.select("zipcode", "core")


@query("h03_mutual_reachability", "SELECT a AS zipcode, min(w) AS w FROM reach GROUP BY a", needs=["reach"], doubles=["w"])
def h03(spark, folder):
    return hotspots.lightest_links(hotspots.spanning_tree(customer_matrix(spark, folder), P.MIN_SAMPLES, BLOCK, FINISH))


BLOCKS["near"] = (("reach",), f"SELECT a, b FROM reach WHERE w <= {EPS}")
BLOCKS["linked"] = (("near",), """
    WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM near UNION SELECT walk.a, near.b FROM walk JOIN near ON near.a = walk.b)
    SELECT a AS zipcode, least(a, min(b)) AS label FROM walk GROUP BY a""")


@query("h05_density_components", """
    SELECT zipcode, coalesce(CAST(c.label AS BIGINT), -1) AS cluster_id FROM places LEFT JOIN linked USING (zipcode)
    LEFT JOIN (SELECT label FROM linked GROUP BY label HAVING count(*) >= 3) AS c USING (label)""", needs=["places", "linked"])
def h05(spark, folder):
    regions = customer_regions(spark, folder)
    tree = hotspots.spanning_tree(hotspots.feature_matrix(regions), P.MIN_SAMPLES, BLOCK)
    return hotspots.components(tree, regions, EPS)


# all edges up to a distance connect as much as the tree's edges up to it: regions less components
STEPS = (0.1, 0.2, 0.3, EPS)
BLOCKS["near_by_step"] = (("reach",), f"SELECT distance, a, b FROM reach, (VALUES {', '.join(f'({t}::DOUBLE)' for t in STEPS)}) AS s(distance) WHERE w <= distance")
BLOCKS["linked_by_step"] = (("near_by_step",), """
    WITH RECURSIVE walk(distance, a, b) AS (SELECT distance, a, b FROM near_by_step
        UNION SELECT walk.distance, walk.a, n.b FROM walk JOIN near_by_step AS n ON n.distance = walk.distance AND n.a = walk.b)
    SELECT distance, a AS zipcode, least(a, min(b)) AS label FROM walk GROUP BY distance, a""")


@query("h04_spanning_tree", """SELECT distance, count(*) - count(DISTINCT label) AS n_edges FROM linked_by_step GROUP BY distance
    UNION ALL SELECT 1e9::DOUBLE, count(*) - 1 FROM vectors""", needs=["vectors", "linked_by_step"], doubles=["distance"])
def h04(spark, folder):
    tree = hotspots.spanning_tree(customer_matrix(spark, folder), P.MIN_SAMPLES, BLOCK, FINISH)
    steps = F.array(*[F.lit(float(t)) for t in (*STEPS, 1e9)])
    upto = tree.select(F.explode(F.filter(steps, lambda t: F.col("w") <= t)).alias("distance"))
    return upto.groupBy("distance").agg(F.count("*").alias("n_edges"))


BLOCKS["region_vectors"] = (("summary",), f"SELECT zipcode, [{', '.join(x.rpartition(' AS ')[0] for x in REGION_PARTS)}] AS x FROM summary")
BLOCKS["region_gaps"] = (("region_vectors",), "SELECT p.zipcode AS a, q.zipcode AS b, list_distance(p.x, q.x) AS d FROM region_vectors AS p JOIN region_vectors AS q ON p.zipcode <> q.zipcode")
BLOCKS["region_cores"] = (("region_gaps",), f"SELECT a AS zipcode, list_sort(list(d))[{P.MIN_SAMPLES}] AS core FROM region_gaps GROUP BY a")
BLOCKS["region_near"] = (("region_gaps", "region_cores"), f"""SELECT a, b FROM region_gaps JOIN region_cores AS p ON p.zipcode = a JOIN region_cores AS q ON q.zipcode = b
    WHERE greatest(d, p.core, q.core) <= {WIDE}""")
BLOCKS["region_linked"] = (("region_near",), """
    WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM region_near UNION SELECT walk.a, region_near.b FROM walk JOIN region_near ON region_near.a = walk.b)
    SELECT a AS zipcode, least(a, min(b)) AS label FROM walk GROUP BY a""")
BLOCKS["region_clusters"] = (("region_cores", "region_linked"), f"""
    SELECT zipcode, coalesce(CAST(c.label AS BIGINT), -1) AS cluster_id, CASE WHEN c.label IS NULL THEN 0.0 WHEN core > 0 THEN least_core / core ELSE 1.0 END::DOUBLE AS cluster_probability
    FROM region_cores LEFT JOIN region_linked USING (zipcode) LEFT JOIN (
        SELECT label, min(core) AS least_core FROM region_linked JOIN region_cores USING (zipcode) GROUP BY label HAVING count(*) >= {P.MIN_CLUSTER_SIZE}) AS c USING (label)""")


@query("h06_density_labels", "SELECT * FROM region_clusters", needs=["region_clusters"], doubles=["cluster_probability"], digits=5)
def h06(spark, folder):
    found = hotspots.detect(region.snapshot(featured(spark, folder), 30), epsilon=WIDE, method="distance")
    return found.select("zipcode", "cluster_id", "cluster_probability")


# the hierarchy's choice of clusters is beyond SQL; tests hold it against a plain version
@query("h06_hierarchy_labels")
def h06_hierarchy(spark, folder):
    return hotspots.detect(region.snapshot(featured(spark, folder), 30)).select("zipcode", "cluster_id", "cluster_probability")


@query("h06_hierarchy_labels_customers")
def h06_hierarchy_customers(spark, folder):
    return hotspots.memberships(customer_matrix(spark, folder))


@query("h07_too_few_regions", f"SELECT {key('o_custkey')} AS zipcode, -1 AS cluster_id, 0.0::DOUBLE AS cluster_probability, 'Low' AS risk_level, '#2ecc71' AS risk_color FROM orders WHERE {key('o_custkey')} IN ('10001', '10002') GROUP BY 1")
def h07(spark, folder):
    two = region.snapshot(cleaned(spark, folder).filter(F.col("zipcode").isin("10001", "10002")))
    return hotspots.detect(two).select("zipcode", "cluster_id", "cluster_probability", "risk_level", "risk_color")


PLACED = "CASE WHEN CAST(zipcode AS INTEGER) % 5 = 0 THEN -1 ELSE CAST(zipcode AS INTEGER) % 3 END"
BLOCKS["placed"] = (("summary",), f"""
    SELECT *, CASE WHEN cluster_id = -1 OR score2 < 0.33 THEN 'Low' WHEN score2 < 0.66 THEN 'Medium' ELSE 'High' END AS risk_level FROM (
        SELECT *, {PLACED} AS cluster_id, least(disease_risk_score * 1.8, 1.0) AS score2 FROM summary) AS s""")


def placed(spark, folder):
    # given clusters, so that the rows are known whatever the clustering finds
    snap = region.snapshot(featured(spark, folder), 30)
    number = F.col("zipcode").cast("int")
    given = F.when(number % 5 == 0, -1).otherwise(number % 3)
    raised = snap.withColumn("disease_risk_score", F.least(F.col("disease_risk_score") * 1.8, F.lit(1.0)))
    return hotspots.with_risk(raised.withColumns({"cluster_id": given, "cluster_probability": F.lit(0.5)}))


@query("h08_risk_levels", "SELECT zipcode, cluster_id, risk_level, CASE risk_level WHEN 'Low' THEN '#2ecc71' WHEN 'Medium' THEN '#f39c12' ELSE '#e74c3c' END AS risk_color FROM placed", needs=["placed"])
def h08(spark, folder):
    return placed(spark, folder).select("zipcode", "cluster_id", "risk_level", "risk_color")


COUNTS = ", ".join(f"""count(*) FILTER (risk_level = '{level}') AS "{level}" """ for level in P.RISK_LEVELS)


@query("a11_hotspot_metadata", f"SELECT count(*) AS n_regions, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters, {COUNTS} FROM placed", needs=["placed"])
def a11(spark, folder):
    return hotspots.metadata(placed(spark, folder))


@query("a12_cluster_summary", f"SELECT cluster_id, {COUNTS}, count(*) AS n_regions FROM placed GROUP BY cluster_id", needs=["placed"])
def a12(spark, folder):
    return hotspots.cluster_summary(placed(spark, folder))


@query("s12_map_features", """
    SELECT zipcode, 'Feature' AS type, lon, lat, city, state, cluster_id, risk_level, round(score2, 4) AS disease_risk_score, round(er_visits, 2) AS er_visits_mean,
           round(pharmacy_sales, 2) AS pharmacy_sales_mean, round(negative_sentiment, 4) AS negative_sentiment_mean, round(aqi, 1) AS aqi_mean, 0.5::DOUBLE AS cluster_probability FROM placed""", needs=["placed"],
       doubles=["lon", "lat"])
def s12(spark, folder):
    rows = hotspots.map_features(placed(spark, folder))
    p = "feature.properties"
    return rows.select(
        "zipcode", "feature.type", F.col("feature.geometry.coordinates")[0].alias("lon"), F.col("feature.geometry.coordinates")[1].alias("lat"),
        *[f"{p}.{c}" for c in ("city", "state", "cluster_id", "risk_level", "disease_risk_score", "er_visits_mean", "pharmacy_sales_mean",
                               "negative_sentiment_mean", "aqi_mean", "cluster_probability")],
    )
