"""Search queries over profiles: customers with their nation and their large orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import filters as q
from quillstone.operators import search
from quillstone.plans.registry import query, table

BIG = 400_000
FIELDS = q.catalog(
    q.Field("id", "integer"), q.Field("name", "text"), q.Field("segment"), q.Field("nation"), q.Field("balance", "float"), q.Field("max_big_order", "float", description="largest order above 400,000"),
    q.Field("big_orders", "integer"), q.Field("priorities", multi=True, description="priorities of orders above 400,000"), q.Field("place", "geo"),
)
#: The same view in SQL, as the beginning of every statement here.
SQL = """
WITH big AS (
  SELECT o_custkey, max(o_totalprice) AS max_big_order, count(*) AS big_orders, list_sort(list(DISTINCT o_orderpriority)) AS priorities
  FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey),
profiles AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, n_name AS nation, c_acctbal AS balance, max_big_order, big_orders, coalesce(priorities, []) AS priorities,
         (c_custkey % 140 - 70)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN big ON c_custkey = o_custkey)
"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > BIG)
    big = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_big_order"), F.count("*").alias("big_orders"), F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
    place = F.struct((F.col("c_custkey") % 140 - 70).cast("double").alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("lon"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"), "max_big_order", "big_orders", F.coalesce("priorities", F.array().cast("array<string>")).alias("priorities"), place.alias("place"))


def profile_table(spark: SparkSession, sf_dir: str, text: str = "contains") -> search.Table:
    return search.Table(profiles(spark, sf_dir), FIELDS, "id", text)


URGENT, HIGH, LOW = "1-URGENT", "2-HIGH", "5-LOW"
TERM = q.Term("segment", "BUILDING")
#: One specification for each predicate and each way of combining them, with the SQL condition it means.
CASES: dict[str, tuple[q.FilterSpec, str]] = {
    "match_all": (q.FilterSpec(), "true"),
    "pred_term": (q.FilterSpec((TERM,)), "segment = 'BUILDING'"),
    "pred_term_number": (q.FilterSpec((q.Term("big_orders", 2),)), "big_orders IS NOT DISTINCT FROM 2"),
    "pred_term_multi": (q.FilterSpec((q.Term("priorities", URGENT),)), "list_contains(priorities, '1-URGENT')"),
    "pred_terms": (q.FilterSpec((q.Terms("nation", ("FRANCE", "GERMANY", "NATION_1", "NATION_2", "NATION_7")),)), "nation IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2', 'NATION_7')"),
    "pred_terms_multi": (q.FilterSpec((q.Terms("priorities", (HIGH, LOW)),)), "list_has_any(priorities, ['2-HIGH', '5-LOW'])"),
    "pred_terms_empty": (q.FilterSpec((q.Terms("nation", ()),)), "false"),
    "pred_range": (q.FilterSpec((q.Range("balance", 1000, 5000),)), "balance BETWEEN 1000 AND 5000"),
    "pred_range_min": (q.FilterSpec((q.Range("max_big_order", min=450_000),)), "max_big_order >= 450000"),
    "pred_range_max": (q.FilterSpec((q.Range("max_big_order", max=450_000),)), "max_big_order <= 450000"),
    "pred_range_open": (q.FilterSpec((q.Range("max_big_order"),)), "max_big_order IS NOT NULL"),
    "pred_exists": (q.FilterSpec((q.Exists("max_big_order"),)), "max_big_order IS NOT NULL"),
    "pred_exists_multi": (q.FilterSpec((q.Exists("priorities"),)), "len(priorities) > 0"),
    "pred_not_term": (q.FilterSpec((q.Not(TERM),)), "segment IS DISTINCT FROM 'BUILDING'"),
    "pred_not_multi": (q.FilterSpec((q.Not(q.Term("priorities", URGENT)),)), "NOT list_contains(priorities, '1-URGENT')"),
    "pred_not_exists": (q.FilterSpec((q.Not(q.Exists("max_big_order")),)), "max_big_order IS NULL"),
    "pred_not_range": (q.FilterSpec((q.Not(q.Range("max_big_order", min=450_000)),)), "max_big_order IS NULL OR max_big_order < 450000"),
    "pred_not_terms": (q.FilterSpec((q.Not(q.Terms("segment", ("BUILDING", "MACHINERY"))),)), "segment IS NULL OR segment NOT IN ('BUILDING', 'MACHINERY')"),
    "pred_double_not": (q.FilterSpec((q.Not(q.Not(q.Range("max_big_order", max=420_000))),)), "max_big_order <= 420000"),
    "pred_text": (q.FilterSpec((q.Text("r#00000001", ("name", "nation")),)), "contains(lower(name), 'r#00000001') OR contains(lower(nation), 'r#00000001')"),
    "pred_geo": (q.FilterSpec((q.Geo("place", 40.0, -74.0, 1500.0),)), "2 * 3958.76 * asin(sqrt(least(1.0, pow(sin(radians(lat - 40) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(lon + 74) / 2), 2)))) <= 1500"),
    "spec_all": (q.FilterSpec((TERM, q.Range("balance", min=0), q.Exists("priorities"))), "segment = 'BUILDING' AND balance >= 0 AND len(priorities) > 0"),
    "spec_any_only": (q.FilterSpec(any=(TERM, q.Term("priorities", URGENT))), "segment = 'BUILDING' OR list_contains(priorities, '1-URGENT')"),
    "spec_combo": (q.FilterSpec((q.Range("balance", min=0), q.Not(q.Term("priorities", HIGH))), (TERM, q.Term("segment", "AUTOMOBILE"))), "balance >= 0 AND NOT list_contains(priorities, '2-HIGH') AND segment IN ('BUILDING', 'AUTOMOBILE')"),
}


def _register(name: str, spec: q.FilterSpec, condition: str) -> None:
    @query(name, f"{SQL} SELECT id, segment, array_to_string(priorities, '|') AS priorities FROM profiles WHERE {condition}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # what a client sends is JSON
        rows = profile_table(spark, sf_dir).matching(q.loads(q.dumps(spec)))
        return rows.select("id", "segment", F.array_join("priorities", "|").alias("priorities"))


for _name, (_spec, _condition) in CASES.items():
    _register(_name, _spec, _condition)

SOME = q.FilterSpec((q.Range("balance", min=0),))


@query("pred_text_tokens", SQL + r"SELECT id FROM profiles WHERE list_has_any(list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ['customer', '000000012']) AND nation IS NOT NULL")
def pred_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir, "tokens").matching(q.FilterSpec((q.Text("Customer 000000012", ("name",)), q.Exists("nation")))).select("id")


@query("count", SQL + "SELECT count(*) AS n FROM profiles WHERE balance >= 0")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).count(SOME)


def _sorted(name: str, sort: tuple[str, str] | None, order: str, limit: int, offset: int) -> None:
    @query(name, f"{SQL} SELECT id, max_big_order, rn FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM profiles WHERE balance >= 0) WHERE rn > {offset} AND rn <= {offset + limit}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_table(spark, sf_dir).page(q.FilterSpec(SOME.all, sort=sort), limit, offset).select("id", "max_big_order", F.col("rn").cast("long").alias("rn"))


_sorted("sort_id", None, "id", 50, 0)
_sorted("sort_asc_nulls", ("max_big_order", "asc"), "max_big_order ASC NULLS FIRST, id", 100, 0)
_sorted("sort_desc_nulls", ("max_big_order", "desc"), "max_big_order DESC NULLS LAST, id", 5000, 0)
_sorted("page_2", ("segment", "desc"), "segment DESC NULLS LAST, id", 25, 25)


@query("keyset_page", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS ordered, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, true AS more FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey < 500) QUALIFY rn <= 20")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    cursor = (F.lit("1997-01-01 00:00:00").cast("timestamp"), 500)
    return search.keyset_page(o, "o_orderdate", "o_orderkey", cursor).select("o_orderkey", F.unix_seconds("o_orderdate").alias("ordered"), F.col("rn").cast("long").alias("rn"), "more")


@query("facet_scalar", SQL + "SELECT nation AS value, count(*) AS n FROM profiles WHERE balance >= 0 AND nation IS NOT NULL GROUP BY nation ORDER BY n DESC, value LIMIT 50")
def facet_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).facet(SOME, "nation")


@query("facet_multi", SQL + "SELECT value, count(*) AS n FROM (SELECT unnest(priorities) AS value FROM profiles WHERE balance >= 0) GROUP BY value ORDER BY n DESC, value LIMIT 50")
def facet_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).facet(SOME, "priorities")


_MANY = """,
each AS (
  SELECT 'segment' AS field, segment AS value FROM profiles WHERE {0} UNION ALL SELECT 'nation', nation FROM profiles WHERE {0}
  UNION ALL SELECT 'priorities', unnest(priorities) FROM profiles WHERE {0}),
ranked AS (
  SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank
  FROM each WHERE value IS NOT NULL GROUP BY field, value)
"""


@query("facet_many", SQL + _MANY.format("balance >= 0") + "SELECT field, value, n, rank FROM ranked WHERE rank <= 50")
def facet_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).facets(SOME, ["segment", "nation", "priorities"]).withColumn("rank", F.col("rank").cast("long"))


@query("vocabulary", SQL + _MANY.format("true") + "SELECT field, string_agg(value, ' | ' ORDER BY rank) AS terms FROM ranked WHERE rank <= 40 GROUP BY field")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).vocabulary()


_IDS = (1, 2, 5, 100, 99, 3, 50_000_000)


@query("hydrate", SQL + "SELECT id, name, position FROM profiles JOIN (SELECT unnest([1, 2, 5, 100, 99, 3, 50000000]) AS id, generate_subscripts([1, 2, 5, 100, 99, 3, 50000000], 1)::INT AS position) USING (id)")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir).hydrate(search.wanted(spark, _IDS, "id")).select("id", "name", "position")


@query("hybrid_search", SQL + """, page AS (SELECT *, row_number() OVER (ORDER BY max_big_order DESC NULLS LAST, id) AS rn FROM profiles WHERE balance >= 0 QUALIFY rn <= 40)
SELECT page.id, rn, CASE WHEN page.id % 3 <> 0 THEN upper(page.name) ELSE page.name END AS name, page.segment FROM page""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second store spells names otherwise, and lacks a third of the rows."""
    t = profile_table(spark, sf_dir)
    page = t.page(q.FilterSpec(SOME.all, sort=("max_big_order", "desc")), 40).select("id", "rn", "name", "segment")
    truth = t.df.where("id % 3 <> 0").select("id", F.upper("name").alias("name"))
    return search.hybrid(page, truth, "id").withColumn("rn", F.col("rn").cast("long"))


@query("seeded_sample", "SELECT c_custkey AS id FROM customer ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.seeded_sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 42, "id", 100)


@query("cell_view", SQL + "SELECT id, CASE WHEN len(priorities) = 0 THEN '—' ELSE array_to_string(priorities[1:3], ', ') || CASE WHEN len(priorities) > 3 THEN ' +' || (len(priorities) - 3)::VARCHAR ELSE '' END END AS shown FROM profiles")
def cell_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("id", search.cell_view(F.col("priorities")).alias("shown"))


@query("profile_page", SQL + """SELECT id, name, segment, balance, max_big_order, array_to_string(priorities, '|') AS priorities, rn
FROM (SELECT *, row_number() OVER (ORDER BY max_big_order DESC NULLS LAST, id) AS rn FROM profiles
      WHERE balance >= 0 AND NOT list_contains(priorities, '2-HIGH') AND segment IN ('AUTOMOBILE', 'BUILDING')) WHERE rn <= 50""")
def profile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = q.FilterSpec((q.Range("balance", min=0), q.Not(q.Term("priorities", HIGH))), (q.Term("segment", "AUTOMOBILE"), q.Term("segment", "BUILDING")), ("max_big_order", "desc"))
    rows = profile_table(spark, sf_dir).page(spec)
    return rows.select("id", "name", "segment", "balance", "max_big_order", F.array_join("priorities", "|").alias("priorities"), F.col("rn").cast("long").alias("rn"))
