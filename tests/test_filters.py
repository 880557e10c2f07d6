import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import filters as q
from quillstone.operators import search

FIELDS = q.catalog(q.Field("id", "integer"), q.Field("k"), q.Field("tags", multi=True), q.Field("x", "float"), q.Field("n", "integer"), q.Field("b", "boolean"), q.Field("t", "text"), q.Field("place", "geo"))
ROWS = [
    (1, "a", ["x", "y"], 5.0, 3, True, "Hello World", (10.0, 20.0)), (2, None, [], None, None, None, None, None), (3, "b", ["x", "x"], 0.5, 7, False, "100% wörld_", (None, 1.0)), (4, "A", None, -1.0, 0, True, "", (89.9, 0.0)),
    (5, "c", ["z", None], 7.25, 3, None, "one two three", (-10.5, 179.9)), (6, "a", ["y", "z", "w", "v"], 5.0, 9, False, "WORLD", (10.2, 20.1)),
]


@pytest.fixture(scope="module")
def table(spark):
    schema = T.StructType([T.StructField(f.name, f.spark_type) for f in FIELDS.values()])
    return search.Table(spark.createDataFrame(ROWS, schema).cache(), FIELDS, "id")


def holds(p, row):
    r = dict(zip(FIELDS, row, strict=True))
    if isinstance(p, q.Not):
        return not holds(p.predicate, row)
    if isinstance(p, q.Text):
        return any(r[f] is not None and p.query.lower() in r[f].lower() for f in p.fields)
    v, f = r[p.field], FIELDS[p.field]
    if isinstance(p, q.Term):
        return str(p.value) in (v or []) if f.multi else v is not None and v == p.value
    if isinstance(p, q.Terms):
        return bool({str(x) for x in p.values} & set(v or [])) if f.multi else v is not None and v in p.values
    if isinstance(p, q.Range):
        return v is not None and (p.min is None or v >= p.min) and (p.max is None or v <= p.max)
    return bool(v) if f.multi else v is not None


value = {"k": st.sampled_from("abcAz"), "tags": st.sampled_from(["x", "y", "z", "q"]), "x": st.sampled_from([5.0, 0.5, -1.0, 2.0]), "n": st.integers(0, 9), "b": st.booleans()}
fields = st.sampled_from(sorted(value))
leaf = st.one_of(
    fields.flatmap(lambda f: value[f].map(lambda v: q.Term(f, v))),
    fields.flatmap(lambda f: st.lists(value[f], max_size=3).map(lambda v: q.Terms(f, tuple(v)))),
    st.sampled_from(["x", "n"]).flatmap(lambda f: st.tuples(st.none() | value[f], st.none() | value[f]).map(lambda b: q.Range(f, *b))),
    st.sampled_from([*sorted(value), "t"]).map(q.Exists),
    st.sampled_from(["world", "O W", "%", "_", ""]).map(lambda s: q.Text(s, ("t", "k"))),
)
predicate = st.recursive(leaf, lambda p: p.map(q.Not), max_leaves=4)
spec = st.builds(q.FilterSpec, st.lists(predicate, max_size=3).map(tuple), st.lists(predicate, max_size=3).map(tuple))


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spec=spec)
def test_any_spec_as_plain(table, spec):
    want = {r[0] for r in ROWS if all(holds(p, r) for p in spec.all) and (not spec.any or any(holds(p, r) for p in spec.any))}
    assert q.loads(q.dumps(spec)) == spec
    assert {r.id for r in table.matching(spec).select("id").collect()} == want


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=predicate)
def test_predicate_and_negation_share_all_rows(table, p):
    c = q.compile_predicate(p, FIELDS)
    r = table.df.agg(F.count_if(c).alias("yes"), F.count_if(~c).alias("no"), F.count_if(c.isNull()).alias("null")).first()
    assert (r.yes + r.no, r["null"]) == (len(ROWS), 0)


def test_pushdown(spark, tmp_path, table):
    table.df.drop("tags", "place").write.parquet(str(tmp_path / "t"))
    t = search.Table(spark.read.parquet(str(tmp_path / "t")), FIELDS, "id")
    for p, pushed in ((q.Term("k", "a"), "EqualNullSafe(k,a)"), (q.Not(q.Term("k", "a")), "Not(EqualNullSafe(k,a))"), (q.Terms("k", ("a", "b")), "In(k, [a,b])"), (q.Range("x", 1, 2), "GreaterThanOrEqual(x,1.0)"), (q.Exists("n"), "IsNotNull(n)")):
        plan = t.matching(q.FilterSpec((p,))).select("id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert pushed in plan, plan


def test_geo(table):
    near = lambda lat, lon, miles: sorted(r.id for r in table.matching(q.FilterSpec((q.Geo("place", lat, lon, miles),))).collect())
    assert near(10, 20, 1) == [1] and near(10, 20, 20) == [1, 6] and near(-10.5, -179.9, 30) == [5] and near(90, 77, 10) == [4]
    assert 2 in {r.id for r in table.matching(q.FilterSpec((q.Not(q.Geo("place", 10, 20, 10_000)),))).collect()}


def test_modes_and_errors(table):
    words = search.Table(table.df, FIELDS, "id", "tokens")
    assert [r.id for r in words.matching(q.FilterSpec((q.Text("World hello", ("t",)),))).orderBy("id").collect()] == [1, 6]
    with pytest.raises(q.UnsupportedPredicate):
        search.Table(table.df, FIELDS, "id", "unsupported").count(q.FilterSpec((q.Text("a", ("t",)),)))
    with pytest.raises(q.UnsupportedPredicate):
        q.compile_predicate(q.Range("tags", 1), FIELDS)
    for bad in ('{"all":[{"kind":"odd"}]}', '{"all":[{"kind":"term","x":1}]}', '{"version":9}'):
        with pytest.raises(ValueError):
            q.loads(bad)
    for s, nl in ((q.FilterSpec((q.Term("zz", 1),)), False), (q.FilterSpec((q.Range("k", 1),)), False), (q.FilterSpec(sort=("k", "up")), False), (q.FilterSpec((q.Range("n", 1),)), True), (q.FilterSpec((q.Not(q.Not(q.Exists("k"))),)), True), (q.FilterSpec((q.Text("a", ("t",)),)), True)):
        with pytest.raises(ValueError):
            q.validate(s, FIELDS, nl)
    q.validate(q.FilterSpec((q.Range("x", 1), q.Not(q.Term("k", "a"))), sort=("x", "asc")), FIELDS, True)


def test_pages(table):
    order = lambda way: [r.id for r in table.page(q.FilterSpec(sort=("x", way))).orderBy("rn").collect()]
    assert order("asc") == [2, 4, 3, 1, 6, 5] and order("desc") == [5, 1, 6, 3, 4, 2]
    first = table.search(q.FilterSpec(), 4)
    assert first.total == 6 and first.cursor == "4" and first.rows.count() == 4
    last = table.search(q.FilterSpec(), 4, first.cursor)
    assert last.cursor is None and [(r.id, r.rn) for r in last.rows.orderBy("rn").collect()] == [(5, 5), (6, 6)]
    assert table.search(q.FilterSpec((q.Terms("k", ()),))).total == 0
    with pytest.raises(q.UnsupportedPredicate):
        table.page(q.FilterSpec(sort=("computed", "asc")))
    assert search.api_limit(None) == 25 and search.api_limit(100) == 100
    with pytest.raises(ValueError):
        search.api_limit(101)


def test_facets(spark, table):
    assert [(r.value, r.n) for r in table.facet(q.FilterSpec(), "k").collect()] == [("a", 2), ("A", 1), ("b", 1), ("c", 1)]
    many = {(r.field, r.value): r.n for r in table.facets(q.FilterSpec(), ["k", "tags", "n"]).collect()}
    assert many["tags", "x"] == 2 and many["tags", "z"] == 2 and many["n", "3"] == 2 and many["k", "a"] == 2
    assert table.facets(q.FilterSpec(), ["tags"], 1).count() == 1
    assert search.wanted(spark, [], "id").count() == 0
    got = table.hydrate(search.wanted(spark, [6, 99, 1], "id")).orderBy("position").collect()
    assert [r.id for r in got] == [6, 1]
    assert [r.v for r in table.df.orderBy("id").select(search.cell_view(F.col("tags")).alias("v")).collect()][5] == "y, z, w +1"


def test_labels():
    s = q.FilterSpec((q.Term("years_code", 3), q.Terms("k", ("a", "b", "c")), q.Range("x", 1, 2)), (q.Exists("n"), q.Not(q.Term("k", "a"))))
    chips = q.build_chips(s)
    assert [(c.id, c.label) for c in chips] == [("all-0", "Years Code: 3"), ("all-1", "K: a, b +1"), ("all-2", "X ≥ 1 and ≤ 2"), ("any-group", "Any of: Has N · NOT K: a")]
    assert chips[1].expanded == ("a", "b", "c") and q.remove_chip(s, "any-group").any == () and q.remove_chip(s, "all-1").all == (s.all[0], s.all[2])
    assert q.next_sort(None, "x") == ("x", "desc") and q.next_sort(("x", "desc"), "x") == ("x", "asc") and q.next_sort(("x", "asc"), "x") is None
    assert q.schema_of(FIELDS)["tags"].metadata["multi"]
