import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.operators import cells as store
from quillstone.operators import filters as q
from quillstone.operators import run
from quillstone.sources import ingest

T0 = datetime.datetime(2024, 1, 1)


def cell(row, version=1, status="done", value="true", hash_="h", attempts=1, cost=0.1, at=0, certificate=None, model="m"):
    return ("c", row, version, model, hash_, status, value, None, None, attempts, 10, 5, cost, 100, certificate, T0 + datetime.timedelta(seconds=at))


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), store.CELLS)


def test_upsert_accumulates_and_clears_certificates(spark):
    old = cells(spark, cell("1", certificate="z", status="reused_certified"), cell("2"), cell("3", at=50))
    new = cells(spark, cell("1", value="false", at=9), cell("3", value="false", status="error", at=1), cell("4", status="reused_certified", certificate="y"))
    got = {r.row_id: r for r in store.upsert(old, new).collect()}
    assert (got["1"].value, got["1"].attempts, got["1"].input_tokens, got["1"].certificate_id) == ("false", 2, 20, None) and got["1"].cost_usd == pytest.approx(0.2)
    assert got["2"].attempts == 1 and got["3"].status == "error" and got["4"].certificate_id == "y" and len(got) == 4


def test_certificates_never_clobber(spark):
    c = cells(spark, cell("1"), cell("2"), cell("3", status="error"), cell("4", status="reused_certified"), cell("2", version=2, value="false"))
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "row_id string")
    got = store.apply_certificate(c, "c", 1, 2, ids, "cert").collect()
    assert [(r.row_id, r.prompt_version, r.status, r.certificate_id, r.cost_usd) for r in got] == [("1", 2, "reused_certified", "cert", 0.0)]
    assert store.apply_certificate(c, "c", 1, 2, ids.limit(0), "cert").count() == 0


def test_versions_and_probes(spark):
    columns, versions = spark.createDataFrame([], store.COLUMNS), spark.createDataFrame([], store.VERSIONS)
    new = spark.createDataFrame([("c", "t", "C", "old {{a}}", 0, "m", "{}", T0)], store.COLUMNS)
    columns, versions = store.create_column(columns, versions, new)
    columns, versions = store.edit_column(columns, versions, "c", "new {{a}}", "m2")
    assert [(r.prompt_version, r.prompt_template, r.model) for r in store.list_columns(columns, "t").collect()] == [(2, "new {{a}}", "m2")]
    assert [(r.version, r.prompt_template, r.model) for r in versions.orderBy("version").collect()] == [(1, "old {{a}}", "m"), (2, "new {{a}}", "m2")]
    c = cells(spark, cell("2", hash_="a"), cell("1", hash_="a", value="x"), cell("3", hash_="b", status="error"), cell("4", hash_="a", version=2), cell("5", hash_="d", status="reused_certified"))
    wanted = spark.createDataFrame([("c", 1, "m", "a"), ("c", 1, "m", "b"), ("c", 1, "other", "a"), ("c", 1, "m", "d")], "column_id string, prompt_version int, model string, row_content_hash string")
    got = {(r.model, r.row_content_hash): (r.hit_row_id, r.hit_value) for r in store.cache_probe(wanted, c).collect()}
    assert got == {("m", "a"): ("1", "x"), ("m", "b"): (None, None), ("other", "a"): (None, None), ("m", "d"): (None, None)}
    assert store.cells_of_version(c, "c", 1, spark.createDataFrame([], "row_id string")).count() == 0 and store.current_cells(c, columns).count() == 1
    assert {r.row_id for r in store.missing_rows(spark.createDataFrame([("1",), ("9",)], "row_id string"), c, "c", 1).collect()} == {"9"}


def test_store_folders(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert not s.exists("cells")
    s.append("cells", cells(spark, cell("1")))
    s.write("cells", store.upsert(s.read("cells"), cells(spark, cell("1", value="false", at=5))))
    s.append("cells", cells(spark, cell("2")))
    assert {(r.row_id, r.value) for r in s.read("cells").collect()} == {("1", "false"), ("2", "true")}


def test_runs(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, None, 2.5), (4, "boom", 0.0), (5, "odd", 0.0), (6, "boom", 0.0)], "id int, a string, b double")
    column = {"id": "c", "prompt_template": "a {{a}}", "prompt_version": 1, "model": "m"}

    def oracle(text):
        if "boom" in text:
            raise RuntimeError("e" * 2000)
        return {"value": "no boolean" if "odd" in text else "x" in text, "rationale": "r" * 900, "input_tokens": 100, "output_tokens": 10}

    none = spark.createDataFrame([], store.CELLS)
    out = run.run_column(rows, "id", column, none, oracle, run.Output("boolean")).cache()
    got = {r.row_id: r for r in out.collect()}
    assert {i: (r.status, r.value, r.attempts) for i, r in got.items()} == {"1": ("done", "true", 1), "2": ("cached", "true", 0), "3": ("done", "false", 1), "4": ("error", None, 1), "5": ("error", None, 1), "6": ("error", None, 0)}
    assert len(got["4"].error) == 800 and len(got["1"].rationale) == 500 and got["1"].cost_usd == pytest.approx(140e-6) and got["2"].cost_usd == 0
    entry = run.ledger_entry(out, "run-1", column).first()
    assert (entry.cells, entry.input_tokens) == (4, 300)
    known = out.withColumns({"certificate_id": F.lit(None).cast("string"), "updated_at": F.lit(T0)}).select(*none.columns)
    again = run.run_column(rows.where("id in (1, 3) or a = 'x'").unionByName(spark.createDataFrame([(9, "x", 0.0)], rows.schema)), "id", column, known, oracle, run.Output("boolean")).collect()
    assert {(r.row_id, r.status) for r in again} == {("2", "cached"), ("9", "cached")}


def test_types_and_budget(spark):
    df = spark.createDataFrame([(v,) for v in ("true", "1.5", '"1.5"', '"a"', '"b"', "{}", None)], "value string")
    ok = lambda spec: [bool(r[0]) for r in df.select(F.coalesce(run.valid(spec), F.lit(False))).collect()]
    assert ok(run.Output("boolean")) == [True] + [False] * 6 and ok(run.Output("number", 1, 2)) == [False, True] + [False] * 5 and ok(run.Output("number", 2)) == [False] * 7
    assert ok(run.Output("select", options=("a",))) == [False] * 3 + [True] + [False] * 3 and ok(run.Output("text")) == [False, False, True, True, True, False, False] and ok(run.Output("json"))[5]
    est = run.estimate(spark.createDataFrame([("x" * 9,)] * 101, "text string"))
    assert est.first().asDict() == {"rows": 101, "input_tokens": 101 * 163, "output_tokens": 6060, "cost_usd": (101 * 163 + 4 * 6060) / 1e6, "confirm": True}
    ledger = spark.createDataFrame([(49.99,)], "cost_usd double")
    with pytest.raises(run.BudgetExceeded):
        run.guard(est, ledger)
    run.guard(est, ledger.limit(0))


def test_ingest(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Id,Langs,Years\n1,"a;b; ",Less than 1 year\n2,NA,12\n3,"x\ny",NA\n')
    from quillstone.functions import text

    raw = ingest.read_csv(spark, str(tmp_path / "s.csv"), ["Id", "Langs", "Years"])
    fields = q.catalog(q.Field("id", "integer"), q.Field("langs", multi=True), q.Field("years", "float"))
    df = ingest.curate(raw, fields, {"id": F.col("Id"), "langs": text.norm_multi(F.col("Langs")), "years": text.norm_years(F.col("Years"))})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, ["a", "b"], 0.5), (2, [], 12.0), (3, ["x\ny"], None)]
    assert ingest.write_table(df, str(tmp_path / "out")) == 3 and ingest.read_parquet(spark, str(tmp_path / "out")).count() == 3
    ingest.append_rows(df, str(tmp_path / "out"))
    assert ingest.read_parquet(spark, str(tmp_path / "out")).count() == 6
    (tmp_path / "l.json").write_text('[{"key": "p", "rowIds": [1, 2], "cached": ["a", null]}]')
    assert [tuple(r) for r in ingest.read_labels(spark, str(tmp_path / "l.json"), ["rowIds", "cached"]).orderBy("position").collect()] == [("p", 0, 1, "a"), ("p", 1, 2, None)]


def test_embed_takes_empty_texts_and_keeps_other_columns(spark, tmp_path):
    import duckdb

    from quillstone.plans import REGISTRY

    big = 2**53 + 1  # a double can't hold it: ids next to a null must not pass through one
    rows = [(big, "word"), (None, ""), (3, None), (4, ""), (5, "é"), (6, "\U0001f600 x")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, REGISTRY.QUERIES["embed"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(REGISTRY.ORACLE_SQL["embed"]).fetchall(), key=str) and (None, 0.0, 0.0) in got and (3, None, None) in got
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        return [[1, 2]] * len(texts)

    df = spark.createDataFrame([(i, None if i % 3 == 0 else "t", {"a": [i]}, T0) for i in range(15)], "id int, t string, m map<string,array<int>>, at timestamp").coalesce(1)
    out = run.embed(df, "t", model, 4).collect()
    assert calls.value == 3 and [r.embedding for r in out] == [None if i % 3 == 0 else [1.0, 2.0] for i in range(15)] and [r[:4] for r in out] == [tuple(r) for r in df.collect()]


def test_embed_query_takes_no_text_back_from_python(spark, tmp_path):
    """With a heap of 1 GB, the texts on their way back were too much."""
    from quillstone.plans import REGISTRY

    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plan = REGISTRY.QUERIES["embed"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    [line] = [x for x in plan.splitlines() if "MapIn" in x]
    back = line[line.rindex("[") :]
    assert "doc_id#" in back and "embedding#" in back and "text#" not in back
    out = run.embed(df, "text", lambda texts: [[len(t)] for t in texts], keep=["doc_id"])
    assert out.columns == ["doc_id", "embedding"] and sorted(map(tuple, out.collect())) == [(1, [2.0]), (2, None)]
