import http.server
import json
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F, types as T

from grainloom import cache, grounding, queries
from grainloom.errors import Forbidden, Refused
from grainloom.governance import AUDIT, SPEND, Governed, Policy, Principal
from grainloom.functions import bucket, dot, normalised
from grainloom.grounding import Clarify, chained, critique, follow_up, ground, retrieve, settled, tokens
from grainloom.model import Model
from grainloom.operators import branch, checks, draft, landing, merge, nearest, profile, sinks, usage, write
from grainloom.plans.query import Filter, SemanticQuery
from grainloom.queries import model, resolver, table
from grainloom.rollout import Rollout, bucket as py_bucket, changed_metrics, version_id
from grainloom.sources import infer, scan
from grainloom.state import Snapshots, StateTable
from grainloom.streaming import sync

from .oracle import assert_same


def test_inference_takes_the_narrowest_kind(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Full Name, Amount,Code,When,Ok,Empty,Mixed\nAda,1.5,007,2024-01-02,yes,,1\nBo,2,010,2024/01/03,no,,x\n,,,,,,\n")
    df = scan.csv(spark, str(tmp_path / "c.csv"))
    kinds = dict(df.dtypes)
    assert kinds == {"Full Name": "string", "Amount": "decimal(38,10)", "Code": "string", "When": "timestamp_ntz", "Ok": "boolean", "Empty": "string", "Mixed": "string"}
    assert df.where("Ok").count() == 1 and df.where("Amount is null").count() == df.count() - 2
    assert infer.folded(df).columns[0] == "full_name"
    with pytest.raises(Refused):
        infer.folded(spark.range(1).selectExpr("1 as `A b`", "2 as `a_b`"))
    assert infer.fold("  Größe (m²) ") == "größe_m²"


def test_json_scan(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"d": {"results": [{"a": {"b": 1, "c": [1, 2]}, "__meta": 1}, {"x": "y"}]}, "none": None}))
    df = scan.json_rows(spark, str(tmp_path / "d.json"), "d.results")
    assert sorted(df.columns) == ["a_b", "a_c", "x"] and df.count() == 2
    with pytest.raises(Refused):
        scan.json_rows(spark, str(tmp_path / "d.json"), "d.rows")


def test_object_scan_unites_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.jsonl").write_text('{"k": 3, "w": {"z": 4}}\n')
    df = scan.objects(spark, str(tmp_path))
    assert {"k", "v", "w_z", "_object"} <= set(df.columns) and df.count() == 2
    assert all(t == "string" for _, t in df.dtypes)


class Pages(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):  # noqa: N802
        Pages.seen.append(self.path)
        at = int(self.path.rpartition("offset=")[2] or 0) if "offset=" in self.path else 0
        if at == 2 and Pages.seen.count(self.path) == 1:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        body = json.dumps({"value": [{"id": at + i, "n": {"x": i}} for i in range(2 if at < 4 else 1)]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_http_pages(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    got = scan.http(spark, [url], record_path="value", pagination="offset", page_size="2", requests_per_second="100")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4] and "n_x" in got.columns
    with pytest.raises(Refused):
        scan.next_page("odata", url, {"@odata.nextLink": "http://elsewhere/x"}, 1, 1, {})
    assert scan.next_page("cursor", url, {"next_cursor": "q"}, 1, 1, {}).endswith("cursor=q")
    assert scan.next_page("page", url + "?page=2", {}, 5, 5, {}).endswith("page=3")
    assert scan.next_page("none", url, {}, 5, 5, {}) is None
    server.shutdown()


@pytest.mark.parametrize("how", ["offset", "page"])
def test_http_pages_of_another_size_are_read_to_the_end(monkeypatch, how):
    def page(url, headers):
        at = dict(scan.urllib.parse.parse_qsl(scan.urllib.parse.urlsplit(url).query))
        first = int(at["offset"]) if "offset" in at else 50 * (int(at.get("page", 1)) - 1)
        return json.dumps([{"id": i} for i in range(first, min(first + 50, 120))]).encode()

    monkeypatch.setattr(scan, "fetched", page)

    def ids(**o):
        reader = scan.HttpReader({"urls": "http://h/x", "pagination": how, "requests_per_second": "1000", **o})
        return [json.loads(r)["id"] for _, r in reader.read(reader.partitions()[0])]

    assert ids() == ids(page_size="100") == ids(page_size="50") == ids(max_pages="3") == list(range(120))
    with pytest.raises(Refused, match="max_pages"):
        ids(max_pages="2")


def test_http_pages_that_lead_back_are_refused(monkeypatch):
    monkeypatch.setattr(scan, "fetched", lambda url, headers: b'{"value": [1], "next_cursor": "q"}')
    reader = scan.HttpReader({"urls": "http://h/x", "pagination": "cursor", "record_path": "value", "requests_per_second": "1000"})
    with pytest.raises(Refused, match="lead back"):
        list(reader.read(reader.partitions()[0]))


def test_manifest(tmp_path):
    (tmp_path / "m.yaml").write_text("sources:\n  - {name: a, type: csv, config: {path: '${WHERE}/a.csv'}}\n")
    assert scan.manifest(str(tmp_path / "m.yaml"), {"WHERE": "/x"})[0]["config"]["path"] == "/x/a.csv"
    with pytest.raises(Refused):
        scan.manifest(str(tmp_path / "m.yaml"), {})


def test_since(spark):
    df = spark.sql("SELECT * FROM VALUES ('2024-01-01'), ('2024-02-01'), (''), (null) t(c)")
    assert scan.since(df, "c", "2024-01-01").count() == 3 and scan.since(df, "c", None).count() == 4


def test_mapping_and_required(spark):
    df = spark.sql("SELECT * FROM VALUES ('Ada', 'a@x', 'r'), ('Bo', ' ', 's') t(`Full Name`, `Email Address`, Extra)")
    m = landing.mapping(df.columns, ["name", "email", "phone"], required=("email", "name"), tags={"batch": "7"})
    assert m.columns == {"name": "Full Name", "email": "Email Address"} and landing.unmapped(df.columns, m) == ["Extra"]
    rows = landing.mapped(df, m)
    assert [tuple(r) for r in landing.accepted(rows).collect()] == [("Ada", "a@x", "7")]
    assert landing.rejected(rows).first()["_reason"] == "missing email"
    assert landing.mapping(df.columns).columns["full_name"] == "Full Name"
    with pytest.raises(Refused):
        landing.check_key(spark.sql("SELECT * FROM VALUES (1), (1), (null) t(k)"), ["k"])


def test_gate_drops_rows_without_a_required_parent(spark):
    s = spark.sql("SELECT * FROM VALUES ('1', '5', 'x'), ('2', '6', '3'), ('y', '5', '4') t(id, ref, n)")
    got = landing.gate(s, "id", {"id": "int", "n": "int"}, required_refs={"ref": (spark.sql("SELECT 5 AS p"), "p")})
    assert [tuple(r) for r in got.select("id", "ref", "n").collect()] == [(1, "5", None)]


def test_merge_rules(spark):
    schema = "id int, name string, ltv string, seg string, at timestamp_ntz"
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "Al", "10", "", t), (2, "Bo", "x", "a", t)], schema)
    b = spark.createDataFrame([(1, "Alice", "9", "b", t), (2, "Bo", "5", "c", t), (3, "Cy", None, None, t)], schema)
    rules = [merge.Rule("name", "longest"), merge.Rule("ltv", "max", alert="range", low=0, high=9.5), merge.Rule("seg", required=True)]
    df = merge.merge(a, b, "id", rules, time="at")
    got = {r["id"]: (r["name"], r["ltv"], r["seg"]) for r in df.collect()}
    assert got == {1: ("Alice", "10", "b"), 2: ("Bo", "x", "a"), 3: ("Cy", None, None)}
    ev = {(r["id"], r["field"], r["kind"], r["severity"]) for r in merge.events(df, "id").collect()}
    assert {(1, "name", "conflict", "info"), (1, "ltv", "alert", "warning"), (2, "ltv", "conflict", "warning"), (2, "seg", "conflict", "warning"), (3, "seg", "required", "error")} <= ev
    with pytest.raises(Refused):
        merge.merge(a, b, "id", [merge.Rule("name", "best")])


@pytest.mark.parametrize(
    ("main", "other", "sums", "n"),
    [(100, 100, {"a": 0.0}, 0), (100, 200, {"a": 100.0}, 2), (100, 90, {"a": -10.0}, 1), (100, 100, {"a": 9900.0}, 2), (0, 0, {}, 0), (100, 100, {"a": 49.0}, 1)],
)
def test_branch_flags(main, other, sums, n):
    assert len(branch.flags(main, other, sums)) == n


def test_branches_are_promoted_at_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.commit({"o": spark.range(10).withColumn("v", F.col("id") * 2)})
    b = branch.Branches(s)
    v = b.create({"o": s.table("o").unionAll(s.table("o"))})
    assert "loaded twice" in " ".join(b.compare(v, {"o": ("id",)})["o"]) and s.table("o").count() == 10
    b.promote(v)
    assert s.table("o").count() == 20


def test_profile_and_findings(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("gone", F.lit(None).cast("string")).withColumn("one", F.lit("x"))
    p = profile.profile(df, "orders")
    assert p.rows == 1500 and p.column("o_orderkey").distinct == -1 and p.column("o_orderstatus").samples == ("F", "O", "P")
    found = {(f.column, f.severity) for f in profile.findings(p, datetime(2024, 1, 1))}
    assert {("gone", "high"), ("one", "low"), ("o_orderdate", "medium")} <= found
    assert profile.profile(df, "orders", sample_above=100).approximate
    assert profile.is_code(5, 10, 40) and not profile.is_code(7, 1, 7) and not profile.is_code(100, 0, 500)
    assert profile.cadence(datetime(2024, 1, 1), datetime(2024, 12, 31), 13) > 30 and profile.cadence(datetime(2024, 1, 1), datetime(2024, 1, 2), 1) == 30
    assert profile.segment_like("store_id", "numeric", 5) and not profile.segment_like("price", "numeric", 5)
    assert profile.shared_end([p]).startswith("2001")


def test_reconcile_and_anchor(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_v")
    cases = [checks.Case("order_value", control="select sum(o_totalprice) from orders_v"), checks.Case("order_count", value=1500, tol=0.5), checks.Case("order_count", value=7)]
    r = checks.reconcile(spark, model(), resolver(spark, sf_dir), cases)
    assert [x.ok for x in r] == [True, True, False]
    assert checks.verdict(model(), r) == "FAILING" and checks.verdict(model(), r[:2]) == "PARTIAL" and checks.verdict(model(), []) == "NOT VERIFIED"
    asia = [x for x in r][0].got
    m = checks.anchor(model(), resolver(spark, sf_dir), "order_value", asia / 100, asia * 1e-9, grains=("year",), queries=2)
    assert m and m[0].scale == 0.01
    one = checks.anchor(model(), resolver(spark, sf_dir), "order_count", 1500, 0.5)
    assert one == [checks.Match("order_count", (), 1500.0)]
    assert checks.conflicts(spark, [checks.Conflict("c", "high", "", "select * from orders_v where o_totalprice < 0")]) == [("c", "high", 0)]


def test_figures():
    assert checks.figure("2,610.3") == (2610.3, 0.05) and checks.figure("97.3%")[0] == 97.3
    assert checks.figure("1.2万")[0] == 12000 and checks.figure("3亿")[0] == 3e8
    with pytest.raises(Refused):
        checks.figure("many")
    assert checks.too_coarse([1.0, 1.1], 0.1) and not checks.too_coarse([1.0], 1)
    assert checks.same_answers([(1, "a"), (2, None)], [(2.0000001, "a"), (1,)]) and not checks.same_answers([(1,)], [(1.1,)])


def test_drift(spark, sf_dir):
    tables = {e.table: table(spark, sf_dir, e.table) for e in model().entities.values()}
    assert checks.drift(model(), tables, [], [], datetime(2024, 1, 1)).healthy
    lost = {**tables, "orders": tables["orders"].drop("o_orderpriority")}
    del lost["part"]
    d = checks.drift(model(), lost, [profile.profile(tables["orders"], "orders")], [], datetime(2024, 1, 1))
    assert d.missing_tables == ["part"] and d.missing_columns == ["orders.o_orderpriority"] and d.stale == ["orders.o_orderdate"]


def test_usage(spark):
    runs = spark.createDataFrame([("r1", '{"touched": ["orders", "x"]}'), ("r2", "{}")], "id string, state string")
    assert [r["id"] for r in usage.lineage(runs, "orders").collect()] == ["r1"]
    v = spark.createDataFrame([(float(i),) for i in range(10)], "ms double")
    assert tuple(usage.latency(v.withColumn("k", F.lit(1)), "ms", "k").select("p50", "p95", "max").first()) == (4.0, 8.0, 9.0)
    graded = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "category string, ok boolean")
    assert checks.category_floors(graded, {"*": 0.9}) == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "5"), ("b", "50"), ("c", "?")], "k string, v string")
    assert [r["k"] for r in sinks.sink("alert:v:0:10")(df).collect()] == ["b"]
    sinks.sink(f"json:{tmp_path}/out")(df)
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    assert sinks.sink("es:index")(df) == 3 and sinks.sink("snowflake:t")(df) == 3
    for bad in ("kafka:x", "alert:v", "json:"):
        with pytest.raises(Refused):
            sinks.sink(bad)
    with pytest.raises(Refused):
        sinks.outside(df, "z", 0, 1)


def test_draft(spark, sf_dir):
    tables = {
        "orders": spark.createDataFrame([], "id int, store_id int, placed_at timestamp_ntz, customer_phone string, revenue double, cogs_amount double, units int"),
        "stores": spark.createDataFrame([], "id int, region string"),
        "melt": spark.createDataFrame([], "id int, charge_t double, tapped_t double, scrap_t double"),
        "_audit": spark.range(1),
    }
    m = draft.draft(tables, references=[("orders", "store_id", "stores", "id")])
    assert set(m.entities) == {"orders", "stores", "melt"} and len(m.joins) == 1
    assert m.dimensions["orders_customer_phone"].mask == "***" and m.dimensions["orders_placed_at"].type == "time"
    assert m.metrics["orders_revenue_sum"].roles and not m.metrics["orders_units_sum"].roles
    assert {"orders_gross_margin", "orders_revenue_per_unit", "melt_yield_rate", "melt_scrap_t_rate"} <= set(m.metrics)
    assert all(m.additivity(n) == "non_additive" for n in ("orders_gross_margin", "melt_yield_rate"))
    assert draft.personal("tel") and not draft.personal("hotel") and draft.identifier("order_id") and not draft.identifier("item_num")
    with pytest.raises(Refused):
        draft.draft({})


def test_expressible():
    unit = [0, [0, [0, 1, False], None]]
    assert draft.expressible({"union": {}}) == "set_operation"
    assert draft.expressible({"from": {"table_units": [["sql", {}]]}}) == "nested_from"
    assert draft.expressible({"where": [[False, 2, unit, {"select": []}, None]]}) == "nested_where"
    assert draft.expressible({"having": [1]}) == "having" and draft.expressible({}) == "malformed"
    assert draft.expressible({"select": [False, [[3, unit]]]}) == "expressible"
    assert draft.expressible({"select": [False, [[0, unit]]]}) == "row_level"
    assert draft.expressible({"select": [False, [[0, unit]]], "orderBy": ["desc", [[0, [3, 1, False], None]]], "limit": 1}) == "top_n_label_only"


def test_writes_are_guarded(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.commit({"price": spark.sql("SELECT * FROM VALUES (1, 10.0, 'a'), (2, 20.0, 'b') t(id, price, kind)")})
    w = write.WriteBack(s, {"price": write.AllowedTable("id", ("update", "insert", "delete"), {"price": "double", "kind": "string", "id": "int"}, ("price",), {"kind": ("a", "b")}, 1)}, ("manager",))
    for bad in (
        write.Change("price", "update", {"price": 1.0}),
        write.Change("price", "update", {"price": "x"}, (("id", "=", 1),)),
        write.Change("price", "update", {"kind": "z"}, (("id", "=", 1),)),
        write.Change("price", "update", {"price": 1.0}, (("id", ">", 0),)),
        write.Change("price", "insert", {"id": 3}),
        write.Change("price", "insert", {"id": 1, "price": 2.0}),
        write.Change("other", "delete", {}, (("id", "=", 1),)),
    ):
        with pytest.raises(Refused):
            w.propose(bad, "u")
    p = w.propose(write.Change("price", "update", {"price": 11.0}, (("id", "=", 1),)), "u")
    with pytest.raises(Forbidden):
        w.approve(p.id, "u", "manager")
    with pytest.raises(Forbidden):
        w.approve(p.id, "v", "clerk")
    w.approve(p.id, "v", "manager")
    assert dict(s.table("price").select("id", "price").collect())[1] == 11
    w.rollback(p.id)
    assert dict(s.table("price").select("id", "price").collect())[1] == 10
    q = w.propose(write.Change("price", "delete", {}, (("id", "=", 2),)), "u")
    w.reject(q.id, "u", "clerk")
    assert q.status == "rejected"


def test_rollback_keeps_later_changes(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.commit({"price": spark.sql("SELECT * FROM VALUES (1, 10.0D, 'a'), (2, 20.0D, 'b'), (3, 30.0D, 'b') t(id, price, kind)")})
    w = write.WriteBack(s, {"price": write.AllowedTable("id", ("update", "insert", "delete"), {"price": "double", "kind": "string", "id": "int"}, ("price",), {}, 1)}, ("manager",))

    def done(operation, values, id):
        p = w.propose(write.Change("price", operation, values, (("id", "=", id),)), "u")
        w.approve(p.id, "v", "manager")
        return p.id

    first, second, third = done("update", {"price": 11.0}, 1), done("update", {"price": 21.0}, 2), done("delete", {}, 3)
    w.rollback(first)
    assert dict(s.table("price").select("id", "price").collect()) == {1: 10.0, 2: 21.0}
    w.rollback(third)
    assert dict(s.table("price").select("id", "price").collect()) == {1: 10.0, 2: 21.0, 3: 30.0}
    done("update", {"price": 22.0}, 2)
    with pytest.raises(Refused):
        w.rollback(second)
    assert dict(s.table("price").select("id", "price").collect())[2] == 22.0


def test_approval_counts_rows_again(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.commit({"price": spark.sql("SELECT * FROM VALUES (1, 10.0D, 'a') t(id, price, kind)")})
    w = write.WriteBack(s, {"price": write.AllowedTable("id", ("update",), {"price": "double", "kind": "string", "id": "int"}, ("price",), {}, 1)}, ("manager",))
    p = w.propose(write.Change("price", "update", {"price": 1.0}, (("id", "=", 1),)), "u")
    s.commit({"price": s.table("price").union(s.table("price"))})
    with pytest.raises(Refused):
        w.approve(p.id, "v", "manager")


def test_zoned_times_are_times_and_guessed_orders_are_not(spark):
    from grainloom.sources.infer import infer

    rows = spark.createDataFrame([("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+02:00", "03/04/2024")], "a string, b string, c string")
    assert infer(rows) == {"a": "date", "b": "date", "c": "text"}


def test_jdbc_reads_a_query_in_parallel():
    from grainloom.sources.scan import jdbc_options

    bounds = {"partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    assert jdbc_options("jdbc:x", "SELECT id FROM t;", **bounds) == {"url": "jdbc:x", "dbtable": "(SELECT id FROM t) source", **bounds}
    with pytest.raises(Refused):
        jdbc_options("jdbc:x", "SELECT 1", partitionColumn="id")


def test_flows_undo_what_they_did():
    log = []
    step = lambda n, fail=False: write.Step(n, lambda s: log.append(n) or (1 / 0 if fail else {n: 1}), lambda s: log.append(f"-{n}"))
    f = write.Flow([step("a"), write.Step("ok", human=True), step("b"), step("c", True)])
    assert f.run() == "waiting" and f.approve() == "failed"
    assert log == ["a", "b", "c", "-b", "-a"] and f.errors[0].startswith("c:")
    g = write.Flow([step("d"), write.Step("ok", human=True)])
    g.run()
    g.reject()
    assert g.status == "rejected" and log[-1] == "-d"
    with pytest.raises(Refused):
        g.approve()


def test_rollout():
    r = Rollout()
    r.add("v1"), r.add("v2")
    r.activate("v1")
    r.canary("v2", 30)
    routed = [r.route(f"user-{i}") for i in range(1000)]
    assert 200 < routed.count("v2") < 400 and routed == [r.route(f"user-{i}") for i in range(1000)]
    assert r.watch(9, 10, 0.8) and not r.watch(5, 10, 0.8) and r.versions["v2"] == "retired"
    with pytest.raises(Refused):
        r.canary("v2", 10)
    other = model().merged({"metrics": [{"name": "gross", "description": "x", "entity": "line", "agg": "sum", "expr": "1"}, {"name": "new", "description": "x", "formula": "gross + 1"}]})
    assert changed_metrics(model(), other) == {"added": ["new"], "removed": [], "changed": ["gross"]}
    assert version_id(model()) != version_id(other)


def test_functions(spark):
    df = spark.createDataFrame([("user-1",), ("é",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(bucket(F.col("k"))).collect()] == [py_bucket("user-1"), py_bucket("é"), py_bucket(""), None]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(normalised(F.col("v")).alias("v"))
    assert [r[0] for r in v.select(dot(F.col("v"), F.col("v"))).collect()] == [pytest.approx(1.0), 0.0]


@pytest.mark.parametrize(
    ("question", "metrics", "by", "grain"),
    [
        ("What are sales by customer region?", ("revenue",), ("customer_region",), None),
        ("monthly revenue by order date", ("revenue",), ("order_date",), "month"),
        ("turnover and units per market segment", ("revenue", "quantity"), ("segment",), None),
        ("how many orders by priority", ("order_count",), ("priority",), None),
        ("value per customer by country", ("value_per_customer",), ("customer_nation",), None),
        ("toxic labels by language", ("toxic_labels",), ("doc_lang",), None),
    ],
)
def test_grounding(question, metrics, by, grain):
    q = ground(model(), question)
    assert isinstance(q, SemanticQuery) and (q.metrics, q.group_by, q.time_grain) == (metrics, by, grain)


def test_questions_that_need_a_question_back():
    assert isinstance(ground(model(), "how is the weather"), Clarify)
    assert ground(model(), "revenue by month").options == ("order_date", "ship_date")
    assert retrieve(model(), "discounted price of lines")[0][0] in ("revenue", "gross")
    assert tokens("各门店 revenue of the") == {"各门", "门店", "revenue"}
    q = SemanticQuery(("revenue",), ("segment",), (Filter("order_status", "=", ("F",)),))
    more = follow_up(model(), q, "and by brand")
    assert more.group_by == ("segment", "brand") and more.where == q.where
    assert follow_up(model(), q, "orders by priority").metrics == ("order_count",)
    assert critique(model(), "revenue by brand", SemanticQuery(("revenue",)))[0] == "revise"
    assert critique(model(), "order value by brand", SemanticQuery(("order_value",), ("brand",)))[0] == "ask"
    assert settled(model(), "revenue by brand", SemanticQuery(("revenue",)), lambda a, b, c: SemanticQuery(("revenue",), ("brand",))).group_by == ("brand",)
    assert isinstance(settled(model(), "revenue by brand", SemanticQuery(("revenue",)), lambda a, b, c: b), Clarify)


def test_chain(spark):
    got = chained([("x", lambda k: spark.range(5, 6)), ("", lambda k: spark.range(k["x"]))])
    assert got.count() == 5


def test_stream_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (0, 1, 7, 12, 40)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(f"{tmp_path}/in")
    q = sync.windowed_counts(s, "ts", "event_type", "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 1, 3]


def test_sync_is_idempotent(spark, tmp_path):
    state = StateTable(spark, f"{tmp_path}/c", sync.CURSORS)
    rows = spark.range(10).withColumn("v", F.lit(1))
    assert sync.sync(rows.where("id < 6"), "s", "id", ["id"], f"{tmp_path}/t", state) == 6
    assert sync.pending(rows, "id", state, "s") == 4
    assert sync.sync(rows, "s", "id", ["id"], f"{tmp_path}/t", state) == 4
    assert sync.sync(rows, "s", "id", ["id"], f"{tmp_path}/t", state) == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10


def test_pending_of_times_texts_and_negative_numbers(spark, tmp_path):
    state = StateTable(spark, f"{tmp_path}/c", sync.CURSORS)
    rows = spark.range(-4, 4).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("at"), F.concat(F.lit("x" * 30), (F.col("id") + 4).cast("string")).alias("name"), (F.col("id") / 2).alias("half"))
    for cursor in ("at", "name", "id", "half"):
        sync.sync(rows.where("id < -1"), cursor, cursor, ["id"], f"{tmp_path}/{cursor}", state)
        assert sync.pending(rows, cursor, state, cursor) == 5


def store_month(spark):
    """A warehouse of pure arithmetic: stores, and sales and shrinkage by store, category and month."""
    cells = spark.range(10).selectExpr("id + 1 AS store_id").crossJoin(spark.range(6).selectExpr("id + 1 AS category_id")).crossJoin(spark.range(24).selectExpr("id AS m"))
    return {
        "stores": spark.range(10).selectExpr("id + 1 AS store_id", "concat('c', id % 3) AS city", "cast(500 + id * 37 as decimal(10,2)) AS area_sqm"),
        "sales": cells.selectExpr("store_id", "category_id", "add_months(date'2023-01-01', int(m)) AS month", "cast(1000 + store_id * 13.37 + category_id * 7 + m as decimal(14,2)) AS revenue", "cast(30 + m as int) AS transactions"),
        "shrinkage": cells.where("(store_id + m) % 4 = 0").selectExpr("store_id", "category_id", "add_months(date'2023-01-01', int(m)) AS month", "cast(5 + category_id as decimal(14,2)) AS loss"),
    }


def test_ratio_over_three_grains(spark):
    m = Model.of(
        {
            "entities": [{"name": "store", "table": "stores", "primary_key": "store_id"}, {"name": "sale", "table": "sales"}, {"name": "loss", "table": "shrinkage"}],
            "joins": [{"from": e, "to": "store", "from_key": "store_id", "to_key": "store_id"} for e in ("sale", "loss")],
            "dimensions": [{"name": "city", "entity": "store", "column": "city"}],
            "metrics": [
                {"name": "sales", "entity": "sale", "agg": "sum", "expr": "revenue"},
                {"name": "area", "entity": "store", "agg": "sum", "expr": "area_sqm"},
                {"name": "lost", "entity": "loss", "agg": "sum", "expr": "loss"},
                {"name": "per_sqm", "formula": "sales / nullif(area, 0)"},
                {"name": "loss_rate", "formula": "lost / nullif(sales, 0)"},
            ],
        }
    )
    from grainloom.catalog import Catalog
    from grainloom.plans.planner import plan

    frames = store_month(spark)
    df = plan(m, SemanticQuery(("per_sqm", "loss_rate"), ("city",)), Catalog(spark, frames=frames).resolver(m))
    df = df.select("city", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("per_sqm", "loss_rate")))
    sql = """SELECT city, round(CAST(s AS DOUBLE) / CAST(a AS DOUBLE), 6) AS per_sqm, round(CAST(l AS DOUBLE) / CAST(s AS DOUBLE), 6) AS loss_rate FROM
    (SELECT city, sum(area_sqm) AS a FROM stores GROUP BY 1) JOIN (SELECT city, sum(revenue) AS s FROM sales JOIN stores USING (store_id) GROUP BY 1) USING (city)
    JOIN (SELECT city, sum(loss) AS l FROM shrinkage JOIN stores USING (store_id) GROUP BY 1) USING (city)"""
    assert_same(df, sql, frames={k: v.toPandas() for k, v in frames.items()})
    assert isinstance(df.schema["per_sqm"].dataType, T.DoubleType)


def test_results_are_kept_and_stand_in(spark):
    now, made = [datetime(2024, 1, 1)], []
    r = cache.Results(spark, timedelta(minutes=1), timedelta(minutes=10), lambda: now[0], most=2)

    def make():
        made.append(1)
        return spark.range(len(made))

    def fails():
        raise ValueError("down")

    assert (r.get("a", make).label, r.get("a", make).label, len(made)) == ("new", "kept", 1)
    now[0] += timedelta(minutes=2)
    old = r.get("a", fails)
    assert (old.label, old.error, old.rows.count()) == ("stale", "ValueError: down", 1)
    assert r.get("a", make).rows.count() == 2
    now[0] += timedelta(minutes=11)
    with pytest.raises(ValueError):
        r.get("a", fails)
    r.get("b", make), r.get("c", make)
    assert list(r.known) == ["b", "c"]


def test_scopes_differ_by_what_callers_may_see():
    q = SemanticQuery(("revenue",))
    ann, bob = Principal("ann", "sales", {"tenant": "t", "region": "ASIA"}), Principal("bob", "sales", {"tenant": "t", "region": "ASIA"})
    assert cache.scope(q, ann) == cache.scope(q, bob)
    others = [Principal("bob", "sales", {"tenant": "t", "region": "EUROPE"}), Principal("bob", "admin", {"tenant": "t", "region": "ASIA"}), Principal("bob", "sales", {"tenant": "u", "region": "ASIA"})]
    assert len({cache.scope(q, p) for p in (ann, *others)} | {cache.scope(q, ann, "v2")}) == 5


def test_raw_statements_are_recorded(spark, tmp_path):
    g = Governed(queries.model(), Policy(), lambda e: None, StateTable(spark, f"file://{tmp_path}/audit", AUDIT), StateTable(spark, f"file://{tmp_path}/spend", SPEND), lambda: datetime(2024, 1, 1))
    assert g.raw(spark, "select 1 as x", Principal("ann", "admin")).count() == 1
    with pytest.raises(Refused):
        g.raw(spark, "drop table x", Principal("ann", "admin"))
    assert sorted((r["question"], r["refused"]) for r in g.audit.read().collect()) == [("drop table x", True), ("select 1 as x", False)]


def test_dates_by_evidence(spark):
    from grainloom.sources.infer import retyped

    df = retyped(spark.createDataFrame([("2024-02-29", "20240101", "1"), (None, "20240230", "x"), (" 2023-01-01", "20240103", "")], "a string, b string, c string"))
    assert [f.dataType.simpleString() for f in df.schema] == ["date", "string", "string"]
    assert [str(r[0]) for r in df.collect()] == ["2024-02-29", "None", "2023-01-01"]


def test_fused_retrieval_exemplars_and_turns():
    m = queries.model()
    assert "revenue" in dict(grounding.retrieve_fused(m, "total revenue", 3)) and grounding.bm25({"a": "x y"}, "zz") == []
    assert grounding.fused([("a", 1), ("b", 1)], [("b", 9)])[0][0] == "b"
    known = [("revenue by region", SemanticQuery(("revenue",), ("customer_region",))), ("orders placed each month", SemanticQuery(("orders",)))]
    assert [x for x, _ in grounding.exemplars(known, "revenue of each region")] == ["revenue by region"] and grounding.exemplars(known, "weather") == []
    c = grounding.Conversation(m)
    assert isinstance(c.turn("hello there"), grounding.Clarify) and c.open
    assert c.turn("revenue").metrics == ("revenue",) and not c.open
    q = c.turn("by segment")
    assert q.metrics == ("revenue",) and "segment" in q.group_by and len(c.turns) == 3


def test_nearest_against_all_pairs(spark):
    """Blocks of a few rows against all pairs: ties, copies, repeated ids, zero, null, short and half-null vectors."""
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in g.integers(-2, 3, 4)]) for i in range(60)] + [(7, [1.0, 1.0, 0.0, 0.0]), (60, None), (61, [1.0, 2.0]), (62, [1.0, None, 0.0, 0.0]), (63, [0.0] * 4), (None, [1.0] * 4)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", normalised(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 10 < 2").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    s = e.join(q, F.col("vec_id") != F.col("query_id")).withColumn("similarity", dot(F.col("q"), F.col("v")))
    w = W.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    place = lambda df: sorted((r["query_id"], r["place"], r["vec_id"], -9 if r["similarity"] is None else round(r["similarity"], 6)) for r in df.collect())
    for k in (3, 64):
        want = place(s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
        for block, asked in ((7, 5), (1000, 3), (1000, 1000)):
            got = nearest.nearest(e, q, k, block, asked)
            assert place(got) == want
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert nearest.nearest(e.limit(0), q, 3).count() == 0 and nearest.nearest(e, q.limit(0), 3).count() == 0
