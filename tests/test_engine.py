"""The engine on hand-derived cases: parsing, features, rules, distances, search, index and evaluation."""

import gzip
import json
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecscore.functions import features as feat
from vecscore.functions.schema import DIMS, RULES
from vecscore.operators import boxes, kmeans, knn
from vecscore.operators.distance import array_distance
from vecscore.operators.rules import with_rule
from vecscore.plans import evaluate, fixtures
from vecscore.plans.score import response_json
from vecscore.sources import ingest, tables

SMOKE = {
    "id": "tx-3576980410", "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"}, "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001", "MERC-001"]},
    "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.709}, "last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.86},
}
LEGIT = {
    "id": "tx-1", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"}, "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": []},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None, "unknown": {"x": [1]},
}
FRAUD = {
    "id": "tx-2", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"}, "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["A", "B", "C"]},
    "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(0, json.dumps(SMOKE)), (1, json.dumps(LEGIT)), (2, json.dumps(FRAUD)), (3, "{broken"), (4, None), (5, "{}")]
    return ingest.parse_requests(spark.createDataFrame(rows, "k int, json string"))


def test_parse(parsed):
    r = {x.k: x for x in parsed.collect()}
    assert abs(r[0].amount - 384.88) < 1e-4 and r[0].installments == 3 and len(r[0].known_merchants) == 3 and r[0].has_last
    assert not r[1].has_last and r[1].last_km is None
    assert r[3].corrupt == "{broken" and r[3].amount == 0 and r[5].corrupt is None and r[5].mcc is None


def test_as_coded_profile(spark):
    r = ingest.parse_requests(spark.createDataFrame([(json.dumps(SMOKE),)], "json string"), profile="as_coded").first()
    assert (r.mcc, r.merchant_avg, r.card_present, r.km_home, r.has_last) == ("0", 0.0, False, 0.0, False) and r.installments == 3


def test_features(parsed):
    rows = {x.k: x for x in feat.with_features(parsed).collect()}
    a, b, c = rows[1], rows[2], rows[0]
    assert [round(a[f"v{d}"], 6) for d in (0, 1, 2, 3, 5, 6, 11)] == [0.004112, round(2 / 12, 6), 0.05, round(18 / 23, 6), -1, -1, 1]
    assert [round(b[f"v{d}"], 4) for d in (0, 1, 2, 7, 8, 11)] == [0.9506, 0.8333, 1, 0.9523, 1, 1]
    assert round(c["v3"] * 23) == 20 and round(c["v4"] * 6) == 2 and round(c["v5"] * 1440) == 325 and c["v11"] == 0
    assert math.isnan(rows[5]["v2"])
    ruled = {x.k: x.rule_id for x in with_rule(feat.with_features(parsed)).collect()}
    assert (ruled[0], ruled[2]) == ("L2", "F1r")


def test_mcc_risk(spark):
    df = feat.with_mcc_risk(spark.createDataFrame([("5411",), ("1234",), ("10000",), ("x",), (None,)], "mcc string"))
    got = {r.mcc: round(r.mcc_risk, 6) for r in df.collect()}
    assert got == {"5411": 0.14902, "1234": 0.501961, "10000": 0.5, "x": 0.501961, None: 0.501961}


def test_each_rule_and_its_strict_bounds(spark):
    """Each rule fires just inside its thresholds and no longer on them."""
    neutral = [0.5, 0, 0.5, 0, 0, -1, -1, 0.45, 0.5, 0.5, 1, 1, 0.4, 0]
    rows = []
    for name, _, conditions in RULES:
        inside, edge = list(neutral), list(neutral)
        for d, how, t in conditions:
            inside[d], edge[d] = t + (0.001 if how == ">" else -0.001), t
        rows += [(name, "in", *map(float, inside)), (name, "edge", *map(float, edge))]
    rows.append(("F2r", "nan", *[float("nan") if d == 2 else float(x) for d, x in enumerate(neutral)]))
    schema = "rule string, kind string, " + ", ".join(f"v{d} float" for d in range(DIMS))
    for r in with_rule(spark.createDataFrame(rows, schema)).collect():
        if r.kind == "in":
            assert r.rule_id == r.rule, r
        else:
            assert r.rule_id != r.rule, r


def test_quantised_and_ratio(spark):
    df = spark.createDataFrame([(0.00019999,), (-1.0,), (float("nan"),), (9.0,), (-9.0,)], "v float").select(ingest.quantised(F.col("v")).alias("q"))
    assert [r.q for r in df.collect()] == [1, -10000, 0, 32767, -32768]
    pairs = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (300.0, 100.0)], "a float, b float").select(feat.ratio(F.col("a"), F.col("b")).alias("r"))
    got = [r.r for r in pairs.collect()]
    assert got[0] == 1 and math.isnan(got[1]) and round(got[2], 6) == 0.3


def test_hash_and_number(spark):
    def djb2(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        return h

    names = ["", "MERC-001", "a" * 50]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(ingest.string_hash(F.col("s")).alias("h"))
    assert [r.h for r in df.collect()] == [djb2(n) for n in names]
    ids = spark.createDataFrame([("tx-12",), ("12",), ("a-b",), ("a-1-2",), ("tx-1x2",), ("t--3",), ("t-18446744073709551615",), ("t-18446744073709551621",), (None,)], "i string").select(ingest.transaction_number(F.col("i")).alias("n"))
    assert [r.n for r in ids.collect()] == [12, 0, 0, 1, 1, 0, -1, 5, 0]


def vectors(spark, rows):
    schema = "vec_id bigint, " + ", ".join(f"q{d} smallint" for d in range(DIMS)) + ", is_fraud boolean, cell_id int"
    return spark.createDataFrame([(i, q, *[0] * (DIMS - 1), f, c) for i, q, f, c in rows], schema)


def queries(spark, values):
    return spark.createDataFrame([(i, q, *[0] * (DIMS - 1)) for i, q in enumerate(values)], "query_id bigint, " + ", ".join(f"q{d} smallint" for d in range(DIMS)))


def test_exact_knn(spark):
    v = vectors(spark, [(0, 1000, False, 0), (1, 9000, True, 0), (2, 2000, False, 0)])
    near = knn.exact_knn(queries(spark, [1000]), v, k=2)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == [0, 2]
    assert knn.votes(queries(spark, [1000]), near).first().fraud_count == 0


def test_exact_knn_ties_and_many_blocks(spark):
    v = vectors(spark, [(i, (i * 7919) % 100, i % 3 == 0, 0) for i in range(500)]).repartition(4)
    got = knn.exact_knn(queries(spark, range(0, 100, 9)).repartition(3), v, k=5).collect()
    for q in range(12):
        want = sorted((((i * 7919) % 100 - q * 9) ** 2, i) for i in range(500))[:5]
        assert [(r.distance, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_searches_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART", 16)
    v = vectors(spark, [(i, (i * 7919) % 90 - 45, i % 3 == 0, None) for i in range(300)])
    c = spark.createDataFrame([(k, x, *[0] * (DIMS - 1)) for k, x in enumerate([-10, 10, 10])], "cell_id int, " + ", ".join(f"c{d} bigint" for d in range(DIMS)))
    v = kmeans.assign(v, kmeans.centroid_array(c))
    values = list(range(-45, 45))
    rows = [(r.vec_id, r.q0, r.cell_id) for r in v.collect()]
    exact, probed = (sorted((r.query_id, r["rank"], r.distance, r.vec_id) for r in df.collect()) for df in (knn.exact_knn(queries(spark, values), v), knn.ivf_neighbours(queries(spark, values), v, c, nprobe=1)))
    best = lambda x, own: [(d, i) for d, i in sorted(((x - q) ** 2, i) for i, q, _ in own)[:5]]
    assert exact == [(n, k + 1, *b) for n, x in enumerate(values) for k, b in enumerate(best(x, rows))]
    assert probed == [(n, k + 1, *b) for n, x in enumerate(values) for k, b in enumerate(best(x, [r for r in rows if r[2] == (0 if x <= 0 else 1)]))]


def test_exact_knn_in_boxes(spark, monkeypatch):
    """Vectors of all coordinates, with copies, ties between cells and cells of fewer than k: the rows are those of a plain search, and most pairs are left out."""
    monkeypatch.setattr(boxes, "CELL", 8)
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (1200, DIMS)) * np.where(np.arange(DIMS) < 3, 1000, 0) + np.where(np.arange(DIMS) == 5, rng.integers(0, 3, (1200, 1)), 0)
    x[:200] = x[0]
    names = [f"q{d}" for d in range(DIMS)]
    v = spark.createDataFrame([(i, i % 3 == 0, *map(int, r)) for i, r in enumerate(x)], "vec_id bigint, is_fraud boolean, " + ", ".join(f"{c} smallint" for c in names))
    asked = np.concatenate([x[::40], rng.integers(-5000, 5000, (20, DIMS))])
    q = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(asked)], "query_id bigint, " + ", ".join(f"{c} smallint" for c in names))
    got = sorted((r.query_id, r["rank"], r.distance, r.vec_id, r.is_fraud) for r in knn.exact_knn(q, v).collect())
    want = []
    for n, a in enumerate(asked):
        best = sorted((int(d), i) for i, d in enumerate(((x - a) ** 2).sum(1)))[:5]
        want += [(n, k + 1, d, i, i % 3 == 0) for k, (d, i) in enumerate(best)]
    assert got == want
    cuts = boxes.cuts_of(v, names)
    own = boxes.with_cell(v, cuts, names).cache()
    sizes = {r.cell_id: r["count"] for r in own.groupBy("cell_id").count().collect()}
    assert len(sizes) > 50 and sum(sizes.values()) == 1200 and min(sizes.values()) < 5
    ids, low, high = boxes.boxes_of(own, names)
    bound = spark.createDataFrame([(i, r[2]) for i, r in enumerate(want[4:150:5])], "query_id bigint, bound bigint")
    met = boxes.other_cells(boxes.with_cell(q, cuts, names).join(bound, "query_id"), (ids, low, high), names)
    assert met.count() < 30 * len(sizes) / 3


def test_searches_without_queries_or_vectors(spark):
    v, q = vectors(spark, [(0, 5, True, 0)]), queries(spark, [5])
    c = spark.createDataFrame([(0, *[0] * DIMS)], "cell_id int, " + ", ".join(f"c{d} bigint" for d in range(DIMS)))
    for own, found in ((q.limit(0), v), (q, v.limit(0))):
        assert knn.exact_knn(own, found).count() == 0 and knn.ivf_neighbours(own, found, c).count() == 0
    assert knn.votes(q, knn.exact_knn(q, v)).first().fraud_count == 1


def test_ivf(spark):
    v = vectors(spark, [(i, 9000 if i < 50 else 1000, i < 50, 0 if i < 50 else 1) for i in range(100)])
    c = spark.createDataFrame([(k, x, *[0] * (DIMS - 1)) for k, x in enumerate([9000, 1000, 0, 0])], "cell_id int, " + ", ".join(f"c{d} bigint" for d in range(DIMS)))
    q = queries(spark, [8000])
    assert knn.votes(q, knn.ivf_neighbours(q, v, c, nprobe=2)).first().fraud_count == 5
    assert [r.cell_id for r in knn.probe_cells(q, c, 4).orderBy("cell_rank").collect()] == [0, 1, 2, 3]
    assert knn.votes(queries(spark, [0]), knn.ivf_neighbours(queries(spark, [0]), v, c, nprobe=1)).first().fraud_count == 0
    assert [(r.frauds, r.n) for r in knn.cell_fraud_counts(v, c).orderBy("cell_id").collect()] == [(5, 50), (0, 50), (0, 0), (0, 0)]


def test_probing_all_cells_is_exact(spark):
    rows = [(i, (i * i * 31) % 20011 - 10000, i % 4 == 0, 0) for i in range(300)]
    v, c = kmeans.build(vectors(spark, rows), cells=8)
    q = queries(spark, [-9000, 17, 5000])
    a = knn.exact_knn(q, v).select("query_id", "distance").collect()
    b = knn.ivf_neighbours(q, v, c, nprobe=8).select("query_id", "distance").collect()
    assert sorted(a) == sorted(b)


def test_kmeans_with_fewer_vectors_than_cells(spark):
    v, c = kmeans.build(vectors(spark, [(0, 5, False, 0), (1, -5, True, 0), (2, -2, True, 0)]), cells=4)
    # all centroids start on vector 0; once cell 0 has moved, cell 1 is the nearest to it
    assert [r.cell_id for r in v.orderBy("vec_id").collect()] == [1, 0, 0]
    assert [r.c0 for r in c.orderBy("cell_id").collect()] == [-3, 5, 5, 5]


def test_index_round_trip(spark, tmp_path):
    v, c = kmeans.build(vectors(spark, [(i, i, i % 2 == 0, 0) for i in range(50)]), cells=5)
    ingest.write_index(v, c, str(tmp_path / "index"))
    back, centroids = ingest.read_index(spark, str(tmp_path / "index"))
    assert sorted(back.select(*v.columns).collect()) == sorted(v.collect()) and sorted(centroids.collect()) == sorted(c.collect())
    c.write.parquet(str(tmp_path / "other/vectors"))
    c.write.parquet(str(tmp_path / "other/centroids"))
    with pytest.raises(ValueError):
        ingest.read_index(spark, str(tmp_path / "other"))


def test_labelled_vectors_from_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "v.json.gz", "wt") as f:
        json.dump([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1, 1e-3] + [0] * 12, "label": "legit"}], f)
    rows = ingest.read_labelled_vectors(spark, str(tmp_path / "v.json.gz"), 2).orderBy("q0").collect()
    assert [(r.q0, r.q1, r.is_fraud) for r in rows] == [(-10000, 10, False), (5000, 5000, True)]


def test_array_distance(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 6, 3])], "a array<int>, b array<int>").select(array_distance("a", "b").alias("d"))
    assert df.first().d == 25


def test_response(spark):
    df = spark.range(6).select(response_json(F.col("id").cast("int")).alias("b"))
    assert [r.b for r in df.collect()][::5] == ['{"approved":true,"fraud_score":0.0}', '{"approved":false,"fraud_score":1.0}']


def test_evaluation(spark):
    rows = [(True, True, 200, 1.0)] * 90 + [(False, False, 200, 1.0)] * 6 + [(True, False, 200, 1.0)] * 2 + [(False, True, 200, 1.0)] + [(True, True, 500, 3000.0)]
    r = evaluate.final_score(spark.createDataFrame(rows, "expected_approved boolean, approved boolean, status int, ms double")).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.err) == (6, 90, 2, 1, 1)
    weighted = 2 + 3 + 5
    assert abs(r.detection_score - (1000 * math.log10(1 / (weighted / 100)) - 300 * math.log10(1 + weighted))) < 1e-5
    assert abs(r.p99 - 30.99) < 1e-6 or r.p99 > 1
    none = evaluate.final_score(spark.createDataFrame([], "expected_approved boolean, approved boolean, status int, ms double")).first()
    assert none.failure_rate == 0


def test_humanized(spark):
    def shown(rows, schema, make):
        df = spark.createDataFrame(rows, schema)
        return [r.s for r in df.select(make(*(F.col(c) for c in df.columns)).alias("s")).collect()]

    sizes = {0: "0 B", 9: "9 B", 10: "10 B", 999: "999 B", 1000: "1.0 kB", 1500000: "1.5 MB", 10**15: "1.0 PB", 25 * 10**17: "2.5 EB"}
    assert shown([(k,) for k in sizes], "n bigint", evaluate.humanize_bytes) == list(sizes.values())
    times = {0.0: "0s", 0.0005: "500ns", 0.5: "500µs", 0.0019999: "1.99µs", 1.5: "1.5ms", 1.999: "1.99ms", 999.0: "999ms", 59999.0: "59.99s", 60000.0: "1m0s", 61000.0: "1m1s", 119999.0: "1m59s", 3723000.0: "1h2m3s"}
    assert shown([(k,) for k in times], "ms double", evaluate.humanize_duration) == list(times.values())
    assert shown([(1999.0,)], "ms double", lambda c: evaluate.humanize_duration(c, "s")) == ["2.00s"]
    values = [(0.99999, "rate", "default"), (1500.0, "counter", "data"), (1.999, "trend", "time"), (2.5, "gauge", "default")]
    assert shown(values, "x double, kind string, contains string", evaluate.humanize_value) == ["99.99%", "1.5 kB", "1.99ms", "2.5"]


def test_bytes_beyond_the_last_unit(spark):
    df = spark.createDataFrame([(9e26,), (1.5e27,), (9e27,), (1e300,)], "n double")
    assert [r.s for r in df.select(evaluate.humanize_bytes(F.col("n")).alias("s")).collect()] == ["900 YB", None, None, None]


def test_report_lines(spark):
    df = spark.createDataFrame([("http_reqs", "a<b", True), ("m{x:'1'}", "p & q", False)], "m string, t string, ok boolean")
    out = df.select(evaluate.display_name(F.col("m")), evaluate.indent(F.col("m")), evaluate.junit_case(F.col("m"), F.col("t"), F.col("ok"))).collect()
    assert [tuple(r) for r in out] == [
        ("http_reqs", "", '<testcase name="http_reqs - a&lt;b" />'),
        ("{ x:'1' }", "  ", '<testcase name="m{x:&#39;1&#39;} - p &amp; q"><failure message="failed" /></testcase>'),
    ]


def test_evaluation_file(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"entries": [\n{"request": {"id": "tx-1", "merchant": {"mcc": "5411"}}, "expected_approved": true},\n{"request": {"id": "tx-2"}}],\n "stats": {"total": 2, "edge_case_rate": 1.5}}')
    entries, stats = ingest.read_evaluation(spark, str(tmp_path))
    rows = ingest.parse_requests(entries).select("position", "id", "mcc", "expected_approved").collect()
    assert [(r.position, r.id, r.expected_approved) for r in rows] == [(0, "tx-1", True), (1, "tx-2", None)]
    assert rows[0].mcc == "5411"
    assert [(r.total, r.fraud_rate, r.edge_case_rate) for r in stats.collect()] == [(2, None, 1.5)]


def test_feature_code_is_small_enough_to_be_compiled(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fixtures.features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000


def test_written_tables_make_no_code_that_is_not_compiled(spark):
    before = spark.conf.get(tables.LIMIT)
    with tables.compiled(spark):
        assert spark.conf.get(tables.LIMIT) == "8000"
    with pytest.raises(ValueError), tables.compiled(spark):
        raise ValueError
    assert spark.conf.get(tables.LIMIT) == before


def test_quantised_ends(spark):
    values = [float("nan"), float("inf"), float("-inf"), 3.27675, -3.27689, 1e9, -1e9, -0.00019, None]
    found = spark.createDataFrame([(v,) for v in values], "v float").select(ingest.quantised(F.col("v")).alias("q"))
    assert found.schema["q"].dataType.simpleString() == "smallint"
    assert [r.q for r in found.collect()] == [0, 32767, -32768, 32767, -32768, 32767, -32768, -1, 0]


def test_kept_assignment_is_written_once(spark):
    rows = [(i, (i * i * 31) % 20011 - 10000, i % 4 == 0, 0) for i in range(300)]
    v, c = kmeans.build(vectors(spark, rows), cells=8)
    kept, same = kmeans.build(vectors(spark, rows), cells=8, keep=True)
    assert sorted(kept.collect()) == sorted(v.collect()) and sorted(same.collect()) == sorted(c.collect())
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()


def test_cell_finder_at_the_ends_of_16_bits_and_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centroids = rng.choice([-32768, 0, 32767], (50, DIMS))
    centroids[7] = centroids[3]
    x = np.concatenate([centroids[[3, 9]], rng.integers(-32768, 32768, (40, DIMS))])
    far = ((x[:, None] - centroids[None]) ** 2).sum(2)
    want = np.lexsort((np.broadcast_to(np.arange(50), far.shape), far), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(x[:, d].astype(np.int16)) for d in range(DIMS)], names=kmeans.Q)
    monkeypatch.setattr(kmeans, "HELD", 150)
    for probes in (1, 4):
        at, distance = kmeans.cell_finder([(k, row.tolist()) for k, row in enumerate(centroids)], probes)(batch)
        assert (at == want[:, :probes]).all() and (distance == np.take_along_axis(far, at, 1)).all()
