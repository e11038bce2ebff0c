"""Every query of the engine by name, and the SQL that gives the same rows. Queries run over whole tables; where a search needs a query set, it is every row whose id is divisible by 50."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions import features as feat
from vecscore.functions import schema as S
from vecscore.operators import kmeans, knn
from vecscore.operators.distance import squared_distance
from vecscore.operators.rules import holds, with_rule
from vecscore.plans import evaluate, fixtures
from vecscore.plans import score as scoring
from vecscore.sources import ingest
from vecscore.sources.tables import fresh_path, written
from vecscore.streaming.stream import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D, Q, C = range(S.DIMS), [f"q{d}" for d in range(S.DIMS)], [f"c{d}" for d in range(S.DIMS)]
QUERY_EVERY = 50

# --- SQL pieces -----------------------------------------------------------------------------------------------------------------

_MCCS = ", ".join(f"'{m}'" for m in fixtures.MCCS)
_TX = f"""ev AS (
  SELECT event_id, user_id, ts, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) * 60 AS cents FROM events),
em AS (SELECT *, 'MERC-' || lpad(CAST(k % 50 AS VARCHAR), 3, '0') AS merchant_id FROM ev),
ew AS (
  SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sum_before,
    count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS in_day,
    coalesce(list(merchant_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS known_merchants,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_k FROM em),
mer AS (SELECT merchant_id, CAST(sum(cents) / count(*) / 100 AS FLOAT) AS merchant_avg FROM em GROUP BY 1),
tx AS (
  SELECT event_id, 'tx-' || event_id AS id, CAST(cents / 100 AS FLOAT) AS amount, CAST(1 + event_id % 12 AS INTEGER) AS installments, ts AS requested_at,
    CAST(CASE WHEN n_before > 0 THEN sum_before / n_before / 100 ELSE cents / 100 END AS FLOAT) AS customer_avg, CAST((in_day - 1) * 2 AS INTEGER) AS tx_count_24h,
    known_merchants, ew.merchant_id, [{_MCCS}][k % 11 + 1] AS mcc, merchant_avg, event_type IN ('click', 'view') AS is_online, event_type IN ('purchase', 'signup') AS card_present,
    CAST((user_id * 37 + k * 37 + event_id * 13) % 1000 AS FLOAT) AS km_home, last_ts IS NOT NULL AS has_last, last_ts, CAST(abs(k - last_k) * 10 AS FLOAT) AS last_km,
    ((event_id * 7 + k) % 5 < 2 OR event_type = 'error') AS is_fraud FROM ew JOIN mer ON ew.merchant_id = mer.merchant_id)"""


def _f(x) -> str:
    return f"CAST({x} AS FLOAT)"


def _share(x: str, of: float) -> str:
    return f"({_f(x)} / {_f(of)})"


def _clamp(x: str) -> str:
    return f"greatest({_f(0)}, least({_f(1)}, {x}))"


_BYTES = " ".join(f"WHEN mcc = '{m}' THEN {b}" for m, b in S.MCC_BYTES.items())
_RISK = f"CASE WHEN CAST(mcc AS INTEGER) >= {S.MCC_LIMIT} THEN {_f(S.MCC_BEYOND)} ELSE {_f(f'CASE {_BYTES} ELSE {S.MCC_DEFAULT} END')} / {_f(255)} END"
_MINUTES = "greatest(0, (epoch_us(requested_at) - epoch_us(last_ts)) // 60000000)"
_RATIO = f"CASE WHEN customer_avg = 0 THEN CASE WHEN amount > 0 THEN {_f(1)} WHEN amount < 0 THEN {_f(0)} ELSE {_f(chr(39) + 'nan' + chr(39))} END ELSE {_clamp(f'(amount / customer_avg / {_f(S.AVG_RATIO)})')} END"
_UNKNOWN = "NOT list_contains(known_merchants, merchant_id)"
_V = [
    _clamp(_share("amount", S.MAX_AMOUNT)), _clamp(_share("installments", S.MAX_INSTALLMENTS)), _RATIO, _share("hour(requested_at)", 23), _share("isodow(requested_at) - 1", 6),
    f"CASE WHEN has_last THEN {_clamp(_share(_MINUTES, S.MAX_MINUTES))} ELSE {_f(-1)} END", f"CASE WHEN has_last THEN {_clamp(_share('last_km', S.MAX_KM))} ELSE {_f(-1)} END",
    _clamp(_share("km_home", S.MAX_KM)), _clamp(_share("tx_count_24h", S.MAX_TX_24H)), _f("CAST(is_online AS INTEGER)"), _f("CAST(card_present AS INTEGER)"), _f(f"CAST({_UNKNOWN} AS INTEGER)"), _RISK, _clamp(_share("merchant_avg", S.MAX_MERCHANT_AVG)),
]
_FEAT = _TX + ",\nfeat AS (SELECT *, " + ", ".join(f"{v} AS v{d}" for d, v in enumerate(_V)) + " FROM tx)"


def _holds(conditions) -> str:
    return " AND ".join(f"v{d} {how} {_f(t)}" for d, how, t in conditions)


_RULE = "CASE " + " ".join(f"WHEN {_holds(c)} THEN '{r}'" for r, _, c in S.RULES) + " ELSE 'Borderline' END"
_VERDICT = "CASE " + " ".join(f"WHEN rule_id = '{r}' THEN '{v}'" for r, v, _ in S.RULES) + " ELSE 'Borderline' END"
_RULED = _FEAT + f",\nr0 AS (SELECT *, {_RULE} AS rule_id FROM feat), ruled AS (SELECT *, {_VERDICT} AS verdict FROM r0)"
_QUANT = ", ".join(f"CAST(trunc({_f(f'v{d} * {_f(S.SCALE)}')}) AS SMALLINT) AS q{d}" for d in D)
_VEC = _RULED + f",\nvec AS MATERIALIZED (SELECT event_id, event_id AS vec_id, rule_id, verdict, is_fraud, {_QUANT} FROM ruled)"
_LIST = ", ".join


def _distance(a: str, b: str, x: str = "q", y: str = "c") -> str:
    return " + ".join(f"(CAST({a}.{x}{d} AS BIGINT) - {b}.{y}{d}) * (CAST({a}.{x}{d} AS BIGINT) - {b}.{y}{d})" for d in D)


_cq = _LIST(f"CAST(q{d} AS BIGINT) AS c{d}" for d in D)
_INIT = f"cnt AS (SELECT count(*) AS n FROM vec), k0 AS MATERIALIZED (SELECT CAST(r.cell AS INTEGER) AS cell_id, {_cq} FROM (SELECT unnest(range({S.CELLS})) AS cell) r, cnt, vec WHERE vec.vec_id = (r.cell * (cnt.n // {S.CELLS})) % cnt.n)"


def _assign(i: int) -> str:
    return f"a{i} AS MATERIALIZED (SELECT vec_id, cell_id FROM (SELECT vec_id, cell_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell_id) AS rn FROM (SELECT v.vec_id, k.cell_id, {_distance('v', 'k')} AS d FROM vec v, k{i} k) x) y WHERE rn = 1)"


def _round(i: int) -> str:
    sums = _LIST(f"sum(CAST(q{d} AS BIGINT)) AS s{d}" for d in D)
    new = _LIST(f"CAST(coalesce(s{d} // n, c{d}) AS BIGINT) AS c{d}" for d in D)
    return f"{_assign(i)}, k{i + 1} AS MATERIALIZED (SELECT k.cell_id, {new} FROM k{i} k LEFT JOIN (SELECT cell_id, count(*) AS n, {sums} FROM vec JOIN a{i} ON vec.vec_id = a{i}.vec_id GROUP BY cell_id) s ON k.cell_id = s.cell_id)"


_KM1 = f"{_VEC},\n{_INIT},\n{_round(0)}"
_KM3 = f"{_KM1},\n{_round(1)},\n{_round(2)}"
_INDEX = _KM3 + f",\nidx AS MATERIALIZED (SELECT vec.vec_id, is_fraud, a2.cell_id, {_LIST(Q)} FROM vec JOIN a2 ON vec.vec_id = a2.vec_id)"


def _search(queries: str, nprobe: int) -> str:
    qc = _LIST(f"q{d}" for d in D)
    return f"""qs AS MATERIALIZED (SELECT event_id AS query_id, {qc} FROM vec WHERE {queries}),
probe AS MATERIALIZED (SELECT query_id, cell_id, rn - 1 AS cell_rank, d AS distance FROM (SELECT query_id, cell_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, cell_id) AS rn FROM (SELECT q.query_id, k.cell_id, {_distance('q', 'k')} AS d FROM qs q, k3 k) x) y WHERE rn <= {nprobe}),
near AS (SELECT query_id, vec_id, is_fraud, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, cell_rank, vec_id) AS rank FROM (SELECT q.query_id, p.cell_rank, i.vec_id, i.is_fraud, {_distance('q', 'i', 'q', 'q')} AS distance FROM qs q JOIN probe p ON q.query_id = p.query_id JOIN idx i ON i.cell_id = p.cell_id) z),
vote AS (SELECT qs.query_id, CAST(coalesce(s.n, 0) AS INTEGER) AS fraud_count FROM qs LEFT JOIN (SELECT query_id, sum(CAST(is_fraud AS INTEGER)) AS n FROM near WHERE rank <= {S.K} GROUP BY 1) s ON qs.query_id = s.query_id)"""


_BRUTE = f"""qs AS MATERIALIZED (SELECT event_id AS query_id, {_LIST(Q)} FROM vec WHERE event_id % {QUERY_EVERY} = 0),
exact AS MATERIALIZED (SELECT * FROM (SELECT query_id, vec_id, is_fraud, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.query_id, v.vec_id, v.is_fraud, {_distance('q', 'v', 'q', 'q')} AS distance FROM qs q, vec v) x) y WHERE rank <= {S.K})"""
_SAMPLED = f"event_id % {QUERY_EVERY} = 0"


def query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _double(x, name: str):
    return F.round(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), 6).alias(name)


# --- parsing and features -------------------------------------------------------------------------------------------------------


@query("parse_transactions", f"WITH {_TX} SELECT event_id, id, round(CAST(amount AS DOUBLE), 6) AS amount, installments, epoch_us(requested_at) AS requested_us, round(CAST(customer_avg AS DOUBLE), 6) AS customer_avg, tx_count_24h, CAST(len(known_merchants) AS INTEGER) AS n_known, merchant_id, mcc, is_online, card_present, round(CAST(km_home AS DOUBLE), 6) AS km_home, has_last, round(CAST(last_km AS DOUBLE), 6) AS last_km FROM tx")
def parse_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = ingest.parse_requests(fixtures.requests(spark, sf_dir))
    return tx.select("event_id", "id", _double("amount", "amount"), "installments", F.unix_micros("requested_at").alias("requested_us"), _double("customer_avg", "customer_avg"), "tx_count_24h", F.size("known_merchants").alias("n_known"), "merchant_id", "mcc", "is_online", "card_present", _double("km_home", "km_home"), "has_last", _double("last_km", "last_km"))


@query("time_features", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", feat.hour_of(at).alias("hour_of_day"), feat.weekday_of(at).alias("day_of_week"))


@query("djb2_hash", f"WITH {_TX}, h AS (SELECT DISTINCT merchant_id FROM tx) SELECT merchant_id, CAST(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(merchant_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 33 + c) % 4294967296) AS BIGINT) AS hash FROM h")
def djb2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark, sf_dir).select("merchant_id").distinct().select("merchant_id", ingest.string_hash(F.col("merchant_id")).alias("hash"))


@query("tx_id_number", "SELECT event_id, event_id AS number FROM events")
def tx_id_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark, sf_dir).select("event_id", ingest.transaction_number(F.col("id")).alias("number"))


@query("last_tx_presence", f"WITH {_TX} SELECT has_last, count(*) AS n FROM tx GROUP BY 1")
def last_tx_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_requests(fixtures.requests(spark, sf_dir)).groupBy("has_last").agg(F.count(F.lit(1)).alias("n"))


_ALL_V = _LIST(f"round(CAST(v{d} AS DOUBLE), 6) AS v{d}" for d in D)


@query("feature_vector", f"WITH {_FEAT} SELECT event_id, {_ALL_V} FROM feat")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("event_id", *[_double(f"v{d}", f"v{d}") for d in D])


@query("feature_clamp", f"SELECT event_id, round(CAST({_clamp(_share('value', 100.0))} AS DOUBLE), 6) AS clamped FROM events")
def feature_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _double(feat.clamp(feat.share(F.col("value"), 100.0)), "clamped"))


@query("feature_ratio", f"WITH {_FEAT} SELECT event_id, round(CAST(v2 AS DOUBLE), 6) AS ratio FROM feat")
def feature_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark, sf_dir).select("event_id", _double(feat.ratio(F.col("amount"), F.col("customer_avg")), "ratio"))


@query("unknown_merchant", f"WITH {_TX} SELECT event_id, {_UNKNOWN} AS unknown FROM tx")
def unknown_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark, sf_dir).select("event_id", feat.unknown_merchant(F.col("known_merchants"), F.col("merchant_id")).alias("unknown"))


@query("unknown_merchant_anti", f"WITH {_TX} SELECT event_id, merchant_id FROM tx WHERE {_UNKNOWN}")
def unknown_merchant_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = written(fixtures.transactions(spark, sf_dir).select("event_id", "merchant_id", "known_merchants"))
    known = tx.select("event_id", F.explode(F.slice("known_merchants", 1, S.KNOWN_MERCHANTS)).alias("merchant_id"))
    return tx.select("event_id", "merchant_id").join(known, ["event_id", "merchant_id"], "left_anti")


@query("last_tx_features", f"WITH {_FEAT} SELECT event_id, round(CAST(v5 AS DOUBLE), 6) AS minutes, round(CAST(v6 AS DOUBLE), 6) AS km FROM feat")
def last_tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("event_id", _double("v5", "minutes"), _double("v6", "km"))


@query("mcc_dim", " UNION ALL ".join(f"SELECT {m} AS mcc, {b} AS risk_byte, round(CAST({_f(b)} / {_f(255)} AS DOUBLE), 6) AS risk" for m, b in S.MCC_BYTES.items()))
def mcc_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.mcc_table(spark).select(F.col("mcc_code").alias("mcc"), "risk_byte", _double(feat.f32(F.col("risk_byte").cast("float") / feat.f32(255)), "risk"))


@query("mcc_risk_lookup", f"WITH {_FEAT} SELECT mcc, round(CAST(v12 AS DOUBLE), 6) AS risk, count(*) AS n FROM feat GROUP BY 1, 2")
def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.with_mcc_risk(fixtures.transactions(spark, sf_dir)).groupBy("mcc", _double("mcc_risk", "risk")).agg(F.count(F.lit(1)).alias("n"))


@query("quantize_vector", f"WITH {_VEC} SELECT event_id, {_LIST(Q)} FROM vec")
def quantize_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.vectors(spark, sf_dir).select(F.col("vec_id").alias("event_id"), *Q)


@query("scan_reference", f"WITH {_VEC} SELECT is_fraud, count(*) AS n, CAST(sum(q0) AS BIGINT) AS sum_q0, CAST(sum(q13) AS BIGINT) AS sum_q13 FROM vec GROUP BY 1")
def scan_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled vectors, written as a JSON array of records and read back."""
    v = fixtures.features(spark, sf_dir).select(F.array(*[f"v{d}" for d in D]).alias("vector"), F.when(F.col("is_fraud"), "fraud").otherwise("legit").alias("label"))
    path = fresh_path(spark)
    v.write.option("compression", "gzip").json(path)
    rows = spark.read.schema("vector ARRAY<FLOAT>, label STRING").json(path)
    back = rows.select(*[ingest.quantised(F.get("vector", F.lit(d))).alias(f"q{d}") for d in D], (F.col("label") == "fraud").alias("is_fraud"))
    return back.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q0").cast("bigint")).alias("sum_q0"), F.sum(F.col("q13").cast("bigint")).alias("sum_q13"))


# --- rules ----------------------------------------------------------------------------------------------------------------------


@query("rule_classify", f"WITH {_RULED} SELECT event_id, rule_id, verdict FROM ruled")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rule(fixtures.features(spark, sf_dir)).select("event_id", "rule_id", "verdict")


@query("rule_histogram", f"WITH {_RULED} SELECT rule_id, verdict, count(*) AS n FROM ruled GROUP BY 1, 2")
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rule(fixtures.features(spark, sf_dir)).groupBy("rule_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("borderline_filter", f"WITH {_RULED} SELECT event_id FROM ruled WHERE verdict = 'Borderline'")
def borderline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rule(fixtures.features(spark, sf_dir)).filter("verdict = 'Borderline'").select("event_id")


def _rule_filter(rule: str, conditions: list) -> None:
    @query(f"rule_{rule}_filter", f"WITH {_FEAT} SELECT event_id FROM feat WHERE {_holds(conditions)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.features(spark, sf_dir).filter(holds(conditions)).select("event_id")


for _rule, _verdict, _conditions in S.RULES:
    _rule_filter(_rule, _conditions)

# --- index ----------------------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return kmeans.build(written(fixtures.vectors(spark, sf_dir)), keep=True)


@query("kmeans_init", f"WITH {_VEC}, {_INIT} SELECT cell_id, {_LIST(C)} FROM k0")
def kmeans_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.first_centroids(written(fixtures.vectors(spark, sf_dir)))


@query("kmeans_assign", f"WITH {_VEC}, {_INIT}, {_assign(0)} SELECT vec_id, cell_id FROM a0")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(fixtures.vectors(spark, sf_dir))
    return kmeans.assign(v, kmeans.centroid_array(kmeans.first_centroids(v))).select("vec_id", "cell_id")


@query("kmeans_iter1", f"WITH {_KM1} SELECT cell_id, {_LIST(C)} FROM k1")
def kmeans_iter1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.build(written(fixtures.vectors(spark, sf_dir)), iterations=1)[1]


@query("kmeans_3iter", f"WITH {_KM3} SELECT cell_id, {_LIST(C)} FROM k3")
def kmeans_3iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.build(written(fixtures.vectors(spark, sf_dir)))[1]


@query("inverted_lists", f"WITH {_INDEX} SELECT vec_id, cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY vec_id) - 1 AS pos FROM idx")
def inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v, _ = _index(spark, sf_dir)
    return v.select("vec_id", "cell_id", (F.row_number().over(Window.partitionBy("cell_id").orderBy("vec_id")) - 1).cast("bigint").alias("pos"))


def _sizes(v: DataFrame, c: DataFrame) -> DataFrame:
    return c.select("cell_id").join(v.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")), "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


_SIZES = "sizes AS (SELECT k3.cell_id, coalesce(s.n, 0) AS n FROM k3 LEFT JOIN (SELECT cell_id, count(*) AS n FROM idx GROUP BY 1) s ON k3.cell_id = s.cell_id)"


@query("cell_stats", f"WITH {_INDEX}, {_SIZES} SELECT min(n) AS least, max(n) AS most, CAST(sum(n) // count(*) AS BIGINT) AS mean, count(*) FILTER (WHERE n = 0) AS empty FROM sizes")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _sizes(*_index(spark, sf_dir)).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.call_function("div", F.sum(n), F.count(F.lit(1))).alias("mean"), F.count_if(n == 0).alias("empty"))


@query("cell_offsets", f"WITH {_INDEX}, {_SIZES} SELECT cell_id, n, CAST(coalesce(sum(n) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM sizes")
def cell_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    # a row for each cell, a fixed number: one task is enough
    before = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    return _sizes(*_index(spark, sf_dir)).select("cell_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first"))


@query("cell_fraud_counts", f"WITH {_INDEX} SELECT k3.cell_id, CAST(least(coalesce(s.f, 0), {S.K}) AS INTEGER) AS frauds, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM k3 LEFT JOIN (SELECT cell_id, sum(CAST(is_fraud AS INTEGER)) AS f, count(*) AS n FROM idx GROUP BY 1) s ON k3.cell_id = s.cell_id")
def cell_fraud_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.cell_fraud_counts(*_index(spark, sf_dir))


@query("index_roundtrip", f"WITH {_INDEX} SELECT cell_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(q0) AS BIGINT) AS sum_q0 FROM idx GROUP BY 1")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    ingest.write_index(*_index(spark, sf_dir), path)
    v, _ = ingest.read_index(spark, path)
    return v.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"), F.sum(F.col("q0").cast("bigint")).alias("sum_q0"))


# --- search ---------------------------------------------------------------------------------------------------------------------


def _queries(v: DataFrame) -> DataFrame:
    return v.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), *Q)


@query("l2_distance", f"WITH {_VEC}, {_INIT} SELECT v.vec_id, CAST({_distance('v', 'k')} AS BIGINT) AS distance FROM vec v, k0 k WHERE k.cell_id = 0")
def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(fixtures.vectors(spark, sf_dir))
    first = kmeans.centroid_array(kmeans.first_centroids(v, S.CELLS))[0][1]
    return v.select("vec_id", *Q, *[F.lit(x).cast("bigint").alias(c) for c, x in zip(C, first, strict=True)]).select("vec_id", squared_distance().alias("distance"))


@query("knn_brute_force", f"WITH {_VEC}, {_BRUTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS BIGINT) AS distance, is_fraud FROM exact")
def knn_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(fixtures.vectors(spark, sf_dir))
    return knn.exact_knn(_queries(v), v)


@query("knn_vote", f"WITH {_VEC}, {_BRUTE} SELECT query_id, CAST(sum(CAST(is_fraud AS INTEGER)) AS INTEGER) AS fraud_count FROM exact GROUP BY 1")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(fixtures.vectors(spark, sf_dir))
    return knn.votes(_queries(v), knn.exact_knn(_queries(v), v))


@query("knn_topk_single", f"WITH {_VEC}, q AS (SELECT * FROM vec WHERE vec_id = 1) SELECT v.vec_id, CAST({_distance('q', 'v', 'q', 'q')} AS BIGINT) AS distance FROM q, vec v ORDER BY 2, 1 LIMIT {S.K}")
def knn_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(fixtures.vectors(spark, sf_dir))
    own = v.filter("vec_id = 1").select(*Q).first()
    near = v.select("vec_id", *Q, *[F.lit(int(own[q])).cast("bigint").alias(c) for q, c in zip(Q, C, strict=True)]) if own else v.limit(0).select("vec_id", *Q, *[F.col(q).alias(c) for q, c in zip(Q, C, strict=True)])
    return near.select("vec_id", squared_distance().alias("distance")).orderBy("distance", "vec_id").limit(S.K)


@query("ivf_probe_cells", f"WITH {_INDEX}, {_search(_SAMPLED, 8)} SELECT query_id, CAST(cell_rank AS INTEGER) AS cell_rank, cell_id, CAST(distance AS BIGINT) AS distance FROM probe")
def ivf_probe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = _index(spark, sf_dir)
    return knn.probe_cells(_queries(v), c, 8).drop(*Q)


def _ivf(nprobe: int) -> None:
    @query(f"ivf_search_nprobe{nprobe}", f"WITH {_INDEX}, {_search(_SAMPLED, nprobe)} SELECT query_id, fraud_count FROM vote")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, c = _index(spark, sf_dir)
        return knn.votes(_queries(v), knn.ivf_neighbours(_queries(v), v, c, nprobe=nprobe))


_ivf(1)
_ivf(8)


@query("ivf_recall", f"WITH {_INDEX}, {_search(_SAMPLED, 8)}, {_BRUTE.replace('qs AS', 'qs2 AS').replace('FROM qs q', 'FROM qs2 q')} SELECT count(*) AS found, (SELECT count(*) FROM exact) AS wanted FROM near JOIN exact ON near.query_id = exact.query_id AND near.vec_id = exact.vec_id WHERE near.rank <= {S.K}")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = _index(spark, sf_dir)
    exact = written(knn.exact_knn(_queries(v), v).select("query_id", "vec_id"))
    near = knn.ivf_neighbours(_queries(v), v, c, nprobe=8).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))


# --- decisions ------------------------------------------------------------------------------------------------------------------

_SCORED = f"{_INDEX}, {_search(chr(39) + 'Borderline' + chr(39) + ' = verdict', 1)}, scored AS (SELECT vec.event_id, rule_id, CAST(CASE verdict WHEN 'Legit' THEN 0 WHEN 'Fraud' THEN 5 ELSE fraud_count END AS INTEGER) AS fraud_count FROM vec LEFT JOIN vote ON vec.event_id = vote.query_id)"
_DECIDED = _SCORED + ", decided AS (SELECT *, fraud_count < 3 AS approved, round(fraud_count / 5, 1) AS fraud_score FROM scored)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = _index(spark, sf_dir)
    return scoring.score(fixtures.transactions(spark, sf_dir), v, c)


@query("score_transactions", f"WITH {_DECIDED} SELECT event_id, rule_id, fraud_count, approved, fraud_score FROM decided")
def score_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query("response_projection", "SELECT CAST(n AS INTEGER) AS fraud_count, n < 3 AS approved, round(n / 5, 1) AS fraud_score FROM (SELECT unnest(range(6)) AS n)")
def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("int")
    approved, score = scoring.decision(n)
    return spark.range(6).select(n.alias("fraud_count"), approved.alias("approved"), score.alias("fraud_score"))


@query("response_json", f"WITH {_DECIDED} SELECT event_id, '{{\"approved\":' || CASE WHEN approved THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CASE fraud_count WHEN 0 THEN '0.0' WHEN 1 THEN '0.2' WHEN 2 THEN '0.4' WHEN 3 THEN '0.6' WHEN 4 THEN '0.8' ELSE '1.0' END || '}}' AS body FROM decided")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", scoring.response_json(F.col("fraud_count")).alias("body"))


@query("stream_score", f"WITH {_DECIDED} SELECT event_id, rule_id, fraud_count, approved, fraud_score FROM decided")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = _index(spark, sf_dir)
    base = fresh_path(spark)
    fixtures.requests(spark, sf_dir).write.parquet(f"{base}/requests")
    score_stream(spark, f"{base}/requests", f"{base}/scores", f"{base}/state", v, c)
    return spark.read.parquet(f"{base}/scores").drop("batch")


# --- evaluation -----------------------------------------------------------------------------------------------------------------

_STATUS, _MS = "CASE WHEN event_id % 97 = 0 THEN 500 ELSE 200 END", "CAST(event_id * 37 % 1000 AS DOUBLE) / 50 + 0.5"
_EVAL = f"{_DECIDED}, ev2 AS (SELECT approved, NOT (event_id % 10 = 3) = approved AS expected_approved, {_STATUS} AS status, {_MS} AS ms FROM decided), cf AS (SELECT count(*) FILTER (WHERE status = 200 AND NOT expected_approved AND NOT approved) AS tp, count(*) FILTER (WHERE status = 200 AND expected_approved AND approved) AS tn, count(*) FILTER (WHERE status = 200 AND expected_approved AND NOT approved) AS fp, count(*) FILTER (WHERE status = 200 AND NOT expected_approved AND approved) AS fn, count(*) FILTER (WHERE status <> 200) AS err, quantile_cont(ms, 0.99) AS p99 FROM ev2), er AS (SELECT *, tp + tn + fp + fn + err AS n, fp + 3 * fn + 5 * err AS weighted, CAST(fp + fn + err AS DOUBLE) / (tp + tn + fp + fn + err) AS failure_rate, CAST(fp + 3 * fn + 5 * err AS DOUBLE) / (tp + tn + fp + fn + err) AS error_rate FROM cf)"
_P99S = "CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000 * log10(1000.0 / greatest(p99, 1.0)) END"
_DETS = "CASE WHEN failure_rate > 0.15 THEN -3000.0 ELSE 1000 * log10(1.0 / greatest(error_rate, 0.001)) - 300 * log10(weighted + 1.0) END"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with made-up outcomes: one in ten unexpected, one in 97 failed, latencies by id."""
    return _scored(spark, sf_dir).selectExpr("approved", "NOT (event_id % 10 = 3) = approved AS expected_approved", f"{_STATUS} AS status", f"{_MS} AS ms")


@query("eval_confusion", f"WITH {_EVAL} SELECT tp, tn, fp, fn, err FROM cf")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_evaluated(spark, sf_dir)).drop("p99")


@query("eval_p99", f"SELECT round(quantile_cont({_MS}, 0.99), 6) AS p99 FROM events")
def eval_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{_MS} AS ms").agg(F.round(F.percentile("ms", 0.99), 6).alias("p99"))


@query("eval_label_stats", f"WITH {_TX} SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud_count, round(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate, count(*) FILTER (WHERE NOT is_fraud) AS legit_count FROM tx")
def eval_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("is_fraud")
    return fixtures.transactions(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(f).alias("fraud_count"), F.round(F.avg(f.cast("int")), 6).alias("fraud_rate"), F.count_if(~f).alias("legit_count"))


def _evaluation_files(spark: SparkSession, sf_dir: str) -> str:
    """The transactions as evaluation objects of a thousand entries and their figures, a line each."""
    known = fixtures.transactions(spark, sf_dir).select("event_id", (~F.col("is_fraud")).alias("good"))
    each = fixtures.requests(spark, sf_dir).join(known, "event_id")
    entry = F.concat(F.lit('{"request":'), "json", F.lit(',"expected_approved":'), F.col("good").cast("string"), F.lit("}"))
    total, good = F.count(F.lit(1)), F.count_if(F.col("good"))
    stats = F.to_json(F.struct(total.alias("total"), (total - good).alias("fraud_count"), good.alias("legit_count"), (100 * (total - good) / total).alias("fraud_rate"), (100 * good / total).alias("legit_rate")))
    files = each.groupBy(F.floor(F.col("event_id") / 1000)).agg(F.array_join(F.collect_list(entry), ",").alias("entries"), stats.alias("stats"))
    path = fresh_path(spark)
    files.select(F.concat(F.lit('{"entries":['), "entries", F.lit('],"stats":'), "stats", F.lit("}"))).write.text(path)
    return path


@query("eval_entries", f"WITH {_TX} SELECT event_id AS number, installments, mcc, NOT is_fraud AS expected_approved FROM tx")
def eval_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation files, written and read back."""
    entries, _ = ingest.read_evaluation(spark, _evaluation_files(spark, sf_dir), lines=True)
    return ingest.parse_requests(entries).select(ingest.transaction_number(F.col("id")).alias("number"), "installments", "mcc", "expected_approved")


@query("eval_input_stats", f"WITH {_TX} SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud_count, count(*) FILTER (WHERE NOT is_fraud) AS legit_count, round(100 * avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate, round(100 * avg(CAST(NOT is_fraud AS INTEGER)), 6) AS legit_rate FROM tx GROUP BY event_id // 1000")
def eval_input_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = ingest.read_evaluation(spark, _evaluation_files(spark, sf_dir), lines=True)
    return stats.select("total", "fraud_count", "legit_count", F.round("fraud_rate", 6).alias("fraud_rate"), F.round("legit_rate", 6).alias("legit_rate"))


@query("eval_errors", f"WITH {_EVAL} SELECT n, weighted, round(failure_rate, 6) AS failure_rate, round(error_rate, 6) AS error_rate FROM er")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(evaluate.confusion(_evaluated(spark, sf_dir))).select("n", "weighted", F.round("failure_rate", 6).alias("failure_rate"), F.round("error_rate", 6).alias("error_rate"))


@query("eval_p99_score", f"WITH {_EVAL} SELECT round({_P99S}, 6) AS p99_score FROM er")
def eval_p99_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_evaluated(spark, sf_dir)).select(F.round(evaluate.p99_score(F.col("p99")), 6).alias("p99_score"))


@query("eval_det_score", f"WITH {_EVAL} SELECT round({_DETS}, 6) AS detection_score FROM er")
def eval_det_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.errors(evaluate.confusion(_evaluated(spark, sf_dir)))
    return df.select(F.round(evaluate.detection_score(F.col("failure_rate"), F.col("error_rate"), F.col("weighted")), 6).alias("detection_score"))


@query("eval_score", f"WITH {_EVAL} SELECT tp, tn, fp, fn, err, round(failure_rate, 6) AS failure_rate, round(p99, 6) AS p99, CASE WHEN p99 <= 2000 THEN round({_P99S}, 6) END AS p99_score, CASE WHEN failure_rate <= 0.15 THEN round({_DETS}, 6) END AS detection_score, round(({_P99S}) + ({_DETS}), 6) AS final_score FROM er")
def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.final_score(_evaluated(spark, sf_dir))


@query("eval_check_pct", "SELECT event_type, CAST(floor(100 * count(*) FILTER (WHERE value > 50) / count(*)) AS BIGINT) AS percent FROM events GROUP BY 1")
def eval_check_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("p"), F.count_if(~(F.col("value") > 50)).alias("f"))
    return sums.select("event_type", evaluate.check_percent(F.col("p"), F.col("f")).alias("percent"))


@query("metric_summary", "SELECT event_type AS name, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(CAST(value > 50 AS INTEGER)), 6) AS rate FROM events GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.avg((v > 50).cast("int")), 6).alias("rate"))


@query("eval_report", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy("name")


_TRIM = r"regexp_replace(regexp_replace({0}, '(\.\d*?)0+$', '\1'), '\.$', '')"


def _cut(x: str, digits: int) -> str:
    return _TRIM.format(f"printf('%.{digits}f', trunc({x} * {10**digits}) / {10**digits})")


def _bytes_sql(n: str) -> str:
    e = f"CAST(floor(ln(CAST({n} AS DOUBLE)) / ln(1000.0)) AS INTEGER)"
    v = f"(floor({n} / pow(1000.0, {e}) * 10 + 0.5) / 10)"
    return f"CASE WHEN {n} < 10 THEN {_TRIM.format(f"printf('%.6f', CAST({n} AS DOUBLE))")} || ' B' ELSE CASE WHEN {v} < 10 THEN printf('%.1f', {v}) ELSE CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) END || ' ' || ['B', 'kB', 'MB', 'GB', 'TB', 'PB', 'EB', 'ZB', 'YB'][{e} + 1] END"


def _time_sql(t: str) -> str:
    whole, sec = f"CAST(trunc({t} / 60000) AS BIGINT)", f"(({t} % 60000) / 1000)"
    tail = f"CASE WHEN {t} > 60000 THEN {_cut(sec, 0)} ELSE {_cut(sec, 2)} END || 's'"
    return f"""CASE WHEN {t} = 0 THEN '0s' WHEN {t} < 0.001 THEN CAST(CAST(trunc({t} * 1000000) AS BIGINT) AS VARCHAR) || 'ns' WHEN {t} < 1 THEN {_cut(f"({t} * 1000)", 2)} || 'µs' WHEN {t} < 1000 THEN {_cut(t, 2)} || 'ms'
      ELSE CASE WHEN {whole} >= 60 THEN CAST({whole} // 60 AS VARCHAR) || 'h' ELSE '' END || CASE WHEN {whole} >= 1 THEN CAST({whole} % 60 AS VARCHAR) || 'm' ELSE '' END || {tail} END"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("humanize_bytes", f"SELECT event_id, {_bytes_sql('n')} AS shown FROM (SELECT event_id, CAST(event_id AS DOUBLE) * event_id * event_id * event_id * 7 AS n FROM events) x")
def humanize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", evaluate.humanize_bytes(e.cast("double") * e * e * e * 7).alias("shown"))


@query("humanize_duration", f"SELECT event_id, {_time_sql('ms')} AS shown FROM (SELECT event_id, CAST(event_id * event_id AS DOUBLE) / 512 AS ms FROM events) x")
def humanize_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", evaluate.humanize_duration((F.col("event_id") * F.col("event_id")).cast("double") / 512).alias("shown"))


_KIND = "CASE WHEN event_id % 4 = 0 THEN 'rate' ELSE 'gauge' END"
_CONTAINS = "CASE event_id % 4 WHEN 1 THEN 'data' WHEN 2 THEN 'time' ELSE 'default' END"


@query("humanize_value", f"""SELECT event_id, CASE WHEN kind = 'rate' THEN printf('%.2f', trunc(x * 100 * 100) / 100) || '%' WHEN contains = 'data' THEN {_bytes_sql('x')} WHEN contains = 'time' THEN {_time_sql('x')} ELSE {_TRIM.format("printf('%.6f', x)")} END AS shown,
  CASE WHEN x >= 0 THEN printf('%.2f', round(x * 0.001, 2)) || 's' END AS seconds FROM (SELECT event_id, {_KIND} AS kind, {_CONTAINS} AS contains, CAST(event_id % 1000 AS DOUBLE) / 8 AS x FROM events) y""")
def humanize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).selectExpr("event_id", f"{_KIND} AS kind", f"{_CONTAINS} AS contains", "cast(event_id % 1000 as double) / 8 AS x")
    x = F.col("x")
    return df.select("event_id", evaluate.humanize_value(x, F.col("kind"), F.col("contains")).alias("shown"), evaluate.humanize_duration(x, "s").alias("seconds"))


_METRIC = "CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || '{user:' || CAST(event_id % 7 AS VARCHAR) || '}' END"


@query("metric_names", f"SELECT event_id, CASE WHEN contains(name, '{{') THEN '{{ ' || regexp_extract(name, '\\{{(.*).$', 1) || ' }}' ELSE name END AS shown, CASE WHEN contains(name, '{{') THEN '  ' ELSE '' END AS indent FROM (SELECT event_id, {_METRIC} AS name FROM events) x")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).selectExpr("event_id", f"{_METRIC.replace('VARCHAR', 'STRING')} AS name")
    return df.select("event_id", evaluate.display_name(F.col("name")).alias("shown"), evaluate.indent(F.col("name")).alias("indent"))


_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;')"
_THRESHOLD = "concat('p(99)<', event_id % 50, ' & \"x\" > ''', event_type, '''')"


@query("junit_cases", f"SELECT event_id, '<testcase name=\"' || {_HTML.format('event_type')} || ' - ' || {_HTML.format('t')} || '\"' || CASE WHEN event_id % 3 = 0 THEN '><failure message=\"failed\" /></testcase>' ELSE ' />' END AS line FROM (SELECT event_id, event_type, {_THRESHOLD} AS t FROM events) x")
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("p(99)<"), (F.col("event_id") % 50).cast("string"), F.lit(" & \"x\" > '"), F.col("event_type"), F.lit("'"))
    return _events(spark, sf_dir).select("event_id", evaluate.junit_case(F.col("event_type"), t, F.col("event_id") % 3 != 0).alias("line"))
