"""Requests as JSON text to flat typed transactions, labelled vectors from JSON files, and the index as Parquet."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions.schema import DIMS, KNOWN_MERCHANTS, MCC_BYTES, REQUEST_DDL, SCALE

VECTORS_DDL = "vec_id BIGINT, " + ", ".join(f"q{d} SMALLINT" for d in range(DIMS)) + ", is_fraud BOOLEAN, cell_id INT"


def parse_requests(requests: DataFrame, json_col: str = "json", profile: str = "full") -> DataFrame:
    """The columns of requests but json_col, the fields of the request as flat columns, and corrupt (the text, where it is no JSON object). Fields that are absent, null or of another type are zero, false or empty; unknown keys are ignored.

    profile "as_coded" keeps what a parser reads that stops at a quoted category code: nothing after it."""
    ddl = f"{REQUEST_DDL}, _corrupt_record STRING"
    df = requests.withColumn("r", F.from_json(json_col, ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    zero = F.lit(0.0).cast("float")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    fields = {
        "id": F.col("r.id"),
        "amount": F.coalesce("r.transaction.amount", zero),
        "installments": F.coalesce("r.transaction.installments", F.lit(0)),
        "requested_at": F.col("r.transaction.requested_at"),
        "customer_avg": F.coalesce("r.customer.avg_amount", zero),
        "tx_count_24h": F.coalesce("r.customer.tx_count_24h", F.lit(0)),
        "known_merchants": F.slice(F.coalesce("r.customer.known_merchants", F.array().cast("array<string>")), 1, KNOWN_MERCHANTS),
        "merchant_id": F.col("r.merchant.id"),
        "mcc": F.col("r.merchant.mcc"),
        "merchant_avg": F.coalesce("r.merchant.avg_amount", zero),
        "is_online": flag("r.terminal.is_online"),
        "card_present": flag("r.terminal.card_present"),
        "km_home": F.coalesce("r.terminal.km_from_home", zero),
        "has_last": F.col("r.last_transaction").isNotNull(),
        "last_ts": F.col("r.last_transaction.timestamp"),
        "last_km": F.when(F.col("r.last_transaction").isNotNull(), F.coalesce("r.last_transaction.km_from_current", zero)),
        "corrupt": F.col("r._corrupt_record"),
    }
    if profile == "as_coded":
        none = {"mcc": "0", "merchant_avg": zero, "is_online": False, "card_present": False, "km_home": zero, "has_last": False, "last_ts": None, "last_km": None}
        types = {"last_ts": "timestamp", "last_km": "float"}
        fields |= {k: (v if isinstance(v, Column) else F.lit(v)).cast(types[k]) if k in types else v if isinstance(v, Column) else F.lit(v) for k, v in none.items()}
    return df.select(*[c for c in requests.columns if c != json_col], *[v.alias(k) for k, v in fields.items()])


def transaction_number(tx_id: Column) -> Column:
    """The digits that follow an id's first dash at once, or 0. Numbers of 64 bits or more wrap around, as bigint; beyond 38 digits they are 0."""
    digits = F.regexp_extract(tx_id, r"^[^-]*-(\d{1,38})(?!\d)", 1)
    wide = F.when(digits != "", digits).try_cast("decimal(38,0)") % F.lit(Decimal(2**64))
    signed = F.when(wide >= F.lit(Decimal(2**63)), wide - F.lit(Decimal(2**64))).otherwise(wide)
    return F.coalesce(signed.cast("bigint"), F.lit(0).cast("bigint"))


def string_hash(text: Column) -> Column:
    """The 32-bit multiply-by-33 hash of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295).cast("bigint")))


def read_labelled_vectors(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A JSON array of {"vector": [...], "label": "..."}, gzip or not, as v0..v13 quantised to q0..q13 and is_fraud. A gzip file is read by one task, so its rows are dealt out at once."""
    rows = spark.read.schema("vector ARRAY<FLOAT>, label STRING").option("multiLine", True).json(path)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.select(*[quantised(F.coalesce(F.get("vector", F.lit(d)), F.lit(0.0).cast("float"))).alias(f"q{d}") for d in range(DIMS)], F.coalesce(F.col("label") == "fraud", F.lit(False)).alias("is_fraud"))


def quantised(v: Column) -> Column:
    """v times SCALE, cut to a whole number of 16 bits; NaN is 0."""
    zero, least, most = (F.lit(float(x)).cast("float") for x in (0, -32768, 32767))
    x = F.coalesce(F.nanvl(v * F.lit(SCALE).cast("float"), zero), zero)
    return F.least(F.greatest(x, least), most).cast("smallint")


def mcc_table(spark: SparkSession) -> DataFrame:
    """The merchant-category risks: mcc, risk_byte (a fixed ten rows)."""
    return spark.createDataFrame(sorted(MCC_BYTES.items()), "mcc_code INT, risk_byte INT")


def write_index(vectors: DataFrame, centroids: DataFrame, path: str) -> None:
    """The vectors, laid out by cell so that a cell's rows lie together, and the centroids."""
    vectors.repartition("cell_id").sortWithinPartitions("cell_id", "vec_id").write.mode("overwrite").parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vectors and the centroids of write_index(); another layout is refused."""
    vectors, centroids = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")
    wanted = {f"q{d}" for d in range(DIMS)} | {"vec_id", "is_fraud", "cell_id"}
    if not wanted <= set(vectors.columns) or not {f"c{d}" for d in range(DIMS)} <= set(centroids.columns):
        raise ValueError(f"{path} holds no index of {DIMS} dimensions")
    return vectors, centroids


#: An evaluation file: entries with a request and the expected decision, and figures of the whole set.
EVALUATION_DDL = f"entries array<struct<request:struct<{REQUEST_DDL}>,expected_approved:boolean>>, stats struct<total:bigint,fraud_count:bigint,fraud_rate:double,legit_count:bigint,legit_rate:double,edge_case_rate:double>"


def read_evaluation(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of evaluation files {"entries": [...], "stats": {...}}, one object a file or, with lines, a line: a row for each entry (position, json as parse_requests() takes it, expected_approved), and the stats of each object. Absent fields are null."""
    files = spark.read.schema(EVALUATION_DDL).json(path, multiLine=not lines)
    entries = files.select(F.posexplode("entries").alias("position", "e")).select("position", F.to_json("e.request").alias("json"), "e.expected_approved")
    return entries, files.select("stats.*")
