"""Fixed values of the engine: the request schema, normalisation constants and the merchant-category risks."""

from __future__ import annotations

DIMS = 14
K, NPROBE, CELLS, ITERATIONS = 5, 1, 1024, 3
KNOWN_MERCHANTS = 32

REQUEST_DDL = (
    "id STRING, transaction STRUCT<amount:FLOAT,installments:INT,requested_at:TIMESTAMP>, "
    "customer STRUCT<avg_amount:FLOAT,tx_count_24h:INT,known_merchants:ARRAY<STRING>>, "
    "merchant STRUCT<id:STRING,mcc:STRING,avg_amount:FLOAT>, "
    "terminal STRUCT<is_online:BOOLEAN,card_present:BOOLEAN,km_from_home:FLOAT>, "
    "last_transaction STRUCT<timestamp:TIMESTAMP,km_from_current:FLOAT>"
)

# Normalisation constants.
MAX_AMOUNT, MAX_INSTALLMENTS, AVG_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0
SCALE = 10000.0

# Risk of a merchant category, in 255ths; categories that are not listed have MCC_DEFAULT.
MCC_BYTES = {5411: 38, 5812: 76, 5912: 51, 5944: 114, 7801: 204, 7802: 191, 7995: 216, 4511: 89, 5311: 63, 5999: 127}
MCC_DEFAULT, MCC_LIMIT, MCC_BEYOND = 128, 10000, 0.5

# The threshold rules in order, as (rule, verdict, [(feature, comparison, threshold)]); the first that holds decides.
RULES = [
    ("L1", "Legit", [(0, "<", 0.03), (7, "<", 0.05), (11, "<", 0.5), (12, "<", 0.2)]),
    ("L2", "Legit", [(2, "<", 0.1), (8, "<", 0.2), (7, "<", 0.15), (10, ">", 0.5)]),
    ("L3", "Legit", [(11, "<", 0.5), (0, "<", 0.15), (7, "<", 0.2), (9, "<", 0.5)]),
    ("L4", "Legit", [(12, "<", 0.15), (11, "<", 0.5), (0, "<", 0.25)]),
    ("F1r", "Fraud", [(0, ">", 0.8), (7, ">", 0.7), (11, ">", 0.5), (12, ">", 0.6)]),
    ("F2r", "Fraud", [(2, ">", 0.9), (8, ">", 0.8), (11, ">", 0.5)]),
    ("F3r", "Fraud", [(9, ">", 0.5), (11, ">", 0.5), (12, ">", 0.6), (0, ">", 0.5)]),
    ("F4r", "Fraud", [(10, "<", 0.5), (7, ">", 0.5), (11, ">", 0.5), (0, ">", 0.4)]),
    ("F5r", "Fraud", [(8, ">", 0.8), (7, ">", 0.5), (11, ">", 0.5)]),
]
