"""URL filters: administrative rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over the characters of host and path, one of accepted and one of rejected
URLs, score every URL by the difference of their log-likelihoods a character. A URL counts as rejected in training if
its host holds a seed word, else as accepted; n-grams of all rows are counted, apart from a held-out tenth by hash. On
the held-out accepted URLs the threshold is calibrated: at most MAX_FALSE_REJECTS of them may fall below it.

Contexts are up to ORDER - 1 characters long and probabilities are interpolated over their lengths (Witten-Bell), so an
unseen context falls back to a shorter one. Characters are mapped to an alphabet of 40 signs: a model has at most
40 ** ORDER entries whatever the input, which bounds both what is collected (two counts an n-gram) and what is broadcast
(one table of differences, 10 MB). Counts are summed in each task before the exchange, so hot hosts cost nothing.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule, and its score is 0 (allowed when
the threshold is not positive); if either model has seen nothing, all scores are 0 and the threshold is 0. Repeated rows
count each time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vecscore.llm.common import UPPER

ORDER = 4
#: 36 letters and digits, the separators, and one sign for all else; 0 is the sign for what comes before the text.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./"
SIZE = len(ALPHABET) + 2
#: Words in a host that make a URL an example of what to reject.
SEEDS = ["casino", "cheap", "pills", "porn", "spam", "viagra", "xxx"]
MAX_FALSE_REJECTS = 0.005
#: Fixed values of the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_MAP = np.full(256, SIZE - 1, np.int64)
for _k, _c in enumerate(ALPHABET):
    _MAP[ord(_c)] = _k + 1


def parts(url: Column) -> tuple[Column, Column]:
    at = F.call_function("locate", F.lit("://"), url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _signs(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as signs, each after ORDER - 1 zeros, and the number of the text that each sign is of (-1: a zero before it)."""
    pad = b"\x00" * (ORDER - 1)
    raw = [t.encode() for t in texts]
    data = _MAP[np.frombuffer(pad + pad.join(raw) if raw else b"", np.uint8)]
    lengths = np.array([len(r) for r in raw], np.int64)
    own = np.full(len(data), -1, np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own[at] = np.repeat(np.arange(len(raw)), lengths)
    data[own < 0] = 0
    return data, own


def _codes(data: np.ndarray, own: np.ndarray, order: int) -> np.ndarray:
    """Of each sign of a text, the number of the n-gram that ends there."""
    code = np.zeros(len(data), np.int64)
    for k in range(order - 1, -1, -1):
        code = code * SIZE + np.concatenate([np.zeros(k, np.int64), data[: len(data) - k]])
    return code[own >= 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    sums = {}
    for b in batches:
        bad = np.array(b.column("bad").to_pylist(), bool)
        data, own = _signs(b.column("chars").to_pylist())
        side = bad[own[own >= 0]].astype(np.int64)
        for order in range(1, ORDER + 1):
            keys, n = np.unique(_codes(data, own, order) * 2 + side, return_counts=True)
            total.setdefault(order, []).append(np.stack([keys, n]))
        for order, found in total.items():
            both = np.concatenate(found, axis=1)
            keys, back = np.unique(both[0], return_inverse=True)
            total[order] = [np.stack([keys, np.bincount(back, both[1], len(keys)).astype(np.int64)])]
            sums[order] = total[order][0]
    for order, (keys, n) in sums.items():
        yield pa.RecordBatch.from_pydict({"size": np.full(len(keys), order, np.int32), "code": keys // 2, "bad": (keys % 2).astype(np.int32), "n": n})


def _log_probabilities(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each n-gram of ORDER signs, the log-probability of its last sign after the others."""
    p = np.full(1, 1 / SIZE)
    for order in range(1, ORDER + 1):
        n = np.zeros(SIZE**order)
        if order in counts:
            n[counts[order][0]] = counts[order][1]
        n = n.reshape(-1, SIZE)
        whole, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SIZE) if order > 1 else np.full((1, SIZE), 1 / SIZE), (SIZE if order > 2 else 1, 1))
        p = np.where(whole > 0, (n + kinds * shorter) / np.maximum(whole + kinds, 1), shorter).reshape(-1)
    return np.log(p).astype(np.float32)


class UrlModel:
    """The two models as one table of log-likelihood differences, and the threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float = 0.0):
        self.ratio, self.threshold = ratio, threshold

    def score(self, texts: list[str]) -> np.ndarray:
        data, own = _signs(texts)
        at = own[own >= 0]
        n = np.bincount(at, minlength=len(texts))
        return np.bincount(at, self.ratio[_codes(data, own, ORDER)], len(texts)) / np.maximum(n, 1)


def train(urls: DataFrame, seeds: list[str] = SEEDS) -> UrlModel:
    """urls: host, path, held_out."""
    bad = F.lit(False)
    for s in seeds:
        bad = bad | F.contains("host", F.lit(s))
    df = urls.select(F.concat("host", "path").alias("chars"), bad.alias("bad"), "held_out")
    counts = df.filter("not held_out").select("chars", "bad").mapInArrow(_count, "size int, code bigint, bad int, n bigint")
    rows = counts.groupBy("size", "code", "bad").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for side in (0, 1):
        own = rows[rows["bad"] == side]
        tables.append(_log_probabilities({k: (g["code"].to_numpy(), g["n"].to_numpy()) for k, g in own.groupby("size")}))
    if rows["bad"].nunique() < 2:
        return UrlModel(np.zeros_like(tables[0]))
    model = UrlModel(tables[0] - tables[1])
    held = scored(df.filter("held_out and not bad").select("chars"), model).agg(F.percentile_approx("score", MAX_FALSE_REJECTS, 10_000).alias("at")).first()["at"]
    model.threshold = min(0.0, held) if held is not None else 0.0
    return model


def scored(df: DataFrame, model: UrlModel) -> DataFrame:
    """df with the score of its column chars."""
    shared = df.sparkSession.sparkContext.broadcast(model.ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlModel(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(b.column("chars").to_pylist()), pa.float64())], names=[*b.schema.names, "score"])

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField("score", DoubleType())]))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, score (accepted over rejected, a character)."""
    host, path = parts(F.col(url_col))
    rule, by_rule = match(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("held_out", F.pmod(F.xxhash64("host", "path"), F.lit(10)) == 0)
    model = train(urls, seeds)
    df = scored(urls.select("page_id", "host", "path", F.concat("host", "path").alias("chars")), model)
    own = F.when(F.col("score") >= model.threshold, F.lit("allow")).otherwise(F.lit("block"))
    return df.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, own)).select("page_id", "host", "path", "rule", "verdict", "score")
