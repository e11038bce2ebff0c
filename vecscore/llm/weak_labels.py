"""Quality classifier from weak labels.

Heuristic labellers each call a document good (1), bad (0) or abstain (-1). Expectation-maximisation over the counts of their vote patterns
estimates how often each labeller votes what on good and on bad documents, and from that the probability of
each pattern. A hashed linear scorer (words and word shapes) is then fitted to these posteriors on a bounded sample
(TRAIN documents by hash) and scores every document.

Votes are expressions, cast once a document and written as a key and a pattern; what is collected is one count a pattern
(at most 3 ** labellers rows, over all documents) and the sample's features. The scorer reads the texts in a second scan, and its
scores meet the written votes by the key: two hashes of id and text, so no text is exchanged.

Defined cases: null text is empty and gets the votes of an empty text; an empty table gives an empty result. Repeated rows
count each time and are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import slices, words, written
from vecscore.llm.near_dedup import Shingler

#: How many documents train the scorer (of a larger corpus, those whose hash falls into this share of it); the bits of a feature; the score that keeps a document.
TRAIN, BITS, KEEP = 8192, 18, 0.5
STEPS, RATE, DECAY = 150, 8.0, 1e-5
LABELLERS = 10

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def line_list(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def labellers(text: Column, found: Column, lines: Column) -> dict[str, Column]:
    """The votes on text, which must not be null, by its words and its lines with a word: 1, 0 or -1."""
    n = F.size(found)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(n, F.lit(1))
    ended = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…:;\"')»”][\x20\x09-\x0D]*\z"))) / F.greatest(F.size(lines), F.lit(1))
    distinct = F.size(F.array_distinct(found)) / F.greatest(n, F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    # without its kind of junk, such a labeller knows nothing of the others
    only_bad = lambda bad: F.when(bad, 0).otherwise(-1)
    symbols, bars, loud, capitals = share(r"[#*$%&<>]"), share(r"[|»•]"), share(r"[!?]{2}"), share(r"\b\p{Lu}{3,}\b")
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s]")) / F.greatest(F.length(text), F.lit(1))
    prose = share(r"(?<!\S)\p{L}[\p{Ll}'’-]*[.,;:!?]?(?!\S)")
    same = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    return {
        "symbols": only_bad(symbols > 0.2),
        "bars": only_bad(bars > 0.2),
        "loud": only_bad(loud > 0.1),
        "capitals": only_bad(capitals > 0.3),
        "repeats": vote((n >= 20) & (distinct < 0.3), (n >= 20) & (distinct > 0.5)),
        "endings": only_bad(ended < 0.5),
        "marks": only_bad((F.length(text) >= 60) & (marks > 0.12)),
        "stutter": only_bad(text.rlike(r"(?<!\S)(\S+)(?:\s+\1(?!\S)){2}")),
        "lines": only_bad((F.size(lines) >= 4) & (same < 0.5)),
        "prose": vote(prose < 0.6, prose > 0.85),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """patterns: votes, a row each. The probability of good of each, and p[labeller, vote + 1, good]. Starts from whether any labeller votes bad."""
    posterior = np.where((patterns == 0).any(1), 0.1, 0.9)
    table = np.zeros((patterns.shape[1], 3, 2))
    # a labeller that only ever votes one way says something by abstaining, one that votes both ways does not
    silent = [k for k in range(patterns.shape[1]) if {0, 1} <= set(patterns[:, k].tolist())]
    for _ in range(rounds):
        both = np.stack([counts * (1 - posterior), counts * posterior], 1)
        for k in range(patterns.shape[1]):
            for v in range(3):
                table[k, v] = both[patterns[:, k] == v - 1].sum(0) + 1
            if k in silent:
                table[k, 0] = 0
            table[k] /= table[k].sum(0)
            if k in silent:
                table[k, 0] = 1
        prior = (both.sum(0) + 1) / (both.sum() + 2)
        logs = np.log(prior) + sum(np.log(table[k][patterns[:, k] + 1]) for k in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    # good is the side on which labellers vote good more often
    if (table[:, 2, 1] - table[:, 2, 0]).sum() < 0:
        posterior, table = 1 - posterior, table[:, :, ::-1]
    return posterior, table


def features(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its hashed words and word shapes (runs of a kind count as one), with weights of length 1."""
    hashes = Shingler(1)
    shapes = []
    for t in texts:
        own = _SHAPE[np.frombuffer(t, np.uint8)]
        shapes.append(own[np.concatenate([[True], own[1:] != own[:-1]])].tobytes() if len(own) else b"")
    out = []
    for (a, n), (b, m) in zip(hashes.counts(texts), hashes.counts(shapes), strict=True):
        half = np.uint64(64 - bits + 1)
        at = np.concatenate([a >> half, (b >> half) + np.uint64(1 << (bits - 1))]).astype(np.int64)
        x = np.concatenate([0.3 * np.sqrt(n / max(n.sum(), 1)), np.sqrt(m / max(m.sum(), 1))])
        out.append((at, x))
    return out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights and, last, the bias of a logistic model; both classes weigh the same."""
    weights = np.zeros((1 << bits) + 1)
    if not len(rows):
        return weights
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    weight = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3)) / len(rows)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(rows)) + bias, -30, 30)))
        error = (p - target) * weight
        w -= RATE * (np.bincount(at, error[row] * x, len(used)) + DECAY * w)
        bias -= 0.5 * error.sum()
    weights[used], weights[-1] = w, bias
    return weights


def weak_label_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: int = TRAIN, bits: int = BITS, keep: float = KEEP) -> DataFrame:
    """A row for each document: doc_id, votes, posterior (of its votes), score (of the scorer), kept."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]

    def vote(rows: DataFrame, *columns: Column | str) -> DataFrame:
        cast = rows.withColumn("words", words(F.col("text"))).withColumn("lines", line_list(F.col("text")))
        return cast.select(*columns, F.concat_ws(",", *[v.cast("string") for v in labellers(F.col("text"), F.col("words"), F.col("lines")).values()]).alias("votes"))

    voted = written(vote(slim, *keys), "votes")
    counted = voted.groupBy("votes").count().toPandas()
    total = int(counted["count"].sum())
    patterns = np.array([list(map(int, v.split(","))) for v in counted["votes"]], int).reshape(-1, LABELLERS)
    posterior, _ = fit_votes(patterns, counted["count"].to_numpy(float)) if total else (np.zeros(0), None)
    by_votes = dict(zip(counted["votes"], posterior.tolist(), strict=True))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = features(b.column("text").cast(pa.binary()).to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([b.column("votes"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["votes", "at", "x"])

    parts = 1 << 20
    limit = parts if total <= train else int(parts * train / total)
    # the sample is drawn before votes are cast, so only its own rows are voted on again
    sample = vote(slim.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < limit), "text")
    rows = sample.select("votes", "text").mapInArrow(featurise, "votes string, at array<bigint>, x array<double>").toArrow()
    pairs = [(np.array(a, np.int64), np.array(x, np.float64)) for a, x in zip(rows["at"].to_pylist(), rows["x"].to_pylist(), strict=True)]
    weights = fit_scorer(pairs, np.array([by_votes[v] for v in rows["votes"].to_pylist()]), bits)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in slices(batches):
            sums = [float(w[at] @ x + w[-1]) for at, x in features(b.column("text").cast(pa.binary()).to_pylist(), bits)]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(p, pa.float64()), pa.array(p >= keep)], names=["doc_id", "k1", "k2", "score", "kept"])

    scored = slim.select("doc_id", *keys, "text").mapInArrow(score, "doc_id bigint, k1 bigint, k2 bigint, score double, kept boolean")
    # a row a pattern, so as few as there are ways to vote
    known = spark.createDataFrame(list(by_votes.items()), "votes string, posterior double")
    out = scored.join(voted.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(F.broadcast(known), "votes")
    return out.select("doc_id", "votes", "posterior", "score", "kept")
