"""Mixing, the weak-label model and the URL models against second versions in plain Python."""

import math
import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash

from vecscore.llm import mixing, url_filter, weak_labels


def spark_hash(*values):
    """xxhash64 of Spark: int, long (as a tuple of one) and string values, each hashed with the last hash as seed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_mix(rows, entropy_share, max_repeats, budget):
    """rows: doc_id, source, tokens. How often each document is taken in which epoch."""
    own = defaultdict(lambda: defaultdict(list))
    for doc_id, source, n in rows:
        key = "-" if source is None else "=" + source
        own[key][spark_hash(mixing.SEED, (doc_id,)) % mixing.BLOCKS].append((spark_hash(mixing.SEED + 1, (doc_id,)) % (1 << 40), n, doc_id))
    size = {k: sum(n for b in blocks.values() for _, n, _ in b) for k, blocks in own.items()}
    total = sum(size.values())
    share = {k: v / total for k, v in size.items() if v}

    def weights(a):
        z = sum(s**a for s in share.values())
        return {k: s**a / z for k, s in share.items()}

    enough = lambda a: -sum(w * math.log(w) for w in weights(a).values()) >= entropy_share * math.log(len(share))
    low, high = (1.0, 1.0) if enough(1.0) else (0.0, 1.0)
    for _ in range(mixing.LEVELS * mixing.PASSES):
        mid = (low + high) / 2
        low, high = (mid, high) if enough(mid) else (low, mid)
    spread = math.log(max(share.values()) / min(share.values()))
    w = weights(max(low, 1 - math.log(max_repeats) / spread if spread else 0.0))
    default = budget is None
    if default:
        budget = max(size[k] / w[k] for k in share if share[k] == max(share.values()))
    taken = Counter()
    for key, blocks in own.items():
        quota = math.floor(w.get(key, 0.0) * budget + 0.5)
        for epoch in range(math.ceil(quota / size[key]) if size[key] else 1):
            start = epoch * size[key]
            for b in sorted(blocks, key=lambda b: (spark_hash(mixing.SEED, epoch, key, b), b)):
                room, before = quota - start, 0
                for _, n, doc_id in sorted(blocks[b]):
                    if default and epoch == 0 or not size[key] or before < room:
                        taken[doc_id, epoch] += 1
                    before += n
                start += before
    return taken, w


def test_mixing_is_that_of_a_plain_version(spark):
    r = np.random.default_rng(11)
    rows = [(k, ["hot", "hot", "hot", "a", "b", None, "none"][k % 7] if k % 3 else "hot", int(r.integers(0, 60)) * (k % 7 != 6 or k % 3 == 0)) for k in range(1500)]
    rows += rows[:40]
    docs = spark.createDataFrame([(i, s, None if n == 0 and i % 2 else "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    for entropy_share, max_repeats, budget in ((mixing.ENTROPY_SHARE, mixing.MAX_REPEATS, None), (0.9, 100.0, None), (1.0, 100.0, 9000.0), (0.5, 2.0, 30_000.0)):
        want, weights = brute_mix(rows, entropy_share, max_repeats, budget)
        found = mixing.mix_sources(docs, entropy_share=entropy_share, max_repeats=max_repeats, budget=budget).collect()
        assert Counter((x.doc_id, x.epoch) for x in found) == want
        assert all(abs(x.weight - weights.get("-" if x.source is None else "=" + x.source, 0.0)) < 1e-9 for x in found)


def brute_votes(counts):
    """counts: documents of each pattern of votes. The probability of good of each, by EM in plain loops."""
    patterns, labellers = list(counts), range(len(next(iter(counts))))
    both = [k for k in labellers if {0, 1} <= {p[k] for p in patterns}]
    good = {p: 0.1 if 0 in p else 0.9 for p in patterns}
    for _ in range(100):
        mass = [sum(n * (1 - good[p]) for p, n in counts.items()), sum(n * good[p] for p, n in counts.items())]
        rate = {}
        for k in labellers:
            for side in (0, 1):
                seen = {v: 1 + sum(n * (good[p] if side else 1 - good[p]) for p, n in counts.items() if p[k] == v) for v in (-1, 0, 1)}
                if k in both:
                    seen[-1] = 0
                for v in seen:
                    rate[k, v, side] = 1 if k in both and v == -1 else seen[v] / sum(seen.values())
        new = {}
        for p in patterns:
            odds = [math.log((mass[side] + 1) / (sum(mass) + 2)) + sum(math.log(rate[k, p[k], side]) for k in labellers) for side in (0, 1)]
            new[p] = 1 / (1 + math.exp(min(60, max(-60, odds[0] - odds[1]))))
        if max(abs(new[p] - good[p]) for p in patterns) < 1e-6:
            break
        good = new
    turned = sum(rate[k, 1, 1] - rate[k, 1, 0] for k in labellers) < 0
    return {p: 1 - g if turned else g for p, g in good.items()}


def brute_scores(texts, target):
    """Scores of a logistic model over a dense matrix of the same features."""
    rows = weak_labels.features([t.encode() for t in texts])
    used = sorted({int(c) for at, _ in rows for c in at})
    x = np.zeros((len(texts), len(used)))
    for k, (at, values) in enumerate(rows):
        for c, v in zip(at, values, strict=True):
            x[k, used.index(c)] += v
    target = np.array(target)
    half = [0.5 / max(np.mean((target >= 0.5) == side), 1e-3) / len(texts) for side in (False, True)]
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(weak_labels.STEPS):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - target) * np.where(target >= 0.5, half[1], half[0])
        w, bias = w - weak_labels.RATE * (x.T @ error + weak_labels.DECAY * w), bias - 0.5 * error.sum()
    return 1 / (1 + np.exp(-(x @ w + bias)))


def test_weak_label_model_is_that_of_a_plain_version(spark):
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("aeioubcd"), r.integers(2, 8)))
    texts = [" ".join(word() for _ in range(r.integers(1, 60))) + "." for _ in range(60)] + ["X | " * 30, "# $ % " * 20, "Ja ja ja ja ja", "LOUD WORDS!! HERE!! " * 6, "", "a\na\na\na\na"] * 3
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    found = weak_labels.weak_label_scores(spark.createDataFrame([(k, t or None) for k, t in rows], "doc_id long, text string")).collect()
    assert Counter(x.doc_id for x in found) == Counter(k for k, _ in rows)
    votes = {x.doc_id: tuple(map(int, x.votes.split(","))) for x in found}
    good = brute_votes(Counter(tuple(map(int, x.votes.split(","))) for x in found))
    assert all(abs(x.posterior - good[votes[x.doc_id]]) < 1e-6 for x in found)
    scores = brute_scores([t for _, t in rows], [good[votes[k]] for k, _ in rows])
    want = {k: s for (k, _), s in zip(rows, scores, strict=True)}
    assert all(abs(x.score - want[x.doc_id]) < 1e-3 for x in found)
    assert all(x.kept == (x.score >= weak_labels.KEEP) for x in found)


def brute_url_scores(accepted, rejected, texts):
    """Log-likelihood a byte under accepted over that under rejected, by Witten-Bell in dictionaries."""
    signs = lambda t: [0] * (url_filter.ORDER - 1) + [url_filter.ALPHABET.find(chr(b)) + 1 or url_filter.SIZE - 1 for b in t.encode()]

    def model(urls):
        after = defaultdict(Counter)
        for u in urls:
            s = signs(u)
            for at in range(url_filter.ORDER - 1, len(s)):
                for k in range(url_filter.ORDER):
                    after[tuple(s[at - k : at])][s[at]] += 1

        def p(context, sign):
            shorter = p(context[1:], sign) if context else 1 / url_filter.SIZE
            seen = after.get(context)
            return (seen[sign] + len(seen) * shorter) / (sum(seen.values()) + len(seen)) if seen else shorter

        return p

    good, bad = model(accepted), model(rejected)
    out = []
    for t in texts:
        s, n = signs(t), url_filter.ORDER - 1
        each = [math.log(good(tuple(s[k - n : k]), s[k])) - math.log(bad(tuple(s[k - n : k]), s[k])) for k in range(n, len(s))]
        out.append(sum(each) / max(len(each), 1))
    return out


def test_url_models_are_those_of_a_plain_version(spark):
    r = np.random.default_rng(13)
    pick = lambda words: str(r.choice(words))
    fine = [f"{pick(['news', 'wiki', 'museum', 'garden'])}{pick(['life', 'ort', 'é'])}.example/{pick(['a', 'b-c', 'de'])}/{r.integers(99)}" for _ in range(400)]
    junk = [f"win{r.integers(9999)}-casino-{pick(['bonus', 'spin'])}777.biz/bonus{r.integers(99)}" for _ in range(150)]
    # like junk, but without a seed word, and not among the URLs of the training
    alike = ["win4711-kasino-bonus777.biz/bonus5", "win12-c4sino-spin777.biz/bonus77"]
    known = [*fine, *junk, *fine[:30], "", ""]
    urls = [*known, *alike]
    rows = [(u, "", k % 10 == 0) for k, u in enumerate(known)]
    model = url_filter.train(spark.createDataFrame(rows, "host string, path string, held_out boolean").repartition(3))
    bad = lambda u: any(s in u for s in url_filter.SEEDS)
    want = brute_url_scores([u for u, _, h in rows if not h and not bad(u)], [u for u, _, h in rows if not h and bad(u)], urls)
    found = model.score(urls)
    assert np.abs(found - want).max() < 1e-4
    held = sorted(s for s, (u, _, h) in zip(want, rows, strict=False) if h and not bad(u))
    assert abs(model.threshold - min(0.0, held[math.ceil(url_filter.MAX_FALSE_REJECTS * len(held)) - 1])) < 1e-4
    blocked = {u for u, s in zip(urls, found, strict=True) if s < model.threshold}
    assert {*junk, *alike} <= blocked and not blocked & {*fine, ""}
