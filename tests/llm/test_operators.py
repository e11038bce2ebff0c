"""Each operator against a brute-force version on small hard rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecscore.llm import anchors, chat_format, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, repeats, suffix_array, tokens, url_filter, weak_labels
from vecscore.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, kept boolean"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = np.random.default_rng(5)
WORDS = ["".join(rng.choice(list("aeioubcdé"), rng.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for k, w in enumerate(r.choice(WORDS, n)):
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return "\n".join(" ".join(out[k : k + 27]) for k in range(0, n, 27))


BASE = prose(300, 1)
PASSAGE = prose(120, 2)
TEXTS = [
    None, "", " \n ", BASE, BASE.upper(), BASE, BASE.replace(WORDS[3], "other"), prose(200, 3) + "\n" + PASSAGE + "\n" + prose(90, 4), PASSAGE + "\n" + prose(150, 5),
    "one", "One two", "a | b | c | d | e | f\ng | h | i | j | k | l\nm | n | o | p", "ja ja ja ja ja ja ja ja ja ja ja ja ja ja", "a" * 900, "a" * 400, prose(9000, 6), "É é Ünï", "é É ünï",
    BASE + " Ja.", BASE + " Nein.", BASE.replace(" ", "  "), "x\ny\nz\nx\ny\nz\nx\ny\nz",
]


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "en", None if k % 7 == 0 else "s" if k % 3 else "t", k, 1, "k", True) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(docs, none, rows):
    found = by_id(exact_dedup.exact_dedup(docs))
    groups = defaultdict(list)
    for k, t in enumerate(TEXTS):
        groups[(t or "").translate(UPPER)].append(k)
    for t, ids in groups.items():
        for k in ids:
            r = found[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_chunks_join_to_the_text(docs):
    cut = docs.filter("text is not null").select("text", exact_dedup.chunks(docs.text, 64, 256).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in cut)


def test_exact_stage_keeps_one_of_repeated_rows(spark, rows):
    twice = spark.createDataFrame(rows + rows, SCHEMA)
    out = exact_dedup.exact_dedup_stage(twice)
    assert out.columns == twice.columns
    assert out.count() == len({(t or "").translate(UPPER) for t in TEXTS})


def test_quality(docs, none):
    found = by_id(quality.quality_rules(docs))
    for k, t in enumerate(TEXTS):
        w = words_of(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        at = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(at), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "") and r.base_failed == (len(w) < 10 or 100 * len(at) > 20 * len(w))
    assert found[3].kept and not found[11].kept and not found[12].kept
    assert quality.quality_rules(none).count() == 0
    assert quality.quality_stage(docs).columns == docs.columns


def test_quality_marks_without_a_pre_test(spark):
    """Lines over the share of marks fail whatever marks they hold."""
    good = prose(54, 80)
    bad = ["a, b, c, d, e", ". . . . . . 12", "★ ★ ★ ★ ab", "─ ─ ─ ─ ┐ x", "、 。 、 。 文", "Ti."]
    texts = [good, *(good + "\n" + x for x in bad), good + "\n" + "\n".join(bad * 12)]
    found = by_id(quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, x in enumerate(bad, 1):
        assert (found[k].n_failed_lines, found[k].lost_chars) == (1, sum(map(len, words_of(x)))), x
    assert found[0].n_failed_lines == 0 and found[0].kept
    assert (found[7].n_failed_lines, found[7].kept) == (72, False)


def test_chat_round_trip(spark):
    said = "\\### <|end|>\n <|a|> \\\\| |> <|"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, None, None, None), (2, 0, "assi|>st<|ant", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.canonical_turns(chat_format.from_rows(df)))
    read = {r.conv_id: (r.t, r.formatted, r.loss_spans) for r in out.selectExpr("*").withColumn("t", F.transform(chat_format.split_turns(out.formatted), chat_format.read_turn)).collect()}
    assert [tuple(t) for t in read[1][0]] == [("", ""), ("user", said), ("assistant", said)]
    assert [tuple(t) for t in read[2][0]] == [("assistant", ""), ("assistant", ""), ("assi|>st<|ant", "x")]
    (span,) = read[1][2]
    assert re.sub(r"(?s)\\(.)", r"\1", read[1][1][span["start"] : span["start"] + span["length"]]) == said


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"instruction":"a","input":"","output":"b"}'), (4, '{"prompt":"a","completion":"b"}'), (5, '{"strange":1}'), (6, "no json"), (7, None), (8, '{"output":null,"instruction":"a"}'),
    ]
    out = chat_format.canonical_turns(spark.createDataFrame(records, "id long, json string")).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv_id, r.part or 0)):
        got[r.conv_id].append((r.role, r.text))
    for k in (1, 2, 3, 4):
        assert got[k] == [("user", "a"), ("assistant", "b")]
    assert got[8] == [("user", "a"), ("assistant", "")]
    assert all(r.layout is None for r in out if r.conv_id in (5, 6, 7))


def test_chat_layouts_with_other_fields(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a","name":"n"},{"role":"gpt","content":null}],"id":3}', "messages", ["a", ""]), (2, '{"instruction":"i","input":null,"output":"o","meta":{"role":"z"}}', "instruction", ["i", "o"]),
        (3, '{"instruction":"i","output":"o","meta":[1]}', "instruction_only", ["i", "o"]), (4, '{"prompt":"p","response":"r","completion":"c"}', "prompt", ["p", "c"]),
        (5, '{"conv_id":1,"role":"user","text":"t","turn":2,"lang":"en"}', "turn", ["t"]), (6, '{"messages":[]}', None, [None]), (7, '{"messages":[{"content":"a"}]}', None, [None]), (8, "[1]", None, [None]),
    ]
    df = spark.createDataFrame([(k, j, "x") for k, j, _, _ in records], "id long, json string, layout string")
    out = chat_format.canonical_turns(df).orderBy("conv_id", "part").collect()
    for k, _, layout, texts in records:
        assert [(r.layout, r.text) for r in out if r.conv_id == k] == [(layout, t) for t in texts]
    assert chat_format.canonical_turns(df.limit(0)).count() == 0
    long = "é|>" * 3_000_000
    df = spark.createDataFrame([(1, 0, "user", long, 1), (2, 0, "assistant", long, 1)], "conv_id long, turn long, role string, text string, piece int")
    found = chat_format.format_chats(chat_format.canonical_turns(chat_format.from_rows(df)))
    assert sorted(r.n for r in found.select(F.length("formatted").alias("n")).collect()) == [12_000_000 + len(f"<|{role}|>\n<|end|>\n") for role in ("user", "assistant")]


def test_line_dedup(docs, none):
    found = by_id(line_dedup.line_dedup(docs))
    lines = {k: [x for x in (t or "").split("\n") if words_of(x)] for k, t in enumerate(TEXTS)}
    first = {}
    for k in sorted(lines):
        for i in range(len(lines[k]) - 2):
            first.setdefault(tuple(lines[k][i : i + 3]), (k, i))
    for k, own in lines.items():
        gone = {i + j for i in range(len(own) - 2) if first[tuple(own[i : i + 3])] != (k, i) for j in range(3)}
        assert (found[k].n_lines, found[k].n_removed) == (len(own), len(gone))
    left = by_id(line_dedup.remove_lines(docs, line_dedup.line_dedup(docs)))
    assert left[3].text == BASE and left[5].text == "" and left[0].text is None
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_long_runs(spark):
    """Runs of one or two lines count if they hold more than 50 words."""
    line = lambda n, seed: " ".join(f"w{seed}x{k}" for k in range(n))
    a, b, c, d, e = line(51, 0), line(50, 1), line(26, 2), line(25, 3), line(3, 4)
    texts = [f"{a}\n{b}\nx0\n{c}\n{d}\nx1\n{a}\n{e}", a, b, f"{c}\n{d}", f"{d}\n{c}", f"{a}\ny0", f"{c}\n \n{d}\n{a}\n{e}\ny1"]
    lines = {k: [x for x in t.split("\n") if x.strip()] for k, t in enumerate(texts)}
    gone = {k: set() for k in lines}
    for n in (1, 2, 3):
        first = {}
        for k, own in lines.items():
            for i in range(len(own) - n + 1):
                window = tuple(own[i : i + n])
                if (n == 3 or len(words_of(" ".join(window))) > 50) and first.setdefault(window, (k, i)) != (k, i):
                    gone[k].update(range(i, i + n))
    found = by_id(line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert {k: r.n_removed for k, r in found.items()} == {k: len(v) for k, v in gone.items()} == {0: 1, 1: 1, 2: 0, 3: 2, 4: 0, 5: 1, 6: 4}
    assert (found[6].n_runs, found[6].longest_run) == (1, 4)


def test_removed_lines_come_from_the_whole_suffix_array(spark, monkeypatch):
    """The query doubles to the end, and its intervals hold what begins with the same lines."""
    depths = []
    whole = line_dedup.suffix_ranks
    monkeypatch.setattr(line_dedup, "suffix_ranks", lambda lines, depth=None, settled=False: depths.append(depth) or whole(lines, depth, settled))
    run = [f"r{k}" for k in range(9)]
    texts = ["\n".join(t) for t in (run, ["a", *run, "b"], ["r1", "r2", "c"], run[3:], ["d", "e"], ["r1", "r2", "r3", "r5"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {k: r.n_removed for k, r in by_id(line_dedup.line_dedup(df)).items()} == {0: 0, 1: 9, 2: 0, 3: 6, 4: 0, 5: 3} and depths == [None]
    found = line_dedup.intervals(line_dedup.line_ids(df), 3, 0).collect()
    own = {k: t.split("\n") for k, t in enumerate(texts)}
    prefixes = defaultdict(set)
    for r in found:
        prefixes[r.length, r.key].add(tuple(own[r.doc_id][r.pos : r.pos + r.length]))
    assert all(len(p) == 1 for p in prefixes.values()) and len(prefixes) == len(set().union(*({(n, x) for x in p} for (n, _), p in prefixes.items())))


def test_whole_suffix_order_of_lines(docs):
    lines = line_dedup.line_ids(docs)
    ranks = {(r.doc_id, r.pos): (r["rank"], r.n) for r in line_dedup.suffix_ranks(lines).collect()}
    own = defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: (r.doc_id, r.pos)):
        own[r.doc_id].append(r.line)
    suffixes = {(k, i): tuple(v[i:]) for k, v in own.items() for i in range(len(v))}
    counts, order = Counter(suffixes.values()), sorted(suffixes.values())
    for at, s in suffixes.items():
        if counts[s] > 1:
            assert ranks[at] == (order.index(s), counts[s])


def test_mixing(spark, docs, none):
    out = mixing.mix_sources(docs).collect()
    assert {r.doc_id for r in out} == set(range(len(TEXTS)))
    weights = {r.source: r.weight for r in out}
    assert abs(sum(weights.values()) - 1) < 1e-9 and all(0 <= r.mix_position <= 1 for r in out)
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 < 8, 'big', concat('s', id % 2)) as source", "repeat('w ', int(id % 50 + 1)) as text")
    got = mixing.mix_sources(many, entropy_share=1.0, max_repeats=100.0)
    sums = {r.source: (r.t, r.w) for r in got.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("weight").alias("w")).collect()}
    total = sum(t for t, _ in sums.values())
    assert all(abs(t / total - w) < 0.01 and abs(w - 1 / 3) < 1e-3 for t, w in sums.values())
    part = mixing.mix_sources(many, budget=1000.0).agg({"tokens": "sum"}).first()[0]
    assert 1000 <= part <= 1300
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_stage(docs).columns == docs.columns


def test_mixing_takes_empty_texts_of_a_last_block(spark):
    texts = [(k, s, t) for k, (s, t) in enumerate((s, t) for s in ("big", "small") for t in ["w " * (9 if s == "big" else 2)] * 20 + [None, "", " "] * 30)]
    out = mixing.mix_sources(spark.createDataFrame(texts, "doc_id long, source string, text string")).filter("epoch = 0").collect()
    assert sorted(r.doc_id for r in out) == [k for k, _, _ in texts]


def test_tokens_are_the_library_s():
    bpe = tokens.WordBpe(tokenizer_path())
    odd = ["", " ", "<|endoftext|> hi", "ΟΔΟΣ", "日本語 x", "e\u0301 É", "a\x1cb", "it's I'LL 12a3!?", "x" * 99, "😀 ok…", "İ ǅ ﬁ ½", *[t for t in TEXTS if t]]
    assert [a.tolist() for a in bpe.encode_batch(odd)] == [bpe.library.encode(t, add_special_tokens=False).ids for t in odd]


def test_tokens_of_letters_signs_and_others_mixed():
    r = np.random.default_rng(11)
    signs = list("aaaabcdeorstinthéüßñçœſŉ") + list(".,;$$%#*'-0129×÷ª²½µ¡…’") + ["Ä", "İ", "'s", "'ll", "e\u0301", "Σ", "日", "😀", "\xa0", "\x85", "\u2003", " ", "\n"]
    texts = ["".join(r.choice(signs, r.integers(0, 60))) for _ in range(3000)] + ["", " ", "\n\n", "x" * 500 + "," * 500]
    bpe = tokens.WordBpe(tokenizer_path())
    want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [a.tolist() for a in bpe.encode_batch(texts)] == want
    assert [a.tolist() for t in texts[:50] for a in bpe.encode_batch([t])] == want[:50]
    assert bpe.encode_batch([]) == []


def test_tokens_take_no_step_of_python_for_each_chunk():
    r = np.random.default_rng(12)
    chunks = list({"".join(r.choice(list("aeioubcdfglmnrst"), r.integers(4, 14))) + r.choice(["", "", ",", ".", "$$$"]) for _ in range(40_000)})
    texts = [" ".join(chunks[k::40]) for k in range(40)]
    bpe, calls = tokens.WordBpe(tokenizer_path()), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = bpe.encode_batch(texts)
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < len(chunks)
    assert [a.tolist() for a in found] == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_rounds_hold_all_rows_in_order():
    texts = ["ab", "", "x" * 30, "", "c", "de" * 4, "f", *[""] * 7]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + len(own))), "text": own}) for k, own in ((0, texts[:4]), (4, texts[4:]))]
    got = list(packing.rounds(iter(batches), 9, 3))
    assert [k for names, _ in got for k in names] == list(range(14)) and [t for _, own in got for t in own] == texts
    assert all(len(own) == 1 or len(own) <= 3 and sum(map(len, own)) <= 9 for _, own in got)


def test_packing(docs, none):
    bpe = tokens.WordBpe(tokenizer_path())
    want = {k: [*bpe.library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(TEXTS)}
    out = packing.pack(docs, tokenizer_path(), window=256, shard=2000, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, ids in want.items():
        own = sorted(pieces[k], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) and r.length == len(r.ids) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= 256 and total & (total - 1) == 0
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_best_fit_takes_the_tightest_window():
    found = packing.best_fit([(0, 0, 60), (1, 0, 70), (2, 0, 30), (3, 0, 40)], 100)
    assert sorted(sorted(p[0] for p in w) for w in found) == [[0, 3], [1, 2]]


def brute_near(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = words_of((t or "").translate(UPPER))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (len(sets[k]), root(k)) for k in sets}


def family(size, seed):
    r = np.random.default_rng(seed)
    own = prose(150, seed).split(" ")
    out = [own]
    for _ in range(size - 1):
        w = list(out[r.integers(len(out))])
        for k in r.integers(0, len(w), r.integers(0, 5)):
            w[k] = "neu" + str(r.integers(1000))
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near(spark, docs, none, n, percent):
    texts = dict(enumerate([*TEXTS, *family(40, 50), *family(25, 51)]))
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, component int").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df, words=n, percent=percent).collect()}
    assert found == brute_near(texts, n, percent)
    if n == 3:
        assert near_dedup.near_dedup(none).count() == 0


def test_weak_labels(docs, none):
    good = [prose(80, 100 + k) for k in range(60)]
    bad = ["X | " * 40 for _ in range(5)] + [" ".join(w + "$$$" for w in prose(60, k).split()) for k in range(5)] + [prose(60, k).upper().replace(" ", "!! ") for k in range(6)]
    df = docs.sparkSession.createDataFrame([(k, t, 1.0) for k, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string, score double")
    found = by_id(weak_labels.weak_label_scores(df))
    assert len(found) == 78 and all(found[k].kept for k in range(60)) and not any(found[k].kept for k in range(60, 76))
    assert weak_labels.weak_label_scores(none).count() == 0


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 7, 30, 400]:
        for letters in (b"a", b"ab", bytes(range(97, 117))):
            t = bytes(r.choice(list(letters), n).astype(np.uint8))
            t = t + t[: n // 2]
            data = np.frombuffer(t, np.uint8)
            order = suffix_array.suffix_array(data)
            assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            windows = Counter(t[i : i + 5] for i in range(len(t) - 4))
            assert suffix_array.repeated_starts(data, 5).tolist() == [i <= len(t) - 5 and windows[t[i : i + 5]] > 1 for i in range(len(t))]


def test_equal_windows_have_equal_keys():
    text = (prose(400, 8) + PASSAGE + prose(50, 9) + PASSAGE + "a" * 900).encode()
    data = np.frombuffer(text, np.uint8)
    first, last, key, _, _, _, _ = anchors.runs(data, np.array([0]), np.array([len(data)]), 100, 16)
    keys = defaultdict(set)
    for a, z, k in zip(first.tolist(), last.tolist(), key.tolist(), strict=True):
        for i in range(a, z + 1):
            keys[text[i : i + 100]].add(k)
    assert len(text) - 99 == sum(last - first + 1) and all(len(v) == 1 for v in keys.values())


@pytest.mark.parametrize("shard", [2_000_000, 3000])
def test_repeats(docs, none, shard):
    """With the small shard, frequent keys take the way of counted windows."""
    texts = {k: (t or "").encode() for k, t in enumerate(TEXTS)}
    windows = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    found = by_id(repeats.remove_repeats(docs, shard=shard))
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if windows[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        r = found[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()), k
    if shard == 3000:
        assert repeats.remove_repeats(none).count() == 0


def test_repeats_of_candidates_only(spark):
    """Texts that share 395 bytes are looked at closely and lose nothing."""
    shared = prose(200, 70).replace("\n", " ").encode()[:395].decode(errors="ignore")
    texts = [prose(120, 71) + shared + prose(120, 72), prose(120, 73) + shared + prose(120, 74)]
    found = by_id(repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: (r.n_bytes, r.n_removed, r.n_spans) for k, r in found.items()} == {k: (len(t.encode()), 0, 0) for k, t in enumerate(texts)}


def test_urls(spark):
    urls = [None, "no url", "http://A.Example.NET/en/x?q#f", "https://example.net", "http://x.net/", "http://example.com/de/1", "http://s.example.com/de/1", "ftp://a.org/fr/", "http://a.org/fr?x", "http://fooorg/fr/", "a://b://c/d"]
    good = [f"http://{WORDS[k % 50][:4]}{k % 9}.site.com/{WORDS[k % 70]}/{k}" for k in range(200)]
    bad = [f"http://cheap-pills{k}.com/buy/{k}" for k in range(60)]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, *good, *bad])], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    want = [("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "", None), ("x.net", "/", "net/"), ("example.com", "/de/1", "example.com/de/"), ("s.example.com", "/de/1", "example.com/de/"), ("a.org", "/fr/", "org/fr/"), ("a.org", "/fr", None), ("fooorg", "/fr/", None), ("b:", "//c/d", None)]
    assert [(found[k].host, found[k].path, found[k].rule) for k in range(len(urls))] == want
    n = len(urls)
    assert [found[k].verdict for k in (2, 4, 5, 7)] == ["allow", "block", "block", "allow"]
    assert sum(found[n + k].verdict == "allow" for k in range(200)) >= 195 and all(found[n + 200 + k].verdict == "block" for k in range(60))
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_passages_of_many_words(docs, none):
    """Against a count of windows of 51 words; a shorter passage is not reported, a passage of fewer bytes than the window is."""
    short = " ".join(f"x{k % 97}y{k}" for k in range(51))
    texts = {**dict(enumerate(TEXTS)), 100: prose(60, 90) + " " + short + "\n" + prose(60, 91), 101: prose(70, 92) + "\n" + short.upper() + " " + prose(9, 93), 102: prose(40, 94) + " " + " ".join(short.split()[:50])}
    said = {k: [w.translate(UPPER) for w in words_of(t)] for k, t in texts.items()}
    windows = Counter(tuple(w[i : i + 51]) for w in said.values() for i in range(len(w) - 50))
    df = docs.sparkSession.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, th int").repartition(3)
    found = by_id(repeats.remove_repeats(df))
    for k, w in said.items():
        at = sorted({i + j for i in range(len(w) - 50) if windows[tuple(w[i : i + 51])] > 1 for j in range(51)})
        runs = sum(i == 0 or at[i - 1] != x - 1 for i, x in enumerate(at))
        assert (found[k].n_passage_words, found[k].n_passages) == (len(at), runs), k
    assert found[100].n_passage_words == found[101].n_passage_words == 51 and found[102].n_passage_words == 0 and found[100].n_removed == 0


def test_repeats_of_rows_without_ids(spark):
    text = prose(120, 95)
    found = repeats.remove_repeats(spark.createDataFrame([(None, text), (None, text + " a"), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in found) == [0, *[len(text.encode())] * 3]


def test_exact_stage_with_repeated_and_missing_ids(spark):
    def left(rows):
        out = exact_dedup.exact_dedup_stage(spark.createDataFrame(rows, "doc_id long, text string, key string, again int"))
        assert out.columns == ["doc_id", "text", "key", "again"]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert left([(1, "alpha unique text", "a", 1), (1, "shared", "b", 1), (2, "shared", "c", 1)]) == [(1, "alpha unique text"), (2, "shared")]
    assert left([(None, "shared", "a", 1), (None, "Shared", "b", 1), (2, "shared", "c", 1), (None, "own", "d", 1), (3, None, "e", 1), (4, "", "f", 1)]) == [(2, "shared"), (4, ""), (None, "own")]
    assert left([(5, "x", "a", 1), (5, "x", "b", 2)]) == [(5, "x")] and len(left([(5, "x", "a", 1), (5, "X", "b", 2)])) == 1
    assert left([]) == []


def test_near_without_ids(spark):
    text = prose(80, 97)
    df = spark.createDataFrame([(None, text), (3, text), (None, "alone here now"), (4, None)], "doc_id long, text string")
    found = [(r.doc_id, r.component_id) for r in near_dedup.near_dedup(df).collect()]
    assert sorted(found, key=str) == sorted([(None, 3), (3, 3), (None, None), (4, 4)], key=str)


def test_quality_stage_passes_what_is_left(spark):
    good, bad = prose(108, 98), "a | b | c | d"
    df = spark.createDataFrame([(1, f"{good}\n\n{bad}", 5), (2, f"{good}\n \n{good[:40]}", 7), (3, bad, 1)], "doc_id long, text string, n_chars int")
    found = {r.doc_id: (r.text, r.n_chars) for r in quality.quality_stage(df).collect()}
    assert found[1] == (good + "\n", len(good) + 1) and found[2][0] == f"{good}\n \n{good[:40]}" and 3 not in found


def test_sketches_never_miss_a_difference():
    r = np.random.default_rng(11)
    for n in (3, 200, 900, 3000):
        base = r.integers(-(1 << 62), 1 << 62, n)
        for change in (0, 1, n // 20, n // 2):
            other = np.unique(np.concatenate([base[change:], r.integers(-(1 << 62), 1 << 62, change)]))
            x, y = (near_dedup.folded(near_dedup.sketch(np.unique(v))).view(np.uint64) for v in (base, other))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(base, other))


def test_doubling_begins_with_as_many_names_as_fit(monkeypatch):
    ranks = np.random.default_rng(3).integers(0, 12, 400)
    want = sorted(range(len(ranks)), key=lambda i: ranks[i:].tolist())
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(suffix_array.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    assert suffix_array._doubling(ranks).tolist() == want and len(sorts) == 1
    assert suffix_array._doubling(np.zeros(50, np.int64)).tolist() == list(range(49, -1, -1))


def test_names_are_compared_eight_bytes_at_a_time():
    text = np.frombuffer(b"abcdefghijkl.abcdefghijkL.abcdefgh", np.uint8)
    a, b, sizes = np.array([0, 0, 0, 0]), np.array([13, 13, 26, 26]), np.array([11, 12, 8, 1])
    assert suffix_array._equal(text, a, b, sizes).tolist() == [True, False, True, True]
    assert suffix_array._equal(text.astype(np.int64), a, b, sizes).tolist() == [True, False, True, True]
