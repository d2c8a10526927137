"""The text operators against brute force, on rows with every edge case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from loomline.llm import bpe, chat, context_tree, prefix_free, quality, queries, rabin_karp, repeats, rules, secrets, simhash, spaced_seeds, text_stats
from loomline.llm.common import fold_of, word_hashes

WORDS = "the of and to in is on at by we go up alpha beta gamma delta river stone cloud train paper glass house plant".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(900, 80)
    out = [(i, prose(i, 60 + i)) for i in range(12)]
    out += [(20, shared + " " + prose(20, 40)), (21, prose(21, 30) + "\n" + shared), (22, shared), (22, shared)]
    out += [(30, out[3][1]), (31, out[3][1].replace("river", "brook", 1)), (40, None), (41, ""), (42, " \t\n"), (None, prose(77, 70)), (None, shared)]
    out += [(50, "a" * 3000), (51, "x" + "a" * 900), (52, prose(5, 3000)), (53, "é漢🙂 " * 120), (54, "word\n" * 60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_chars int, id string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_row(got, rows, key):
    """Results as a multiset beside the expected ones."""
    return sorted(map(str, got)), sorted(str(key(i, t)) for i, t in rows)


def test_simhash_components(docs, rows, empty):
    got = simhash.near_duplicates(docs, 3, 2).collect()
    fp = [simhash.text_fingerprint((t or "").encode(), 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    want = sorted(str((i, np.array([fp[k]], np.uint64).view(np.int64)[0].item(), min(least[find(k)], default=None))) for k, (i, _) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in got) == want
    assert simhash.near_duplicates(empty, 3, 2).count() == 0


def test_hot_buckets_lose_no_component(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")

    def roots(cap):
        got = {x.node: x.root for x in simhash.components(simhash.links(nodes, 2, cap)).collect()}
        return {x: got.get(x, x) for x in signed}

    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for x in fps:
        groups[find(x)].add(x - (1 << 64) if x >> 63 else x)
    for cap in (4, 10_000):
        got = collections.defaultdict(set)
        for x, y in roots(cap).items():
            got[y].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_one_of_each_keeps_clean_documents(docs, rows):
    kept = collections.Counter(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert kept[3] == 1 and kept[30] == 0 and kept[22] == 1 and all(kept[i] == 1 for i in range(12))


def test_one_of_each_loses_no_clean_row(spark):
    a, b = prose(70, 60), prose(71, 60)
    rows = [(42, a, 1), (42, b, 2), (None, None, 3), (None, prose(72, 60), 4), (42, b, 5), (7, "", 6), (8, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `KEY` int")
    kept = sorted(r.KEY for r in simhash.one_of_each(docs).collect())
    assert kept in ([1, 2, 4, 6], [1, 4, 5, 6])  # rows without words are equal; one of the repeated rows stays
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(docs.limit(0)).count() == 0


def test_similar_groups_are_those_of_all_pairs(spark):
    r = random.Random(8)
    texts = [("| " * 200 + prose(i, 30 + i)) for i in range(6)] + [""]
    for seed, n in ((60, 70), (61, 150), (62, 600), (63, 900)):
        texts.append(base := prose(seed, n))
        for share in (0.003, 0.01, 0.018, 0.022, 0.025, 0.03, 0.05):
            w = base.split()
            for k in r.sample(range(len(w)), max(1, int(share * len(w)))):
                w[k] = f"new{r.randint(0, 9999)}"
            texts += [" ".join(w), "| " * 300 + " ".join(w[: len(w) // 2])]
    sets = []
    for t in texts:
        w = t.encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    crowd = collections.Counter(find(k) for k in range(len(texts)))
    want = {k: find(k) for k in range(len(texts)) if crowd[find(k)] > 1}
    got = {x.key: x.group for x in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "a~0<|im_end|>\n<|im_start|>x~~1"), (1, 1, "assistant", None), (1, 1, "assistant", "ok"), (2, None, None, ""), (None, 0, "assistant", "é"), (3, 5, "as\nsistant", "t")]
    df = spark.createDataFrame([(*r, "extra") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for c in (1, 2, 3, None):
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in said if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat.render(chat.canonical(df))
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digest(out).collect()} == want
    r = out.filter("conv_id = 1").select("formatted", chat.loss_spans(F.col("formatted")).alias("s")).first()
    assert [r.formatted[s.start : s.end] for s in r.s] == ["", "ok"]
    assert chat.digest(chat.render(chat.canonical(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    lines = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
             '{"instruction": "q", "output": "a"}', '{"instruction": "q", "input": "", "output": "a"}', '{"prompt": "q", "completion": "a"}', '{"prompt": "q", "response": "a"}', '{"question": "q", "answer": "a"}', "nope", '{"x": 1}', None]
    got = chat.canonical_json(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, json string")).orderBy("k").collect()
    assert [[tuple(t) for t in r.turns] if r.turns else None for r in got] == [[("user", "q"), ("assistant", "a")]] * 7 + [None] * 3
    mixed = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "prompt": "p", "output": "o"}', '{"instruction": "q", "output": "a", "prompt": "p", "messages": []}', '{"prompt": "q", "completion": "a", "response": null, "question": "x"}']
    got = chat.canonical_json(spark.createDataFrame([(k, x, 1, 2) for k, x in enumerate(mixed)], "k int, json string, doc int, present int")).orderBy("k").collect()
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in got] == [(x, [("user", "q"), ("assistant", "a")]) for x in ("messages", "instruction", "prompt_completion")]
    both = spark.createDataFrame([([("user", "q"), ("assistant", "a")], "p", "x")], "messages array<struct<role:string,content:string>>, prompt string, turns string")
    assert [tuple(t) for t in chat.canonical(both).first().turns] == [("user", "q"), ("assistant", "a")]
    assert chat.canonical(spark.createDataFrame([("x",)], "prompt string")).first().turns is None
    flat = chat.canonical(spark.createDataFrame([("q", "a", 1)], "prompt string, response string, id int")).first()
    assert [tuple(t) for t in flat.turns] == [("user", "q"), ("assistant", "a")]


def test_quality_machine_learns_and_scores_all(spark, docs, empty):
    good = [(i, prose(i, 80)) for i in range(300)]
    bad = [(1000 + i, "BUY!! NOW!! " * 20 + prose(i, 10).upper()) for i in range(120)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.learn(train, labels)
    held = train.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held"))
    got = quality.score(train, m).join(held, "doc_id").filter("held").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 1000) for r in got]) > 0.97
    scores = quality.score(docs, m).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(empty, m).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(train, labels.limit(0))).collect()} == {0.5}
    kept = quality.keep(docs, m, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_factorisation_identity():
    r = np.random.default_rng(1)
    m = quality.Machine(np.zeros(1), np.ones(1), 0.3, r.normal(size=6), r.normal(size=(6, 3)))
    x = r.normal(size=6)
    z, _ = m.forward(np.zeros(6, int), np.arange(6), x, 1)
    pair = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert z[0] == pytest.approx(0.3 + m.w @ x + pair)


def test_spaced_seeds_find_substituted_passages(spark, docs, empty):
    items = [(0, prose(500, 40)), (1, prose(501, 20)), (2, "the of and"), (3, "one two three four five six"), (None, "p q"), (4, None), (5, "")]
    w = prose(500, 40).split()
    for k in (6, 15, 24, 33):
        w[k] = "changed"
    planted = [(100, "before " + prose(500, 40).upper() + " after"), (101, prose(9, 50) + " " + " ".join(w)), (102, "say: one, two; three four-five six!"), (103, prose(8, 200)), (104, prose(501, 9)), (None, prose(501, 20))]
    table = spark.createDataFrame(planted, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in spaced_seeds.contamination(table, bench).collect()}
    assert set(got) == {(100, 0), (101, 0), (102, 3), (None, 1)}
    assert got[(100, 0)].n_match == 40 and got[(101, 0)].n_match == 36
    assert spaced_seeds.contamination(empty, bench).count() == 0 == spaced_seeds.contamination(docs, bench.limit(0)).count()


def test_spaced_seeds_find_every_short_rewording(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(n))) for k, n in enumerate((13, 15, 16, 20))]
    out, d = [], 0
    for k, t in items:
        w = t.split()
        every = [c for c in itertools.combinations(range(len(w)), len(w) // 5)]
        for gone in rng.sample(every, min(len(every), 200)):
            out.append((d := d + 1, "before it " + " ".join("new" if i in gone else x for i, x in enumerate(w)) + " after it", k))
    docs = spark.createDataFrame([x[:2] for x in out], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(x[0], x[2]) for x in out}


def test_seeds_hit_every_overlap_that_counts():
    """Of all patterns that no seed hits, the least number of mismatches among n tokens is over a fifth of n, for each n from 12 on."""
    masks = [[len(m) - 1 - k for k, c in enumerate(m) if c == "1"] for m in spaced_seeds.SEEDS]
    bits = max(map(len, spaced_seeds.SEEDS)) - 1
    state = {0: 0}  # the last tokens' mismatches, oldest first; nothing before the start matches
    for n in range(1, 400):
        new: dict[int, int] = {}
        for last, cost in state.items():
            for miss in (0, 1):
                window = last << 1 | miss
                if any(n >= len(m) and not any(window >> k & 1 for k in mask) for m, mask in zip(spaced_seeds.SEEDS, masks, strict=True)):
                    continue
                key = window & ((1 << bits) - 1)
                if cost + miss < new.get(key, 1 << 30):
                    new[key] = cost + miss
        state = new
        if n >= 12:
            assert min(state.values()) > n // 5, n


def test_spaced_seeds_equal_all_diagonals(spark):
    r = random.Random(21)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, [r.choice(vocabulary) for _ in range(r.choice((7, 12, 13, 14, 18, 25, 40, 90)))]) for k in range(24)]
    items += [(100, items[7][1]), (101, items[9][1][:6] + items[8][1])]
    docs = []
    for k in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            own = list(r.choice(items)[1])
            for p in range(len(own)):
                if r.random() < r.choice((0, 0.1, 0.2, 0.25)):
                    own[p] = "x" + r.choice(vocabulary)
            w += own + [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        docs.append((k, w))
    docs += [(200, [x for _ in range(40) for x in vocabulary[:3]]), (201, items[5][1] * 3)]
    want = {}
    for d, w in docs:
        for i, t in items:
            for shift in range(-len(t) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(t), len(w) - shift)
                same = [w[q + shift] == t[q] for q in range(lo, hi)]
                if len(t) < spaced_seeds.SPAN and not (len(same) == len(t) and all(same)):
                    continue
                count = list(itertools.accumulate(same, initial=0))
                for a in range(len(same)):
                    for z in range(len(same), a, -1):
                        if z - a < max(min(13, len(t)), want.get((d, i), (0,))[0]):
                            break
                        if 5 * (count[z] - count[a]) >= 4 * (z - a):
                            want[d, i] = max(want.get((d, i), (0, 0)), (z - a, count[z] - count[a]))
                            break
    rows = lambda x: spark.createDataFrame([(k, " ".join(w)) for k, w in x], "id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_overlap, x.n_match) for x in spaced_seeds.contamination(rows(docs), rows(items), id_col="id", item_id="id").collect()}
    assert got == want and len(want) > 60


def test_context_tree_and_base(docs, rows, empty):
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter()
    for i, t in rows:
        if train(i):
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for i, t in rows)
    full, tails = (context_tree.score(docs, head_grams=g, head_words=h).collect() for g, h in ((1 << 20, 1 << 20), (5, 3)))
    for got in (full, tails):
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {n}
    assert np.allclose(sorted(r.score for r in full), sorted(r.score for r in tails))
    assert context_tree.score(empty).count() == 0


def plain_tree(texts: list[bytes], scored: list[bytes], depth: int) -> list[float]:
    """log10 probabilities of texts by a tree of dictionaries, written from the definition."""
    bits = lambda b: [(1 << k | b >> (8 - k), b >> (7 - k) & 1) for k in range(8)]
    padded = lambda t: b"\xff" * depth + t.lower() + b"\xff"
    count: dict = collections.defaultdict(lambda: [0, 0])
    longer: dict = collections.defaultdict(set)
    for weight, group in ((1, texts), (0, scored)):
        for t in map(padded, group):
            for k in range(depth, len(t)):
                for prefix, bit in bits(t[k]):
                    for d in range(depth + 1):
                        count[t[k - d : k], prefix][bit] += weight
                        if d < depth:
                            longer[t[k - d : k], prefix].add(t[k - d - 1 : k])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight: dict = {}

    def log_w(c, prefix):
        if (c, prefix) not in weight:
            own = kt(*count[c, prefix])
            weight[c, prefix] = own if len(c) == depth else math.log(0.5) + np.logaddexp(own, sum(log_w(x, prefix) for x in longer[c, prefix]))
        return weight[c, prefix]

    def predicted(t, k, prefix, bit):
        p = None
        for d in range(depth, -1, -1):
            c = t[k - d : k]
            n = count[c, prefix]
            own = (n[bit] + 0.5) / (sum(n) + 1)
            q = 1 if d == depth else math.exp(math.log(0.5) + kt(*n) - log_w(c, prefix))
            p = q * own + (1 - q) * (p or 0)
        return p

    return [sum(math.log10(predicted(t, k, *x)) for k in range(depth, len(t)) for x in bits(t[k])) for t in map(padded, scored)]


def test_context_tree_equals_a_plain_one(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["the ", "an", "Th", "\n", "é", "on", " ", "x"]) for _ in range(r.randint(0, 40)))) for i in range(40)] + [(40, ""), (41, None), (None, "The  end"), (41, None)]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    want = plain_tree(train, [(t or "").encode() for _, t in rows], context_tree.DEPTH)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for grams in (1 << 20, 3):
        got = context_tree.score(df, head_grams=grams, head_words=grams).collect()
        assert sorted((str(x.doc_id), round(x.score, 6)) for x in got) == sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, want, strict=True))
        assert all(x.bits_per_byte == pytest.approx(-x.score * math.log2(10) / x.n_bytes) for x in got)
    scores = {x.doc_id: x.score for x in context_tree.score(spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "A b")], "doc_id long, text string")).collect()}
    assert scores[1] != scores[2] == scores[3]


def test_bpe_equals_the_library(docs, rows, empty):
    path = queries.tokenizer_path()
    codec, library = bpe.Codec(path, leaf=16, long_run=48, run_leaf=16), tokenizers.Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    r = random.Random(2)
    parts = ["the", "ing", "é", "漢", "a", "  ", "12", "#", "\n", "zz", "🙂", "<|endoftext|>", " ", "'s", "'", "r", "e", "l", " '", "\u3000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 300))) for _ in range(400)]
    texts += ["a" * 5000, " " * 700, "漢字" * 900, "'re" * 300, "é" * 2001]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codec.encode(texts)] == want and codec.joins > 1000
    assert codec.decode(want) == [library.decode(x, skip_special_tokens=False) for x in want]
    some = [[r.randrange(library.get_vocab_size()) for _ in range(r.randint(0, 30))] for _ in range(300)]
    assert codec.decode(some) == library.decode_batch(some, skip_special_tokens=False)
    got = sorted(map(str, (tuple(x) for x in bpe.round_trip(docs, path).collect())))
    exp = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        exp.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(exp)
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((str(x.doc_id), x.text) for x in back) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(empty, path).count() == 0


def test_bpe_joins_long_documents(spark, small):
    codec, library = bpe.Codec(queries.tokenizer_path()), tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation(), library.no_padding()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").filter("length(text) > 4096").select("text").collect()]
    got = codec.encode(texts)
    assert codec.joins >= len(texts) > 20
    assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_secrets(spark, docs, empty):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [(1, f'x token = "{key}" y {key}'), (2, f"commit {key} fixes it"), (3, "password is thereofandtoin3"), (4, "card 4111222233334444 ok"), (5, None), (6, ""), (None, "use ghp_" + "aB3" * 12),
             (7, f'commit {key} fixed. Later token = "{key}".'), (8, f'a\x01b\x02A token = "{key}" é漢🙂 x{key}y\x01')]
    t = spark.createDataFrame([(i, x, "src", 9, "z", "w", 3) for i, x in texts], "doc_id long, text string, source string, n_chars int, secrets string, own string, parts int")
    judge = secrets.default_judge(t)
    got = secrets.findings(t, judge)
    assert {r.doc_id for r in got.collect()} == {1, None, 7, 8}
    places = {(r.doc_id, r.start, r.length) for r in got.collect() if r.doc_id}
    assert places == {(1, 11, 40), (1, 55, 40), (7, 7, 40), (7, 70, 40), (8, 15, 40)}
    clean = {r.doc_id: tuple(r)[1:] for r in secrets.redact(t, judge).collect()}
    assert clean[1][0] == 'x token = "[SECRET]" y [SECRET]' and clean[2][0] == texts[1][1] and clean[5][0] is None
    assert clean[7][0] == 'commit [SECRET] fixed. Later token = "[SECRET]".' and clean[8][0] == 'a\x01b\x02A token = "[SECRET]" é漢🙂 x[SECRET]y\x01'
    assert {x[1:] for x in clean.values()} == {("src", 9, "z", "w", 3)} and secrets.redact(t, judge).columns == t.columns
    assert secrets.findings(empty, judge).count() == 0 == secrets.redact(empty, judge).count()
    assert secrets.findings(docs, judge).count() == 0
    assert secrets.dictionary(empty) == tuple(sorted(secrets.CODE_WORDS)) and {"river", "alpha"} <= set(secrets.dictionary(docs))
    assert secrets.train(secrets.labelled(spark, 0)).forest == "1.0d"


def test_secrets_are_whole(spark):
    part = lambda salt, n: "".join(hashlib.sha256(f"{salt}{k}".encode()).hexdigest() for k in range(6))[:n]
    jwt = f"eyJ{part('a', 33)}.eyJ{part('b', 290)}.{part('c', 43)}"
    block = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(200)) + "\n-----END PRIVATE KEY-----"
    texts = {1: f'token = "{jwt}" end', 2: block, 3: 'the passphrase: "corr!Horse99" ok', 4: f"use {jwt} end", 5: f'token = "{part("d", 320)}" end'}
    t = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact(t, secrets.default_judge(t)).collect()}
    assert clean == {1: 'token = "[SECRET]" end', 2: "[SECRET]", 3: 'the passphrase: "[SECRET]" ok', 4: "use [SECRET] end", 5: 'token = "[SECRET]" end'}


def test_secret_places_are_those_of_plain_matching(spark):
    """With a judge that takes every candidate, against the patterns applied one by one."""
    r = random.Random(12)
    bits = ["token = ", "password:", '"', " ", "a1b2c3d4e5f6a7b8c9", "/", "=", "é", "🙂", "eyJhbGciOiJIUzI1.eyJzdWIiOiIx", "\n", "\x01", "secret=>", "xyz", "-----BEGIN PRIVATE KEY-----abc\n-----END PRIVATE KEY-----"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["api_key=" + "q" * 20_000, " token = 'k1k2k3k4k5k6k7k8'" * 400]
    judge = secrets.Judge(secrets.CODE_WORDS, "1.0d")
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), judge).select("doc_id", "secrets").collect()

    def want(t):
        found = []
        for kind, (before, value) in secrets.KINDS.items():
            rx = f"({before})({value})".replace("(?i)", "", 1)
            rx = rx if "(?i)" not in before else f"((?i:{before.replace('(?i)', '')}))({value})"
            found += [(m.start(2), m.end(2), kind) for m in re.finditer(rx, t, re.ASCII)]
        out = []
        for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
            if not out or e > out[-1][1]:
                out.append((s, e, k))
        return out

    for row in got:
        assert [(s.start, s.stop, s.kind) for s in row.secrets] == want(texts[row.doc_id]), repr(texts[row.doc_id])


@pytest.mark.parametrize("crowd", [1, 4096])
def test_byte_windows(docs, rows, empty, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    n = 200
    starts = collections.Counter((t or "").encode()[k : k + n] for _, t in rows for k in range(len((t or "").encode()) - n + 1))

    def want(i, t):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if starts[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        return (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())

    w = repeats.Windows("bytes", n, 32)
    assert repeats.repeated(docs, w, False, crowd=crowd).count() == len(rows)
    got = prefix_free.remove_repeats(docs, n).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    a, b = by_row([tuple(r) for r in got], rows, want)
    assert a == b
    assert prefix_free.remove_repeats(empty, n).count() == 0


def test_suffix_ranks_are_those_of_sorting():
    r = random.Random(1)
    for length in (1, 5, 8, 13, 200):
        raw = bytes(r.choice(b"ab") for _ in range(900)) + b"ab" * 300
        want = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        place = {x: k for k, x in enumerate(sorted(set(want)))}
        assert repeats.suffix_ranks(np.frombuffer(raw, np.uint8), length).tolist() == [place[x] for x in want]


def test_periodic_text_is_few_rows(spark):
    texts = ["a" * 100_000, "ab" * 20_000, "x" + "ab" * 500 + "y", "abc" * 3000 + prose(1, 100), prose(1, 100), "-" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.selectExpr("doc_id as id", "doc_id as key", "text")
    assert repeats.parse(keyed, repeats.Windows("bytes", 200, 32), False).count() < 200
    starts = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for r in prefix_free.remove_repeats(docs).select("doc_id", "n_removed").collect():
        gone = bytearray(len(texts[r.doc_id]))
        for k in range(len(gone) - 199):
            if starts[texts[r.doc_id][k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert r.n_removed == sum(gone)


def test_word_windows(docs, rows, empty):
    n = 50
    low: dict = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            low[tuple(w[k : k + n])] = min(order(i), low.get(tuple(w[k : k + n]), order(i)))

    def want(i, t):
        w = (t or "").encode().split()
        gone = [0] * len(w)
        for k in range(len(w) - n + 1):
            if low[tuple(w[k : k + n])] < order(i):
                gone[k : k + n] = [1] * n
        return (i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())

    got = rabin_karp.remove_repeats(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    a, b = by_row([tuple(r) for r in got], rows, want)
    assert a == b
    assert rabin_karp.remove_repeats(empty, n).count() == 0


@pytest.mark.parametrize("units", ["bytes", "words"])
def test_crowded_triggers_give_the_same(docs, units):
    w = repeats.Windows(units, 60 if units == "bytes" else 12, 8 if units == "bytes" else 4)

    def marks(crowd):
        out = prefix_free.covered, repeats.repeated(docs, w, units == "words", crowd=crowd).collect()
        return sorted(str((r.id, r.text, sorted((m.at, m.more, sorted(m.offs or [-1])) for m in r.marks or []))) for r in out[1])

    assert marks(1) == marks(1 << 20)


def test_text_statistics_and_rules(spark, docs, rows, empty):
    def want(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))

    got = rules.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    a, b = by_row([tuple(r) for r in got], rows, want)
    assert a == b
    assert rules.statistics(empty).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert rules.learn_from(docs, labels) == []
    verdicts = rules.judge(docs, []).collect()
    assert all(r.kept == (not r.base_failed) for r in verdicts)
    assert text_stats.SYMBOLS


def test_decision_list_is_learned():
    r = np.random.default_rng(3)
    x = r.uniform(size=(3000, len(rules.RATIOS)))
    bad = (x[:, 1] > 0.8) | ((x[:, 2] > 0.7) & (x[:, 4] > 0.6))
    names = list(rules.RATIOS)
    found = rules.learn(x, bad, names)
    hit = np.zeros(len(x), bool)
    for rule in found:
        hit |= rules._covers(rule, x, names)
    assert (hit == bad).mean() > 0.97 and any(len(rule) > 1 for rule in found)


def test_pipeline_runs_whole(spark, small):
    import corpus_pipeline as cp

    n = spark.read.parquet(f"{small}/documents.parquet")
    seen, docs = [], n
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == n.columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0.7 * n.count() < seen[-1] <= n.count()
    last = cp.STAGES[-1][1](spark, docs, small)
    assert last.count() == seen[-1]


def test_quality_scores_equal_a_plain_machine(spark, docs, rows):
    r = np.random.default_rng(5)
    size = quality.BUCKETS + len(quality.STATS)
    m = quality.Machine(r.normal(size=len(quality.STATS)), np.abs(r.normal(size=len(quality.STATS))) + 0.5, -0.2, r.normal(0, 0.3, size), r.normal(0, 0.1, (size, quality.FACTORS)))

    def plain(t):
        raw = (t or "").encode()
        buf, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        column = lambda w: int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(20)) % quality.BUCKETS
        count = collections.Counter(column(w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw))
        x = {k: 1 + math.log(n) for k, n in count.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        x = {k: v / norm for k, v in x.items()}
        stats = quality.features(buf, off).stats[0]
        x |= {quality.BUCKETS + k: 0.3 * min(max((float(s) - m.mean[k]) / m.spread[k], -4), 4) for k, s in enumerate(stats)}
        keys = list(x)
        z = m.w0 + sum(m.w[k] * x[k] for k in keys) + sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for a, i in enumerate(keys) for j in keys[:a])
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    got = sorted((str(x.doc_id), round(x.score, 3)) for x in quality.score(docs, m).collect())
    want = sorted((str(i), round(plain(t), 3)) for i, t in rows)
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=0.003)


def test_rules_verdicts_equal_plain_ones(docs):
    tests = [(rules.Test("mean_word", True, 4.4), rules.Test("distinct_share", False, 0.3)), (rules.Test("upper_share", True, 0.5),), (rules.Test("n_words", False, 70.0), rules.Test("words_per_line", True, 60.0))]
    value = {
        "mean_word": lambda s: s.word_chars / max(s.n_words, 1), "distinct_share": lambda s: s.n_distinct / max(s.n_words, 1), "upper_share": lambda s: s.n_upper / max(s.word_chars, 1),
        "n_words": lambda s: s.n_words, "words_per_line": lambda s: s.n_words / max(s.n_lines, 1),
    }
    holds = lambda t, s: value[t.name](s) >= t.bound if t.least else value[t.name](s) <= t.bound
    for s in rules.judge(docs, tests).collect():
        failed = s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
        assert s.base_failed == failed and s.kept == (not failed and not any(all(holds(t, s) for t in rule) for rule in tests))


def test_pipeline_stages_take_edge_cases(spark, small):
    import corpus_pipeline as cp

    bench = spark.read.parquet(f"{small}/benchmark.parquet").filter("length(text) > 80").first().text
    good = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1"), "doc_id").limit(3).collect()]
    secret = 'token = "' + hashlib.sha1(b"z").hexdigest() + '"'
    rows = [(1, good[0]), (1, good[0]), (2, good[1]), (2, good[2]), (None, good[0]), (None, None), (3, ""), (4, None), (5, f"{prose(3, 90)} {bench}"), (6, f"{prose(4, 90)} {secret}"), (7, prose(5, 40_000))]
    made = [(i, t, "en", "s", len(t or ""), "k", "o", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, key string, old string, _key int")
    stages = dict(cp.STAGES)
    for name in ("quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan"):
        assert stages[name](spark, docs, small).columns == docs.columns and stages[name](spark, docs.limit(0), small).count() == 0
    distinct = {r._key for r in stages["simhash_near_dedup"](spark, docs, small).collect()}
    assert len(distinct & {0, 1}) == 1 and {2, 3, 8, 9, 10} <= distinct and not {4} & distinct and len(distinct & {5, 6, 7}) == 1
    clean = {r._key for r in stages["benchmark_decontamination"](spark, docs, small).collect()}
    assert 8 not in clean and {0, 1, 4, 5, 6, 7, 9, 10} <= clean
    safe = {r._key: r for r in stages["secret_scan"](spark, docs, small).collect()}
    assert safe[9].text.endswith('token = "[SECRET]"') and safe[9].n_chars == len(safe[9].text) and safe[5].text is None and safe[10].text == rows[10][1]
    coded = stages["bpe_encoding"](spark, docs, small)
    assert coded.count() == len(rows) and coded.filter("doc_id = 3").first().n_tokens == 0
