"""Training-data operators against brute-force versions, on small fixtures with nulls, empties, repeats and ties."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, components, embed_dedup, licenses, mixing, packing, quality, simhash, suffix_array, suffix_dedup, topk, toxicity

R = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def sentence(n):
    return " ".join(R.choice(WORDS) + str(R.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = sentence(80)
    passage = sentence(60)
    near = base.split()
    near[40] = "changed"
    out = [base, base, " ".join(near), None, "", "one two", sentence(30) + "\n" + passage + "\n" + sentence(20), passage + " " + sentence(5), "a" * 900, sentence(3000), "É " * 150, "x"]
    return out + [sentence(50) for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # clashing extra columns, a null id, a repeated row
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "t1", 2) for i, t in enumerate(texts)]
    rows += [(None, "null id text " + sentence(10), None, "s1", 5, 1, "x", 2), rows[1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, _n long")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (21, 22), (22, 20), (3, 9)]
    got = {(r.node, r.root) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (9, 3), (20, 20), (21, 20), (22, 20)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    x[500:] = x[:500] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(500)], np.uint64)
    d = x[:500] ^ x[500:]
    for radius in (0, 3, 4, 6):
        got = simhash._lanes(simhash.within(simhash.bit_planes(d), radius), 500)
        assert got.tolist() == [bin(int(v)).count("1") <= radius for v in d]


def test_block_masks_lose_nothing():
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.masks(*simhash.block_sets(n))
        for _ in range(300):
            bits = sum(1 << b for b in R.sample(range(64), 4))
            assert any(not bits & m for m in masks)


def brute_print(t):
    from xxhash import xxh64_intdigest

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    want = Counter((d, f"{prints[i]:016x}", min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    found = simhash.near_duplicates(docs)
    got = Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ids)
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_oversized_blocks(spark):
    base = R.getrandbits(64)
    prints = {base ^ sum(1 << b for b in R.sample(range(64), 2)) for _ in range(80)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(classes, len(signed), block=8)
    roots = {r.root for r in components.connected_components(links).collect()}
    assert len(roots) == 1


def test_repeated_starts():
    for _ in range(25):
        segments = [bytes(R.choice(b"ab") for _ in range(R.randrange(1, 40))) for _ in range(R.randrange(1, 10))]
        n, weights = R.randrange(1, 9), np.array([R.choice([1, 1, 2]) for _ in range(10)])
        seen = Counter()
        for s, m in zip(segments, weights):
            for i in range(len(s) - n + 1):
                seen[s[i : i + n]] += m
        want = [[i for i in range(len(s) - n + 1) if seen[s[i : i + n]] > 1] for s in segments]
        assert [x.tolist() for x in suffix_array.repeated_starts(segments, weights[: len(segments)], n)] == want


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, *b[:3], b[3]) for (d, _), b in zip(rows, suffix_dedup.brute_force([t for _, t in rows])))
    import hashlib

    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert sum(r[2] for r in want) > 0
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    model, lib = bpe.WordBpe(path), Tokenizer.from_file(path)
    odd = ["", "aaaa aaaaaaaa", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ", "İstanbul\x1cb", "été x", "##$%% 's it's we'll", "日本語 🎉🎉", "x" * 3000, "</w> a</w>", "１２３ ½ Ⅷ", "ß ﬁ"]
    odd += ["".join(R.choice("abeilnrst'éσ1#! ") for _ in range(R.randrange(1, 120))) for _ in range(500)]
    for text, ids, ref in zip(odd, model.encode(odd), lib.encode_batch(odd, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.ids, text
        assert model.decode(ids) == lib.decode(ref.ids, skip_special_tokens=False)
    import hashlib

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(spark.createDataFrame([], EMPTY)).count() == 0


def test_mixing(spark, docs):
    import re

    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(re.findall(mixing.WORD_PATTERN, r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * size[s] for s in capped)
        goal = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        new = {s for s in free if goal[s] > 3 * size[s] + 1e-9}
        if not new:
            break
        capped |= new
    assert all(min(abs(r.target - g) for g in goal.values()) < 1e-6 for r in rows)
    assert all(r.taken <= 3 * r.size for r in rows)
    taken, source_of = Counter(), {(r.doc_id, len(re.findall(mixing.WORD_PATTERN, r.text or ""))): r.source for r in docs.collect()}
    for r in rows:
        taken[source_of[r.doc_id, r.size]] += r.taken
    for s in order:  # each source's words come near its target: within a block's width of words, or a hundredth
        assert abs(taken[s] - goal[s]) <= max(1.5, 0.02 * goal[s]), (s, taken[s], goal[s])
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.taken_words(docs).collect()))
    mixed = mixing.documents_of(docs).collect()
    assert sum(len(re.findall(mixing.WORD_PATTERN, r.text)) for r in mixed) == sum(r.taken for r in rows)
    assert mixing.taken_words(spark.createDataFrame([], EMPTY)).count() == 0


def test_mixing_small_sources(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate([("a", 30), ("b", 30), ("c", 30), ("d", 1), ("e", 0)])]
    got = {r.doc_id: r.taken for r in mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    targets = {r.doc_id: r.target for r in mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(abs(got[i] - targets[i]) <= 1 for i in got) and got[4] == 0


def test_mixing_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = [(1, "one two three", "s")] * 11 + [(2, "four five", "s"), (3, "six", "t")]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 13 and all(r.taken <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()))


def test_shard_draws(spark, monkeypatch):
    """Every shard but the last is full, the sources' totals come out, and counts scatter around the weights."""
    monkeypatch.setattr(mixing, "STRETCH", 4)
    want = {0: 200_000, 1: 90_000, 2: 100, 3: 0}
    plan = spark.createDataFrame([(r, n, max(n // 2, 1)) for r, n in want.items()], "rank long, n_slots long, n_blocks long")
    rows = mixing.shard_draws(plan).collect()
    shards, totals = Counter(), Counter()
    for r in rows:
        shards[r.shard] += r.n
        totals[r["rank"]] += r.n
    assert all(totals[r] == n for r, n in want.items())
    assert sorted(shards) == list(range(len(shards))) and all(shards[s] == mixing.SHARD for s in range(len(shards) - 1))
    share = [r.n / mixing.SHARD for r in rows if r["rank"] == 0 and r.shard < max(shards)]
    assert abs(np.mean(share) - 200_000 / 290_100) < 0.01 and np.std(share) > 0
    for rank in want:
        runs = sorted((r.first, r.n) for r in rows if r["rank"] == rank)
        assert [a for a, _ in runs] == [sum(n for _, n in runs[:i]) for i in range(len(runs))]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
        assert n < 17 or mixing.permuted(np.arange(n), n, 5).tolist() != mixing.permuted(np.arange(n), n, 6).tolist()


def test_toxicity(spark, docs):
    bad = ["idiotx", "morony"]
    rows = [sentence(30) for _ in range(300)]
    labels = np.array([i % 4 == 0 for i in range(300)], int)
    rows = [t + " " + R.choice(bad) + R.choice(["", "er", "ly"]) + " " + sentence(5) if y else t for t, y in zip(rows, labels)]
    model = toxicity.fit(rows[:200], labels[:200])
    predicted = model.scores(rows[200:]) >= toxicity.DECISION
    assert (predicted == labels[200:]).mean() > 0.9
    again = toxicity.fit(rows[:200], labels[:200])
    assert np.array_equal(model.scores(rows), again.scores(rows))
    scored = toxicity.score(docs, model.to_bytes())
    assert scored.columns == [*docs.columns, "score"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(spark.createDataFrame([], EMPTY), model.to_bytes()).count() == 0
    same = toxicity.fit(["a", "b"], np.array([0, 0])).scores(["a", "", None])
    assert np.allclose(same, 0.25)
    labels_df = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels_df, "toxic", toxicity._fit_bytes)
    assert toxicity.train(docs, labels_df.limit(0), "toxic", toxicity._fit_bytes)


def test_quality():
    good = [sentence(60) for _ in range(150)]
    bad = [" | ".join(sentence(20).split()) for _ in range(50)]
    texts, labels = good + bad, np.array([1] * 150 + [0] * 50)
    order = np.random.default_rng(0).permutation(200)
    model = quality.fit([texts[i] for i in order[:140]], labels[order[:140]])
    s = quality.Model.from_bytes(model.to_bytes()).scores([texts[i] for i in order[140:]])
    assert ((s >= quality.DECISION) == labels[order[140:]]).mean() > 0.95
    assert np.isfinite(model.scores(["", None, "x" * 100000])).all()
    assert np.allclose(quality.fit(["a"], np.array([1])).scores([""]), 2 / 3)


def vectors(n=400, size=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, size))
    x[n // 2 :] = x[: n - n // 2] + 0.03 * rng.standard_normal((n - n // 2, size))
    x[7] = x[8]
    return x.astype(np.float32)


def vector_rows(x):
    rows = [(i, [float(v) for v in y], i % 3) for i, y in enumerate(x)]
    rows += [(900, None, 1), (901, [float("nan")] * x.shape[1], 1), (902, [None] * x.shape[1], 1), (903, [0.0] * x.shape[1], 1), (904, rows[5][1], None), rows[6], (None, rows[9][1], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, k=5):
    """(query's id, rank, id, score) for every row whose id is divisible by 50, in whole numbers; ids may repeat or be missing."""
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    out = Counter()
    for a, (q, x) in enumerate(good):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(int(s) * int(t) for s, t in zip(x, y)), i is None, i or 0, i) for b, (i, y) in enumerate(good) if b != a)
            out.update((q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(scores[:k]))
    return out


def topk_of(df, k=5):
    return Counter(map(tuple, topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, k).collect()))


def test_topk(spark):
    rows = vector_rows(vectors())
    # repeated ids: an equal row, another vector of the same id, and a query's id three times over; ties in score; sizes that differ
    rows += [rows[50], (50, rows[60][1], 1), (100, rows[3][1], 1), (101, rows[3][1], 1), (7, rows[9][1][:5], 1), (8, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", v int, row int")
    assert topk_of(df) == brute_topk(rows)
    assert topk_of(df, 700) == brute_topk(rows, 700)
    assert topk_of(df.limit(0)) == Counter()
    assert topk_of(df.filter("vec_id = 1")) == Counter()
    few = rows[:3] + [(50, rows[4][1], 0)]
    assert topk_of(spark.createDataFrame(few, SCHEMA)) == brute_topk(few)


def test_topk_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 8)], 0) for i in range(60)] + [(0, [1.0] * 8, 0)]
    assert topk_of(spark.createDataFrame(rows, SCHEMA)) == brute_topk(rows)


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "PROBES", 5)
    monkeypatch.setattr(topk, "STRIP", 16)
    test_topk(spark)


def test_topk_leaves_out_what_cannot_matter():
    """Lengths that fall and a floor near the top: almost everything is pruned, nothing that matters."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((500, 32)) * np.geomspace(5000, 5, 500)[:, None])
    q = x[:20]
    turn = topk.rotation(x.T @ x)
    at, row, _, score = topk.best_in_block(np.arange(20), q, np.arange(500), np.arange(500), x, turn, 5, np.full(20, -np.inf))
    for i in range(20):
        want = sorted(((-int(v), j) for j, v in enumerate(q[i] @ x.T) if j != i))[:5]
        assert sorted(zip((-score[at == i]).tolist(), row[at == i].tolist())) == sorted(want)


@pytest.mark.parametrize("block", [2048, 16])
def test_embed_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vector_rows(vectors())
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(map(tuple, embed_dedup.linked(df).collect()))
    ok = [v is not None and None not in v and np.isfinite(v).all() and any(v) and l is not None for _, v, l in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2]:
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    want = Counter()
    for i, r in enumerate(rows):
        c = min((x for x in ids[find(i)] if x is not None), default=None)
        want[r[0], links[i], c, r[0] == c] += 1
    wrong = sum((want - got).values())
    assert sum(r[1] * n for r, n in got.items()) >= 0.9 * sum(links)
    assert wrong <= 0.03 * len(rows)
    assert embed_dedup.linked(df.limit(0)).count() == 0


def test_packing(spark, docs):
    rows = packing.pack(docs, length=64, stretch=2000).collect()
    encoder = packing.encoder(packing.vocabulary_path())
    pieces = {}
    for r in rows:
        ids, positions = np.frombuffer(bytes(r.ids), "<u4"), np.frombuffer(bytes(r.positions), "<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= 64
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text or "") + [packing.END]
        parts = sorted(pieces[r.doc_id])
        copies = sum(s == 0 for s, _ in parts)
        assert sum(len(p) for _, p in parts) == copies * len(ids)
        assert [t for s, p in sorted({(s, tuple(p)) for s, p in parts}) for t in p] == ids
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_depends_on_documents_only(spark, docs):
    one = Counter(tuple(map(str, r)) for r in packing.pack(docs.repartition(1), length=64, stretch=500).collect())
    assert one == Counter(tuple(map(str, r)) for r in packing.pack(docs.repartition(7, "text"), length=64, stretch=500).collect())
    assert sum(one.values()) > 20


def test_packing_files(spark, docs, tmp_path):
    rows = packing.pack(docs, length=64, stretch=500)
    packing.write(rows, f"{tmp_path}/parquet")
    held = spark.read.parquet(f"{tmp_path}/parquet").collect()
    want = Counter((bytes(r.ids), bytes(r.positions), tuple(r.cu_seqlens)) for r in held)
    parts = packing.write_binary(rows, f"{tmp_path}/binary").collect()
    got = Counter()
    for p in parts:
        ids, positions, ends = packing.read_binary(f"{tmp_path}/binary", p.part, p.length)
        assert len(ids) == len(positions) == len(ends) == p.rows and p.length == 64
        got.update((i.tobytes(), q.tobytes(), tuple(map(int, e))) for i, q, e in zip(ids, positions, ends))
    assert got == want and sum(p.rows for p in parts) == len(held)
    assert packing.write_binary(packing.pack(docs.limit(0)), f"{tmp_path}/none").count() == 0


def test_best_fit():
    for _ in range(40):
        sizes = [R.randrange(1, 21) for _ in range(R.randrange(1, 60))]
        rows, rooms = packing.best_fit(sizes, 20), []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [r for r in rooms if r >= sizes[i]]
            if fit:
                rooms[rooms.index(min(fit))] -= sizes[i]
            else:
                rooms.append(20 - sizes[i])
        assert sorted(20 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_licenses(spark):
    import regex

    texts = [None, "", "Released under", "x " * 40 + "Released under the MIT License. more"]
    for v in licenses.TEMPLATES.values():
        w = v.split()
        if len(w) > 30:
            w[len(w) // 2] = "CHANGED"
        texts.append(sentence(R.randrange(0, 70)) + " " + " ".join(w) + " tail words here")
    texts.append(texts[-1])
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word) for r in licenses.scan(df).collect()}
    shingles = lambda t: [tuple(w[i : i + 5]) for w in [[x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]] for i in range(len(w) - 4)]
    want = {}
    for i, t in enumerate(texts):
        s = shingles(t)
        for k, v in licenses.TEMPLATES.items():
            q = shingles(v)
            best = max(((len(set(q) & set(s[p : p + len(q)])) / len(set(q)), -p) for p in range(len(s))), default=(0, 0))
            if best[0] >= licenses.CONTAINMENT:
                want[i if i else None, k] = (round(best[0], 9), -best[1])
    assert got == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_held_out_remainders(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", toxicity.remainder(3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows)
