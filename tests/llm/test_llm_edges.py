"""Every operator and stage on rows that are awkward: nulls, empty and very long texts, ties, repeats, empty tables, columns whose names clash."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, embed_dedup, licenses, mixing, packing, quality, simhash, suffix_dedup, topk, toxicity

R = random.Random(11)
#: Columns that operators use by themselves, as a user's own.
CLASHES = ("_t1", "_t2", "score", "ids", "decoded", "row", "h", "hits", "fp", "root", "component_id", "rank", "size", "bucket", "copy", "kept", "removed", "found", "n_removed", "_row", "_n", "q", "stretch", "times", "target")


def words(n):
    return " ".join(R.choice(["alpha", "beta", "gamma", "delta"]) + str(R.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(120)
    return [base, base, None, "", " \n ", "one", words(20_000), "é" * 900, base + " " + words(30), words(40) + "\n" + "x" * 5000, "� a", base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i % 10 if i < 11 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None if i == 2 else len(t or ""), *["own"] * len(CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_bpe(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "STEP_CHARS", 500)
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for doc, text in rows_of(docs):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs).collect()) == want


@pytest.mark.parametrize("most", [20_000, 0])
def test_suffix_dedup(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "STEP", 3000)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "JOINED", 400)
    held = rows_of(docs)
    want = Counter((d, *b) for (d, _), b in zip(held, suffix_dedup.brute_force([t for _, t in held])))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs.drop("kept", "removed", "n_removed")).collect())
    assert got == want and sum(r[2] for r in want) > 10_000


def test_simhash(docs):
    import xxhash

    def print_of(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    found = {(r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(d, print_of(t)) for d, t in rows_of(docs)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["root"] for r in kept.collect()) == {"own": len({p for _, p in found})}


def test_mixing(docs):
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) < 0.02 * sum(r.size for r in rows)
    mixed = mixing.documents_of(docs)
    assert mixed.columns == docs.columns and all(r["rank"] == "own" and r.n_chars == len(r.text) for r in mixed.collect())


def test_licenses(spark, docs):
    notice = licenses.TEMPLATES["cc-by-4.0-notice"]
    extra = spark.createDataFrame([(77, words(30_000) + " " + notice + " " + words(30_000)), (78, (notice + " ") * 400), (78, notice), (None, notice)], "doc_id long, text string")
    got = Counter((r.doc_id, r.license) for r in licenses.scan(docs.select("doc_id", "text", "row", "h", "hits").unionByName(extra, allowMissingColumns=True)).collect())
    assert got == {(77, "cc-by-4.0-notice"): 1, (78, "cc-by-4.0-notice"): 2, (None, "cc-by-4.0-notice"): 1}


def test_licenses_short_templates(spark):
    """Near copies of the templates of 8 and 9 shingles with an end word changed, and all short ones as they are, amid other words."""
    rows, want = [], Counter()
    for name, text in licenses.TEMPLATES.items():
        parts = text.split()
        for k in range(60):
            changed = list(parts)
            if name in ("gpl-3.0-notice", "cc-by-4.0-notice") and k % 3:
                changed[0 if k % 3 == 1 else -1] = "changed"
            rows.append((len(rows), f"{words(R.randrange(0, 40))} {' '.join(changed)} {words(R.randrange(0, 40))}"))
            want[len(rows) - 1, name] += 1
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(want) <= found


def test_license_chances():
    assert licenses.collision_chance(4) == licenses.collision_chance(1) == licenses.collision_chance(9) == 1
    assert all(licenses.collision_chance(n) > 0.97 for n in (17, 30, 36, 63))


@pytest.mark.parametrize("op", [toxicity, quality])
def test_scores(docs, op):
    rows = rows_of(docs)
    labels = np.array([i % 2 for i in range(len(rows))])
    model = op.fit([t for _, t in rows] * 10, np.tile(labels, 10))
    scorer = None if op is toxicity else quality._score_bytes
    with pytest.raises(ValueError):
        toxicity.score(docs, model.to_bytes(), scorer)
    scored = toxicity.score(docs, model.to_bytes(), scorer, name="mine")
    assert scored.columns == [*docs.columns, "mine"]
    by_text = {}
    for r in scored.collect():
        assert 0 <= r.mine <= 1 and r.score == "own"
        by_text.setdefault(r.text or "", set()).add(round(r.mine, 9))
    assert all(len(s) == 1 for s in by_text.values())


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 8))
    rows = [(i, x[i % 6].tolist(), 1, "own") for i in range(12)] + [(5, x[0].tolist(), 2, "own"), (5, x[0].tolist(), 1, "own"), (99, x[0][:5].tolist(), 1, "own"), (98, [], 1, "own"), (None, x[1].tolist(), 1, "own"), (97, None, 1, "own")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, c string").selectExpr("*", "c as h1", "c as weight", "c as size", "c as signs", "c as keys", "c as v", "c as row")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.linked(df).collect())
    want = Counter({(99, 0, 99, True): 1, (98, 0, 98, True): 1, (97, 0, 97, True): 1, (5, 0, 5, True): 1})
    for i in range(12):
        want[i, {0: 2, 1: 2}.get(i % 6, 1), i % 6, i < 6] += 1
    want[5, 2, 0, False] += 1
    want[None, 2, 1, False] += 1
    assert got == want
    best = topk.top_k(topk.quantised(df), F.col("vec_id") == 5).collect()
    assert Counter(r.query_id for r in best) == {5: 15}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, sf, docs, name, stage):
    """Each stage on awkward documents: columns, rows and an empty table."""
    out = stage(spark, docs, sf)
    rows = out.collect()
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == out.columns
    if name == "bpe":
        assert len(rows) == docs.count()
        return
    assert out.columns == docs.columns and {r["rank"] for r in rows} == {"own"}
    if name == "toxicity":
        assert len(rows) <= docs.count() and Counter(map(str, rows)) <= Counter(map(str, docs.collect()))
    if name == "suffix-array dedup":
        held = {r.doc_id: r.text for r in rows if r.doc_id in (2, 3, 5)}
        assert len(rows) == docs.count() and held == {2: None, 3: "", 5: "one"}
    if name == "mixing":
        assert not [r for r in rows if not (r.text or "").strip()]


def test_packing(docs):
    rows = packing.pack(docs, length=128, stretch=3000).collect()
    parts = Counter()
    for r in rows:
        parts.update(d for d, s in zip(r.doc_ids, r.starts) if s == 0)
    assert parts == Counter(d for d, _ in rows_of(docs))
