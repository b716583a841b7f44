"""The two classifiers: tabulated convolution against a direct one, gradients against differences, densities against the
plain formula, and both queries over small tables with nulls, empty texts, repeats, ties and clashing columns."""

import zlib

import numpy as np
import pytest

from corpusloom.llm import quality, toxicity

R = np.random.default_rng(11)
WORDS = ["alpha", "beta", "gamma", "delta", "über", "zeta", "eta", "theta", "the", "und", "le"]


def sentence(n):
    return " ".join(f"{R.choice(WORDS)}{R.integers(30)}" for _ in range(n))


def labelled(n=240):
    texts, labels = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        texts.append(sentence(12) + (" idiotx moronly" if y else "") + " " + sentence(4))
        labels.append(y)
    return texts, np.array(labels)


def direct_logit(model, text):
    """The network as it is defined: embeddings of a word's buckets, filters over every place, the largest value of each."""
    p, pad = model.parts, max(toxicity.WIDTHS)
    rows = []
    for w in toxicity.words(text):
        buckets = toxicity.parts_of(w)
        rows.append(p["E"][p["own"][buckets]].sum(axis=0) * toxicity.SCALE / np.sqrt(len(buckets)))
    x = np.concatenate([np.array(rows, np.float64).reshape(-1, toxicity.DIMENSIONS), np.zeros((2 * pad, toxicity.DIMENSIONS))])
    pooled = [np.max([sum(x[i + k] @ p[f"W{w}"][k] for k in range(w)) for i in range(len(rows) + pad)], axis=0) for w in toxicity.WIDTHS]
    return float(np.maximum(np.concatenate(pooled) + p["b"], 0) @ p["v"] + p["c"][0])


def test_convolution_is_the_direct_one():
    texts, labels = labelled()
    model = toxicity.fit(texts, labels)
    asked = [*texts[:15], "", None, "idiotx", "a b", sentence(300), "x" * 5000]
    z, lang = model.logits(asked)
    assert np.allclose(z, [direct_logit(model, t) for t in asked], atol=1e-3)
    moved = z - model.parts["thresholds"][lang] + np.log(toxicity.DECISION / (1 - toxicity.DECISION))
    assert np.allclose(model.scores(asked), 1 / (1 + np.exp(-moved)), atol=1e-6)


def test_gradients_are_differences_of_the_loss():
    rng = np.random.default_rng(0)
    p = {"E": rng.normal(0, 0.5, (30, toxicity.DIMENSIONS)), "b": rng.normal(0, 0.1, 8 * 3), "v": rng.normal(0, 0.5, 8 * 3), "c": np.zeros(1)}
    p |= {f"W{w}": rng.normal(0, 0.5, (w, toxicity.DIMENSIONS, toxicity.FILTERS)) for w in toxicity.WIDTHS}
    p["E"][0] = 0
    table = np.zeros((10, toxicity.PARTS), np.uint16)
    table[1:, :2] = rng.integers(1, 30, (9, 2))
    scale = rng.uniform(0.5, 1, 10)
    docs, y = [rng.integers(1, 10, n).astype(np.int32) for n in (5, 7, 1, 4)], np.array([1, 0, 1, 0])

    def loss(q):
        total = 0.0
        for d, t in zip(docs, y):
            e = np.concatenate([q["E"][table[d]].sum(axis=1) * scale[d][:, None], np.zeros((6, toxicity.DIMENSIONS))])
            pooled = np.concatenate([np.max([sum(e[i + k] @ q[f"W{w}"][k] for k in range(w)) for i in range(len(d) + 3)], axis=0) for w in toxicity.WIDTHS])
            z = np.maximum(pooled + q["b"], 0) @ q["v"] + q["c"][0]
            total += np.logaddexp(0, z) - t * z
        return total / len(docs) + 0.5e-4 * (np.sum(q["v"] ** 2) + sum(np.sum(q[f"W{w}"] ** 2) for w in toxicity.WIDTHS))

    found = toxicity._gradients(p, docs, y, table, scale)
    for name in ("v", "b", "c", "W1", "W2", "W3", "E"):
        for _ in range(12):
            at = tuple(rng.integers(s) for s in p[name].shape)
            if name == "E" and at[0] == 0:
                continue
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += 1e-5
            up = loss(q)
            q[name][at] -= 2e-5
            assert found[name][at] == pytest.approx((up - loss(q)) / 2e-5, abs=2e-4), (name, at)


def test_densities_are_the_plain_formula():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1, (200, 6)) @ rng.normal(0, 1, (6, 6))
    labels = (rng.random(200) < 0.4).astype(int)
    rows[labels == 1] += 0.7
    shrink = 0.2
    model = quality.discriminant(rows, labels, shrink)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = np.clip((rows - mean) / spread, -quality.CLIP, quality.CLIP)
    pooled = np.mean([(x[i] - x[labels == labels[i]].mean(axis=0)) ** 2 for i in range(200)], axis=0) + 0.05
    densities = []
    for c in (0, 1):
        mine = x[labels == c]
        own = shrink + (1 - shrink) * min(1, 6 / (2 * len(mine)))
        cov = (1 - own) * np.cov(mine.T, bias=True) + own * np.diag(pooled)
        d = x - mine.mean(axis=0)
        densities.append(-0.5 * np.sum(d * np.linalg.solve(cov, d.T).T, axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.differences(rows), densities[1] - densities[0])


def test_statistics():
    row = dict(zip([*quality._CLASSES, "chars", "words", "lines"], quality.statistics("Ab 1.\nAb 1.\n")))
    assert row["upper"] == pytest.approx(np.log(2 / 12 + 1e-3)) and row["line"] == pytest.approx(np.log(2 / 12 + 1e-3))
    assert row["chars"] == pytest.approx(np.log1p(12)) and row["words"] == pytest.approx(np.log1p(4)) and row["lines"] == pytest.approx(np.log1p(2))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels as files: a null id, null and empty texts, a repeated row, equal texts, clashing columns."""
    where = str(tmp_path_factory.mktemp("tables"))
    texts, y = labelled(200)
    rows = [(i, t, "en", "s", 1, 9.0, True) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s", 1, 9.0, True), (500, None, None, None, 0, 9.0, None), (501, "", "en", "s", 0, 9.0, False), rows[3], (502, texts[3], "fr", "s", 1, 9.0, True), (503, "x " * 60_000, "en", "s", 1, 9.0, True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean").write.parquet(f"{where}/documents.parquet")
    good = [(i, int(len(t) > 95), int(v)) for i, (t, v) in enumerate(zip(texts, y))] + [(None, 1, 1), (500, None, None), (999, 1, 1)]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_query(spark, tables, name):
    where, rows = tables
    query, modulus, kept_out, limit = {"toxicity": (toxicity.op4_toxicity, 3, 1, 0.7), "quality": (quality.op5_quality, 5, 0, 0.3)}[name]
    got = query(spark, where).collect()
    assert len(got) == len(rows)
    for r in got:
        remainder = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % modulus
        assert r.held_out == (remainder == kept_out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[3]) == 1 and by_id[3] == by_id[502] and by_id[None] == by_id[0] and by_id[500] == by_id[501]
    again = query(spark, where).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_held_out_do_not_teach(spark, tables):
    """Turning the labels of held-out rows over changes no score."""
    where, _ = tables
    labels = spark.read.parquet(f"{where}/labels.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    turned = labels.withColumn("toxic", (toxicity.F.when(toxicity.remainder(3) == 1, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))))
    one, other = (toxicity.train(docs, x.filter(toxicity.remainder(3) != 1), "toxic", toxicity._fit_bytes) for x in (labels, turned))
    assert one == other


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert toxicity.op4_toxicity(spark, str(tmp_path)).count() == 0
    assert quality.op5_quality(spark, str(tmp_path)).count() == 0
