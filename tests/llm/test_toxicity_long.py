import random

import corpus_pipeline
import numpy as np
from loomgraph.llm import toxicity

BAD = [f"scum{k}" for k in range(10)]


def texts(n, seed):
    """n texts of 20 to 1,500 words, a tenth toxic: those have two bad words each."""
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(3000)]
    out = []
    for i in range(n):
        words = [some[min(int(rng.paretovariate(0.5)), 3000) - 1] for _ in range(int(20 * 75 ** rng.random()))]
        y = int(i % 10 == 0)
        for at in rng.sample(range(len(words)), 2 * y):
            words[at] = rng.choice(BAD)
        out.append((i, " ".join(words), y))
    return out


def test_few_bad_words_in_long_texts(spark, tmp_path):
    rows = texts(2000, 3)
    spark.createDataFrame([(i, y) for i, _, y in rows if i < 1500], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    fresh = [(i, t, y) for i, t, y in rows if i >= 1500]
    toxic = [i for i, _, y in fresh if y]
    assert sum(i not in kept for i in toxic) >= 0.96 * len(toxic)
    assert sum(i in kept for i, _, y in fresh if not y) >= 0.98 * (len(fresh) - len(toxic))


def test_evidence_and_slopes():
    model = toxicity.train([(t, y) for _, t, y in texts(600, 5)])
    assert (model.slopes >= 0).all() and model.slopes[1:].any()
    w = model.encode("w0 scum1 w1 w2 scum2 w0 w3")
    p = np.log(model.probabilities(np.r_[0, w[:-1]], w))
    ratio = sorted(p[1] - p[0], reverse=True)
    assert np.allclose(model.evidence(w), [np.mean(ratio), *ratio[: toxicity.PEAKS]])
    assert (model.evidence(w[:0]) == 0).all() and model.evidence(w[:1])[2] == 0


def test_calibration_drops_what_would_lower_a_score():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500).astype(float)
    x = np.c_[y + rng.normal(0, 1, 500), 0.5 * rng.normal(0, 1, 500) - y]
    slopes, _ = toxicity._calibrate(x, y, np.ones(500))
    assert slopes[0] > 0 and slopes[1] == 0
    alone, _ = toxicity._calibrate(x[:, :1], y, np.ones(500))
    assert np.isclose(slopes[0], alone[0])
