import random

import pytest

from loomgraph.llm import toxicity


@pytest.fixture(scope="module")
def labelled():
    """3,000 texts, a tenth toxic; bad words are likelier in those, but neither sure nor exclusive."""
    rng = random.Random(4)
    out = []
    for i in range(3000):
        y = int(i % 10 == 0)
        tail = [f"scum{k}" if rng.random() < (0.5 if y else 0.1) else "word" for k in range(6)]
        out.append((i, " ".join([rng.choice("abcdefgh") for _ in range(20)] + tail), y))
    return out


def test_flagged_share_does_not_follow_the_sample(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
    mean, flagged = {}, {}
    for rows in (3000, 600, 150):  # no class is cut; the ordinary one; both
        scores = [r.score for r in toxicity.score(docs, toxicity.fitted(docs, labels, rows)).collect()]
        mean[rows], flagged[rows] = sum(scores) / len(scores), sum(s >= 0.3 for s in scores) / len(scores)
    for rows in (600, 150):
        assert abs(mean[rows] - mean[3000]) < 0.05 and abs(flagged[rows] - flagged[3000]) < 0.05, (mean, flagged)
