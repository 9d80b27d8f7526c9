import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import sketches as S

SF = "/root/testdata/sf0.001"


def keys(text):
    return Counter(S.paragraphs(pa.array([text], pa.string()))[0].tolist())


def dice(a, b):
    a, b = keys(a), keys(b)
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 1.0


def test_paragraphs_do_not_depend_on_the_batch():
    texts = ["One. Two words!\nThree", "  lead. x", "", None, "a b c. " * 50, "x" * 300, "tail\n\n", "é? ü"]
    found, bounds = S.paragraphs(pa.array(texts))
    for k, t in enumerate(texts):
        assert found[bounds[k] : bounds[k + 1]].tolist() == S.paragraphs(pa.array([t], pa.string()))[0].tolist()
    assert len(keys("One. Two words!\nThree")) == 3 and sum(keys("same. same. same. ").values()) == 3 and len(keys("same. same. same. ")) == 3


def test_peeling_recovers_every_difference():
    rng = random.Random(3)
    pool = [rng.getrandbits(64) for _ in range(4000)]
    left, right = [], []
    for size in (0, 0, 1, 5, 30, 300, 2000):
        both = rng.sample(pool, size)
        left.append(both + [rng.getrandbits(64) for _ in range(size // 3)]), right.append(both + [rng.getrandbits(64) for _ in range(size // 2)])
    right[0] = [5]
    pack = lambda rows: (np.array([k for r in rows for k in r], np.uint64), np.r_[0, np.cumsum([len(r) for r in rows])])
    found, owner, sign = S.differences(pack(left), pack(right))
    for k in range(len(left)):
        for side, own, other in ((1, left, right), (-1, right, left)):
            assert sorted(found[(owner == k) & (sign == side)].tolist()) == sorted(set(own[k]) - set(other[k]))


def check(rows, got):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    want = []
    for place, k in enumerate(order):
        text, after = rows[k][1] or "", rows[order[(place + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        one, two = S.fingerprints(S.paragraphs(pa.array([text, edited])))
        want.append((rows[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), one, two, dice(text, edited), dice(text, after)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_query_equals_the_plain_one(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = S.op11_fingerprints(spark, SF).collect()
    check(rows, got)
    assert np.median([r.near_edited for r in got]) > 0.4 > 0.1 > np.median([r.near_next for r in got])


def test_nulls_ties_empty_and_clashing_columns(spark, tmp_path):
    rows = [(None, "no id. " * 9, 0), (7, "seven. and more", 0), (7, "a seven", 0), (7, "a seven", 0), (-5, None, 0), (9, "", 0), (8, "long words here. " * 20_000, 0), (2**62, "last é ü. one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, S.op11_fingerprints(spark, str(tmp_path)).collect())
    docs.limit(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert S.op11_fingerprints(spark, f"{tmp_path}/one").first().near_next == 1.0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op11_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_versions_give_their_differing_paragraphs(spark):
    rows = [(1, "One. Two. Three.", "One. 2. Three."), (None, None, "New."), (2, "", None), (3, "Same. Same. ", "Same. ")]
    got = {r.doc_id: r for r in S.compare(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()}
    sizes = {k: (len(r.removed), len(r.added), round(r.likeness, 4)) for k, r in got.items()}
    assert sizes == {1: (1, 1, 0.6667), None: (0, 1, 0.0), 2: (0, 0, 1.0), 3: (1, 0, 0.6667)}
    one = S.sketch(spark.createDataFrame([(1, "Equal. "), (2, "Equal. "), (3, "Other. "), (4, None)], "doc_id long, text string")).collect()
    print_of = {r.doc_id: (r.n_paragraphs, r.fingerprint) for r in one}
    assert print_of[1] == print_of[2] != print_of[3] and print_of[4][0] == 0
