import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loomgraph.llm import periods as P

SF = "/root/testdata/sf0.001"


def plain_runs(w, least, powers):
    """Every stretch of least period q that no neighbour extends, by trying all periods."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            # Of one stretch the smallest period comes first.
            if n >= powers * q and (i, n) not in found:
                found[i, n] = q
            i = j
    return sorted((i, n, q) for (i, n), q in found.items() if n >= max(least, powers * q))


@pytest.mark.parametrize(("least", "powers"), [(2, 2), (6, 2), (3, 3), (24, 3)])
def test_runs_equal_those_of_all_periods(least, powers):
    rng = random.Random(least * 10 + powers)
    texts = [[], [1], [1] * 100, [1, 2] * 60 + [3] + [1, 2] * 60]
    for _ in range(250):
        letters = rng.choice([1, 2, 3, 8])
        w = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            a, b = sorted(rng.randrange(len(w) + 1) for _ in range(2))
            w = w[:b] + w[a:b] * rng.randrange(5) + w[b:] + (w[a:b] if rng.random() < 0.5 else [])
            w = w[:600]
        texts.append(w)
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    texts.append(fib[-1])
    codes = P.mix(np.array([x for w in texts for x in w], np.uint64) + np.uint64(9))
    got = P.runs_of(codes, np.r_[0, np.cumsum([len(w) for w in texts])], least, powers)
    for k, w in enumerate(texts):
        assert got.get(k, []) == plain_runs(w, least, powers), (k, w)


def wanted(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    keep = [not any(s + q <= i < s + m for s, m, q in runs) for i in range(n)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2], digest(lines.encode()), digest(b" ".join(x for x, k in zip(w, keep) if k)))


def test_query_equals_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in P.op12_periods(spark, SF).collect()}
    assert got == {wanted(r.doc_id, r.text) for r in docs} and sum(r[1] > 0 for r in got) > 5


def test_nulls_repeats_long_and_clashing_columns(spark, tmp_path):
    rows = [(None, "a b " * 40, 1), (1, None, 1), (2, "", 1), (2, " \n", 1), (3, "x " * 2_000, 1), (4, "é\x0bé é " * 30, 1), (4, "é\x0bé é " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, P.op12_periods(spark, str(tmp_path)).collect()))
    names = P.op12_periods(spark, str(tmp_path)).columns
    want = [dict(zip(names, wanted(i, t))) for i, t, _ in rows]
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in w.items()) + ")" for w in want)
    assert P.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.find_runs(docs, powers=1)
