import base64
import gzip
from collections import defaultdict
from urllib.parse import quote

import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import jaccard, mixing, secrets, token_counts

SF = "/root/testdata/sf0.001"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, component_id string" + extra)


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def edge_rows():
    return [(1, None, None, "x"), (2, "", "a", "x"), (3, " \t", "a", None), (4, "one two", "a", "x"), (4, "one two", "a", "x"), (None, "one two", None, "x"), (5, "a b c d e " * 3000, "b", "x"), (6, "A b c d e " * 3000, "b", "x")]


def test_mixing_targets_and_limits(spark):
    rows = mixing.op1_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        per.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in per.values()) - total) < 1e-6 * total
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}
    size = {s: sum(r["size"] for r in v) for s, v in per.items()}
    capped, target = set(), {}
    while True:
        left = total - sum(3 * size[s] for s in capped)
        w = sum(weights[s] for s in per if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weights[s] / w for s in per}
        more = {s for s in per if target[s] > 3 * size[s] * (1 + 1e-12)}
        if not more:
            break
        capped |= more
    for s, v in per.items():
        assert abs(v[0].target - target[s]) < 1e-6 * total
        assert abs(sum(r.taken for r in v) - target[s]) <= max(r["size"] for r in v) + 0.05 * target[s]


def test_mixing_edges(spark):
    rows = mixing.mix(frame(spark, edge_rows())).collect()
    assert len(rows) == 8 and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_token_counts_match_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    found = [*texts(spark), "aaaaaaaaa bbbb <|endoftext|>x<|startoftext|>", "", None, "\x1c  É 𝔘 1234 don't"]
    want = [len(e.ids) for e in t.encode_batch([x or "" for x in found], add_special_tokens=False)]
    assert token_counts.Merger(path).counts(found) == want
    assert token_counts.count_tokens(frame(spark, edge_rows()), path).count() == 8


def brute_components(rows, width=4):
    sets = {}
    for i, t in rows:
        w = jaccard.shingle_words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    base = ("w%d " * 400) % tuple(range(400))
    near = [(10_000 + k, base.replace(f"w{k * 3} ", f"z{k} ").replace(f"w{k * 3 + 30} ", f"y{k} ")) for k in range(30)]
    drift = [(20_000 + k, " ".join(f"v{j}" for j in range(k * 4, k * 4 + 100))) for k in range(8)]
    short = [(30_000 + k, " ".join(["q"] * (k + 1))) for k in range(12)]
    every = rows + near + drift + short
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert got == brute_components(every)


def test_jaccard_edges(spark):
    rows = jaccard.near_duplicates(frame(spark, edge_rows())).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_secrets_layers_and_edges(spark):
    key = "AKIA" + "Z" * 16
    inner = base64.b64encode(gzip.compress(quote(f"password={key}").replace("A", "%41").encode())).decode()
    base, spans = secrets.scan(f"x {inner} y")
    assert ("access" in {k for _, k, _ in spans}) and all((a, b) == (2, 2 + len(inner)) for a, k, b in spans if (a, k, b) not in base)
    twice = base64.b64encode(base64.b64encode(f"token: {key}".encode())).decode()
    assert (0, "assign", len(twice)) in secrets.scan(twice)[1]
    assert secrets.base_spans("secret=abc token='abcdefgh1'") == [(11, "assign", 27)]
    assert secrets.scan(None) == ([], []) and secrets.scan("plain %41%41%41 text")[0] == []
    assert secrets.redact(f"a {key} b") == "a [SECRET] b" and secrets.redact(None) is None
    rows = secrets.scan_documents(frame(spark, edge_rows())).collect()
    assert len(rows) == 8 and all(r.n_hex == 0 for r in rows)
    assert secrets.redact_documents(frame(spark, edge_rows())).count() == 8


def test_mixing_keeps_columns_that_clash(spark):
    names = ["s", "s2", "tilt", "mean", "offset", "buckets", "source_docs", "bin", "run", "rank", "n", "a.b"]
    plain = frame(spark, edge_rows())
    found = mixing.mix(plain.select("*", *(mixing.F.lit(k).alias(n) for k, n in enumerate(names))))
    assert found.columns == [*plain.columns, *names, "size", "source_size", "target", "rate", "copies", "taken"]
    assert sorted(map(str, found.select(*mixing.mix(plain).columns).collect())) == sorted(map(str, mixing.mix(plain).collect()))
    assert {tuple(r[n] for n in names) for r in found.collect()} == {tuple(range(len(names)))}


def test_mixing_empty_sources(spark):
    rows = mixing.mix(frame(spark, [(1, "", "a", "x"), (2, None, "a", "x"), (3, "one two three", "b", "x")])).collect()
    assert {r.doc_id: r.copies for r in rows if r.doc_id < 3} == {1: 0, 2: 0}
    assert sum(r.taken for r in rows) == 3
    assert [r.copies for r in mixing.mix(frame(spark, [(1, "", "a", "x")])).collect()] == [0]


def test_long_runs_and_members(spark):
    import time

    began = time.time()
    secrets.scan("a" * 1_000_000 + "%41")
    secrets.scan("a" * 1_000_000 + "\\u0041")
    assert time.time() - began < 2
    key = "AKIA" + "Z" * 16
    two = base64.b64encode(gzip.compress(b"plain text here") + gzip.compress(key.encode())).decode()
    assert (2, "access", 2 + len(two)) in secrets.scan("x " + two)[1]


def test_neighbours_of_each_length(spark):
    from loomgraph.llm import neighbours

    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 4.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.search(v, v.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (100, 1, 101, 1.0)]
