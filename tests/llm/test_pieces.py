import hashlib

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from loomgraph.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "   a  b    c", "Hé 𝔘\n\t\n  x " + "ab" * 300 + " y", "▁▁a▁b", "hello" * 60, "日本語のテキスト テスト", "\n", " \n lead", "x\x00y", "=====-----", " " * 70 + "end", None, "twice", "twice"]


def test_ids_are_the_library_s(spark):
    p = SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(None if k == 3 else k, t, 0) for k, t in enumerate(HARD)], "doc_id long, text string, ids int")
    got = pieces.encode(docs, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(None if k == 3 else k), p.encode(t) if t else []) for k, t in enumerate(HARD))
    assert sorted(r.text for r in pieces.decode(got, PATH).collect()) == sorted((t or "").replace("▁", " ") for t in HARD)
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_query_is_the_library_s(spark):
    p = SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pieces.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = p.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


@pytest.mark.parametrize("rising", [True, False])
def test_merges_and_best_paths_match_plain_ones(spark, rising):
    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "ab": -2.0, "bc": -1.0, "abc": -3.0 if rising else -0.5, "aa": -4.0, "aab": -5.0}
    table = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    ids = {p: k for k, p in enumerate(scores)}
    words = ["abc", "aabc", "aaaa", "aab", "cab", "abab", "axb", "b"]
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    queue = pieces.Queue(table.collect(), 100)
    assert {r.word: r.ids for r in pieces.merged_words(vocabulary, table, 100).collect()} == {w: queue.ids(w) for w in words}

    def best(w):
        paths = [(0.0, [])]
        for end in range(1, len(w) + 1):
            found = [(paths[end - n][0] + scores[w[end - n : end]], -n, paths[end - n][1] + [ids[w[end - n : end]]]) for n in range(1, min(3, end) + 1) if w[end - n : end] in scores]
            found = found or [(paths[-1][0] - 1e12, -1, paths[-1][1] + [100 + b for b in w[end - 1].encode()])]
            top = max(found)
            paths.append((top[0], top[2]))
        return paths[-1][1]

    assert {r.word: r.ids for r in pieces.best_words(vocabulary, table, 100).collect()} == {w: best(w) for w in words}
