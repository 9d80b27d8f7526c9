import math
import zlib
from collections import Counter

import pytest

from loomgraph.llm import katz
from loomgraph.llm.common import UPPER, WORD_RE

SF = "/root/testdata/sf0.001"


class Plain:
    """The model over Python dictionaries."""

    def __init__(self, seqs):
        self.uni = Counter(w for s in seqs for w in s)
        self.big = Counter(p for s in seqs for p in zip(["\n"] + s[:-1], s))
        self.n = sum(self.uni.values())
        d1, self.d2 = katz.discounts(Counter(self.uni.values())), katz.discounts(Counter(self.big.values()))
        freed = sum((1 - self.d(d1, c)) * c for c in self.uni.values())
        total = self.n + (freed <= 0)
        self.unseen = (freed if freed > 0 else 1) / total
        self.p1 = {w: self.d(d1, c) * c / total for w, c in self.uni.items()}
        after = {}
        for (h, w), c in self.big.items():
            after.setdefault(h, {})[w] = c
        self.history = {}
        for h, ws in after.items():
            ch, freed = sum(ws.values()), sum((1 - self.d(self.d2, c)) * c for c in ws.values())
            ch, freed = (ch, freed) if freed > 0 else (ch + 1, 1)
            self.history[h] = ch, freed / ch / (1 - sum(self.p1[w] for w in ws))

    @staticmethod
    def d(ratios, c):
        return ratios[c] if c <= katz.K else 1.0

    def p(self, h, w):
        if (h, w) in self.big:
            return self.d(self.d2, self.big[h, w]) * self.big[h, w] / self.history[h][0]
        return (self.history[h][1] if h in self.history else 1) * self.p1.get(w, self.unseen)


def words(text):
    return [*WORD_RE.findall((text or "").translate(UPPER)), "\n"]


@pytest.mark.parametrize(("frequent", "tokens"), [(500_000, 2_000_000), (300, 5_000)])
def test_scores_match_the_plain_model(spark, monkeypatch, frequent, tokens):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    monkeypatch.setattr(katz, "PART_TOKENS", tokens)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    model = Plain([words(t) for i, t in rows if not held[i]])
    kinds = len(model.uni)
    got = {r.doc_id: r for r in katz.op9_katz(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ws, r = words(t), got[i]
        base = sum(math.log10((model.uni[w] + 0.5) / (model.n + 0.5 * (kinds + 1))) for w in ws)
        score = sum(math.log10(model.p(h, w)) for h, w in zip(["\n"] + ws[:-1], ws))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in model.uni for w in ws), model.n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 1e-6 * abs(score)
    for h in list(model.history)[:50]:
        assert abs(sum(model.p(h, w) for w in model.uni) + model.p(h, "never seen") - 1) < 1e-9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (4, "one two"), (None, "one two"), (5, "a b c " * 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    found = katz.score(docs, katz.F.lit(False)).collect()
    assert len(found) == 7 and all(r.score <= 0 for r in found) and sorted(r.n_tokens for r in found) == [1, 1, 1, 3, 3, 3, 15001]
    assert {r.score for r in katz.score(docs, katz.F.lit(True)).collect()} == {0.0}
    assert katz.score(docs.limit(0), katz.F.lit(False)).count() == 0
