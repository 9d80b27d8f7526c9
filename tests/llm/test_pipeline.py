import corpus_pipeline
from loomgraph.llm import jaccard, mixing, pieces, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_what_their_operators_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) < 0.3]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows if (w := jaccard.shingle_words(r.text))}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in sets.items():
        for j, t in sets.items():
            if i < j and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    kept = {r.doc_id: secrets.redact(r.text) for r in rows if r.doc_id not in sets or root(r.doc_id) == r.doc_id}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= kept.keys()
    mixed = mixing.mix(spark.createDataFrame([(r.doc_id, kept[r.doc_id], r.source) for r in rows if r.doc_id in kept], "doc_id long, text string, source string"))
    size = {r.doc_id: r["size"] for r in mixed.collect()}
    want = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    source = {r.doc_id: r.source for r in rows}
    for s, target in want.items():
        mine = [size[r.doc_id] for r in got if source[r.doc_id] == s]
        assert abs(sum(mine) - target) <= max([v for i, v in size.items() if source[i] == s]) + 0.05 * target
    p = pieces._processor(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == p.encode(kept[r.doc_id]) for r in got)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if docs.columns != list(corpus_pipeline.COLUMNS):
            break
