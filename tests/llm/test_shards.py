import hashlib
from pathlib import Path

import numpy as np

from loomgraph.llm import materialise as m

TEXTS = [(1, "a" * 3000), (2, "\0\n é\0"), (None, "no id"), (3, ""), (4, None), (4, "x" * 1024)] + [(k, f"text {k}\0") for k in range(5, 20)]


def test_shards_hold_every_slot_and_resume(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 0) for r in TEXTS], "doc_id long, text string, slot int").repartition(3).cache()
    path = str(tmp_path / "shards")
    n = m.write_shards(docs, path, shard_rows=4)
    want = sorted(str((i, k // 1024, (t or "").encode()[k : k + 1024])) for i, t in TEXTS for k in range(0, len((t or "").encode()), 1024))
    got = {r.slot: (r.doc_id, r.chunk, bytes(r.ids)) for r in m.read_shards(spark, path, shard_rows=4).collect()}
    assert n == len(want) and sorted(got) == list(range(n)) and sorted(map(str, got.values())) == want
    for slot in range(n):
        (file,) = Path(path, f"shard={slot // 4}").glob("part-*")
        row = np.frombuffer(file.read_bytes(), m.record_type(m.STRIDE))[slot % 4]
        assert (row["doc_id"] if row["known"] else None, row["chunk"], bytes(row["ids"][: row["used"]])) == got[slot]
    for first in (0, 1, 4, 7, n - 1, n):
        found = {r.slot: (r.doc_id, r.chunk, bytes(r.ids)) for r in m.read_shards(spark, path, first, shard_rows=4).collect()}
        assert found == {k: v for k, v in got.items() if k >= first}
    assert m.write_shards(docs.limit(0), str(tmp_path / "none")) == 0


def test_query_digests_what_was_written(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = m.op8_materialise(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and sum(r.n_bytes for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        part = docs[r.doc_id][r.chunk * m.STRIDE : (r.chunk + 1) * m.STRIDE]
        assert r.payload_sha256 == hashlib.sha256(part).hexdigest() and r.offset == r.slot % m.SHARD_ROWS * m.RECORD
