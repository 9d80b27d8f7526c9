"""SentencePiece encoding and decoding over a relational lattice of a piece table."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffer, pack, string_codes, unpack
from .common import release, sliced, table

SPACE = "▁"
#: Words of more characters are merged by a queue instead of bit masks of 64-bit integers.
MASKED = 62
#: Bytes of texts whose distinct words are asked for together.
BLOCK = 10 << 20
#: Bytes of texts that are cut into words at a time.
PART = 1 << 20


def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score) of a model's ordinary pieces, U+2581 as a blank; as many as the vocabulary file has."""
    p = _processor(path)
    rows = [(p.id_to_piece(i).replace(SPACE, " "), i, p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def first_byte_id(path: str) -> int:
    return _processor(path).piece_to_id("<0x00>")


def joints(pieces: list[str]) -> np.ndarray:
    """Whether a piece holds two bytes side by side, at 256 * first + second; bytes of one character always do.

    Where two neighbouring bytes of a text have no such piece, no path of the lattice goes over the
    place between them, so it falls into words there: at blanks and breaks, beside most signs.
    """
    out = np.zeros(1 << 16, bool)
    out.reshape(256, 256)[:, 0x80:0xC0] = True
    for piece in pieces:
        raw = np.frombuffer(piece.encode(), np.uint8).astype(np.int64)
        out[raw[:-1] * 256 + raw[1:]] = True
    return out


def _words(column: pa.Array, joined: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words as they come up, their codes, number of each word among them, words of each text)."""
    if pc.any(pc.match_substring(column, SPACE)).as_py():
        column = pc.replace_substring(column, SPACE, " ")
    raw, at = buffer(column)
    full = np.flatnonzero(np.diff(at))
    raw = np.insert(raw, at[full], 32)
    at = at + np.searchsorted(full, np.arange(len(at)))
    if not len(raw):
        return pa.array([], pa.string()), np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(len(column), np.int64)
    first = np.empty(len(raw) + 1, bool)
    first[1:-1] = ~joined[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
    first[at] = True
    bound = np.flatnonzero(first)
    codes = pa.array(string_codes(raw, bound[:-1])).dictionary_encode()
    every = pa.LargeStringArray.from_buffers(len(bound) - 1, pa.py_buffer(bound), pa.py_buffer(raw))
    return every.take(pa.array(_firsts(codes))).cast(pa.string()), codes.dictionary.to_numpy(), codes.indices.to_numpy(), np.diff(np.searchsorted(bound[:-1], at))


def _firsts(codes: pa.DictionaryArray) -> np.ndarray:
    """The first place of each code; they are numbered as they come up."""
    return np.searchsorted(np.maximum.accumulate(codes.indices.to_numpy()), np.arange(len(codes.dictionary)))


def words_of(column: pa.Array, joined: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in order, number of each word among them, n + 1 bounds of each text's words).

    Texts get a leading blank and read U+2581 as one; a text's words joined are the text. An empty or
    null one has none. Words are told apart by 64-bit codes. Texts are cut a few at a time, as what is
    held for that is many times their size; of each time only the distinct words and the numbers stay.
    """
    column = pc.fill_null(column, "")
    parts = [_words(some.column(0), joined) for some in sliced(pa.RecordBatch.from_arrays([column], names=["text"]), PART)]
    if not parts:
        return pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)
    codes = pa.array(np.concatenate([p[1] for p in parts])).dictionary_encode()
    kinds = pa.concat_arrays([p[0] for p in parts]).take(pa.array(_firsts(codes)))
    order = pc.sort_indices(kinds).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    place = np.split(place[codes.indices.to_numpy()], np.cumsum([len(p[1]) for p in parts])[:-1])
    number = np.concatenate([own[p[2]] for own, p in zip(place, parts)])
    return kinds.take(pa.array(order)), number, np.r_[0, np.cumsum(np.concatenate([p[3] for p in parts]))]


def _bytes_of(char: Column, byte0: int) -> Column:
    hexes = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda i: (F.conv(F.substring(hexes, i, F.lit(2)), 16, 10) + byte0).cast("int"))


def edges_of(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, start, len and the piece's other columns) of all pieces in the words, and of each character
    without one (nulls). A column `w`, equal to `word`, is read in its place if there is one."""
    width = pieces.agg(F.coalesce(F.max(F.length("piece")), F.lit(1))).first()[0]
    text = "w" if "w" in vocabulary.columns else "word"
    at = vocabulary.select("word", F.col(text).alias("w"), F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("start"))
    cut = at.select("word", "w", "start", F.explode(F.sequence(F.lit(1), F.least(F.length("w") - F.col("start"), F.lit(width)))).alias("len"))
    cut = cut.withColumn("piece", F.substring("w", F.col("start") + 1, F.col("len")))
    rest = [c for c in pieces.columns if c != "piece"]
    return cut.join(F.broadcast(pieces), "piece", "left").where(F.col(rest[0]).isNotNull() | (F.col("len") == 1)).select("word", "start", "len", *rest)


def _ids(word: Column, chosen: Column, byte0: int) -> Column:
    """The ids of the chosen edges, characters without a piece in bytes."""
    return F.flatten(F.transform(chosen, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(_bytes_of(F.substring(word, e["start"] + 1, F.lit(1)), byte0))))


def _derived(pieces: list) -> tuple[list, bool]:
    """The pieces that merging their own characters gives, and whether each comes after its parts.

    Bounds are never put back, so what lies between two bounds merges as if it stood alone: other
    pieces never come up, and if each comes after its parts, one turn through all edges in order of
    score does all merges.
    """
    cost = {r.piece: -r.score for r in pieces}
    some, rising = [], True
    for r in pieces:
        symbols, done = list(r.piece), []
        while len(symbols) > 1 and (free := [(cost[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in cost]):
            c, k = min(free)
            done.append(c)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        if len(symbols) == 1:
            some.append(r)
            rising &= all(c <= cost[r.piece] for c in done)
    return some, rising


def merged_words(vocabulary: DataFrame, pieces: DataFrame, byte0: int) -> DataFrame:
    """(word, ids) of distinct words of up to MASKED characters, as a merging model has them.

    The fold's state is the set of the symbols' bounds as bits. Lattice edges come in order of score
    (ties: leftmost); one that spans just two symbols drops the bound between them. Models in which
    a piece comes before its parts take the best such edge at each step instead.
    """
    some, rising = _derived(pieces.collect())
    if any(len(r.piece) > 31 for r in some):
        raise ValueError("pieces of more than 31 characters do not fit the masks")
    some.sort(key=lambda r: -r.score)
    # An edge is one integer: place in the order of score, start and length.
    order, place = {}, -1
    for k, r in enumerate(some):
        place = k if k == 0 or r.score != some[k - 1].score else place
        order[r.piece] = place
    table = pieces.sparkSession.createDataFrame([(r.piece, order[r.piece] << 11, k) for k, r in enumerate(some)], "piece string, first long, k int")
    bounds_of = [(s, n) for s in range(64) for n in range(32)]
    ends = _constants([(1 << s | 1 << (s + n)) & (1 << 63) - 1 for s, n in bounds_of], "bigint")
    inner = _constants([((1 << n) - 2 << s) & (1 << 63) - 1 if n > 1 else 0 for s, n in bounds_of], "bigint")
    ids = _constants([r.id for r in some], "int")
    none = len(some)
    spot = F.col("start") * 32 + F.col("len")
    text = "w" if "w" in vocabulary.columns else "word"
    edges = edges_of(vocabulary.where(F.length(text) <= MASKED), table)
    edges = edges.select("word", F.coalesce(F.col("first") + spot, spot).alias("e"), F.struct(spot.cast("int").alias("spot"), F.coalesce("k", F.lit(none)).alias("k")).alias("x"))
    edges = edges.select("word", (F.col("e") * (1 << 20) + F.col("x.k")).alias("e"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("es"))
    every = F.expr("shiftleft(1L, length(word) + 1) - 1L")

    def spot_of(e):
        return F.shiftright(e, 20).bitwiseAND(2047).cast("int")

    def free(bounds, e):
        return (bounds.bitwiseAND(ends[spot_of(e)]) == ends[spot_of(e)]) & (F.bit_count(bounds.bitwiseAND(inner[spot_of(e)])) == 1)

    def drop(bounds, e):
        return bounds.bitwiseAND(F.bitwise_not(inner[spot_of(e)]))

    def best(bounds, _):
        found = F.filter("es", lambda e: free(bounds, e))
        return F.when(F.size(found) > 0, drop(bounds, found[0])).otherwise(bounds)

    if rising:
        bounds = F.aggregate("es", every, lambda b, e: F.when(free(b, e), drop(b, e)).otherwise(b))
    else:
        bounds = F.aggregate(F.sequence(F.lit(1), F.length("word")), every, best)
    folded = grouped.withColumn("bounds", bounds)
    b = F.col("bounds")
    left = F.filter("es", lambda e: (b.bitwiseAND(inner[spot_of(e)]) == 0) & (b.bitwiseAND(ends[spot_of(e)]) == ends[spot_of(e)]))
    path = F.sort_array(F.transform(left, lambda e: F.shiftright(e, 25).bitwiseAND(63) * (1 << 20) + e.bitwiseAND((1 << 20) - 1)))

    def piece(x):
        return x.bitwiseAND((1 << 20) - 1).cast("int")

    spelled = F.flatten(F.transform(path, lambda x: F.when(piece(x) < none, F.array(ids[piece(x)])).otherwise(_bytes_of(F.substring(F.col("word"), F.shiftright(x, 20).cast("int") + 1, F.lit(1)), byte0))))
    plain = F.transform(path, lambda x: ids[piece(x)])
    return folded.select("word", F.when(F.exists(path, lambda x: piece(x) == none), spelled).otherwise(plain).alias("ids"))


def _constants(values: list[int], kind: str) -> Column:
    """The values as one constant array."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


class Queue:
    """The same for a word of any length, by a queue of the neighbouring symbols that form a piece."""

    def __init__(self, pieces: list, byte0: int):
        self.known, self.byte0 = {r.piece: (-r.score, r.id) for r in pieces}, byte0

    def ids(self, word: str) -> list[int]:
        n = len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i):
            j = after[i]
            if j < n and (found := self.known.get(word[i : end[j]])):
                heapq.heappush(queue, (found[0], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, stop = heapq.heappop(queue)
            if end[i] != j or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            found = self.known.get(word[i : end[i]])
            out += [found[1]] if found else [self.byte0 + b for b in word[i : end[i]].encode()]
            i = end[i]
        return out


def best_words(vocabulary: DataFrame, pieces: DataFrame, byte0: int) -> DataFrame:
    """(word, ids) of distinct words as a model of piece probabilities has them: Viterbi's path of the
    greatest summed score, the shortest last piece on ties; a spelled character costs more than any piece."""
    width = pieces.agg(F.coalesce(F.max(F.length("piece")), F.lit(1))).first()[0]
    edge = F.struct((F.col("start") + F.col("len")).alias("end"), F.struct("len", F.coalesce("score", F.lit(-1e12)).alias("score"), "start", "id").alias("e"))
    ends = edges_of(vocabulary, pieces).select("word", edge.alias("x")).groupBy("word", F.col("x.end").alias("end")).agg(F.array_sort(F.collect_list("x.e")).alias("es"))
    grouped = ends.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "es"))).alias("ends"))
    path = "array<struct<start:int,id:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.array().cast(path).alias("path")))

    def step(state, end):
        reach = F.transform(end["es"], lambda e: F.struct((F.element_at(state, -e["len"])["s"] + e["score"]).alias("s"), (-e["len"]).alias("short"), F.struct(e["start"].alias("start"), e["id"].alias("id")).alias("e")))
        best = F.array_max(reach)
        longer = F.concat(F.element_at(state, best["short"])["path"], F.array(best["e"]))
        return F.slice(F.concat(state, F.array(F.struct(best["s"].alias("s"), longer.alias("path")))), F.greatest(F.lit(1), F.size(state) + 2 - width), width)

    chosen = F.aggregate("ends", start, step, lambda s: F.element_at(s, -1)["path"])
    return grouped.select("word", _ids(F.col("word"), chosen, byte0).alias("ids"))


def encode(docs: DataFrame, path: str, words=merged_words) -> DataFrame:
    """doc_id, n_pieces, ids of every row of docs(doc_id, text), as the library encodes a merging model.

    Null and empty texts have no ids; texts and words of any length are taken whole; repeated rows
    keep one result each, null ids included; an empty table gives an empty result; other columns
    are not read.

    Each block of texts asks for its distinct words by number. Every word is folded once, and its ids
    return to the blocks that asked; only the numbers of the words travel with the texts. `words`
    folds the lattice: merged_words, or best_words for a model of piece probabilities; words too long
    for its masks are merged by a queue. `docs` must give the same rows in the same partitions each
    time it is read, as files do; if it does not, this fails.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    pieces, byte0 = piece_table(spark, path), first_byte_id(path)
    rows = pieces.collect()
    joined, queue = joints([r.piece for r in rows]), spark.sparkContext.broadcast(Queue(rows, byte0))

    def marked(some) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
        """The words of a block, and a mark of these and of its first row."""
        kinds, numbers, bounds = words_of(some.column("text"), joined)
        raw, at = buffer(kinds)
        mark = xxhash.xxh3_64_intdigest(raw.tobytes() + at.tobytes(), seed=some.column("row")[0].as_py())
        return kinds, numbers, bounds, int(np.uint64(mark).astype(np.int64))

    def ask(batches):
        release()
        for batch in batches:
            for some in sliced(batch, BLOCK):
                kinds, _, _, mark = marked(some)
                yield pa.RecordBatch.from_arrays([kinds, pa.array(np.full(len(kinds), mark)), pa.array(np.arange(len(kinds), dtype=np.int32))], names=["word", "block", "number"])
                del kinds
                release()

    asked = docs.select("text", "row").mapInArrow(ask, "word string not null, block long, number int").repartition("word")
    # The distinct words come from the exchange of the requests: all its columns are used here, and no
    # filter on `w` can be pushed to below it.
    kinds = asked.groupBy("word").agg(F.min("number").alias("n"), F.min("block").alias("b"))
    folded = words(kinds.select("word", F.when((F.col("n") >= 0) & F.col("b").isNotNull(), F.col("word")).alias("w")), pieces, byte0)

    def answer(batches):
        release()
        found = []
        for batch in batches:
            ids, word = batch.column("ids"), batch.column("word")
            late = np.flatnonzero(~ids.is_valid().to_numpy(zero_copy_only=False)).tolist()
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy().astype(np.int32)
            for i in late:
                more = np.array(queue.value.ids(word[i].as_py()), np.int32)
                at = int(size[:i].sum())
                flat, size[i] = np.r_[flat[:at], more, flat[at:]], len(more)
            found.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), size, flat))
        if not found:
            return
        block, number, size, flat = (np.concatenate([f[k] for f in found]) for k in range(4))
        if not len(block):
            return
        start = np.cumsum(size) - size
        order = np.lexsort((number, block))
        cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            n = size[at]
            ids = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            packed = pack(np.diff(number[at], prepend=0).astype(np.uint32), n.astype(np.uint32), ids.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([block[at[0]]], pa.int64()), pa.array([packed], pa.binary()), pa.array([None], pa.binary())], names=["block", "pieces", "texts"])

    answers = asked.join(folded, "word", "left").select("word", "block", "number", "ids").mapInArrow(answer, "block long, pieces binary, texts binary")

    def number(batches):
        release()
        for batch in batches:
            for some in sliced(batch, BLOCK):
                kinds, numbers, bounds, mark = marked(some)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", some.column("doc_id").type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([some.column("doc_id")], names=["doc_id"]))
                names = np.frombuffer(sink.getvalue(), np.uint8)
                texts = pack(names, np.array([len(kinds)], np.uint32), np.diff(bounds).astype(np.uint32), numbers.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), pa.array([None], pa.binary()), pa.array([texts], pa.binary())], names=["block", "pieces", "texts"])
                del kinds, numbers, bounds, names, texts
                release()

    numbered = docs.mapInArrow(number, "block long, pieces binary, texts binary")

    def assemble(batches):
        release()
        answered: dict[int, list[bytes]] = {}
        texts: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                (answered if p is not None else texts).setdefault(block, []).append(p if p is not None else t)
        for block, some in texts.items():
            got = [unpack(p) for p in answered.pop(block, [])]
            order = np.concatenate([np.cumsum(g[0]) for g in got]) if got else np.empty(0, np.int64)
            size, ids = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.uint32) for k in (1, 2))
            start = np.cumsum(size, dtype=np.int64) - size
            place = np.argsort(order)
            start, size = start[place], size[place].astype(np.int64)
            for one in some:
                names, kinds, lengths, stream = unpack(one)
                if len(order) != kinds[0]:
                    raise ValueError("the texts changed between two reads")
                doc_ids = pa.ipc.open_stream(pa.py_buffer(names)).read_all()["doc_id"].combine_chunks()
                doc_ids = doc_ids.chunk(0) if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
                bounds = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
                cuts = [0, *(np.flatnonzero(np.diff(bounds[:-1] // 500_000)) + 1).tolist(), len(lengths)]
                for lo, hi in zip(cuts, cuts[1:]):
                    w = stream[bounds[lo] : bounds[hi]]
                    n = size[w]
                    flat = ids[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int32)
                    upto = np.r_[0, np.cumsum(n)][bounds[lo : hi + 1] - bounds[lo]]
                    column = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array(np.diff(upto)), column], names=["doc_id", "n_pieces", "ids"])

    both = answers.unionByName(numbered).repartition("block")
    return both.mapInArrow(assemble, f"doc_id {kind.simpleString()}, n_pieces long, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `text` (replaced if there is one), the text their ids stand for; null for null, empty for none."""

    @F.pandas_udf("string")
    def text(column):
        p = _processor(path)
        return column.map(lambda x: p.decode([int(i) for i in x]), na_action="ignore")

    return rows.withColumn("text", text(ids))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the supplied model: how many pieces, and a digest of their ids."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
