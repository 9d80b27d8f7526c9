"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import collections
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import WORD_RE, map_columns, table

#: Distinct chunks whose counts a worker keeps, and their longest; past it the store starts anew.
KEPT = 500_000
LONGEST_KEPT = 64
#: Characters of the texts whose chunks are held at a time (a longer text is a block of its own).
BLOCK = 4_000_000


class Merger:
    """Counts of a byte-level BPE file with word ends: its own normaliser and pre-tokens, merged here."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normal, self.pre = whole.normalizer, whole.pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(self.vocab.values()) + 1
        keys = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.store: dict[str, int] = {}

    def merge(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each pre-token, all pre-tokens side by side.

        Each turn gives every sequence the lowest rank among its adjacent pairs and merges all of
        that pair's occurrences, from the left where they overlap. A pair with a new symbol always
        has a later rank, so the order of the turns is that of one merge at a time.
        """
        symbols = [[*p[:-1], p[-1] + self.end] for p in pieces]
        flat = np.array([self.vocab[s] for w in symbols for s in w], np.int64)
        seq = np.repeat(np.arange(len(pieces)), [len(w) for w in symbols])
        count = np.zeros(len(pieces), np.int64)
        none = len(self.made)
        while len(flat):
            rank = np.full(len(flat), none)
            if len(flat) > 1:
                key = flat[:-1] * self.width + flat[1:]
                at = np.minimum(np.searchsorted(self.keys, key), none - 1)
                rank[:-1] = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(rank, starts)
            done = np.repeat(lowest == none, lengths)
            count[seq[starts[lowest == none]]] = lengths[lowest == none]
            hit = (rank == np.repeat(lowest, lengths)) & ~done
            spot = np.flatnonzero(hit)
            if len(spot):
                first = np.r_[True, np.diff(spot) != 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(spot)), 0))
                spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
                flat[spot] = self.made[rank[spot]]
                done[spot + 1] = True
            flat, seq = flat[~done], seq[~done]
        return count

    def measure(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk; special strings count one and are cut out first."""
        extra, found = [], []
        for chunk in chunks:
            parts = self.special.split(chunk)
            extra.append(len(parts) - 1)
            found.append([w for part in parts if part for w, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part))])
        distinct = list({w for pre in found for w in pre})
        left = dict(zip(distinct, self.merge(distinct).tolist()))
        return [n + sum(map(left.__getitem__, pre)) for n, pre in zip(extra, found)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, as the sum over its chunks between ASCII white space.

        Neither a pre-token nor a special string holds white space, and no normal form joins
        characters over it, so chunks count on their own; a chunk seen before is looked up.
        """
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < BLOCK:
                size += len(texts[end] or "")
                end += 1
            found = [WORD_RE.findall(t) if t else [] for t in texts[at:end]]
            if len(self.store) > KEPT:
                self.store.clear()
            new = list({w for chunks in found for w in chunks} - self.store.keys())
            known = dict(zip(new, self.measure(new)))
            self.store.update((w, n) for w, n in known.items() if len(w) <= LONGEST_KEPT)
            known = collections.ChainMap(self.store, known) if any(len(w) > LONGEST_KEPT for w in new) else self.store
            out += [sum(map(known.__getitem__, chunks)) for chunks in found]
            at = end
        return out


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null and empty texts have 0 of each.

    path names the vocabulary on every node. Ties and repeated rows stay as they are.
    """

    def batch(ids, texts):
        counts = merger(path).counts(texts)
        return ids, [len((t or "").encode()) for t in texts], counts, [c > limit for c in counts]

    return map_columns(docs, ["doc_id", "text"], batch, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
