"""Encoding a corpus with a public byte-level BPE tokenizer.

A token sequence is what BPE's merges give exactly when every two adjacent tokens are compatible, that is, when
merging the bytes of both would have stopped at their border. So a text is encoded by taking the longest token at
each position and going back to a shorter one only where two neighbours aren't compatible. The tokens' bytes are
held as Latin-1 characters in an Aho-Corasick automaton; compatibility is remembered for each pair. Every position
is given up at most once, so the time is linear in the text, however long a word is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORD_MEMO = 200_000  #: words remembered by each worker
PAIR_MEMO = 2_000_000  #: pairs of tokens remembered by each worker
LONG_WORD = 64  #: longer words aren't remembered


def _byte_of_symbol() -> dict[str, str]:
    """The vocabulary's printable stand-ins for bytes, each with its byte as a Latin-1 character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(256 + n): chr(b) for n, b in enumerate(other)}


class Encoder:
    """Exact encoder of one vocabulary file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        symbol = _byte_of_symbol()

        def latin(token: str) -> str:
            return "".join(symbol[c] for c in token)

        vocab, model = {}, spec["model"]
        for token, i in model["vocab"].items():
            if token not in special:
                vocab[latin(token)] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        last = -1
        for left, right in merges:
            a, b = latin(left), latin(right)
            whole = vocab[a + b]
            if whole <= last:
                raise ValueError("the ids of the merges don't ascend in this vocabulary")
            last = whole
            self.merged[vocab[a], vocab[b]] = whole
            self.halves[whole] = (vocab[a], vocab[b])
        self.length = dict.fromkeys(vocab.values(), 0)
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.length[i] = len(token)
            self.automaton.add_word(token, (i, len(token)))
            for n in range(len(token) - 1, 0, -1):
                if (prefix := vocab.get(token[:n])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton.make_automaton()
        self.single = {c: vocab[c] for c in map(chr, range(256))}
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, run over the bytes of both, would leave just these two tokens."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' last merges, step by step; a merge across the border that comes
        before the one just undone would have been taken, so that the border couldn't be there."""
        undone = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            # Of merges of one rank the leftmost comes first: one across the border goes before its like in the
            # right token, but after its like in the left.
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one piece of the split, its bytes given as Latin-1 characters."""
        size = len(word)
        if size == 1:
            return [self.single[word]]
        best: list[int] = [-1] * size
        reach = [0] * size
        for end, (i, n) in self.automaton.iter(word):
            start = end - n + 1
            if n > reach[start]:
                reach[start], best[start] = n, i
        if reach[0] == size:  # every token of the vocabulary is what its own bytes merge to
            return [best[0]]
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, best[0]
        length, shorter = self.length, self.shorter
        while at < size:
            while True:
                end = at + length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = best[at] if at < size else -1
                    break
                smaller = shorter.get(token)
                if smaller is None:
                    dead[at] = 1
                    token = out.pop()
                    at -= length[token]
                    break
                token = smaller
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for piece in self.find(text):
            ids = words.get(piece)
            if ids is None:
                ids = self.encode_word(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= LONG_WORD:
                    if len(words) >= WORD_MEMO:
                        words.clear()
                    words[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file in each worker: the file at `path`, or else the one that came with the job."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Sends the vocabulary file along with the job, once for each context, so that only the driver must have it."""
    context = spark.sparkContext
    if os.path.exists(path) and path not in (shipped := getattr(context, "_jobmill_files", set())):
        context.addFile(path)
        context._jobmill_files = shipped | {path}


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_PATH) -> DataFrame:
    """`key` and `ids` (array<int>) of every row of `df`, ids by the vocabulary file at `path`, no special tokens.

    Null and empty texts give an empty array; rows with a null key are kept; repeated rows stay repeated; other
    columns of `df` are left out. No shuffle, no broadcast: one pass over the rows, in Arrow batches.
    """
    ship_vocabulary(df.sparkSession, path)
    schema = df.select(key).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = [np.asarray(enc.encode(t), dtype=np.int32) for t in batch.column(1).to_pylist()]
            yield from _packed(batch.column(0), lists, key)

    return df.select(key, text).mapInArrow(run, schema)


def _packed(keys: pa.Array, lists: list[np.ndarray], key: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `most` ids, so that long texts don't make huge ones."""
    start = size = 0
    for n, ids in enumerate([*lists, None]):
        if ids is None or (size + len(ids) > most and n > start):
            part = lists[start:n]
            offsets = np.zeros(len(part) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in part], out=offsets[1:])
            values = np.concatenate(part) if part else np.zeros(0, dtype=np.int32)
            if part or not lists:
                yield pa.RecordBatch.from_arrays([keys.slice(start, n - start), pa.ListArray.from_arrays(offsets, pa.array(values))], [key, "ids"])
            start, size = n, 0
        size += len(ids) if ids is not None else 0
