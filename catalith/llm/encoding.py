"""Encoding of texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of the vocabulary, white space being the Unicode property White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = 1 << 30
_LONG = 200
_KEPT = 150_000
_FLUSH = 2_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of a word, by a contiguous array of ranks.

    bounds holds where the parts begin, and the end; near[i] the rank of parts i and i + 1 together. The least rank
    (the first of equal ones) is looked for from end to end, its inner boundary deleted and the ranks on both sides of
    it made anew, until no two neighbours form a token.
    """
    bounds = list(range(len(word) + 1))
    get = ranks.get
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word, where repeated scans would cost the square of its length: a heap of ranks and linked parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], _NONE)) != _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := get(word[h:end], _NONE)) != _NONE:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Word -> token ids; words met before are kept, up to a bound on their number."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.words = regex.compile(SPLIT).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple((merge_short if len(raw) <= _LONG else merge_long)(raw, self.ranks))
        if len(raw) <= _LONG:
            if len(self) >= _KEPT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None):
        """The ids of a text one by one; none for an empty and for a null text."""
        return chain.from_iterable(map(self.__getitem__, self.words(text))) if text else ()


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, made once."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(read_ranks(shared.value))
    return _encoders[shared.id]


class _Shared:
    """A broadcast vocabulary and a number that tells it from others in a worker."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.id = hash((path, len(raw)))
        self.raw = spark.sparkContext.broadcast(raw)

    @property
    def value(self) -> bytes:
        return self.raw.value


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids ARRAY<INT>: the token ids of each row's text, without special tokens.

    What looks like a special token is plain text. An empty and a null text give an empty list, never null. Repeated
    rows come out as often as they stand; key may be null. Texts are encoded whole, whatever their length. Rows are
    independent: nothing is shuffled, and all that is sent to the executors is the vocabulary file (0.8 MB).
    """
    shared = _Shared(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            ids, ends, since = array("i"), [0], 0
            texts = batch.column(1)
            for i, text in enumerate(texts.to_pylist(), 1):
                ids.extend(encoder.encode(text))
                ends.append(len(ids))
                if len(ids) >= _FLUSH or i == len(texts):
                    values = pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(since, i - since), lists], names=[key, "ids"])
                    ids, ends, since = array("i"), [0], i

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text: str, to: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of df but text, and to BIGINT: the number of tokens of text, 0 for an empty and for a null one."""
    shared = _Shared(df.sparkSession, vocabulary)
    rest = [c for c in df.columns if c != text and c != to]
    schema = df.select(*rest).schema.add(to, "long")

    def run(batches):
        encoder = _encoder(shared)
        size = lambda s: sum(map(len, map(encoder.__getitem__, encoder.words(s)))) if s else 0
        for batch in batches:
            counts = pa.array([size(s) for s in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], counts], names=[*rest, to])

    return df.select(*rest, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str, to: str = "data", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of df but ids, and to BINARY: the bytes that token ids stand for; null for a null list. An id the vocabulary lacks is an error."""
    shared = _Shared(df.sparkSession, vocabulary)
    rest = [c for c in df.columns if c != ids and c != to]
    schema = df.select(*rest).schema.add(to, "binary")

    def run(batches):
        tokens = {rank: token for token, rank in _encoder(shared).ranks.items()}
        for batch in batches:
            data = [None if row is None else b"".join(map(tokens.__getitem__, row)) for row in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(data, pa.binary())], names=[*rest, to])

    return df.select(*rest, ids).mapInArrow(run, schema)
