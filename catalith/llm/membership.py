"""Whether a key was seen before: Elias-Fano encoded partitions of hashed keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import longs
from catalith.session import cut, width

_U = np.uint64
_BLOCK = 65_536
_TASK = 1_000_000


def _select_bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th (from 0) set bit of each word."""
    place = np.zeros(len(words), np.uint64)
    rest, rank = words.copy(), rank.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = rest & _U((1 << step) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rank >= count
        rank = np.where(up, rank - count, rank)
        place = np.where(up, place + _U(step), place)
        rest = np.where(up, rest >> _U(step), low)
    return place.astype(np.int64)


@dataclass
class EliasFano:
    """A sorted set of numbers below 2 ** bits: the high bits of each in unary, its low bits packed.

    zeros[w] is the number of zero bits before word w of upper, so that the members with given high bits are found
    without decoding. Per member about 2 + log2(2 ** bits / size) bits are kept.
    """

    size: int
    bits: int
    low_bits: int
    upper: np.ndarray
    lower: np.ndarray
    zeros: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, bits: int) -> EliasFano:
        """values: uint64, sorted, without repeats, below 2 ** bits."""
        n = len(values)
        low_bits = max(0, bits - max(1, n).bit_length())
        highs = (values >> _U(low_bits)).astype(np.int64) if n else np.empty(0, np.int64)
        unary = np.zeros(-(-(n + (1 << (bits - low_bits)) + 1) // 64) * 64, bool)
        unary[highs + np.arange(n)] = True
        upper = np.packbits(unary, bitorder="little").view(_U)
        lower = np.zeros(-(-n * low_bits // 64) + 1, _U)
        if low_bits and n:
            low = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, off = at >> 6, (at & 63).astype(_U)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lower[word[starts]] = np.bitwise_or.reduceat(low << off, starts)
            over = off.astype(np.int64) + low_bits > 64
            lower[word[over] + 1] |= low[over] >> (_U(64) - off[over])
        zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))]
        return cls(n, bits, low_bits, upper, lower, zeros)

    @property
    def nbytes(self) -> int:
        return self.upper.nbytes + self.lower.nbytes + self.zeros.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(_U)
        after = self.lower[np.minimum(word + 1, len(self.lower) - 1)]
        both = (self.lower[word] >> off) | ((after << _U(1)) << (_U(63) - off))
        return both & _U((1 << self.low_bits) - 1)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many members have high bits below each of high."""
        word = np.searchsorted(self.zeros, high - 1, side="right") - 1
        word = np.clip(word, 0, len(self.upper) - 1)
        place = word * 64 + _select_bit(~self.upper[word], high - 1 - self.zeros[word])
        return np.where(high == 0, 0, place - (high - 1))

    def contains(self, values: np.ndarray) -> np.ndarray:
        """Whether each value is a member: the successor is searched for among those with the same high bits."""
        if not self.size or not len(values):
            return np.zeros(len(values), bool)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        want = values & _U((1 << self.low_bits) - 1)
        lo, end = self._below(high), self._below(high + 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = self._low(lo[found]) == want[found]
        return found

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        i = np.arange(self.size, dtype=np.int64)
        return ((ones - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def merge(self, values: np.ndarray) -> EliasFano:
        """The set with more members: sorted, without repeats, none of them in it yet."""
        both = np.concatenate([self.decode(), values])
        both.sort(kind="stable")  # two sorted runs
        return EliasFano.encode(both, self.bits)


def _own_bits(stored: np.ndarray, part_bits: int) -> np.ndarray:
    return stored.view(_U) & _U((1 << (64 - part_bits)) - 1)


def fingerprint(key: Column) -> Column:
    """64 bits of a key; null for a null key."""
    return F.when(key.isNotNull(), F.xxhash64(key))


def _part(part_bits: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 64 - part_bits).cast("long")


def part_bits_for(spark, keys: int, part_keys: int = 250_000) -> int:
    """Enough partitions that each holds about part_keys keys, and some for each core."""
    return max(1, min(40, (max(-(-keys // part_keys), 4 * width(spark)) - 1).bit_length()))


def _first_in_task(spread: int):
    """Marks, before the shuffle, the rows whose key the same task has met in an earlier row: they are found for certain."""

    def flush(order: list, keys: list) -> pa.RecordBatch:
        order, keys = np.concatenate(order), np.concatenate(keys)
        _, group = np.unique(keys, return_inverse=True)
        first = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(first, group, order)
        again = order > first[group]
        return pa.RecordBatch.from_arrays([pa.array(order), pa.array(keys), pa.array(np.where(again, -1 - order % spread, 0))], names=["row_no", "fp", "again"])

    def run(batches):
        order, keys, held = [], [], 0
        for batch in batches:
            order.append(longs(batch.column(0))[0])
            keys.append(longs(batch.column(1))[0])
            held += batch.num_rows
            if held >= _TASK:
                yield flush(order, keys)
                order, keys, held = [], [], 0
        if held:
            yield flush(order, keys)

    return run


def _once_in_task(batches):
    """The different keys among each million or so of a task's, so that a key in very many rows leaves it as few."""
    keys, held = [], 0
    for batch in batches:
        keys.append(longs(batch.column(0))[0])
        held += batch.num_rows
        if held >= _TASK:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)))], names=["fp"])
            keys, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)))], names=["fp"])


_INDEX = "part long, part_bits int, keys long, low_bits int, upper binary, lower binary"
_INDEX_ARROW = pa.schema([("part", pa.int64()), ("part_bits", pa.int32()), ("keys", pa.int64()), ("low_bits", pa.int32()), ("upper", pa.binary()), ("lower", pa.binary())])


def _stored(code: EliasFano, part: int) -> pa.Table:
    row = [part, 64 - code.bits, code.size, code.low_bits, code.upper.tobytes(), code.lower.tobytes()]
    return pa.table([[x] for x in row], schema=_INDEX_ARROW)


def _loaded(table: pa.Table, part_bits: int) -> EliasFano:
    """The code of a partition, an empty one where the index has none."""
    if not len(table):
        return EliasFano.encode(np.empty(0, _U), 64 - part_bits)
    upper, lower = (np.frombuffer(table[c][0].as_py(), _U) for c in ("upper", "lower"))
    zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))]
    return EliasFano(table["keys"][0].as_py(), 64 - part_bits, table["low_bits"][0].as_py(), upper, lower, zeros)


def _pass(index: EliasFano, rows: pa.Table, part_bits: int) -> tuple[EliasFano, np.ndarray, int, float]:
    """Goes through a partition's rows in order, a block at a time: probe, then merge what is new.

    Returns the new code, the numbers of the rows found, the probes made and the expected number of wrong answers.
    """
    again = longs(rows["again"])[0] < 0 if len(rows) else np.zeros(0, bool)
    order, fps = longs(rows["row_no"])[0], longs(rows["fp"])[0]
    found, probes, odds = [order[again]], 0, again.sum() * _TASK / 2.0**64
    by = np.argsort(order[~again], kind="stable")
    order, values = order[~again][by], _own_bits(fps[~again][by], part_bits)
    for at in range(0, len(order), _BLOCK):
        block, numbers = values[at : at + _BLOCK], order[at : at + _BLOCK]
        seen = index.contains(block)
        uniq, first, group = np.unique(block[~seen], return_index=True, return_inverse=True)
        repeat = first[group] != np.arange(len(group))
        odds += len(block) * (index.size + len(uniq)) / 2.0 ** (64 - part_bits)
        probes += len(block)
        hits = seen.copy()
        hits[np.flatnonzero(~seen)[repeat]] = True
        found.append(numbers[hits])
        index = index.merge(uniq)
    return index, np.concatenate(found), probes, odds


def _scan(part_bits: int, want: str):
    """For a partition's known keys (or their code) and rows: the rows found, what they cost, or the code with them."""

    def run(known: pa.Table, rows: pa.Table) -> pa.Table:
        if "upper" in known.column_names:
            index = _loaded(known, part_bits)
        else:
            held = np.unique(_own_bits(longs(known["fp"])[0], part_bits)) if len(known) else np.empty(0, _U)
            index = EliasFano.encode(held, 64 - part_bits)
        index, found, probes, odds = _pass(index, rows, part_bits)
        part = longs((known if len(known) else rows)["part"])[0][0]
        if want == "report":
            return pa.table({"part": [part], "keys": [index.size], "index_bytes": [index.nbytes], "probes": [probes], "found": [len(found)], "wrong_bound": [odds]})
        rows = pa.table({"row_no": pa.array(found)})
        if want == "rows":
            return rows
        code = _stored(index, part) if part >= 0 else _INDEX_ARROW.empty_table()
        return code if want == "index" else pa.concat_tables([rows, code], promote_options="default").select([*_INDEX_ARROW.names, "row_no"])

    return run


_OUT = {"rows": "row_no long", "report": "part long, keys long, index_bytes long, probes long, found long, wrong_bound double", "index": _INDEX, "both": f"{_INDEX}, row_no long"}


def _dealt(rows: DataFrame, key: str, order: str, part_bits: int) -> DataFrame:
    slim = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("long").alias("row_no"), fingerprint(F.col(key)).alias("fp"))
    marked = slim.mapInArrow(_first_in_task(4 * width(rows.sparkSession)), "row_no long, fp long, again long")
    return marked.select(F.when(F.col("again") < 0, F.col("again")).otherwise(_part(part_bits)).alias("part"), "row_no", "fp", "again")


def _seen(known: DataFrame, rows: DataFrame, key: str, order: str, want: str, part_keys: int) -> DataFrame:
    part_bits = part_bits_for(rows.sparkSession, known.count() + rows.count(), part_keys)
    keys = known.where(F.col(key).isNotNull()).select(fingerprint(F.col(key)).alias("fp"))
    stored = keys.mapInArrow(_once_in_task, "fp long").select(_part(part_bits).alias("part"), "fp")
    return stored.groupBy("part").cogroup(_dealt(rows, key, order, part_bits).groupBy("part")).applyInArrow(_scan(part_bits, want), _OUT[want])


def seen_before(known: DataFrame, rows: DataFrame, key: str, order: str, part_keys: int = 250_000) -> DataFrame:
    """The rows whose key is among the known ones or in a row before: row_no BIGINT, the row's value of order.

    known holds BINARY keys in a column named key, rows has them with a unique number of order. A row with a null key
    or a null number is never found and counts for no other. Repeated known keys count once. Other columns play no
    part; either side may be empty.

    Keys are hashed to 64 bits and cut into partitions of about part_keys by their top bits. In each, the known keys
    are held in an Elias-Fano code; the rows are taken in their order, a block at a time, each probed by a search for
    its successor, and the new keys of the block are merged into the code. A row is wrongly found only if another key
    has the same 64 bits: with k keys before it the odds are below k / 2 ** 64; no row is wrongly missed. seen_report
    sums these odds. A row that repeats a key which its own task has met in an earlier row is found without a probe and
    spread over the partitions by its number, and known keys leave the task that reads them once, so a key with a third
    of all rows on either side is not gathered in one task.
    """
    return _seen(known, rows, key, order, "rows", part_keys)


def seen_report(known: DataFrame, rows: DataFrame, key: str, order: str, part_keys: int = 250_000) -> DataFrame:
    """One row: keys, index_bytes, bits_per_key, probes, found, wrong_bound (expected number of wrong answers) and wrong_rate."""
    parts = _seen(known, rows, key, order, "report", part_keys)
    total = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("keys", "index_bytes", "probes", "found")), F.coalesce(F.sum("wrong_bound"), F.lit(0.0)).alias("wrong_bound"))
    return total.withColumns({"bits_per_key": 8 * F.col("index_bytes") / F.nullif("keys", F.lit(0)), "wrong_rate": F.col("wrong_bound") / F.nullif("probes", F.lit(0))})


def key_index(known: DataFrame, rows: DataFrame, key: str, order: str, part_keys: int = 250_000) -> DataFrame:
    """The index of all keys of known and rows, to be stored: one row a partition, its code as bytes."""
    return _seen(known, rows, key, order, "index", part_keys)


def split_index(index: DataFrame, bits: int) -> DataFrame:
    """An index with each partition cut into 2 ** bits by the next bits of its keys."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                part, part_bits = row["part"][0].as_py(), row["part_bits"][0].as_py()
                values = _loaded(row, part_bits).decode()
                own = 64 - part_bits - bits
                child = values >> _U(own)
                for c in np.unique(child):
                    code = EliasFano.encode(values[child == c] & _U((1 << own) - 1), own)
                    yield from _stored(code, (part << bits) | int(c)).to_batches()

    return index.select(*_INDEX_ARROW.names).mapInArrow(run, _INDEX)


def probe_index(index: DataFrame, rows: DataFrame, key: str, order: str, part_keys: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """The rows of a new batch seen before, as of seen_before, and the index with their keys.

    index is one made by key_index or by this function, not empty. Both results come from one pass, written once to the
    shared folder. An index of whose partitions one has grown to twice part_keys is split first, so that codes keep
    fitting a task.
    """
    part_bits, most = index.agg(F.first("part_bits"), F.max("keys")).first()
    if most > 2 * part_keys:
        more = (-(-most // part_keys) - 1).bit_length()
        index, part_bits = split_index(index, more), part_bits + more
    groups = index.groupBy("part").cogroup(_dealt(rows, key, order, part_bits).groupBy("part"))
    both = cut(groups.applyInArrow(_scan(part_bits, "both"), _OUT["both"]))
    return both.where(F.col("row_no").isNotNull()).select("row_no"), both.where(F.col("row_no").isNull()).drop("row_no")
