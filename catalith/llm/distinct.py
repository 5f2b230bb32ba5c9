"""Distinct counts over huge identifier sets: registers of minimum exponential hash values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import longs, one

_U = np.uint64
REGISTERS = 1024
#: Levels: which of the two group columns a group fixes.
ALL, FIRST, SECOND, BOTH = 0, 1, 2, 3
_FLUSH = 400_000
#: Sketches with registers a task holds before it passes them on (of 4 KB each at 1,024 registers).
_HELD = 8192
_SALTS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser; its constants are fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def add_elements(registers: np.ndarray, group: np.ndarray, elements: np.ndarray) -> None:
    """Lowers registers (groups x m, float32) to what they are with the elements (uint64) of the groups.

    An element has, in each register, the first arrival of a Poisson process of rate 1: an exponential value that
    depends on the element alone. All its processes together are one of rate m whose arrivals fall on registers at
    random, so an element's values are made in rising order, and it is done when they exceed the greatest register of
    its group. A group of any size costs about its elements and m (ln m + 1) values more, not m values an element.
    """
    m = registers.shape[1]
    flat = registers.ravel()
    time = np.zeros(len(elements))
    state, step = _mix(elements.astype(_U)), 0
    while len(elements):
        state = state + _U(0x9E3779B97F4A7C15)
        drawn = _mix(state)
        time = time - np.log(((drawn >> _U(20)).astype(np.float64) + 0.5) * 2.0**-44) / m
        np.minimum.at(flat, group * m + (drawn & _U(m - 1)).astype(np.int64), time.astype(np.float32))
        step += 1
        if step % 4 == 0 or step < 4:
            live = time < registers.max(axis=1)[group]
            elements, group, time, state = elements[live], group[live], time[live], state[live]


@lru_cache
def gamma_quantile(shape: int, p: float) -> float:
    """The p-quantile of the gamma distribution with an integer shape and rate 1."""

    def below(x: float) -> float:  # 1 - P(Poisson(x) < shape)
        log_x = math.log(x)
        return 1 - math.fsum(math.exp(k * log_x - x - math.lgamma(k + 1)) for k in range(shape))

    lo, hi = 1e-9, shape + 40 * math.sqrt(shape) + 40
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _keys_of(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0..n of the groups in rows sorted by group, and where each begins."""
    new = np.r_[True, (level[1:] != level[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return np.cumsum(new) - 1, np.flatnonzero(new)


_NONE = np.iinfo(np.int64).min
_SCHEMA = "level int, a long, b long, few binary, registers binary"
_ARROW = pa.schema([("level", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("few", pa.binary()), ("registers", pa.binary())])


def _cut_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """counts[i] values of each row as BINARY, null where there are none."""
    ends = np.r_[0, np.cumsum(counts)] * values.dtype.itemsize
    full = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return full.take(pa.array(np.arange(len(counts)), mask=counts == 0)).cast(pa.binary())


def _sketch(level: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray, elements: np.ndarray, m: int, dense: np.ndarray, registers: np.ndarray) -> pa.RecordBatch:
    """Groups with their distinct elements (sorted by group) and registers as rows; a group of more than m / 2 elements is turned into registers."""
    n = len(level)
    counts = np.bincount(group, minlength=n)
    turn = (counts > m // 2) | (dense & (counts > 0))
    if turn.any():
        rows = np.flatnonzero(turn)
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        inside = turn[group]
        made = registers[rows]
        add_elements(made, place[group[inside]], elements[inside])
        registers[rows] = made
        dense = dense | turn
        group, elements = group[~inside], elements[~inside]
        counts = np.bincount(group, minlength=n)
    few = _cut_binary(elements.astype(_U), counts)
    packed = _cut_binary(registers[dense].ravel(), np.where(dense, m, 0))
    null = lambda x: pa.array(x, mask=x == _NONE)
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), null(a), null(b), few, packed], schema=_ARROW)


def _partial(m: int, levels: tuple[int, ...], flush_rows: int, held_most: int):
    """Sketches of a task's rows, one row for each level and group with registers, and what small groups hold flush_rows at a time."""

    def flush(parts: list) -> pa.RecordBatch:
        a, b, fp = (np.concatenate(x) for x in zip(*parts))
        ls, as_, bs, es = [], [], [], []
        for level in levels:
            ls.append(np.full(len(a), level, np.int32))
            as_.append(a if level & 1 else np.full(len(a), _NONE + 1))
            bs.append(b if level & 2 else np.full(len(b), _NONE + 1))
            es.append(fp)
        level, x, y, e = (np.concatenate(z) for z in (ls, as_, bs, es))
        by = np.lexsort((e, y, x, level))
        level, x, y, e = level[by], x[by], y[by], e[by]
        same = np.r_[False, (level[1:] == level[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (e[1:] == e[:-1])]
        level, x, y, e = level[~same], x[~same], y[~same], e[~same]
        group, at = _keys_of(level, x, y)
        n = len(at)
        return _sketch(level[at], x[at], y[at], group, e.view(_U), m, np.zeros(n, bool), _Lazy(n, m))

    def folded(fold: dict) -> pa.RecordBatch:
        level, a, b = (np.array(x) for x in zip(*fold))
        packed = pa.array([x.tobytes() for x in fold.values()], pa.binary())
        null = lambda x: pa.array(x, mask=x == _NONE)
        return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), null(a), null(b), pa.nulls(len(level), pa.binary()), packed], schema=_ARROW)

    def run(batches):
        parts, held, fold = [], 0, {}

        def take(parts: list):
            """Folds the sketches with registers into what the task holds; the others go on."""
            made = flush(parts)
            dense = np.asarray(made.column(4).is_valid())
            level = longs(made.column(0))[0]
            a, b = (np.where(null, _NONE, x) for x, null in (longs(made.column(i)) for i in (1, 2)))
            for i in np.flatnonzero(dense):
                key, mine = (int(level[i]), int(a[i]), int(b[i])), np.frombuffer(made.column(4)[int(i)].as_py(), np.float32)
                fold[key] = np.minimum(fold[key], mine) if key in fold else mine
            return made.filter(pa.array(~dense))

        for batch in batches:
            (a, a_null), (b, b_null), (fp, _) = (longs(batch.column(i)) for i in range(3))
            parts.append((np.where(a_null, _NONE, a), np.where(b_null, _NONE, b), fp))
            held += batch.num_rows
            if held >= flush_rows:
                yield take(parts)
                parts, held = [], 0
                if len(fold) >= held_most:
                    yield folded(fold)
                    fold.clear()
        if held:
            yield take(parts)
        if fold:
            yield folded(fold)

    return run


class _Lazy:
    """Registers of many groups, of which few are ever used; the others take no memory."""

    def __init__(self, n: int, m: int):
        self.rows: dict[int, np.ndarray] = {}
        self.m = m

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        index = np.flatnonzero(which) if which.dtype == bool else which
        out = np.full((len(index), self.m), np.inf, np.float32)
        for i, k in enumerate(index):
            if int(k) in self.rows:
                out[i] = self.rows[int(k)]
        return out

    def __setitem__(self, index: np.ndarray, values: np.ndarray) -> None:
        for i, k in enumerate(index):
            self.rows[int(k)] = values[i]

    def lower(self, k: int, values: np.ndarray) -> None:
        self.rows[k] = np.minimum(self.rows[k], values) if k in self.rows else values


def _merged(table: pa.Table, m: int) -> pa.RecordBatch:
    """The rows of whole groups, sorted by group, merged into one row each."""
    level = longs(table["level"])[0]
    a, b = (np.where(null, _NONE, x) for x, null in (longs(table["a"]), longs(table["b"])))
    group, at = _keys_of(level, a, b)
    few, packed = one(table["few"]), one(table["registers"])
    sizes = np.asarray(pc.fill_null(pc.binary_length(few), 0)) // 8
    elements = np.frombuffer(b"".join(x for x in few.to_pylist() if x), _U)
    of = np.repeat(group, sizes)
    by = np.lexsort((elements, of))
    of, elements = of[by], elements[by]
    keep = np.r_[True, (of[1:] != of[:-1]) | (elements[1:] != elements[:-1])] if len(of) else np.zeros(0, bool)
    registers, dense = _Lazy(len(at), m), np.zeros(len(at), bool)
    for i in np.flatnonzero(np.asarray(packed.is_valid())):
        registers.lower(int(group[i]), np.frombuffer(packed[int(i)].as_py(), np.float32))
        dense[group[i]] = True
    return _sketch(level[at], a[at], b[at], of[keep], elements[keep], m, dense, registers)


def _merge(m: int):
    """Merges the sketches of each group; the rows of a group follow each other."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            level = longs(table["level"])[0]
            a, b = (np.where(null, _NONE, x) for x, null in (longs(table["a"]), longs(table["b"])))
            _, at = _keys_of(level, a, b)
            last = int(at[-1])
            if last:
                yield _merged(table.slice(0, last), m)
            tail = table.slice(last)
            rest = pa.Table.from_batches([_merged(tail, m)]) if tail.num_rows > 1 else tail
        if rest is not None:
            yield _merged(rest, m)

    return run


def _grouped(partial: DataFrame, m: int) -> DataFrame:
    """Sketches of parts merged into one a group: those with registers first within as many shares of the tasks as there are salts."""
    keys = ("level", "a", "b")
    salt = F.when(F.col("registers").isNotNull(), F.pmod(F.spark_partition_id(), F.lit(_SALTS))).otherwise(F.lit(0))
    some = partial.withColumn("salt", salt).repartition(*keys, "salt").sortWithinPartitions(*keys).select(*keys, "few", "registers").mapInArrow(_merge(m), _SCHEMA)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(m), _SCHEMA)


def distinct_sketches(df: DataFrame, a: Column, b: Column, key: Column, levels: tuple[int, ...] = (ALL, FIRST, SECOND, BOTH), m: int = REGISTERS, flush_rows: int = _FLUSH, held_most: int = _HELD) -> DataFrame:
    """Mergeable sketches of the distinct keys overall, per a, per b and per both: level, a, b, few, registers.

    a, b: integer group columns; null is a group of its own. key: BIGINT, 64 bits of an identifier; null is none, and
    a group without keys has no row. m, a power of two, is the number of registers. A group of up to m / 2 keys is held
    as these keys (few), a larger one as registers: register i is the minimum of its keys' i-th exponential values, so
    sketches of parts merge to that of the whole, elementwise by minimum. A key repeated or spread over many rows, tasks
    or sketches counts once.

    Each task folds its rows, flush_rows at a time, into one sketch a group before the shuffle (up to held_most of those
    with registers at once), so a group that holds a third of all rows leaves it as one small row; these are merged in
    two steps, so that no task merges a sketch of every other.
    """
    slim = df.select(a.cast("long").alias("a"), b.cast("long").alias("b"), key.alias("fp")).where(F.col("fp").isNotNull())
    return _grouped(slim.mapInArrow(_partial(m, levels, flush_rows, held_most), _SCHEMA), m)


def merge_sketches(sketches: DataFrame, level: Column, a: Column, b: Column, m: int = REGISTERS) -> DataFrame:
    """Sketches merged into coarser groups: level, a and b are those of the merged sketch, from the columns of the finer ones."""
    moved = sketches.select(level.cast("int").alias("level"), a.cast("long").alias("a"), b.cast("long").alias("b"), "few", "registers")
    return _grouped(moved, m)


def exact_counts(df: DataFrame, a: Column, b: Column, key: Column, levels: tuple[int, ...] = (ALL, FIRST, SECOND, BOTH)) -> DataFrame:
    """level, a, b, n_exact: what distinct_sketches estimates, counted exactly, to measure its error by.

    Keys are made distinct within their groups before these are counted, so no group is one task's work.
    """
    slim = df.select(a.cast("long").alias("x"), b.cast("long").alias("y"), key.alias("fp")).where(F.col("fp").isNotNull()).distinct()
    level = slim.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    of = lambda bit, c: F.when(F.col("level").bitwiseAND(bit) == bit, F.col(c)).otherwise(F.lit(_NONE + 1))
    once = level.select("level", of(1, "x").alias("a"), of(2, "y").alias("b"), "fp").distinct()
    return once.groupBy("level", "a", "b").agg(F.count("*").alias("n_exact"))


def measured(sketched: DataFrame, exact: DataFrame) -> DataFrame:
    """The rows of estimates, with n_exact, and inside: whether the interval holds it."""
    same = (sketched["level"] == exact["level"]) & sketched["a"].eqNullSafe(exact["a"]) & sketched["b"].eqNullSafe(exact["b"])
    joined = sketched.join(exact, same).select(sketched["*"], exact["n_exact"])
    return joined.withColumn("inside", F.col("n_exact").between(F.floor("low"), F.ceil("high")))


def estimates(sketches: DataFrame, m: int = REGISTERS, confidence: float = 0.95) -> DataFrame:
    """level, a, b, n, low, high, exact: the distinct keys of each sketch and their confidence interval.

    With n keys the registers are independent exponentials of rate n and their sum S is gamma distributed with shape m
    and rate n. (m - 1) / S is then an unbiased estimate with a relative standard error of 1 / sqrt(m - 2) (3.1 % for
    1,024 registers), and n lies between the gamma quantiles over S with the given confidence, exactly. A sketch that
    still holds its keys is exact.
    """
    tail = (1 - confidence) / 2
    low, high = gamma_quantile(m, tail), gamma_quantile(m, 1 - tail)

    def run(batches):
        for batch in batches:
            few, packed = batch.column(3), batch.column(4)
            exact = np.asarray(packed.is_null())
            n = (np.asarray(pc.fill_null(pc.binary_length(few), 0)) // 8).astype(np.float64)
            sums = np.array([np.frombuffer(x, np.float32).sum(dtype=np.float64) for x in packed.to_pylist() if x is not None])
            lo, hi = n.copy(), n.copy()
            if len(sums):
                n[~exact], lo[~exact], hi[~exact] = (m - 1) / sums, low / sums, high / sums
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(lo), pa.array(hi), pa.array(exact)], names=["level", "a", "b", "n", "low", "high", "exact"])

    return sketches.select("level", "a", "b", "few", "registers").mapInArrow(run, "level int, a long, b long, n double, low double, high double, exact boolean")
