"""New batches held against all history: exact and near duplicates by a segment index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.arrays import longs
from catalith.session import cut, exists
from catalith.sources.buckets import BucketStore

_U = np.uint64
#: A set of a members and one of b with i in common are near duplicates if i / (a + b - i) >= 0.7. As sequences in one
#: order their edit distance (insertions and deletions) is a + b - 2 i, so that is at most 3 (a + b) / 17.
_NUM, _DEN = 3, 17
_SALTS = 16
#: Sets are indexed in parts of at most about this many items.
_PART = 32
#: Rows a task turns into entries or probes at a time, counted in items.
_CHUNK = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser; its constants are fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hot_items(members: DataFrame, item: Column, rows: int, hot_parts: int = 20_000) -> DataFrame:
    """item, rank: the items that stand in more than 1 / hot_parts of all rows, at most hot_parts of them. rows: at least the rows of members."""
    counts = members.select(item.alias("item")).where(F.col("item").isNotNull()).groupBy("item").agg(F.count("*").alias("rank"))
    return counts.where(F.col("rank") > max(2, rows // hot_parts))


def ordered_sets(members: DataFrame, owner: str, item: Column, hot: DataFrame) -> DataFrame:
    """owner, items ARRAY<BIGINT>, hot INT: the distinct items (64 bits each) of each owner, in one order for all sets.

    Items in hot (bounded as of hot_items, so broadcast) stand at the end, the most frequent last; hot is their number
    in the set. Rows with a null item are left out, and an owner that has no other is not returned.
    """
    slim = members.select(F.col(owner).alias("owner"), item.alias("item")).where(F.col("owner").isNotNull() & F.col("item").isNotNull())
    ranked = slim.join(F.broadcast(hot), "item", "left").select("owner", F.struct(F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), "item").alias("x"))
    sets = ranked.groupBy("owner").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return sets.select(F.col("owner").alias(owner), F.transform("x", lambda x: x["item"]).alias("items"), F.size(F.filter("x", lambda x: x["rank"] > 0)).alias("hot"))


def _edits(a, b):
    """The most edits between near duplicates of a and b items."""
    return _NUM * (a + b) // _DEN


def _segments(size):
    """Into how many segments a stored part is cut: one more than the edits to the longest part it can resemble."""
    return _edits(size, size * 10 // 7) + 1


def _parts_of(size: np.ndarray) -> np.ndarray:
    """Into how many parts a set of this size is dealt: a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(1, size / _PART))).astype(np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts[i] rows each: i and the number within i."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Parts:
    """The parts of some sets: owner (row of the set), first (place in items), n (items) and rare (those that are not hot).

    An item's part depends on the item and on the number of parts alone. Within a part items keep the sets' order.
    """

    def __init__(self, items: np.ndarray, sizes: np.ndarray, hot: np.ndarray, parts: np.ndarray):
        row, at = _spread(sizes)
        part = (_mix(items.view(_U)) >> _U(7)).astype(np.int64) & (parts[row] - 1)
        is_hot = at >= (sizes - hot)[row]
        by = np.lexsort((at, part, row))
        row, part, is_hot, items = row[by], part[by], is_hot[by], items[by]
        self.first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.empty(0, np.int64)
        self.owner = row[self.first]
        self.n = np.diff(np.r_[self.first, len(row)])
        self.rare = self.n - (np.add.reduceat(is_hot.astype(np.int64), self.first) if len(row) else 0)
        self.parts = parts[self.owner]
        up = np.full(len(items) + 1, _BASE, _U)
        up[0] = 1
        up = np.cumprod(up)
        down = np.full(len(items) + 1, _INVERSE, _U)
        down[0] = 1
        self._down = np.cumprod(down)
        self._sums = np.r_[_U(0), np.cumsum(_mix(items.view(_U) + _U(1)) * up[:-1])]

    def keys(self, part: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64 bits of the length items from place at of parts, and of the number of parts."""
        start = self.first[part] + at
        slices = (self._sums[start + length] - self._sums[start]) * self._down[start]
        return _mix(_mix(slices ^ _mix(length.astype(_U))) + self.parts[part].astype(_U)).view(np.int64)


def _even(k: np.ndarray, size: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the k-th of the even parts of size, the longer ones last."""
    short, longer = size // parts, size % parts
    over = np.maximum(0, k - (parts - longer))
    return k * short + over, short + (k >= parts - longer)


def _entries_of(p: _Parts):
    """part, shift, start and length of all segments of parts; shift is how many places one can have moved.

    A part of n items is cut into _segments(n) segments, of its rare items alone if there are enough of them. If not,
    each rare item is a segment; if hot items are fewer than the 0.7 n that a near duplicate must share, it shares a
    rare one, and these segments suffice; else the hot items are cut into as many as are left, which makes these as
    long as they can be.
    """
    want = _segments(p.n)
    few = p.rare < want
    rare_only = few & ((p.n - p.rare) * 10 < p.n * 7)
    part, k = _spread(np.where(rare_only, p.rare, want))
    n, rare, want, few = p.n[part], p.rare[part], want[part], few[part]
    start, length = _even(k, rare, want)
    s2, l2 = _even(k - rare, n - rare, np.maximum(1, want - rare))
    start = np.where(few, np.where(k < rare, k, rare + s2), start)
    length = np.where(few, np.where(k < rare, 1, l2), length)
    return part, np.where(rare_only[part], want - 1, k), start, length


def _probes_of(p: _Parts):
    """part, start and length of the substrings of new parts that can be a segment of a stored part that resembles them.

    Segments of rare items have at most three: a part of n is cut into more than n / 3 segments. Segments of hot items
    may be longer; they occur only in parts with fewer rare items than segments, and these cannot resemble one with
    many more rare items.
    """
    found = []
    for length in (1, 2, 3):
        part, at = _spread(np.maximum(0, p.rare - length + 1))
        found.append((part, at, np.full(len(part), length)))
    longest = p.n * 10 // 7
    reached = np.flatnonzero((p.rare < _segments(longest) + _edits(p.n, longest)) & (p.n > p.rare))
    of, at = _spread((p.n - p.rare)[reached])
    part = reached[of]
    of, more = _spread((p.n - p.rare)[part] - at)
    found.append((part[of], p.rare[part[of]] + at[of], more + 1))
    return tuple(np.concatenate(x) for x in zip(*found))


_ENTRIES = "seg long, stored struct<h:bigint,g:bigint>, n int, k int, start int"
_PROBES = "seg long, probe struct<h:bigint,g:bigint>, b int, at int"


def _sliced(batches):
    """Batches of sets in pieces of at most about _CHUNK items (one set at least): id column, items, sizes, hot."""
    for batch in batches:
        ids, lists, hot = batch.column(0), batch.column(1), longs(batch.column(2))[0]
        sizes = np.diff(np.asarray(lists.offsets))
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
            piece = lists.slice(first, last - first)
            yield ids.slice(first, last - first), longs(piece.flatten())[0], sizes[first:last], hot[first:last]
            first = last


def segment_entries(sets: DataFrame) -> DataFrame:
    """The index entries of stored sets (sid, items, hot): seg BIGINT (64 bits of a segment's items), stored, n, k, start.

    A set of more than about _PART items is dealt to parts by its items, and each part is indexed as if it were a set:
    of two near duplicates, some part of one is a near duplicate of that part of the other, as the edits of all parts
    together are few enough. A part of n items is cut into one segment more than the edits it can need; seg stands for
    the segment's items, start is its place, k how far it can have moved (its number, or all edits). An index grows by appending the entries of new sets;
    nothing stored changes.
    """

    def run(batches):
        for ids, items, sizes, hot in _sliced(batches):
            p = _Parts(items, sizes, hot, _parts_of(sizes))
            part, shift, start, length = _entries_of(p)
            owner = ids.take(pa.array(p.owner[part]))
            yield pa.RecordBatch.from_arrays([pa.array(p.keys(part, start, length)), owner, *(pa.array(x.astype(np.int32)) for x in (p.n[part], shift, start))], names=["seg", "stored", "n", "k", "start"])

    return sets.select("sid", "items", "hot").mapInArrow(run, _ENTRIES)


def segment_probes(sets: DataFrame) -> DataFrame:
    """The substrings of new sets (sid, items, hot) that can be a segment of a near duplicate: seg, probe, b (items of the part), at.

    A set is dealt to as many parts as each size it can resemble is, at most three different numbers of them. Probes
    grow with the size of a set, not faster.
    """

    def run(batches):
        for ids, items, sizes, hot in _sliced(batches):
            least, most = _parts_of(-(-sizes * 7 // 10)), _parts_of(sizes * 10 // 7)
            for step in (1, 2, 4):
                tried = np.flatnonzero(least * step <= most)
                if not len(tried):
                    break
                within = np.repeat(least * step <= most, sizes)
                p = _Parts(items[within], sizes[tried], hot[tried], least[tried] * step)
                part, at, length = _probes_of(p)
                owner = ids.take(pa.array(tried[p.owner[part]]))
                yield pa.RecordBatch.from_arrays([pa.array(p.keys(part, at, length)), owner, *(pa.array(x.astype(np.int32)) for x in (p.n[part], at))], names=["seg", "probe", "b", "at"])

    return sets.select("sid", "items", "hot").mapInArrow(run, _PROBES)


def candidates(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, stored: the pairs of a new and another stored set that share a segment, each once.

    Sizes must fit, and a segment can have moved by no more places than segments stand before it: if the parts
    differ by few enough edits, some segment is untouched with exactly as many edits before it. Where a part has rare
    segments alone, only the edits altogether bound that.
    """
    n, b = F.col("n"), F.col("b")
    fits = (n * 10 >= b * 7) & (b * 10 >= n * 7) & (F.abs(F.col("at") - F.col("start")) <= F.col("k"))
    return entries.join(probes, "seg").where(fits & (F.col("probe") != F.col("stored"))).select("probe", "stored").distinct()


def verified(pairs: DataFrame, stored: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs whose edit distance, a + b - 2 |common items|, is small enough; stored and new have sid and items."""
    a = new.select(F.col("sid").alias("probe"), F.col("items").alias("x"))
    b = stored.select(F.col("sid").alias("stored"), F.col("items").alias("y"))
    sizes = F.size("x") + F.size("y")
    edits = sizes - 2 * F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "probe").join(b, "stored").where(edits * _DEN <= sizes * _NUM).select("probe", "stored")


def near_sets(stored: DataFrame, new: DataFrame) -> DataFrame:
    """probe, stored: the pairs of a new and another stored set (sid, items, hot) that are near duplicates. None is left out."""
    return verified(candidates(segment_entries(stored), segment_probes(new)), stored, new)


def _two(*what: Column) -> Column:
    """128 bits of hash as a struct."""
    return F.struct(F.xxhash64(*what).alias("h"), F.xxhash64(F.lit(17), *what).alias("g"))


def _described(packages: DataFrame, numbers: DataFrame, sets: DataFrame) -> DataFrame:
    """id, batch, kid, sid, items, hot: each package once, with the classes of its hash and of its set."""
    ids = packages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("key"))
    known = ids.join(numbers, ids["id"] == numbers["package_id"], "left").drop("package_id")
    return known.join(sets, known["id"] == sets["package_id"], "left").select(
        "id",
        F.coalesce("batch_no", F.lit(0)).alias("batch"),
        F.when(F.col("key").isNotNull(), _two(F.lit("key"), F.col("key"))).alias("kid"),
        # the set, not the sequence: its order may differ from one index to another
        F.when(F.col("items").isNotNull(), _two(F.lit("set"), F.sort_array("items"))).alias("sid"),
        "items",
        "hot",
    )


def _numbers(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("package_id").isNotNull() & F.col("batch_no").isNotNull()).groupBy("package_id").agg(F.min("batch_no").alias("batch_no"))


def history_duplicates(packages: DataFrame, batches: DataFrame, members: DataFrame, member_rows: int) -> DataFrame:
    """first_id, package_id: the packages of a batch that repeat an earlier one, and the least id each repeats.

    packages: id BIGINT, key BINARY (the package's own hash, null if none). batches: package_id, batch_no (> 0); all
    other packages are history. members: package_id, item BIGINT (64 bits of a member's hash, null if none).
    member_rows: at least the rows of members. Earlier are history, lower batches, and lower ids of the same batch. A
    package repeats one with the same key, or one whose set of distinct items has 0.7 of the union in common with its
    own; a package without items resembles none. Only ids in packages count; repeated rows count once, of several keys
    of an id the least holds, of several batches the first. Rows with a null id are left out. Any table may be empty.

    All packages with the same key, and all with the same set, form one class. Classes, not packages, are compared:
    a class keeps the least id of each batch, so copies never meet in pairs and a class with a third of all packages
    is one row a batch. Sets are looked up in the segment index, which holds each once. The packages of a class are
    dealt out by a salt when they fetch their answer. HistoryIndex gives the same rows batch by batch.
    """
    sets = ordered_sets(members, "package_id", F.col("item"), hot_items(members, F.col("item"), member_rows))
    full = cut(_described(packages, _numbers(batches), sets))
    classes = _classes(full)
    new = classes.where(F.col("last") > 0)
    return _answers(full.where(F.col("batch") > 0), _least(full), near_sets(classes, new))


def _classes(full: DataFrame) -> DataFrame:
    return full.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.first("items").alias("items"), F.first("hot").alias("hot"), F.max("batch").alias("last"))


def _least(full: DataFrame) -> DataFrame:
    """cid, batch, least: the least id each class has in each batch."""
    return full.select("id", "batch", F.explode(F.array("kid", "sid")).alias("cid")).where(F.col("cid").isNotNull()).groupBy("cid", "batch").agg(F.min("id").alias("least"))


def _answers(asked: DataFrame, least: DataFrame, links: DataFrame) -> DataFrame:
    """first_id, package_id of the asked packages, from the least ids of classes and the links between sets."""
    through = links.join(least, links["stored"] == least["cid"]).select(F.col("probe").alias("cid"), "batch", "least")
    asked = asked.select("id", "batch", F.explode(F.array("kid", "sid")).alias("cid")).where(F.col("cid").isNotNull())
    own = least.join(asked.select("cid").distinct(), "cid", "left_semi")
    merged = own.unionByName(through).groupBy("cid", "batch").agg(F.min("least").alias("least"))
    # of the batches of a class only those matter that bring a lower id than all before
    steps = merged.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("batch", "least"))).alias("steps"))
    lows = F.aggregate(
        "steps",
        F.expr("cast(array() as array<struct<batch:int,least:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["least"] <= x["least"]), done).otherwise(F.concat(done, F.array(x))),
    )
    steps = steps.select("cid", lows.alias("lows"))
    salted = steps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    asked = asked.withColumn("salt", F.pmod(F.hash("id"), F.lit(_SALTS)))
    before = F.filter("lows", lambda x: (x["batch"] < F.col("batch")) | ((x["batch"] == F.col("batch")) & (x["least"] < F.col("id"))))
    answers = asked.join(salted, ["cid", "salt"]).select("id", F.array_min(F.transform(before, lambda x: x["least"])).alias("first_id"))
    return answers.where(F.col("first_id").isNotNull()).groupBy(F.col("id").alias("package_id")).agg(F.min("first_id").alias("first_id")).select("first_id", "package_id")


class HistoryIndex:
    """The segment index on disk: each batch is checked against what was accepted before, then its own entries are appended.

    Under path, a folder all executors share, are four tables. hot: the items that were frequent in the first batch
    (history), which fix the order of items for good. ids (the least id of each class), sets (each set once) and
    segments (their entries) are bucket stores, keyed by what they are looked up by. Checking a batch opens only the
    buckets its probes, its candidates and its classes fall into, never the packages accepted before, so with enough
    buckets what a small batch reads is bounded by its own size. Batches are appended under rising numbers; one appended
    again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path = spark, path
        store = lambda name, schema, key: BucketStore(spark, f"{path}/{name}", schema, key, buckets)
        self.ids = store("ids", "cid struct<h:bigint,g:bigint>, least bigint", "cid")
        self.sets = store("sets", "sid struct<h:bigint,g:bigint>, items array<bigint>, hot int", "sid")
        self.segments = store("segments", _ENTRIES, "seg")

    def _hot(self, members: DataFrame) -> DataFrame:
        path = f"{self.path}/hot"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            hot_items(members, F.col("item"), members.count()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("item bigint, rank bigint").parquet(path)

    def check_and_append(self, number: int, packages: DataFrame, members: DataFrame) -> DataFrame:
        """first_id, package_id of the packages of batch number that repeat one of an earlier batch, or one of a lower id in it.

        packages and members are those of the batch alone, as of history_duplicates.
        """
        none = self.spark.createDataFrame([], "package_id bigint, batch_no int")
        sets = ordered_sets(members, "package_id", F.col("item"), self._hot(members))
        full = cut(_described(packages, none, sets).withColumn("batch", F.lit(1)))
        mine = cut(_least(full))
        known = self.ids.around(mine.select("cid"), number).groupBy("cid").agg(F.min("least").alias("least"))
        new = _classes(full).drop("last")
        fresh = cut(new.join(known.select(F.col("cid").alias("sid")), "sid", "left_anti"))
        probes = cut(segment_probes(new))
        entries = self.segments.around(probes.select("seg"), number)
        pairs = cut(candidates(entries.unionByName(segment_entries(fresh)), probes))
        stored = self.sets.around(pairs.select("stored"), number)
        links = cut(verified(pairs, stored.unionByName(fresh), new))
        asked = mine.select("cid").unionByName(links.select(F.col("stored").alias("cid")))
        ids = self.ids.around(asked, number).groupBy("cid").agg(F.min("least").alias("least"))
        found = cut(_answers(full, ids.select("cid", F.lit(0).alias("batch"), "least").unionByName(mine), links))
        # of a class known already, only a lower id is news
        lower = mine.join(known.withColumnRenamed("least", "had"), "cid", "left").where(F.col("had").isNull() | (F.col("least") < F.col("had"))).select("cid", "least")
        for store, rows in ((self.ids, lower), (self.sets, fresh), (self.segments, segment_entries(fresh))):
            store.put(rows, number)
        return found


def incremental_duplicates(packages: DataFrame, batches: DataFrame, members: DataFrame, path: str, buckets: int = 256) -> DataFrame:
    """The rows of history_duplicates from a HistoryIndex at path: history first, then batch by batch in rising order.

    The feed is laid out by batch first, so each step reads its own packages and members alone. The numbers of the
    batches come to the driver; a batch is one step of the feed, so there are as many as arrivals.
    """
    spark = packages.sparkSession
    numbers = cut(_numbers(batches))
    for name, df, key in (("packages", packages, "id"), ("members", members.distinct(), "package_id")):
        known = df.join(numbers.withColumnRenamed("package_id", "_id"), F.col(key) == F.col("_id"), "left").drop("_id")
        known.withColumn("batch_no", F.coalesce("batch_no", F.lit(0))).write.mode("overwrite").partitionBy("batch_no").parquet(f"{path}/feed/{name}")
    feed = lambda name, df, number: spark.read.schema(T.StructType([*df.schema, T.StructField("batch_no", T.IntegerType())])).parquet(f"{path}/feed/{name}").where(F.col("batch_no") == number).drop("batch_no")
    index, found = HistoryIndex(spark, path, buckets), spark.createDataFrame([], "first_id bigint, package_id bigint")
    steps = sorted(r[0] for r in numbers.select("batch_no").distinct().collect())
    for number in (0, *steps):
        repeats = index.check_and_append(number, feed("packages", packages, number), feed("members", members, number))
        if number:
            found = found.unionByName(repeats)
    return found
