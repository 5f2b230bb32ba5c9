"""Long exact spans shared between texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import longs, one
from catalith.operators.skew import salted_left_join
from catalith.session import cut, drop_cut

_U = np.uint64
#: An odd multiplier of the rolling hash and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (its constants are fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def anchors(codes: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place and hash of the anchors of texts, whose code points follow each other in codes up to ends.

    The MinHash of a window of neighbouring grams (one gram at each place) is the least of their hashes, and the last
    of equal ones is the window's anchor. Windows with equal text have their anchor in the same place, and every window
    has one, so two texts with gram + window - 1 characters in common have an anchor in common there.
    """
    n = len(codes)
    if n < gram:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.r_[_U(0), np.cumsum((codes.astype(_U) + _U(1)) * up)]
    hashes = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    starts = np.r_[0, ends[:-1]]
    lengths = ends - starts
    # windows: those that lie within one text
    reach, best = 1, np.arange(len(hashes))
    while reach * 2 <= window:
        best = _later_least(hashes, best, reach)
        reach *= 2
    if reach < window:
        best = _later_least(hashes, best, window - reach)
    wide = gram + window - 1
    long_ = np.flatnonzero(lengths >= wide)
    if not len(long_):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    counts = lengths[long_] - wide + 1
    first = starts[long_]
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    text = np.repeat(long_, counts)
    place = best[at]
    new = np.r_[True, place[1:] != place[:-1]]
    return text[new], place[new] - starts[text[new]], hashes[place[new]]


def _later_least(hashes: np.ndarray, best: np.ndarray, step: int) -> np.ndarray:
    """Of the anchors of two overlapping windows, step apart, the one with the least hash, the later one of equals."""
    a, b = best[:-step], best[step:]
    return np.where(hashes[b] <= hashes[a], b, a)


_COUNT_BITS = 32
#: Pairs compared at a time.
_PAIRS = 20_000


def runs(text: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring anchors of one text with one hash, equally far apart, as runs: where each begins, and its step and how many follow.

    Repetitive text has an anchor in every period, however long it is; its anchors are a few runs.
    """
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.r_[False, (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])]
    step = np.where(same, np.r_[0, np.diff(place)], 0)
    before = np.r_[0, step[:-1]]
    first = np.flatnonzero(~(same & ((before == step) | (before == 0))))
    more = np.diff(np.r_[first, len(place)]) - 1
    step = np.where(more > 0, step[np.minimum(first + 1, len(place) - 1)], 0)
    return first, step << _COUNT_BITS | more


def _anchor_rows(gram: int, window: int, chunk: int):
    def flush(ids, since, texts) -> pa.RecordBatch:
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        ends = np.cumsum([len(t) for t in texts])
        text, place, hashes = anchors(np.frombuffer(raw, np.uint32), ends, gram, window)
        first, run = runs(text, place, hashes)
        text, place, hashes = text[first], place[first], hashes[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(place + since[text]), pa.array(run), pa.array(hashes.view(np.int64))], names=["doc", "place", "run", "gram"])

    def run(batches):
        ids, since, parts, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(text), chunk):  # parts overlap, so that every window lies in one
                    part = text[at : at + chunk + gram + window - 2]
                    ids.append(doc), since.append(at), parts.append(part)
                    held += len(part)
                    if held >= chunk:
                        yield flush(np.array(ids), np.array(since), parts)
                        ids, since, parts, held = [], [], [], 0
        if parts:
            yield flush(np.array(ids), np.array(since), parts)

    return run


def _places_of(place: int, run: int, gram: int, side: int):
    """The places of a run, as first and last of those in a row that have the same text around them.

    If the grams of a run overlap or touch, its text repeats every step, and all places that are side away from both
    ends look alike.
    """
    step, more = run >> _COUNT_BITS, run & ((1 << _COUNT_BITS) - 1)
    last = place + step * more
    alike = -(-side // step) if 0 < step <= gram else more
    if more > 2 * alike:
        for i in range(alike):
            yield place + i * step, place + i * step
        yield place + alike * step, last - alike * step
        place = last - (alike - 1) * step
    for p in range(place, last + 1, max(1, step)):
        yield p, p


def _around(gram: int, side: int, span: int):
    """Cuts the surroundings of the places listed with each text.

    Places of a text no more than span apart that have the same surroundings come out as one row, from the first to the
    last; so low-entropy text of any length gives few rows. Spans of at least span characters around all of them
    together cover the whole stretch.
    """
    names = ["hi", "lo", "gram", "place", "upto", "left", "right"]

    def run(batches):
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)], names=names)
        for batch in batches:
            for hi, lo, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                open_: dict[tuple, list[int]] = {}
                for x in sorted(at, key=lambda x: x["place"]):
                    for p, q in _places_of(x["place"], x["run"], gram, side):
                        kind = (x["gram"], text[max(0, p - side) : p], text[p : p + gram + side])
                        mine = open_.get(kind)
                        if mine and mine[0] - span <= q and p <= mine[1] + span:
                            mine[0], mine[1] = min(mine[0], p), max(mine[1], q)
                        else:
                            if mine:
                                rows.append((hi, lo, kind[0], *mine, *kind[1:]))
                            open_[kind] = [p, q]
                        if len(rows) + len(open_) >= 50_000:
                            rows += ((hi, lo, k[0], *r, *k[1:]) for k, r in open_.items())
                            open_ = {}
                            yield pack()
                            rows = []
                rows += ((hi, lo, k[0], *r, *k[1:]) for k, r in open_.items())
        if rows:
            yield pack()

    return run


def _points(texts: list[str], width: int, right: bool) -> np.ndarray:
    """Texts as rows of code points, filled up with 0 on the left or on the right."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), width), np.uint32)
    column = np.arange(width)
    mask = column < lengths[:, None] if right else column >= width - lengths[:, None]
    out[mask] = flat + np.uint32(1)
    return out


def common_reach(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the grams of pairs of rows are equal, and how far their texts agree before and after them.

    left: the code points before the gram, as of _points; right: those of the gram and after it.
    """
    x, y = left[a], right[a]
    same_left, same_right = (x == left[b]) & (x > 0), (y == right[b]) & (y > 0)
    before = np.where(same_left.all(axis=1), left.shape[1], np.argmin(same_left[:, ::-1], axis=1))
    after = np.where(same_right.all(axis=1), right.shape[1], np.argmin(same_right, axis=1)) - gram
    return after >= 0, before, np.maximum(after, 0)


def pairs_within(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of each group (rows sorted by group and side): of side 2 each with each later one, of side 0 each with all of side 1."""
    n = len(group)
    ends = np.searchsorted(group, group, side="right")
    ones = np.cumsum(side == 1)
    others = ends - (ones[ends - 1] - ones + (side == 1))  # where side 1 of a row's group begins, seen from side 0
    first = np.where(side == 2, np.arange(n) + 1, others)
    counts = np.where(side == 1, 0, ends - first)
    a = np.repeat(np.arange(n), counts)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def components(nodes: DataFrame, links: DataFrame, key: str, least: str) -> DataFrame:
    """key and least: the least number among the nodes of each node's connected component.

    nodes: key and its own number least, unique; links: a, b in both directions. In each round every node takes the least label
    among its neighbours, and then the label that the node of this number has by now, so that labels travel in leaps; the
    rounds end when no label changes. Labels are folded before the shuffle, so a node with very many links is no task's own.
    """
    state = cut(nodes.select(key, F.col(least).alias("own"), F.col(least).alias("was"), F.col(least).alias("label")))
    while True:
        heard = links.join(state.select(F.col(key).alias("b"), "label"), "b").groupBy(F.col("a").alias(key)).agg(F.min("label").alias("heard"))
        near = state.join(heard, key, "left").select(key, "own", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        near = cut(near)
        old = state
        # a label is the number of a node, whose own label may be lower still
        ahead = near.where(F.col("label") < F.col("own")).select(F.col("own").alias("label"), F.col("label").alias("further"))
        state = cut(near.join(ahead, "label", "left").select(key, "own", "was", F.coalesce("further", "label").alias("label")))
        drop_cut(old), drop_cut(near)
        if state.where(F.col("label") != F.col("was")).isEmpty():
            return state.select(key, F.col("label").alias(least))


class SharedSpans:
    """Spans of at least span characters (code points, compared exactly) that stand in more than one text.

    key: BIGINT, unique; rows with a null key or text take no part. Paragraphs here are all stretches of span
    characters, wherever they begin; the MinHash of a stretch is the least hash of its grams of gram characters, one
    band of one row, so that equal stretches always collide. Anchors (the places of these MinHashes) that stand in two
    different texts are compared exactly with what surrounds them; a shared stretch always lies within window - 1
    characters of an anchor it contains, so this decides by itself.

    Texts that are exact copies are treated as one and expanded at the end. Repetitive text, whatever its length, gives a
    few runs of anchors and few different surroundings. Anchors that stand in one text only are
    dropped after a count by gram that is folded before the shuffle. Equal surroundings are compared once, however many
    texts have them, and pairs are dealt out by salts in proportion to their number. A gram with more than most_kinds
    different surroundings is cut into finer blocks first, so that a common phrase shorter than a span brings no pairs;
    this changes the plan, not the rows.
    Texts are read chunk characters at a time, whatever their length.
    """

    def __init__(self, df: DataFrame, key: str, text: str, span: int = 160, gram: int = 48, most_kinds: int = 32, chunk: int = 1_000_000):
        self.most_kinds, self.chunk = most_kinds, chunk
        self.span, self.gram, self.window = span, gram, span - gram + 1
        long_ = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.char_length(text) >= span))
        self.docs = long_.select("doc", F.xxhash64("text").alias("hi"), F.xxhash64(F.lit(17), "text").alias("lo"), "text")
        self._places: DataFrame | None = None
        self._known_kinds: DataFrame | None = None
        self._matches: DataFrame | None = None

    def places(self) -> DataFrame:
        """hi, lo (the text), gram, place, upto, left, right, ctx: the anchors whose gram stands in several texts, and their surroundings."""
        if self._places is None:
            w, g = self.window - 1, self.gram
            found = cut(self.docs.select("doc", "text").mapInArrow(_anchor_rows(g, self.window, self.chunk), "doc long, place long, run long, gram long"))
            several = found.groupBy("gram").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where(F.col("x") != F.col("y")).select("gram")
            # one row stands for all copies of a text
            first = self.docs.groupBy("hi", "lo").agg(F.min("doc").alias("doc")).select("doc")
            # a text's places, a few for each hundred characters, go with it as one list
            at = found.join(several, "gram").groupBy("doc").agg(F.collect_set(F.struct("place", "run", "gram")).alias("at")).join(first, "doc", "left_semi")
            near = self.docs.join(at, "doc").select("hi", "lo", "text", "at")
            near = near.mapInArrow(_around(g, w, self.span), "hi long, lo long, gram long, place long, upto long, left string, right string")
            self._places = cut(near.withColumn("ctx", F.xxhash64("left", F.lit(0), "right")))
            drop_cut(found)
        return self._places

    def _kinds(self) -> DataFrame:
        """gram, ctx, left, right, least, most, n: the different surroundings of each gram that has several, the texts that have them, and their number."""
        if self._known_kinds is None:
            t = F.struct("hi", "lo")
            kinds = self.places().groupBy("gram", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.min(t).alias("least"), F.max(t).alias("most"))
            sizes = self.places().select("gram", "ctx").distinct().groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1)
            self._known_kinds = cut(kinds.join(sizes, "gram"))
        return self._known_kinds

    def _windows(self, kinds: DataFrame, step: int, as_text: bool = False) -> DataFrame:
        """kinds with i and block: for each step, the gram and as much around it as a shared stretch must have.

        A stretch that agrees for x characters before the gram, with i = x // step, agrees for i * step of them and for
        all that then has to follow it. A block is a hash of that, or, if asked for, the text itself.
        """
        w, g = self.window - 1, self.gram
        i = F.col("i")
        before, after = i * step, F.greatest(F.lit(0), w - (i + 1) * step + 1)
        cut_up = kinds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(w // step))))
        cut_up = cut_up.where((F.char_length("left") >= before) & (F.char_length("right") >= g + after))
        text = F.concat(F.substring("left", F.char_length("left") - before + 1, before), F.substring("right", F.lit(1), g + after))
        return cut_up.withColumn("block", text if as_text else F.xxhash64("i", text))

    def _compared(self, kinds: DataFrame, on: list[str], step: int, apart: bool = False, parts: Column | None = None) -> DataFrame:
        """gram, ctx_a, ctx_b, before, after: the pairs of kinds, equal in on, that share a stretch.

        apart: without the pairs whose two kinds stand in one and the same text only. The kinds of a group are dealt to
        parts of about 500, by default as many as their number asks for, and each two parts meet as one block of rows: a
        text goes along once a block, not once a pair.
        """
        if parts is None:
            sizes = kinds.groupBy(*on).agg(F.count("*").alias("size")).where(F.col("size") > 1).select(*on, F.ceil(F.col("size") / 500).cast("int").alias("parts"))
            kinds, parts = kinds.join(sizes, on), F.col("parts")
        mine, other = F.pmod(F.col("ctx"), parts.cast("long")).cast("int"), F.col("other")
        rows = kinds.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        side = F.when(F.col("mine") == other, 2).when(F.col("mine") < other, 0).otherwise(1).alias("side")
        alone = F.when((F.col("least") == F.col("most")) & F.lit(apart), F.col("least"))
        keys = [*on, "low", "high"]
        rows = rows.select(*on, F.least("mine", other).alias("low"), F.greatest("mine", other).alias("high"), side, "ctx", "left", "right", alone["hi"].alias("hi"), alone["lo"].alias("lo"))
        g, w, span = self.gram, self.window, self.span
        blocks = "i" in on

        def compare(table: pa.Table, group: np.ndarray):
            side = longs(table["side"])[0]
            left = _points(one(table["left"]).to_pylist(), w - 1, False)
            right = _points(one(table["right"]).to_pylist(), g + w - 1, True)
            (hi, many), (lo, _), (ctx, _), (gram, _) = (longs(table[c]) for c in ("hi", "lo", "ctx", "gram"))
            i = longs(table["i"])[0] if blocks else None
            all_a, all_b = pairs_within(group, side)
            for at in range(0, len(all_a), _PAIRS):
                a, b = all_a[at : at + _PAIRS], all_b[at : at + _PAIRS]
                equal, before, after = common_reach(left, right, a, b, g)
                good = equal & (before + g + after >= span) & (many[a] | many[b] | (hi[a] != hi[b]) | (lo[a] != lo[b]))
                if blocks:  # a pair meets in several blocks and counts in one
                    good &= before // step == i[a]
                a, b = a[good], b[good]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[a], ctx[a], ctx[b], before[good], after[good])], names=["gram", "ctx_a", "ctx_b", "before", "after"])

        def run(batches):
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
                columns = [longs(table[k])[0] for k in keys]
                group = np.cumsum(np.r_[False, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield from compare(table.slice(0, last), group[:last])
                rest = table.slice(last)
            if rest is not None:
                yield from compare(rest, np.zeros(len(rest), np.int64))

        return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "gram long, ctx_a long, ctx_b long, before long, after long")

    def _few(self, apart: bool = False) -> DataFrame:
        return self._compared(self._kinds().where(F.col("n") <= self.most_kinds), ["gram"], 1, apart, F.ceil(F.col("n") / 500).cast("int"))

    def matches(self) -> DataFrame:
        """gram, ctx_a, ctx_b, before, after: surroundings that share a stretch, and how far they agree around the gram.

        Surroundings of a gram that has few of them are compared with each other, those of others only where they agree
        in all but step - 1 characters of a stretch.
        """
        if self._matches is None:
            step = max(1, self.window // 8)
            many = self._windows(self._kinds().where(F.col("n") > self.most_kinds), step)
            self._matches = cut(self._few().unionByName(self._compared(many, ["gram", "i", "block"], step)))
        return self._matches

    def reach(self) -> DataFrame:
        """gram, ctx, before, after: how far around its gram the text of a kind is shared with another kind in another text.

        Surroundings of a gram that has many are not paired for this: each of their stretches is looked up among all,
        as text.
        """
        few = self._few(apart=True)
        near = few.select("gram", F.col("ctx_a").alias("ctx"), "before", "after").unionByName(few.select("gram", F.col("ctx_b").alias("ctx"), "before", "after"))
        many = self._windows(self._kinds().where(F.col("n") > self.most_kinds), 1, True).select("gram", "ctx", "i", "block", "least", "most")
        shared = many.groupBy("gram", "i", "block").agg(F.min("least").alias("x"), F.max("most").alias("y")).where(F.col("x") != F.col("y")).select("gram", "i", "block")
        far = many.join(shared, ["gram", "i", "block"]).select("gram", "ctx", F.col("i").cast("long").alias("before"), (self.window - 1 - F.col("i")).cast("long").alias("after"))
        return near.unionByName(far).groupBy("gram", "ctx").agg(F.max("before").alias("before"), F.max("after").alias("after"))

    def _kinds_of_texts(self) -> DataFrame:
        return self.places().select("gram", "ctx", "hi", "lo", (F.char_length("left") + F.char_length("right")).alias("size")).distinct()

    def text_pairs(self) -> DataFrame:
        """a, b (structs of hi and lo, a < b): the pairs of different texts that share a stretch, each once."""
        texts = self._kinds_of_texts().select("gram", "ctx", F.struct("hi", "lo").alias("t"), "size")
        same = texts.where(F.col("size") >= self.span).drop("size")
        within = self._joined(same.withColumnRenamed("t", "a"), same.withColumnRenamed("t", "b"), ["gram", "ctx"])
        links = self.matches()
        a = texts.select("gram", F.col("ctx").alias("ctx_a"), F.col("t").alias("a"))
        b = texts.select("gram", F.col("ctx").alias("ctx_b"), F.col("t").alias("b"))
        across = links.select("gram", "ctx_a", "ctx_b").join(a, ["gram", "ctx_a"]).join(b, ["gram", "ctx_b"])
        pairs = within.where(F.col("a") < F.col("b")).select("a", "b").unionByName(across.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        return pairs.distinct()

    def _joined(self, a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        """a join b, the rows of a key dealt to salts in proportion to their number."""
        sizes = b.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*on, F.ceil(F.col("n") / 500).cast("int").alias("salts"))
        left = a.join(sizes, on).withColumn("salt", F.pmod(F.hash("a"), F.col("salts"))).drop("salts")
        right = b.join(sizes, on).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return left.join(right, [*on, "salt"])

    def pairs(self) -> DataFrame:
        """doc_a, doc_b (doc_a < doc_b): all pairs of rows that share a span, those of exact copies among them."""
        docs = self.docs.select(F.struct("hi", "lo").alias("t"), "doc").distinct()
        a, b = docs.select(F.col("t").alias("a"), F.col("doc").alias("x")), docs.select(F.col("t").alias("b"), F.col("doc").alias("y"))
        across = self.text_pairs().join(a, "a").join(b, "b").select("x", "y")
        copies = self._joined(docs.select("t", F.col("doc").alias("a")), docs.select("t", F.col("doc").alias("b")), ["t"])
        both = across.unionByName(copies.where(F.col("a") < F.col("b")).select(F.col("a").alias("x"), F.col("b").alias("y")))
        return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def _stars(self) -> tuple[DataFrame, DataFrame]:
        """links (a, b), by which texts that share spans are connected, and t, n_links of each text that has any.

        All texts with the same surroundings of a gram are linked to the least of them. Surroundings of a gram that has
        few are linked pair by pair; of one that has many, those that share a stretch are linked to the least of them,
        for each of their stretches. So there are at most about most_kinds links for each anchor, however many texts
        share it.
        """
        t, w, key = F.struct("hi", "lo"), self.window - 1, ["gram", "ctx"]
        texts = self.places().where(F.char_length("left") + F.char_length("right") >= self.span).select(F.struct("gram", "ctx").alias("kind"), t.alias("t")).distinct()
        classes = cut(texts.groupBy("kind").agg(F.min("t").alias("hub"), F.count("*").alias("n")).select("kind.*", "hub", "n"))
        few = cut(self._few())
        a, b = (classes.select("gram", F.col("ctx").alias(f"ctx_{x}"), F.col("hub").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        across = cut(few.join(a, ["gram", "ctx_a"]).join(b, ["gram", "ctx_b"]))
        # stretches begin from w - after to before characters before the gram; the most pairs meet where one of them begins
        met = lambda mine, other: across.select("gram", F.col(f"ctx_{mine}").alias("ctx"), F.struct((w - F.col("after")).alias("first"), F.col("before").alias("last"), F.col(f"n_{other}").alias("n")).alias("m"))
        lists = met("a", "b").unionByName(met("b", "a")).groupBy(*key).agg(F.collect_list("m").alias("m"))
        here = lambda at: F.aggregate(F.filter("m", lambda y: (y["first"] <= at) & (at <= y["last"])), F.lit(0).cast("long"), lambda s, y: s + y["n"])
        near = lists.select(*key, F.array_max(F.transform("m", lambda x: here(x["first"]))).alias("more"))
        many = self._windows(self._kinds().where(F.col("n") > self.most_kinds), 1, True).select(*key, "i", "block").join(classes, key)
        groups = many.groupBy("gram", "i", "block").agg(F.min("hub").alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("kinds") > 1)
        far = cut(many.join(groups, ["gram", "i", "block"]).groupBy(*key, "hub", "top").agg(F.max(F.col("all") - F.col("n")).alias("more")))
        most = near.unionByName(far.select(*key, "more")).groupBy(*key).agg(F.max("more").alias("more"))
        full = classes.join(most, key, "left").select(F.struct("gram", "ctx").alias("kind"), "hub", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n")).where(F.col("n") > 0)
        joined = cut(salted_left_join(texts, full, "kind", self.places().count()).where(F.col("hub").isNotNull()).select("t", "hub", "n"))
        links = joined.select(F.col("t").alias("a"), F.col("hub").alias("b")).unionByName(across.select("a", "b")).unionByName(far.select(F.col("hub").alias("a"), F.col("top").alias("b")))
        return links.where(F.col("a") != F.col("b")).distinct(), joined.groupBy("t").agg(F.max("n").alias("n_links"))

    def clusters(self) -> DataFrame:
        """doc, cluster, n_links, kept: the rows of at least span characters, by connected components of shared spans.

        cluster is the least doc that can be reached through shared spans (copies are one text); n_links is how many
        other texts share the one stretch of the row's text that most of them share (one that has it in different
        surroundings counts for each); kept is true for one row of each cluster, that least doc. Texts that share a
        stretch are not listed in pairs.
        """
        docs = self.docs.select(F.struct("hi", "lo").alias("t"), "doc")
        links, counts = self._stars()
        both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        texts = docs.groupBy("t").agg(F.min("doc").alias("least"))
        label = components(texts, both, "t", "least")
        out = docs.join(label, "t").join(counts, "t", "left")
        return out.select("doc", F.col("least").alias("cluster"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("doc") == F.col("least")).alias("kept"))

    def coverage(self) -> DataFrame:
        """doc, n_chars, n_shared: for each row of at least span characters, how many of them lie in shared spans.

        Rows with shorter, null or empty texts share nothing and are not returned. A text that stands in several rows
        is shared whole.
        """
        w, g = self.window - 1, self.gram
        reach = self.reach()
        places = self.places().select("gram", "ctx", "hi", "lo", "place", "upto", F.char_length("left").alias("l"), F.char_length("right").alias("r"))
        t = F.struct("hi", "lo")
        same = places.groupBy("gram", "ctx").agg(F.min(t).alias("x"), F.max(t).alias("y")).where(F.col("x") != F.col("y")).select("gram", "ctx", F.lit(True).alias("twice"))
        full = F.col("twice") & (F.col("l") + F.col("r") >= self.span)
        spans = places.join(reach, ["gram", "ctx"], "left").join(same, ["gram", "ctx"], "left").select(
            "hi",
            "lo",
            (F.col("place") - F.when(full, F.col("l")).otherwise(F.col("before"))).alias("start"),
            (F.col("upto") + F.when(full, F.col("r")).otherwise(F.col("after") + g)).alias("stop"),
        )
        spans = spans.where(F.col("start").isNotNull()).distinct()
        # a text's spans in order, each cut where the ones before it end; their number is bounded by the text's length
        listed = spans.groupBy("hi", "lo").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        union = F.aggregate("spans", zero, lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n")))
        covered = listed.select("hi", "lo", union["n"].alias("n"))
        docs = self.docs.select("doc", "hi", "lo", F.char_length("text").cast("long").alias("n_chars"))
        copies = docs.groupBy("hi", "lo").agg(F.count("*").alias("copies"))
        per_text = copies.join(covered, ["hi", "lo"], "left")
        whole = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0).cast("long")))
        return docs.join(per_text, ["hi", "lo"]).select("doc", "n_chars", whole.alias("n_shared"))
