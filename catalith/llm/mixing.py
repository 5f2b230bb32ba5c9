"""Mixing sources to target weights."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalith.llm.encoding import VOCABULARY, count_tokens
from catalith.operators.skew import salted_left_join
from catalith.session import cut, drop_cut

_CELL = ["source", "lang", "topic"]
#: Documents that are ranked together in one task at most.
_BUCKET = 100_000
#: The order of the draw, not its outcome on average: documents are drawn by size, first those with more than 1 / 20 of the tokens their source is to give, and so on.
_LEVELS = (20, 400)
_UNIT = 1 << 20


def rake(tokens: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], caps: np.ndarray, rounds: int = 50, close: float = 1e-4) -> np.ndarray:
    """Iterative proportional fitting: the weight of each cell, at most its cap, so that weight x tokens meets the margins.

    margins: for each, the category of every cell and the target of every category. All are raked in turn, the first
    one last and once more at the end, so that it is met exactly wherever its caps let it: what a capped cell cannot
    take, its category's other cells do. A category whose cells are all at their caps falls short. Where the margins
    contradict each other, the first holds and the others are met as far as rounds bring them.
    """
    weight = np.minimum(np.ones(len(tokens)), caps)
    if not len(tokens):
        return weight

    def fit(weight: np.ndarray, category: np.ndarray, target: np.ndarray) -> np.ndarray:
        have = np.bincount(category, weight * tokens, len(target))
        down = np.divide(target, have, out=np.ones(len(target)), where=have > 0)
        at_cap = weight >= caps
        fixed = np.bincount(category, np.where(at_cap, weight * tokens, 0), len(target))
        free = have - fixed
        up = np.divide(target - fixed, free, out=np.ones(len(target)), where=free > 0)
        scale = np.where(down[category] < 1, down[category], np.where(at_cap, 1, np.maximum(up[category], 1)))
        return np.minimum(weight * scale, caps)

    for _ in range(rounds):
        old = weight
        for category, target in [*margins[1:], margins[0]]:
            weight = fit(weight, category, target)
        if np.allclose(weight, old, rtol=close, atol=0):
            break
    for _ in range(rounds):  # each pass fills what the caps of the pass before left over
        old, weight = weight, fit(weight, *margins[0])
        if np.allclose(weight, old, rtol=1e-9, atol=0):
            break
    return weight


def largest_total(tokens: dict[str, float], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """The most tokens that can be drawn so that each source that has any reaches its share within its repeats."""
    there = {s: share for s, share in shares.items() if share > 0 and tokens.get(s, 0) > 0 and repeats[s] > 0}
    whole = sum(there.values())
    return min((tokens[s] * repeats[s] * whole / share for s, share in there.items()), default=0.0)


def rake_cells(cells: DataFrame, rounds: int = 50, close: float = 1e-4) -> DataFrame:
    """cells with weight: the same as rake, over cells that are too many for the driver.

    cells: source, lang, topic, tokens, cap, goal (tokens the source is to give), planned (tokens all sources are to
    give) and whole (tokens of all cells). Each round rakes to languages, topics and sources in turn, with one aggregate
    and one join each, and is written to the shared folder; the greatest change of a round is all that comes to the driver.
    """
    have = F.col("weight") * F.col("tokens")

    def fit(now: DataFrame, part: str) -> DataFrame:
        target = F.max("goal") if part == "source" else F.sum("tokens") * F.max(F.col("planned") / F.col("whole"))
        sums = now.groupBy(F.col(part).alias("_part")).agg(target.alias("_target"), F.sum(have).alias("_have"), F.sum(F.when(F.col("weight") >= F.col("cap"), have).otherwise(0.0)).alias("_fixed"))
        free = F.col("_have") - F.col("_fixed")
        up = F.when(free > 0, F.greatest(F.lit(1.0), (F.col("_target") - F.col("_fixed")) / free)).otherwise(1.0)
        scale = F.when(F.col("_target") < F.col("_have"), F.col("_target") / F.col("_have")).when(F.col("weight") >= F.col("cap"), 1.0).otherwise(up)
        return now.join(sums, F.col(part) == F.col("_part")).withColumn("weight", F.least("cap", F.col("weight") * scale)).drop("_part", "_target", "_have", "_fixed")

    state = cut(cells.withColumns({"weight": F.least(F.lit(1.0), "cap"), "was": F.lit(0.0)}))
    for parts, near in ((("lang", "topic", "source"), close), (("source",), 1e-9)):
        for _ in range(rounds):
            old, now = state, state.withColumn("was", F.col("weight"))
            for part in parts:
                now = fit(now, part)
            state = cut(now)
            change = state.agg(F.max(F.abs(F.col("weight") - F.col("was")) / F.greatest("was", F.lit(1e-300)))).first()[0]
            drop_cut(old)
            if (change or 0.0) <= near:
                break
    return state.drop("was")


def _draw(df: DataFrame) -> DataFrame:
    """df with copies: weight rounded down or up, by systematic draws along one sequence for each source.

    The sequence runs through the sizes, the cells and a hash of the key. The rows of a cell (n of them) fall into
    buckets of about _BUCKET by that hash. Sums are added up over the sizes of a source, then over the buckets of a
    size, then over the rows of a bucket, so no task sorts more than one of these, and over any stretch of the sequence
    the number drawn is off by less than one.
    """
    units = F.round(F.col("weight") * _UNIT).cast("long")  # whole numbers, whose sums depend on no order
    df = df.withColumn("whole", F.floor(units / _UNIT)).withColumn("part", units % _UNIT).withColumn("size", F.floor(F.log2(F.col("n_tokens") + 1) * 2).cast("int"))
    df = df.withColumn("order", F.xxhash64(F.lit(41), "doc")).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.ceil(F.col("n") / _BUCKET)))
    stretch = ["source", "size", "lang", "topic", "bucket"]
    sums = df.groupBy(*stretch).agg(F.sum("part").alias("in_bucket"))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    past = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    sizes = sums.groupBy("source", "size").agg(F.sum("in_bucket").alias("in_size")).withColumn("base", past("in_size", before(["source"], ["size"]))).drop("in_size")
    sums = sums.withColumn("here", past("in_bucket", before(["source", "size"], ["lang", "topic", "bucket"]))).join(sizes, ["source", "size"])
    sums = sums.select(*stretch, (F.col("base") + F.col("here")).alias("base"))
    df = df.withColumn("inner", past("part", before(stretch, ["order", "doc"])))
    placed = df.join(sums, stretch).withColumn("before", F.col("base") + F.col("inner"))
    more = F.floor((F.col("before") + F.col("part") + _UNIT // 2) / _UNIT) - F.floor((F.col("before") + _UNIT // 2) / _UNIT)
    return placed.withColumn("copies", (F.col("whole") + more).cast("int"))


class Mix:
    """Documents drawn so that each source gives its share of all tokens.

    targets: source STRING, target_share DOUBLE, max_repeats INT, a small table that the driver reads. Of several rows of a source the
    greatest share and the least repeats hold; null, negative or zero shares and repeats mean none. A document takes
    part if its source has a target; one of null, empty or other source, without tokens or with a null key is not
    drawn. Sources are compared exactly.

    total_tokens is how much to draw, by default the most at which every source that has tokens reaches its share
    without using a document more than max_repeats times; the shares of sources without tokens go to the others in
    proportion. If more is asked for, sources that have not enough fall short, and mix_report shows by how much.

    Tokens are summed by cells of source, language and topic, null being a value of its own. Cell weights are raked to
    the target of each source and to the share each language and topic has among the documents that take part; every
    language and every topic counts, however rare. Up to driver_cells cells are raked in the driver and their weights
    broadcast; beyond, rake_cells does the same with tables. A document of a cell of weight w is used floor(w) times,
    and once more with the probability that is left. These draws are systematic along a sequence of size, cell and a
    hash of the key; those of large documents come first, so that the others can make up for their rounding. What is
    made up is on average nothing, so on average over the hash documents keep their weight. The result is the same in
    every run.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, key: str, text: str, source: str, lang: Column, topic: Column, total_tokens: float | None = None, driver_cells: int = 100_000, vocabulary: str = VOCABULARY):
        spark = df.sparkSession
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()
        shares = {r["source"]: max(0.0, r["share"] or 0.0) for r in wanted}
        repeats = {r["source"]: max(0, r["repeats"] or 0) for r in wanted}
        names = [s for s in shares if shares[s] > 0 and repeats[s] > 0]
        value = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))
        slim = df.select(F.col(key).alias("doc"), F.col(source).alias("source"), value(lang).alias("lang"), value(topic).alias("topic"), F.col(text).alias("text"))
        slim = slim.where(F.col("doc").isNotNull() & F.col("source").isin(names) & (F.char_length("text") > 0))
        self.counted = cut(count_tokens(slim, "text", "n_tokens", vocabulary))
        summed = cut(self.counted.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
        of_source = {r["source"]: float(r["tokens"]) for r in summed.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
        self.total = largest_total(of_source, shares, repeats) if total_tokens is None else float(total_tokens)
        whole = sum(shares[s] for s in of_source) or 1.0
        self.goals = {s: self.total * shares[s] / whole for s in of_source}
        bounds = F.broadcast(spark.createDataFrame([(s, float(repeats[s]), g) for s, g in self.goals.items()], "source string, cap double, goal double"))  # one row a source
        self.few = summed.count() <= driver_cells
        if self.few:
            self.cells = self._raked_here(spark, summed.orderBy(*_CELL).collect(), repeats)
        else:
            all_tokens = F.lit(sum(of_source.values()))
            self.cells = rake_cells(summed.join(bounds, "source").withColumns({"planned": F.lit(self.total), "whole": all_tokens})).drop("planned", "whole")

    def _raked_here(self, spark, cells, repeats: dict[str, int]) -> DataFrame:
        tokens = np.array([float(c["tokens"]) for c in cells])
        margins = []
        for part in _CELL:
            values = sorted({c[part] for c in cells})
            place = {v: i for i, v in enumerate(values)}
            category = np.array([place[c[part]] for c in cells], np.int64)
            target = np.array([self.goals[v] for v in values]) if part == "source" else self.total * np.bincount(category, tokens, len(values)) / max(tokens.sum(), 1)
            margins.append((category, target))
        weight = rake(tokens, margins, np.array([float(repeats[c["source"]]) for c in cells]))
        rows = [(c["source"], c["lang"], c["topic"], int(c["tokens"]), int(c["n"]), float(repeats[c["source"]]), self.goals[c["source"]], float(w)) for c, w in zip(cells, weight)]
        return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n long, cap double, goal double, weight double")

    def drawn(self) -> DataFrame:
        """The documents drawn: doc, source, lang, topic, n_tokens, copies (how often each is used, at least once)."""
        spark, weights = self.counted.sparkSession, self.cells.drop("tokens")
        if self.few:
            weighed = self.counted.join(F.broadcast(weights), _CELL)
        else:
            cell = F.struct(*_CELL).alias("_cell")
            weighed = salted_left_join(self.counted.select(cell, "doc", "n_tokens", *_CELL), weights.select(cell, "n", "cap", "goal", "weight"), "_cell", self.counted.count()).drop("_cell")
        used, drawn, rest = dict.fromkeys(self.goals, 0), [], weighed
        for level in (*_LEVELS, None):
            # what rounding the larger documents left over or took too much is made up by the others of their source
            planned = dict(rest.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens"))).collect())
            scale = [(s, round(max(0.0, self.goals[s] - used[s]) / planned[s], 9)) for s in planned if planned[s]]
            scales = F.broadcast(spark.createDataFrame(scale, "source string, scale double"))  # one row a source
            now = rest if level is None else rest.where(F.col("n_tokens") > F.col("goal") / level)
            now = now.join(scales, "source").withColumn("weight", F.least("cap", F.col("weight") * F.col("scale"))).drop("scale")
            part = cut(_draw(now).select("doc", *_CELL, "n_tokens", "copies").where(F.col("copies") > 0))
            drawn.append(part)
            if level is not None:
                rest = rest.where(F.col("n_tokens") <= F.col("goal") / level)
                for s, n in part.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens"))).collect():
                    used[s] += n
        return functools.reduce(DataFrame.unionByName, drawn)

    def available(self) -> DataFrame:
        """source, most_tokens: what each source could give at most, every document used as often as it may be."""
        return self.cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("cap")).cast("long").alias("most_tokens"))

    def margins(self) -> DataFrame:
        """margin (source, lang or topic), value, target_share, planned_share, actual_share: for every value of each, none left out.

        target_share is the source's target, or the share a language or topic has among the documents that take part;
        planned_share follows from the weights, actual_share from the documents drawn.
        """
        cells = self.cells.select(*_CELL, F.col("tokens").cast("double").alias("tokens"), (F.col("weight") * F.col("tokens")).alias("planned"), F.lit(0.0).alias("used"), "goal")
        drawn = self.drawn().select(*_CELL, F.lit(0.0).alias("tokens"), F.lit(0.0).alias("planned"), (F.col("copies") * F.col("n_tokens")).cast("double").alias("used"), F.lit(None).cast("double").alias("goal"))
        value = lambda c: F.when(F.col(c) != "", F.col(c) if c == "source" else F.substr(F.col(c), F.lit(2)))
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("margin"), value(c).alias("value")) for c in _CELL))).alias("m")
        sums = cells.unionByName(drawn).select(each, "tokens", "planned", "used", "goal").select("m.*", "tokens", "planned", "used", "goal")
        per = sums.groupBy("margin", "value").agg(*(F.sum(c).alias(c) for c in ("tokens", "planned", "used")), F.max("goal").alias("goal"))
        whole = F.broadcast(per.where(F.col("margin") == "source").agg(*(F.sum(c).alias(f"all_{c}") for c in ("tokens", "planned", "used", "goal"))))  # one row
        share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(0.0)
        target = F.when(F.col("margin") == "source", share("goal")).otherwise(share("tokens"))
        return per.join(whole).select("margin", "value", target.alias("target_share"), share("planned").alias("planned_share"), share("used").alias("actual_share"))


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: source, target_share, actual_share, n_docs, n_uses, n_tokens, most_uses; of what Mix drew."""
    per = drawn.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_uses"))
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = wanted.join(per, "source", "left").select("source", "target_share", *map(zero, ("n_docs", "n_uses", "n_tokens", "most_uses")))
    whole = joined.agg(F.sum("n_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("n_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share")
    return joined.join(F.broadcast(whole)).select("source", "target_share", share, "n_docs", "n_uses", "n_tokens", "most_uses")
