"""Mixing sources to target weights by entropy balancing.

Of all document rates r between 0 and the cap, those that meet each source's token target and are closest
to 1 in entropy are r = min(cap, exp(lambda_s * size)). The convex dual has one unknown per source; its
gradient and curvature are sums over documents, which each Newton step takes from a table of
(source, size, number of documents). The rates are then rounded into whole copies.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import hash_unit, small_table, staged, word_count

#: Fixed values of the mix.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
SEED = 20
FLAT, NONE, FULL = "tilt", "none", "full"
_PARAMS = "source string, target double, mode string, lam double, unit double, theta double, extra array<string>"


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Token targets by source: weights go round the sources by code point, null last; what lies above cap times a source is shared again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: cap * n for s, n in order}
    out, free, left = {}, [s for s, _ in order], share * sum(n for _, n in order)
    while free:
        per = left / sum(weight[s] for s in free)
        above = [s for s in free if per * weight[s] > limit[s]]
        if not above:
            out |= {s: per * weight[s] for s in free}
            break
        for s in above:
            out[s] = limit[s]
            left -= limit[s]
        free = [s for s in free if s not in above]
    return out


def _rate(cap: float = CAP) -> Column:
    tilt = F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("unit"))))
    return F.when(F.col("mode") == FULL, F.lit(cap)).when(F.col("mode") == NONE, F.lit(0.0)).otherwise(tilt)


def _exact(x: Column) -> Column:
    """Sums of decimals don't depend on the order of rows; sums of doubles do, and a rerun could round another way."""
    return F.sum(x.cast(T.DecimalType(28, 6)))


class Mix:
    """The solved mix of a corpus: per source its target, dual and rounding threshold.

    max_sources bounds what the driver holds (a few numbers per source) and what is broadcast; more raise an error.
    """

    def __init__(self, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, max_sources: int = 100_000, steps: int = 60):
        if cap != int(cap) or cap < 1:
            raise ValueError("the cap is a number of whole copies")
        self.spark, self.text, self.source, self.key, self.cap = docs.sparkSession, text, source, key, cap
        self.sizes = staged(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
        self.by_size = staged(self.sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
        totals = self.by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("size").alias("longest")).limit(max_sources + 1).collect()
        if len(totals) > max_sources:
            raise ValueError(f"more than {max_sources} sources; raise max_sources or map sources to fewer")
        self.words = {r["source"]: int(r["words"] or 0) for r in totals}
        self.target = targets(list(self.words.items()), weights, share, cap)
        self.state = {s: {"target": float(t), "mode": FULL if t >= cap * self.words[s] else FLAT if t > 0 else NONE, "lam": 0.0, "unit": 1.0, "theta": 0.0, "extra": []} for s, t in self.target.items()}
        #: Sources whose dual wasn't solved in so many steps. Rounding still fills their targets, by rates off the optimum.
        self.unsolved: list[str | None] = []
        for r in totals:
            self.state[r["source"]]["unit"] = float(max(1, r["longest"] or 0))
        self._newton(steps)
        self._round()

    def params(self) -> DataFrame:
        return F.broadcast(small_table(self.spark, [(s, v["target"], v["mode"], v["lam"], v["unit"], v["theta"], v["extra"]) for s, v in self.state.items()], _PARAMS).withColumnRenamed("source", "_source"))

    def _with(self, df: DataFrame) -> DataFrame:
        return df.join(self.params(), df["source"].eqNullSafe(F.col("_source")), "left")

    def _newton(self, steps: int) -> None:
        """Newton's steps for all sources at once, each within a bracket that halves where a step would leave it."""
        bracket = {s: [None, None] for s, v in self.state.items() if v["mode"] == FLAT}
        for _ in range(steps):
            if not bracket:
                return
            r, x = _rate(self.cap), F.col("size") / F.col("unit")
            sums = self._with(self.by_size).filter(F.col("mode") == FLAT).groupBy("_source").agg(
                _exact(F.col("size") * r * F.col("n")).alias("g"), _exact(F.when(r < self.cap, F.col("size") * x * r * F.col("n")).otherwise(0)).alias("h")
            )
            for row in sums.collect():
                s, v = row["_source"], self.state[row["_source"]]
                if s not in bracket:
                    continue
                gap, slope, lam = float(row["g"]) - v["target"], float(row["h"]), v["lam"]
                if abs(gap) <= max(0.5, 1e-9 * v["target"]):
                    del bracket[s]
                    continue
                low, high = bracket[s] = [lam, bracket[s][1]] if gap < 0 else [bracket[s][0], lam]
                step = lam - gap / slope if slope > 0 else None
                if step is not None and (low is None or step > low) and (high is None or step < high):
                    v["lam"] = step
                elif low is not None and high is not None:
                    v["lam"] = (low + high) / 2
                else:
                    v["lam"] = lam * 2 + (1.0 if gap < 0 else -1.0)
        self.unsolved = list(bracket)
        if bracket:
            warnings.warn(f"the dual of {len(bracket)} sources isn't solved after {steps} steps", stacklevel=3)

    def _key(self) -> Column:
        """From its source's theta on, a document gets the copy that its rate has a fraction of. Order: by chance, weighted by that fraction."""
        r = _rate(self.cap)
        return (r - F.floor(r)) - hash_unit(F.col("doc_id"), F.lit(SEED))

    def _round(self, levels: int = 3, fan: int = 1024, fills: int = 4) -> None:
        """Theta per source, so that whole copies come up to the target but for less than a document, and a few more documents.

        Sums over bins of the key narrow theta to a bin, then to a part of it, levels times. What is left then takes the
        document that comes closest to it, fills times.
        """
        r = _rate(self.cap)
        docs = self._with(self.sizes).filter((F.col("mode") == FLAT) & (F.col("size") > 0)).select("_source", F.col("doc_id").cast("string").alias("doc"), "size", F.floor(r).alias("whole"), self._key().alias("v"), (r < self.cap).alias("open"))
        docs = staged(docs, "rates")
        base = {x["_source"]: x["b"] for x in docs.groupBy("_source").agg(F.sum(F.col("size") * F.col("whole")).alias("b")).collect()}
        need = {s: v["target"] - base.get(s, 0) for s, v in self.state.items() if v["mode"] == FLAT}
        span = {s: (-1.0, 2.0 / fan) for s in need}
        for _ in range(levels):
            if not span:
                break
            at = F.broadcast(small_table(self.spark, [(s, *x, need[s]) for s, x in span.items()], "s string, low double, width double, need double"))
            bins = docs.filter("open").join(at, F.col("_source").eqNullSafe(F.col("s"))).withColumn("bin", F.floor((F.col("v") - F.col("low")) / F.col("width")))
            bins = bins.filter((F.col("bin") >= 0) & (F.col("bin") < fan)).groupBy("s", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
            # At most fan rows a source, from the top bin down.
            bins = bins.withColumn("cum", F.sum("words").over(Window.partitionBy("s").orderBy(F.desc("bin"))))
            cut = bins.groupBy("s").agg(F.max(F.when(F.col("cum") > F.col("need"), F.col("bin"))).alias("bin"), F.max(F.when(F.col("cum") <= F.col("need"), F.col("cum"))).alias("taken"))
            left = {}
            for row in cut.collect():
                s = row["s"]
                low, width = span[s]
                need[s] -= row["taken"] or 0
                # The bin that is too much goes on to the next level; theta lies above it.
                if row["bin"] is None:
                    self.state[s]["theta"] = low
                else:
                    edge = low + row["bin"] * width
                    self.state[s]["theta"], left[s] = edge + width, (edge, width / fan)
            span = left
        for _ in range(fills):
            at = [(s, n, self.state[s]["theta"], self.state[s]["extra"]) for s, n in need.items() if n >= 1]
            if not at:
                return
            at = F.broadcast(small_table(self.spark, at, "s string, need double, theta double, extra array<string>"))
            rest = docs.filter("open and doc is not null").join(at, F.col("_source").eqNullSafe(F.col("s"))).filter((F.col("v") < F.col("theta")) & ~F.array_contains("extra", F.col("doc")))
            # Rows that share a key are taken together.
            rest = rest.groupBy("s", "doc", "need").agg(F.sum("size").alias("size"))
            found, pair = rest.groupBy("s"), F.struct("size", "doc")
            for s, under, over in found.agg(F.max(F.when(F.col("size") <= F.col("need"), pair)), F.min(F.when(F.col("size") > F.col("need"), pair))).collect():
                if over and over["size"] - need[s] < need[s] - (under["size"] if under else 0):
                    under = over
                if under:
                    self.state[s]["extra"].append(under["doc"])
                need[s] = need[s] - under["size"] if under else 0

    def _copies(self) -> Column:
        r = _rate(self.cap)
        more = (self._key() >= F.col("theta")) | F.coalesce(F.array_contains("extra", F.col("doc_id").cast("string")), F.lit(False))
        copies = F.floor(r) + ((r < self.cap) & more).cast("long")
        return F.when(F.col("size") == 0, F.lit(1)).when(F.col("mode") == FULL, F.lit(int(self.cap))).when(F.col("mode") == NONE, F.lit(0)).otherwise(copies).cast("long")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, rate, copies, taken: a row per document.

        A null or wordless text has size 0 and one copy; a null source is a source; repeated rows are documents of their own
        that get the same copies; an empty table gives an empty result; other columns aren't read.
        """
        own = F.broadcast(small_table(self.spark, [(s, n) for s, n in self.words.items()], "s string, source_size long"))
        out = self._with(self.sizes).join(own, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", self._copies())
        return out.select("doc_id", "source", "size", "source_size", "target", _rate(self.cap).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with each row as often as the mix takes it, and no other columns. No row is moved: copies follow from a row and its source's few numbers."""
        names = docs.columns
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(self.key).alias("doc_id"), F.col(self.source).cast("string").alias("source"), word_count(F.col(self.text)).alias("size"))
        row = self._with(row).withColumn("copies", self._copies()).filter("copies > 0")
        return row.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col("_row").getField(c).alias(c) for c in names])
