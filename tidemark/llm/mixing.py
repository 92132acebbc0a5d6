"""Mixing sources to target weights (problem 9).

Method: Pareto order sampling.  A source that must supply more than its own size gives
whole copies of every document first; the rest of its quota is a fixed-size sample without
replacement.  Each document gets a random u and an inclusion probability p, and the ranking
variable (u / (1 - u)) / (p / (1 - p)); the smallest ranks are taken until the quota is met.

Inclusion probabilities are unequal: p is proportional to the document's size, or to
``weight`` where one is given.  Documents whose share would exceed 1 are certain; they are
taken out and the others' p is solved again, until the expected tokens are the quota.

Size of the mix: the largest one whose target shares can all be met within the repeat
caps, min over sources of cap x size / share.  A source without any tokens cannot
contribute; the others keep the proportions of their targets, and the report shows it.

Scale: two aggregations, combined map-side, tell the driver all it needs.  The first counts
tokens by source and weight, in bins a 64th of a power of two wide, and gives sizes, quotas
and p.  The second counts tokens by source and rank.  As p makes the expected tokens the
quota, the cut lies near rank 1, within the deviation of n random draws; bins are the
narrower the nearer they lie to it (a 64th of their distance), so the bin that holds the
cut has about sqrt(n) / 64 documents, and only those are sorted.  Both give at most a few
thousand rows per target source.  u is a hash of the document id, so a task that runs again
draws the same numbers.

Defined results: documents of other or no source, and those without tokens, stay out;
equal ranks fall to the document id; a source with share 0 or cap 0 contributes nothing;
a document larger than what is left of a quota is passed over; what no document in order
fits is filled by the remaining one that comes nearest to it, if that helps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import label

#: Bins per power of two, of weights and of distances from rank 1; powers that are told apart.
FINE, POWERS = 64, 40
#: Documents around the cut among which those that fit are looked for.
ZONE = 1000


@dataclass(frozen=True)
class Quota:
    source: str
    share: float
    cap: int
    size: int
    tokens: float

    @property
    def whole(self) -> int:
        """Copies that every document gets for certain."""
        return min(self.cap, int(self.tokens / self.size)) if self.size else 0

    @property
    def rest(self) -> float:
        """Tokens left for the sample."""
        return max(0.0, self.tokens - self.whole * self.size) if self.whole < self.cap else 0.0


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, int]) -> list[Quota]:
    """Tokens every source owes to the largest mix that meets all shares within the caps."""
    usable = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and sizes.get(s, 0) > 0]
    whole = sum(share for _, share, _ in usable)
    if not usable:
        return []
    total = min(cap * sizes[s] * whole / share for s, share, cap in usable)
    return [Quota(s, share, cap, sizes[s], total * share / whole) for s, share, cap in usable]


def scale(bins: list[tuple[int, float, float]], rest: float) -> float:
    """The factor c of p = min(1, c x weight) that makes the expected tokens ``rest``.

    ``bins``: weight bin, tokens, tokens x weight.  Bins are taken out as certain from the
    heaviest down, until no p of the others exceeds 1.
    """
    tokens, weighted = sum(t for _, t, _ in bins), sum(x for _, _, x in bins)
    if rest <= 0 or not weighted:
        return 0.0
    certain = 0.0
    for b, t, x in sorted(bins, reverse=True):
        c = (rest - certain) / weighted if weighted > 0 else 0.0
        if c * 2.0 ** (b / FINE) <= 1 or certain + t >= rest or certain + t >= tokens:
            return max(c, 0.0)
        certain += t
        weighted -= x
    return max((rest - certain) / weighted, 0.0) if weighted > 0 else 0.0


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of every document in the mix.

    ``documents``: doc_id, source, n_tokens (and ``weight``, positive, if p is not to follow
    the size); ``targets``: source, target_share, max_repeats.  ``documents`` is read several
    times: pass a stored table.  Two jobs run when this is called.
    """
    spark = documents.sparkSession
    told = targets.select(label("source").alias("source"), "target_share", "max_repeats").filter("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share").alias("s"), F.max("max_repeats").alias("m"))
    wanted = [(r[0], float(r[1]), int(r[2] or 0)) for r in told.orderBy("source").collect()]
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1e-9)) if "weight" in documents.columns else F.col("n_tokens").cast("double")
    docs = documents.select("doc_id", label("source").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), weight.alias("w")).filter(F.col("source").isin([s for s, _, _ in wanted]) & (F.col("n_tokens") > 0))
    limit = FINE * POWERS
    weight_bin = F.greatest(F.least(F.floor(F.log2("w") * FINE), F.lit(limit)), F.lit(-limit)).alias("b")
    by_weight: dict[str, list[tuple[int, float, float]]] = {s: [] for s, _, _ in wanted}
    for s, b, t, x in docs.groupBy("source", weight_bin).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("w"))).collect():
        by_weight[s].append((b, t, x))
    owed = quotas(wanted, {s: sum(t for _, t, _ in bins) for s, bins in by_weight.items()})
    if not owed:
        return docs.filter("false").select("doc_id", "source", "n_tokens", F.lit(0).alias("copies"))

    plan = spark.createDataFrame([(q.source, scale(by_weight[q.source], q.rest), q.whole, q.rest) for q in owed], "source string, c double, whole int, rest double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    p = F.least(F.greatest(F.col("c") * F.col("w"), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = (u / (1 - u)) / (p / (1 - p))
    off = F.col("x") - 0.5
    level = F.least(F.floor(-F.log2(F.greatest(F.abs(off), F.lit(2.0 ** -(POWERS - 1)))) * FINE), F.lit(limit - 1)).cast("int")
    # One row per target source is broadcast.
    ranked = docs.join(F.broadcast(plan), "source").withColumn("x", odds / (1 + odds)).withColumn("b", F.when(off < 0, level - limit).otherwise(limit - level))

    frame = ranked.filter("n_tokens <= rest")  # a document larger than all that is owed cannot be part of it
    zones = F.broadcast(spark.createDataFrame([(s, *z) for s, z in _reached(frame, {q.source: q.rest for q in owed}).items()], "source string, cut int, stop int, left double"))
    placed = frame.join(zones, "source")
    one = ["doc_id", "source", "n_tokens"]
    sure = placed.filter("b < cut").select(*one, F.lit(1).alias("extra"))

    # Around the cut documents are taken in order while they fit; those that do not are passed over.
    row = F.struct("x", "doc_id", "n_tokens")
    nothing = F.struct(F.col("left").alias("left"), F.expr("cast(array() as array<struct<x: double, doc_id: " + dict(docs.dtypes)["doc_id"] + ", n_tokens: bigint>>)").alias("took"))
    fits = lambda acc, d: F.when(d["n_tokens"] <= acc["left"], F.struct((acc["left"] - d["n_tokens"]).alias("left"), F.concat(acc["took"], F.array(d)).alias("took"))).otherwise(acc)
    zone = placed.filter("b between cut and stop").groupBy("source").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(row)).alias("rows")).select("source", F.aggregate("rows", nothing, fits).alias("z"))
    taken = zone.select("source", F.explode("z.took").alias("d")).select("d.doc_id", "source", "d.n_tokens", F.lit(1).alias("extra"))

    # What then is left is filled by the one document that leaves least.
    gaps = zones.join(zone.select("source", F.col("z.left").alias("still")), "source", "left").select("source", F.coalesce("still", "left").alias("gap"))
    beyond = placed.filter("b >= cut").join(F.broadcast(gaps), "source").withColumn("off", F.abs(F.col("n_tokens") - F.col("gap"))).filter("off < gap")
    beyond = beyond.join(taken.select("doc_id"), "doc_id", "left_anti")
    fill = beyond.groupBy("source").agg(F.min(F.struct("off", "x", "doc_id", "n_tokens")).alias("m")).select("m.doc_id", "source", "m.n_tokens", F.lit(1).alias("extra"))
    certain = ranked.filter("whole > 0").select(*one, F.col("whole").alias("extra"))
    copies = certain.unionByName(sure).unionByName(taken).unionByName(fill)
    return copies.groupBy("doc_id").agg(F.first("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.sum("extra").cast("int").alias("copies"))


def _reached(frame: DataFrame, quota: dict[str, float]) -> dict[str, tuple[int, int, float]]:
    """Per source the bin in which the quota is reached, the last bin looked at for what fits, and what is left at the first.

    The second is where the bins hold as much as is left without their largest documents,
    or ZONE documents.
    """
    sums: dict[str, list[tuple[int, int, int, int]]] = {s: [] for s in quota}
    for s, *r in frame.groupBy("source", "b").agg(F.sum("n_tokens"), F.max("n_tokens"), F.count(F.lit(1))).collect():
        sums[s].append(tuple(r))
    out = {}
    for s, want in quota.items():
        bins, below, at = sorted(sums[s]), 0, 0
        while at < len(bins) and below + bins[at][1] < want:
            below += bins[at][1]
            at += 1
        left, stop, room, seen = want - below, at, 0, 0
        while stop < len(bins) - 1 and room < left and seen < ZONE:
            room += bins[stop][1] - bins[stop][2]
            seen += bins[stop][3]
            stop += 1
        nowhere = FINE * POWERS + 1
        out[s] = (bins[at][0], bins[stop][0], left) if at < len(bins) else (nowhere, nowhere, left)
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents`` for every target source."""
    made = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    told = targets.select(label("source").alias("source"), "target_share").filter("source is not null")
    both = told.join(made, "source", "left").fillna(0, ["tokens", "documents"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    return both.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents")
