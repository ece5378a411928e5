"""Fuzzy matching of cues with sound assets by their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castline.functions.text import coverage, jaccard, scope_rank

FLOOR, STRONG_COVERAGE, STRONG_JACCARD, STRONG_MARGIN, JACCARD_WEIGHT = 0.5, 0.8, 0.4, 0.15, 0.25


def candidates(cues: DataFrame, pool: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Cues (cue, cue_tokens, placement) with assets (asset, asset_tokens, placement), both without repeats, that cover enough of them.

    An asset that covers a share of at least ``floor`` has one of the first tokens of the cue, as
    many as it may lack and one: only these are looked up, in an equi-join. Rarer tokens come
    first, so that a token of a third of all assets is seldom among them.
    """
    counts = pool.select(F.explode("asset_tokens").alias("token")).groupBy("token").count()
    ranked = (
        cues.select("cue", "placement", "cue_tokens", F.explode("cue_tokens").alias("token")).join(counts, "token")
        .withColumn("place", F.row_number().over(Window.partitionBy("cue", "placement").orderBy("count", "token")))
    )
    n = F.size("cue_tokens")
    probes = ranked.where(F.col("place") <= n - F.ceil(n * floor) + 1).select("cue", "placement", "token")
    listed = pool.select("asset", "placement", F.explode("asset_tokens").alias("token"))
    # Names meet first; the tokens come back to those that are left.
    met = probes.join(listed, ["token", "placement"]).select("cue", "placement", "asset").distinct()
    met = met.join(cues.select("cue", "placement", "cue_tokens"), ["cue", "placement"]).join(pool.select("asset", "placement", "asset_tokens"), ["asset", "placement"])
    met = met.select("cue", "placement", "cue_tokens", "asset", "asset_tokens")
    scored = met.withColumns({"coverage": coverage(F.col("cue_tokens"), F.col("asset_tokens")), "jaccard": jaccard(F.col("cue_tokens"), F.col("asset_tokens"))})
    return scored.where(F.col("coverage") >= floor).withColumn("score", F.col("coverage") + JACCARD_WEIGHT * F.col("jaccard"))


def ranked_matches(scored: DataFrame, cues: DataFrame, top: int = 3) -> DataFrame:
    """The best candidates of each cue with rank, margin and tier; a cue without any has one row of tier NONE."""
    order = Window.partitionBy("cue").orderBy(F.desc("score"), "asset")
    best = scored.withColumns({"rank": F.row_number().over(order), "margin": F.col("score") - F.lead("score", 1, 0.0).over(order)}).where(F.col("rank") <= top)
    strong = (F.col("coverage") >= STRONG_COVERAGE) & (F.col("jaccard") >= STRONG_JACCARD) & (F.col("margin") >= STRONG_MARGIN)
    tier = F.max(F.when(F.col("rank") == 1, F.when(strong, "STRONG").otherwise("REVIEW"))).over(Window.partitionBy("cue"))
    best = best.withColumn("tier", tier).select("cue", "asset", "coverage", "jaccard", "score", "rank", "tier")
    return cues.select("cue").join(best, "cue", "left").withColumn("tier", F.coalesce("tier", F.lit("NONE")))


def exact_index(assets: DataFrame, own: str, name: str = "filename") -> DataFrame:
    """The preferred copy of each file name: of the own show, then shared, then the first one seen."""
    best = F.min_by(F.struct(*assets.columns), F.struct(scope_rank(F.col("scope"), F.lit(own)), "at"))
    return assets.groupBy(name).agg(best.alias("_best")).select("_best.*")


def with_exact(cues: DataFrame, index: DataFrame, ranked: DataFrame, file_name: str = "filename") -> DataFrame:
    """Cues whose own file is there are EXACT; the others keep their ranked candidates."""
    exact = cues.join(index.select(F.col(file_name), F.col("asset").alias("asset")), file_name).select("cue", "asset", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("jaccard"), F.lit(1.25).alias("score"), F.lit(1).alias("rank"), F.lit("EXACT").alias("tier"))
    return exact.unionByName(ranked.join(exact.select("cue"), "cue", "left_anti"))
