"""What clipping does to cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.text import loss_tier, placement


def cue_impact(cues: DataFrame, natural: Column, loop: Column, play_percent: Column, duration: Column) -> DataFrame:
    """Seconds that each cue plays, loses, and the tier of the loss.

    A loop plays on; an explicit share of its length comes before a duration; without a duration a
    cue plays in full; else it is clipped. A cue without a natural length is MISSING.
    """
    there = F.coalesce(natural > 0, F.lit(False))
    clipped = F.least(duration, natural)
    is_clip = ~loop & play_percent.isNull() & F.coalesce(duration > 0, F.lit(False))
    plays = F.when(loop, natural).when(play_percent.isNotNull(), natural * play_percent / 100).when(is_clip, clipped).otherwise(natural)
    lost = F.greatest(natural - plays, F.lit(0.0))
    tier = F.when(~there, "MISSING").when(is_clip, loss_tier(natural - clipped)).otherwise("EXCLUDED")
    return cues.withColumns({
        "plays_now_s": F.when(there, plays), "delta_s": F.when(there, lost), "lost_pct": F.when(there, lost / natural * 100), "tier": tier, "placement": placement(F.col("cue")),
        "remediation": F.when(tier.isin("2-minor", "3-review"), "play_duration: 100").otherwise(""),
    })
