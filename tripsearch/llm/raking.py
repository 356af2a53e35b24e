"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are counted in cells of source, language and topic. Raking scales the cells' token weights
until the weighted tokens of every source, language and topic meet their target shares; all three
margins are fitted in turn, a pass at a time, over the table of cells. One factor then turns
weights into inclusion probabilities, capped at 1, so that the expected sample has ``keep`` of all
tokens; what the cap cuts off stays as a weight of the sampled document. A document is drawn by a
hash of its id. All of it is DataFrame operations; the driver sees single numbers.

Defined results: a null source, language or topic is a value of its own. Null and empty texts have
no tokens; they carry weight 0 tokens and are drawn by their cell's probability (1 in cells without
any tokens). Rows that repeat an id are drawn together; rows without an id are drawn by their
text. Targets for values that do not occur are spread over the others. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.storage import durable

MARGINS = ("source", "lang", "topic")
KEEP = 0.5
#: Passes end when every margin is this near its target; targets that contradict each other never are.
TOLERANCE = 1e-6
MOST_PASSES = 60
#: Target shares are the observed ones to this power: rare values gain, frequent ones lose.
TEMPER = 0.7
SEED = 20_240_101


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def topic_of(text: Column) -> Column:
    """A rough kind of text from its marks, capitals and figures."""
    size = F.length(text)
    marks = F.regexp_count(text, F.lit(r"[|#%&$*!<>{}=]"))
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(capitals * 2 > size, "capitals").when(marks * 20 > size, "marks")
        .when(size < 600, "short").when(size < 6000, "middle").otherwise("long")
    )


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, draw (uniform in [0, 1))."""
    at = F.coalesce(F.xxhash64(F.lit(SEED), F.when(F.col(key).isNotNull(), F.col(key))), F.lit(0))
    at = F.when(F.col(key).isNull(), F.xxhash64(F.lit(SEED), F.col(text))).otherwise(at)
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (topic_of(F.col(text)) if topic is None else topic).alias("topic"), token_count(F.col(text)).alias("tokens"),
        (F.pmod(at, F.lit(1 << 53)) / float(1 << 53)).alias("draw"),
    )


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """value, share: observed token shares to a power."""
    held = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    total = held.agg(F.sum(F.pow("tokens", F.lit(power))).alias("s")).first()["s"] or 1.0
    return held.select("value", (F.pow("tokens", F.lit(power)) / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES) -> DataFrame:
    """``cells`` with ``weight``: the fitted tokens of a cell are ``tokens * weight``, in all as many as before."""
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    goals = {}
    for margin, target in targets.items():
        there = cells.filter("tokens > 0").select(F.col(margin).alias("value")).distinct()
        held = durable(target.join(there, target["value"].eqNullSafe(there["value"]), "left_semi"), "targets")
        whole = held.agg(F.sum("share").alias("s")).first()["s"] or 1.0
        goals[margin] = held.select(F.col("value").alias("goal_of"), (F.col("share") / whole * total).alias("goal"))
    fitted = durable(cells.withColumn("weight", F.lit(1.0)), "cells")
    for _ in range(most_passes):
        worst = 0.0
        for margin in targets:
            now = fitted.groupBy(F.col(margin).alias("sum_of")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            step = durable(
                now.join(goals[margin], F.col("sum_of").eqNullSafe(F.col("goal_of")), "left")
                .select("sum_of", "now", F.coalesce("goal", F.lit(0.0)).alias("goal")), "margin",
            )
            off = step.agg(F.max(F.abs(F.col("now") - F.col("goal"))).alias("o")).first()["o"]
            worst = max(worst, (off or 0.0) / max(total, 1))
            ratio = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0)
            fitted = (
                fitted.join(step, fitted[margin].eqNullSafe(step["sum_of"]), "left")
                .select(*cells.columns, (F.col("weight") * ratio).alias("weight"))
            )
        fitted = durable(fitted, "cells")
        if worst <= tolerance:
            break
    return fitted


def probabilities(fitted: DataFrame, keep: float) -> DataFrame:
    """``fitted`` with ``probability`` and ``sample_weight`` (over 1 where the cap cuts off)."""
    goal = keep * (fitted.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    factor = 0.0
    while True:
        capped = (F.col("weight") * factor >= 1) if factor else F.lit(False)
        sums = fitted.agg(
            F.sum(F.when(capped, F.col("tokens"))).alias("full"),
            F.sum(F.when(~capped, F.col("tokens") * F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        # capped cells stay capped as the factor only grows: it settles after at most one round per cell
        higher = max(0.0, goal - (sums["full"] or 0)) / sums["open"] if sums["open"] else factor
        if higher <= factor * (1 + 1e-12):
            break
        factor = higher
    scaled = F.col("weight") * F.lit(factor)
    return fitted.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), scaled)).otherwise(1.0)).withColumn(
        "sample_weight", F.when(F.col("tokens") > 0, F.greatest(F.lit(1.0), scaled)).otherwise(1.0)
    )


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """Per document its cell, tokens, token_weight, probability, sample_weight and whether it is sampled."""
    rows = durable(features(docs, topic=topic), "features")
    cells = durable(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    targets = targets or {m: durable(tempered(cells, m), "targets") for m in MARGINS}
    fitted = durable(probabilities(rake(cells, targets), keep), "cells").select(
        *[F.col(m).alias(f"cell_{m}") for m in MARGINS], "weight", "probability", "sample_weight"
    )
    same = F.lit(True)
    for m in MARGINS:
        same = same & F.col(m).eqNullSafe(F.col(f"cell_{m}"))
    return rows.join(fitted, same, "left").select(
        "doc_id", *MARGINS, "tokens", F.col("weight").alias("token_weight"), "probability", "sample_weight",
        (F.col("draw") < F.col("probability")).alias("sampled"),
    )
