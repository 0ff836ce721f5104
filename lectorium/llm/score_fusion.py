"""One ranking from lists of scores on different scales.

Each list of a query is standardised by its median and median absolute deviation, turned so that more is better,
squashed into (0, 1) by the logistic function, and the bounded values of an item are combined by a weighted
geometric mean over all lists of the query. A list that has no usable score for an item gives it the floor, the
least bounded value there is, and so no gain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectorium.llm.common import checkpointed, row_numbers

#: Bounded value of an item that a list doesn't have; no usable score is squashed below it.
FLOOR = 0.02
#: A deviation of this many robust standard deviations is squashed to the logistic of 1.
SLOPE = 1.0


def usable_scores(results: DataFrame) -> DataFrame:
    """(query_id, score_list, chunk_id, score): one finite score for each chunk of each list.

    Where `score` is null or NaN, the score in `item_json` stands in; rows without either are no result. A result
    given more than once counts once: by its best score, which the direction of the list decides, so both bounds
    are kept here as least and greatest.
    """
    own = F.when(~F.isnan("score"), F.col("score"))
    inside = F.get_json_object("item_json", "$.score").cast("double")
    score = F.coalesce(own, F.when(~F.isnan(inside), inside))
    rows = results.select("query_id", "score_list", "chunk_id", score.alias("score")).where("query_id is not null and chunk_id is not null and score_list is not null and score is not null")
    rows = rows.where(~F.col("score").isin(float("inf"), float("-inf")))
    return rows.groupBy("query_id", "score_list", "chunk_id").agg(F.min("score").alias("least"), F.max("score").alias("greatest"))


#: Half-width, in ranks, of the bracket around the median; the sketch that finds it is ten times as exact.
BRACKET, ACCURACY = 0.001, 10_000


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(`keys`, `name`): the exact median of each group, the mean of the two middle values of an even number.

    A sketch of bounded size brackets the median; only the distinct values within the bracket are ordered, after
    their counts are summed, so a group of any size and with any ties passes through partial aggregates.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    sketch = F.percentile_approx(value, F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET)), ACCURACY)
    brackets = df.groupBy(*keys).agg(sketch.alias("_q"), F.count("*").alias("_total"))
    placed = counts.join(brackets, keys)
    below = placed.groupBy(*keys).agg(F.sum(F.when(F.col("_v") < F.col("_q")[0], F.col("_n")).otherwise(0)).alias("_below"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # what is in the bracket
    inside = placed.where(F.col("_v").between(F.col("_q")[0], F.col("_q")[1])).join(below, keys).withColumn("_upto", F.col("_below") + F.sum("_n").over(order))
    holds = [(F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at) for at in (F.expr("(_total - 1) div 2"), F.expr("_total div 2"))]
    middle = inside.groupBy(*keys).agg(*[F.max(F.when(h, F.col("_v"))).alias(f"_m{i}") for i, h in enumerate(holds)])
    return middle.select(*keys, ((F.col("_m0") + F.col("_m1")) / 2).alias(name))


def fused_scores(results: DataFrame, lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, fused_score) of every chunk that a list has.

    `lists` gives for each score_list which end is better ('low' or 'high'); lists it doesn't name, and lists of a
    query without any usable score, take no part. `weights` (1 each) are relative. A list whose usable scores
    are all equal gives each of them the middle value 0.5. Where the median absolute deviation is 0 but scores
    differ, the mean absolute deviation takes its place. Empty input gives an empty ranking.
    """
    known = F.broadcast(lists.where("better in ('low', 'high')").select("score_list", "better").dropDuplicates(["score_list"]))
    scores = usable_scores(results).join(known, "score_list")
    scores = scores.select("query_id", "score_list", "chunk_id", F.when(F.col("better") == "high", F.col("greatest")).otherwise(-F.col("least")).alias("score"))
    # both are read several times below, so each is worked out once
    keys, scores = ["query_id", "score_list"], checkpointed(scores)
    scores = checkpointed(scores.join(medians(scores, keys, "score", "median"), keys).withColumn("gap", F.abs(F.col("score") - F.col("median"))))
    spread = scores.groupBy(*keys).agg(F.avg("gap").alias("mean_gap")).join(medians(scores, keys, "gap", "mad"), keys)
    unit = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.when(F.col("mean_gap") > 0, F.col("mean_gap") * 1.2533))
    z = F.coalesce((F.col("score") - F.col("median")) / unit, F.lit(0.0))
    bounded = FLOOR + (1 - FLOOR) / (1 + F.exp(-SLOPE * z))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("score_list") == name, F.lit(float(value))).otherwise(weight)
    log_floor = F.log(F.lit(FLOOR))
    gains = scores.join(spread, ["query_id", "score_list"]).select("query_id", "chunk_id", "score_list", weight.alias("weight"), F.log(bounded).alias("log"))
    total = gains.select("query_id", "score_list", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("total"))
    items = gains.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * (F.col("log") - log_floor)).alias("gain"))
    return items.join(total, "query_id").select("query_id", "chunk_id", F.exp(log_floor + F.col("gain") / F.col("total")).alias("fused_score"))


def fused_ranking(results: DataFrame, lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, fused_score, fused_rank), best first; ties go to the smaller chunk_id."""
    return row_numbers(fused_scores(results, lists, weights), ["query_id"], [F.col("fused_score").desc(), F.col("chunk_id").asc()], "fused_rank")


def best(results: DataFrame, lists: DataFrame, k: int = 5) -> DataFrame:
    """The k best of each query: (query_id, chunk_id). Each task keeps its own k best before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")
    return fused_scores(results, lists).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).select("query_id", "chunk_id")
