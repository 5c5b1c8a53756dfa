"""Laps and sectors: session history, pace, comparison, diagnosis and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(laps: DataFrame, sectors: DataFrame) -> DataFrame:
    """Best lap, mean, spread, theoretical best and potential gain of each session. Times of 0 and less don't count."""
    timed = F.when(F.col("lap_time_ms") > 0, F.col("lap_time_ms"))
    of_laps = laps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("lap_count"), F.min(timed).alias("best_lap_time_ms"), F.min_by("lap_number", F.when(timed.isNotNull(), F.struct(timed, F.col("lap_number")))).alias("best_lap_number"),
        F.avg(timed).alias("average_lap_time_ms"), F.stddev_pop(timed).alias("stddev_lap_time_ms"),
    )
    best = best_sectors(sectors).groupBy("session_id").agg(F.sum("best_sector_time_ms").alias("theoretical_best_ms"), F.count(F.lit(1)).alias("sector_count"))
    gain = F.greatest(F.lit(0), F.col("best_lap_time_ms") - F.col("theoretical_best_ms"))
    return of_laps.join(best, "session_id", "left").withColumn("potential_gain_ms", F.when(F.col("best_lap_time_ms").isNotNull() & F.col("theoretical_best_ms").isNotNull(), gain))


def best_sectors(sectors: DataFrame) -> DataFrame:
    """The best positive time of each session's sectors, and the first lap that has it."""
    return sectors.where("sector_time_ms > 0").groupBy("session_id", "sector_number").agg(
        F.min("sector_time_ms").cast("long").alias("best_sector_time_ms"), F.min_by("lap_number", F.struct("sector_time_ms", "lap_number")).alias("best_lap_number")
    )


def lap_list(laps: DataFrame, sectors: DataFrame) -> DataFrame:
    """Laps with their sectors as a sorted array of structs, and ``is_session_best``."""
    nested = sectors.groupBy("session_id", "lap_number").agg(F.array_sort(F.collect_list(F.struct("sector_number", "sector_time_ms"))).alias("sectors"))
    best = history(laps, sectors).select("session_id", F.col("best_lap_number").alias("__best"))
    empty = F.array().cast("array<struct<sector_number:int,sector_time_ms:int>>")
    return (
        laps.join(nested, ["session_id", "lap_number"], "left").join(best, "session_id", "left")
        .withColumns({"sectors": F.coalesce("sectors", empty), "is_session_best": F.coalesce(F.col("lap_number") == F.col("__best"), F.lit(False))}).drop("__best")
    )


def pace(laps: DataFrame, least_for_spread: int = 3) -> DataFrame:
    """Best lap, mean, spread (from three laps on) and the last change of each session, of laps with a positive time."""
    timed = laps.where("lap_time_ms > 0")
    w = Window.partitionBy("session_id").orderBy("lap_number")
    marked = timed.withColumn("__change", F.col("lap_time_ms") - F.lag("lap_time_ms").over(w))
    return marked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("timed_laps"), F.min_by("lap_number", F.struct("lap_time_ms", "lap_number")).alias("best_lap_number"), F.avg("lap_time_ms").alias("mean_ms"),
        F.when(F.count(F.lit(1)) >= least_for_spread, F.stddev_pop("lap_time_ms")).alias("spread_ms"), F.max_by("__change", "lap_number").alias("last_change_ms"),
    )


def sector_deltas(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors that both laps of a pair have with a positive time: target minus reference."""
    timed = sectors.where("sector_time_ms > 0").select("session_id", "lap_number", "sector_number", "sector_time_ms")
    ref = timed.select("session_id", F.col("lap_number").alias("ref_lap"), "sector_number", F.col("sector_time_ms").alias("ref_ms"))
    target = timed.select("session_id", F.col("lap_number").alias("target_lap"), "sector_number", F.col("sector_time_ms").alias("target_ms"))
    return pairs.join(ref, ["session_id", "ref_lap"]).join(target, ["session_id", "target_lap", "sector_number"]).select(
        "session_id", "ref_lap", "target_lap", "sector_number", "ref_ms", "target_ms", (F.col("target_ms") - F.col("ref_ms")).alias("delta_ms")
    )


PAIR = ("session_id", "ref_lap", "target_lap")


def compare(pairs: DataFrame, laps: DataFrame, sectors: DataFrame) -> DataFrame:
    """Total and sector gains and losses of each pair of laps; ``is_complete`` if both have the same sectors, at least one."""
    deltas = sector_deltas(pairs, sectors)
    d = F.col("delta_ms")
    sums = deltas.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("common_sectors"), F.sum(F.when(d > 0, d).otherwise(0)).alias("lost_ms"), F.sum(F.when(d < 0, -d).otherwise(0)).alias("gained_ms"),
        F.min_by("sector_number", F.when(d > 0, F.struct(-d, F.col("sector_number")))).alias("biggest_loss_sector"), F.min_by("sector_number", F.when(d < 0, F.struct(d, F.col("sector_number")))).alias("biggest_gain_sector"),
    )
    numbers = sectors.where("sector_time_ms > 0").groupBy("session_id", "lap_number").agg(F.count(F.lit(1)).alias("n"))
    time = laps.select("session_id", "lap_number", "lap_time_ms").join(numbers, ["session_id", "lap_number"], "left")
    side = lambda name: time.select("session_id", F.col("lap_number").alias(f"{name}_lap"), F.col("lap_time_ms").alias(f"{name}_time_ms"), F.coalesce("n", F.lit(0)).alias(f"__{name}"))
    joined = pairs.join(side("ref"), ["session_id", "ref_lap"]).join(side("target"), ["session_id", "target_lap"]).join(sums, list(PAIR), "left")
    common = F.coalesce("common_sectors", F.lit(0))
    return joined.select(
        *PAIR, "ref_time_ms", "target_time_ms", (F.col("target_time_ms") - F.col("ref_time_ms")).alias("total_delta_ms"), common.alias("common_sectors"), F.coalesce("lost_ms", F.lit(0)).alias("lost_ms"),
        F.coalesce("gained_ms", F.lit(0)).alias("gained_ms"), "biggest_loss_sector", "biggest_gain_sector", ((common > 0) & (common == F.col("__ref")) & (common == F.col("__target"))).alias("is_complete"),
    )


def pairs_with_best(laps: DataFrame, sectors: DataFrame) -> DataFrame:
    """Every timed lap against its session's best lap."""
    best = history(laps, sectors).where("best_lap_number is not null").select("session_id", F.col("best_lap_number").alias("ref_lap"))
    return laps.where("lap_time_ms > 0").join(best, "session_id").where("lap_number != ref_lap").select("session_id", "ref_lap", F.col("lap_number").alias("target_lap"))


def diagnose(pairs: DataFrame, laps: DataFrame, sectors: DataFrame) -> DataFrame:
    """Each sector of a pair as lost, gained or neutral, its rank within that kind, its share of all losses, and the pair's unexplained time."""
    deltas = sector_deltas(pairs, sectors)
    d = F.col("delta_ms")
    kind = F.when(d > 0, "lost").when(d < 0, "gained").otherwise("neutral")
    all_of = Window.partitionBy(*PAIR)
    marked = deltas.withColumns({"kind": kind, "__lost": F.sum(F.when(d > 0, d).otherwise(0)).over(all_of), "__sum": F.sum(d).over(all_of)})
    rank = F.row_number().over(Window.partitionBy(*PAIR, "kind").orderBy(F.desc(F.abs("delta_ms")), "sector_number"))
    time = lambda name: laps.select("session_id", F.col("lap_number").alias(f"{name}_lap"), F.col("lap_time_ms").alias(f"__{name}"))
    joined = marked.withColumn("rank", rank).join(time("ref"), ["session_id", "ref_lap"]).join(time("target"), ["session_id", "target_lap"])
    share = F.when(F.col("kind") == "lost", F.try_divide(d.cast("double"), F.col("__lost")))
    return joined.select(*PAIR, "sector_number", "delta_ms", "kind", "rank", share.alias("loss_share"), (F.col("__target") - F.col("__ref") - F.col("__sum")).alias("unexplained_ms"))


def recommend(pairs: DataFrame, laps: DataFrame, sectors: DataFrame, high: float = 0.6, medium: float = 0.3) -> DataFrame:
    """Ranked advice for each pair: data quality (sectors missing or not adding up), primary and secondary loss, a balanced loss, and the best gain to keep."""
    diagnosis = diagnose(pairs, laps, sectors)
    whole = compare(pairs, laps, sectors)
    first, second = (diagnosis.where(f"kind = 'lost' and rank = {k}") for k in (1, 2))
    level = F.when(F.col("loss_share").isNull(), "MEDIUM").when(F.col("loss_share") >= high, "HIGH").when(F.col("loss_share") >= medium, "MEDIUM").otherwise("LOW")
    row = lambda df, order, code, priority: df.select(*PAIR, F.lit(order).alias("rule_order"), F.lit(code).alias("code"), priority.alias("priority"), "sector_number", "delta_ms")
    none = whole.withColumns({"sector_number": F.lit(None).cast("int"), "delta_ms": F.lit(None).cast("int")})
    lost = diagnosis.where("kind = 'lost'").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    balanced = first.where(F.col("loss_share") < high).join(lost.where("n >= 2"), list(PAIR), "left_semi")
    rules = [
        row(none.where("not is_complete or total_delta_ms != lost_ms - gained_ms"), 1, "data_quality", F.lit("HIGH")), row(first, 2, "primary_sector", level), row(second, 3, "secondary_sector", F.lit("MEDIUM")),
        row(balanced, 4, "balanced_improvement", F.lit("LOW")), row(diagnosis.where("kind = 'gained' and rank = 1"), 5, "consolidate_gain", F.lit("LOW")),
    ]
    all_rules = rules[0]
    for r in rules[1:]:
        all_rules = all_rules.unionByName(r)
    weight = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    return all_rules.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy(weight, "rule_order"))).drop("rule_order")
