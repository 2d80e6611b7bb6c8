"""Ranking and selection of candidates: weighted scores with missing values, duplicates, strata, top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def weighted(components: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """The weighted mean over the components that are not null, and the share of weight that they have. Null without any."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    have = add([F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in components.values()])
    total = sum(w for _, w in components.values())
    value = add([F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in components.values()])
    return F.try_divide(value, F.nullif(have, F.lit(0.0))), have / F.lit(total)


def rank_score(components: dict[str, tuple[Column, float]], penalties: list[tuple[Column, float]], uncertainty: float = 0.08) -> tuple[Column, Column]:
    """Score in [0, 1]: the weighted mean less penalties (those whose condition holds) and less `uncertainty` for what is missing."""
    mean, coverage = weighted(components)
    minus = reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(0.0) for c, p in penalties], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - minus - F.lit(uncertainty) * (1 - coverage))), coverage


def duration_gate(seconds: Column, story: Column) -> tuple[Column, Column]:
    """Whether a clip's length is allowed (8 to 180 s; up to 300 s for a story), and how suitable it is: 1, .75, .35 or 0."""
    ok = seconds.between(8, 180) | (story & seconds.between(8, 300))
    fit = F.when(seconds.between(30, 90), 1.0).when(seconds.between(15, 120), 0.75).when(ok, 0.35).otherwise(0.0)
    return ok, fit


def equivalent_pairs(candidates: DataFrame, least_iou: float = 0.8, least_share: float = 0.8) -> DataFrame:
    """Pairs a < b of one source whose times overlap by `least_iou` of their union, or of the shorter with so much evidence shared."""
    c = candidates.select("source_id", "moment_id", "start_us", "end_us", "evidence")
    j = interval_join(c, c).where("moment_id < b_moment_id")
    both = F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")
    union = F.greatest("end_us", "b_end_us") - F.least("start_us", "b_start_us")
    shorter = F.least(F.col("end_us") - F.col("start_us"), F.col("b_end_us") - F.col("b_start_us"))
    shared = F.size(F.array_intersect("evidence", "b_evidence")) / F.least(F.size("evidence"), F.size("b_evidence"))
    return j.where((both / union >= least_iou) | ((both / shorter >= least_iou) & (shared >= least_share))).select("source_id", F.col("moment_id").alias("a"), F.col("b_moment_id").alias("b"))


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group, numbered."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def stratified(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """n rows dealt round robin over the strata: a row's turn is its rank in its stratum, then the stratum's name."""
    r = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n)
    return r.withColumn("pick", F.row_number().over(Window.orderBy("turn", stratum))).where(F.col("pick") <= n)


def spread_pick(df: DataFrame, by: str, order: list[Column], priority: list[Column], n: int) -> DataFrame:
    """First, last, and the best of each of n - 2 equal slices between, per group."""
    w = Window.partitionBy(by).orderBy(*order)
    r = df.withColumn("pos", F.row_number().over(w)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(by)))
    slot = F.when(F.col("pos") == 1, 0).when(F.col("pos") == F.col("of"), n - 1).otherwise(F.expr(f"1 + (pos - 2) * {n - 2} div greatest(of - 2, 1)"))
    r = r.withColumn("slot", slot.cast("int"))
    return r.withColumn("k", F.row_number().over(Window.partitionBy(by, "slot").orderBy(*priority))).where("k = 1").drop("k", "of")


def exclusion_counts(df: DataFrame, labels: str) -> DataFrame:
    """How many rows carry each label; a row counts once for each."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def greedy_groups(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Groups in which all members are mutually equivalent: candidates by start, end and id join the first group that they fit.

    pairs: source_id, a, b. One source's candidates are folded in one group; sources are bounded (guard: source_guard).
    """
    import pandas as pd

    def fold(key, c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(p["a"].tolist(), p["b"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        member_of: dict[int, list[int]] = {}
        groups: list[list[int]] = []
        for m in c.sort_values(["start_us", "end_us", "moment_id"])["moment_id"].tolist():
            own = near.get(m, set())
            seen = dict.fromkeys(g for x in own for g in member_of.get(x, ()))
            g = next((g for g in sorted(seen) if all(x in own for x in groups[g])), None)
            if g is None:
                groups.append([])
                g = len(groups) - 1
            groups[g].append(m)
            member_of.setdefault(m, []).append(g)
        return pd.DataFrame([(key[0], m, groups[g][0]) for g, ms in enumerate(groups) for m in ms], columns=["source_id", "moment_id", "group_id"])

    c = candidates.select("source_id", "moment_id", "start_us", "end_us")
    of_source = pairs.select(F.col("source_id").alias("pair_source"), "a", "b")
    return c.groupBy("source_id").cogroup(of_source.groupBy("pair_source")).applyInPandas(fold, "source_id long, moment_id long, group_id long")


def source_guard(df: DataFrame, most: int = 50_000) -> DataFrame:
    """Sources with more rows than a per-source fold should see."""
    return df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def diverse_shortlist(candidates: DataFrame, most: int = 12, least: float = 0.5, per_topic: int = 2, margin: float = 0.08) -> DataFrame:
    """Per source: again and again, of those within the margin of the best score that is left, the one newest in topic, format and minute."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["score"] >= least].sort_values(["score", "moment_id"], ascending=[False, True]).to_dict("records")
        taken: list[dict] = []
        topics: dict = {}
        seen: tuple[set, set, set] = (set(), set(), set())
        while left and len(taken) < most:
            left = [x for x in left if topics.get(x["topic"], 0) < per_topic]
            if not left:
                break
            close = [x for x in left if x["score"] >= left[0]["score"] - margin]
            fresh = lambda x: (x["topic"] not in seen[0]) + (x["format"] not in seen[1]) + (x["start_us"] // 600_000_000 not in seen[2])
            best = max(close, key=lambda x: (fresh(x), x["score"], -x["moment_id"]))
            taken.append(best | {"rank": len(taken) + 1})
            left.remove(best)
            topics[best["topic"]] = topics.get(best["topic"], 0) + 1
            for s, v in zip(seen, (best["topic"], best["format"], best["start_us"] // 600_000_000), strict=True):
                s.add(v)
        return pd.DataFrame(taken, columns=["source_id", "moment_id", "rank", "score"])

    return candidates.select("source_id", "moment_id", "start_us", "score", "topic", "format").groupBy("source_id").applyInPandas(fold, "source_id long, moment_id long, rank long, score double")
