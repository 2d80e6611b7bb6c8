"""Audits: references, runs, stages, identities and detections against truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .lineage import cut


def reference_audit(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, namespace: str) -> DataFrame:
    """One row: references, those that resolve, distinct dangling keys, null-safe coverage."""
    keys = parents.select(F.col(parent_key).alias("_p")).distinct()
    j = children.select(F.col(child_key).alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("n")).join(keys, F.col("_c") == F.col("_p"), "left")
    n, ok = F.sum("n"), F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("n"))), F.lit(0))
    return j.agg(F.lit(namespace).alias("namespace"), n.alias("n_refs"), ok.alias("n_resolved"), F.count_if(F.col("_p").isNull()).alias("n_dangling"), ratio(ok, n).alias("coverage"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, delta, status: a delta only where both have a number of the same scope."""
    j = old.select("metric", F.col("value").alias("old"), F.col("scope").alias("old_scope")).join(new.select("metric", F.col("value").alias("new"), F.col("scope").alias("new_scope")), "metric", "full_outer")
    status = F.when(F.col("old_scope").isNull(), "added").when(F.col("new_scope").isNull(), "removed").when(F.col("old_scope") != F.col("new_scope"), "scope_differs").when(F.col("old").isNull() | F.col("new").isNull(), "not_numeric").otherwise("compared")
    return j.withColumn("status", status).select("metric", "old", "new", F.when(F.col("status") == "compared", F.round(F.col("new") - F.col("old"), 6)).alias("delta"), "status")


def stage_impact(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Every stage that a failed one reaches over edges (stage, needs): the failed causes, sorted.

    Breadth first: a round follows the edges of the pairs (cause, stage) that the last one found for the first time, so many
    ways to one stage cost no more than one, and a cycle ends.
    """
    found = cut(stages.where("status = 'failed'").select(F.col("stage").alias("cause"), "stage").distinct())
    newest = found
    while not newest.isEmpty():
        step = newest.select("cause", F.col("stage").alias("needs")).join(edges.select("stage", "needs"), "needs").select("cause", "stage").distinct()
        newest = cut(step.join(found, ["cause", "stage"], "left_anti"))
        found = cut(found.union(newest))
    return found.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("cause")), ",").alias("causes"))


def pairwise_identity(labels: DataFrame) -> DataFrame:
    """One row: pairs together in truth and prediction by counts n (n - 1) / 2, precision, recall. No pair is made."""
    pairs = lambda keys, name: labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))
    both = pairs(["truth", "predicted"], "tp").crossJoin(pairs(["truth"], "truth_pairs")).crossJoin(pairs(["predicted"], "predicted_pairs"))  # three single rows
    return both.select("tp", (F.col("predicted_pairs") - F.col("tp")).alias("false_merges"), (F.col("truth_pairs") - F.col("tp")).alias("false_splits"), ratio(F.col("tp"), F.col("predicted_pairs")).alias("precision"), ratio(F.col("tp"), F.col("truth_pairs")).alias("recall"))


def binary_eval(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, abstained, precision, recall, f1 of truth and predicted (0, 1 or null)."""
    c = lambda p, t: F.count_if((F.col("predicted") == p) & (F.col("truth") == t))
    n = rows.agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"), F.count_if(F.col("predicted").isNull()).alias("abstained"))
    return n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def stage_estimates(runs: DataFrame, least: int = 3) -> DataFrame:
    """Median and range of a stage's seconds over good, uncached runs with one fingerprint, if there are enough."""
    good = runs.where("status = 'ok' and not cached and elapsed is not null")
    return good.groupBy("stage", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("elapsed"), 6).alias("median"), F.min("elapsed").alias("lo"), F.max("elapsed").alias("hi")).where(F.col("n") >= least)


def latency_report(runs: DataFrame, last: int = 512) -> DataFrame:
    """p50 and p95 of each stage's newest samples."""
    w = Window.partitionBy("stage").orderBy(F.col("at").desc(), F.col("id").desc())
    newest = runs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    return newest.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("elapsed", 0.5), 6).alias("p50"), F.round(F.percentile("elapsed", 0.95), 6).alias("p95"))


def chunk_manifest(rows: DataFrame, key: str, order: list[str], content: str, most: int = 500) -> DataFrame:
    """Chunks of at most `most` rows of each key: records, bytes, first and last place, digest."""
    w = Window.partitionBy(key).orderBy(*order)
    n = rows.withColumn("pos", F.row_number().over(w)).withColumn("chunk", F.expr(f"(pos - 1) div {most}"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.sha2(F.col(content), 256).alias("h")))), lambda x: x["h"]), "")
    return n.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(content)).alias("bytes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sha2(body, 256).alias("digest"))


def content_catalog(rows: DataFrame, content: str, origin_rank: str, path: str) -> DataFrame:
    """One location for each distinct content: the best origin, then the first path; how many copies there are."""
    h = rows.where(F.col(content).isNotNull()).withColumn("sha256", F.sha2(content, 256)).select("sha256", F.col(origin_rank).alias("origin"), F.col(path).alias("path"))
    return h.groupBy("sha256").agg(F.min_by("path", F.struct("origin", "path")).alias("path"), F.min("origin").alias("origin"), F.count(F.lit(1)).alias("copies"))


def changed_sources(new: DataFrame, ledger: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Sources whose parts differ from the ledger's, and which: new, removed, or the names of the parts."""
    old = ledger.select(F.col(key), *(F.col(p).alias(f"old_{p}") for p in parts), F.lit(True).alias("was"))
    j = new.withColumn("is", F.lit(True)).join(old, key, "full_outer")
    diff = F.array_compact(F.array(*(F.when(~F.col(p).eqNullSafe(F.col(f"old_{p}")), F.lit(p)) for p in parts)))
    why = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").otherwise(F.array_join(diff, ","))
    return j.select(key, why.alias("why")).where("why <> ''")


def contract_audit(stages: DataFrame, counts: DataFrame, rows: DataFrame, gates: DataFrame, mandatory: tuple[str, ...], camera_only: tuple[str, ...], most: int = 32) -> DataFrame:
    """source_id, place, code, path, expected, received: the first `most` breaches of each source's contract, by path and code.

    stages: source_id, stage, status, capability. counts: source_id, name, expected, received. rows: source_id, name, row_no, id.
    gates: source_id, status, missing (array). A stage must be usable, or known to be off; mandatory ones must be there; counts must agree;
    rows need ids; a failed gate blocks unless only the camera is missing.
    """
    say = lambda code, path, expected, received: (F.lit(code).alias("code"), path.alias("path"), F.lit(expected).alias("expected") if isinstance(expected, str) else expected.alias("expected"), received.alias("received"))
    off = F.coalesce((F.col("status") == "skipped") & (F.col("capability") == "not_measured_disabled"), F.lit(False))
    bad = stages.where(~F.coalesce(F.col("status").isin("ok", "partial", "degraded"), F.lit(False)) & ~off).select("source_id", *say("upstream_stage_not_usable", F.concat(F.lit("stage_status."), "stage"), "ok_or_evidence_backed_partial", F.coalesce("status", F.lit("none"))))
    asked = stages.select("source_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, mandatory))))
    gone = asked.join(stages.select("source_id", "stage"), ["source_id", "stage"], "left_anti").select("source_id", *say("mandatory_stage_status_missing", F.concat(F.lit("stage_status."), "stage"), "explicit_completed_stage", F.lit("missing")))
    differ = counts.where(~F.col("expected").eqNullSafe(F.col("received"))).select("source_id", *say("count_disagreement", F.col("name"), F.col("expected").cast("string"), F.coalesce(F.col("received").cast("string"), F.lit("none"))))
    nameless = rows.where(F.coalesce(F.trim("id"), F.lit("")) == "").select("source_id", *say("row_missing_id", F.concat("name", F.lit("["), F.col("row_no").cast("string"), F.lit("]")), "nonempty_id", F.lit("missing")))
    only = (F.size("missing") > 0) & (F.size(F.array_except("missing", F.array(*map(F.lit, camera_only)))) == 0)
    gate = gates.where((F.col("status") == "P0_FAIL") & ~only).select("source_id", *say("quality_gate_p0", F.lit("quality_gate.status"), "non_blocking", F.lit("P0_FAIL")))
    every = bad.unionByName(gone).unionByName(differ).unionByName(nameless).unionByName(gate)
    w = Window.partitionBy("source_id").orderBy("path", "code")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def detector_runs(boxes: DataFrame, labels: DataFrame, bindings: DataFrame) -> DataFrame:
    """Of each run against people's labels: run, true_positive, false_positive, false_negative, precision, recall, instances, false_merge, false_split, abstentions, bindings, false_bindings, binding_abstentions; null where nothing was measured.

    boxes: run, instance_id (null: a prediction that no true box matched), matched, person_id (of the matched prediction). labels: instance_id, label; null, empty and
    unknown ones don't count. bindings: run, label (who speaks), person_id (who the run says it is). An instance has a person if all of its boxes have one and the same. Pairs of instances are
    counted from the sizes of groups, none is made.
    """
    of = F.lower(F.trim("label"))
    known = labels.where(F.coalesce(~of.isin("", "unknown", "?", "uncertain"), F.lit(False))).select("instance_id", "label").distinct()
    seen, hit = F.col("instance_id").isNotNull(), F.coalesce(F.col("matched"), F.lit(False))
    body = boxes.groupBy("run").agg(F.count_if(seen & hit).alias("true_positive"), F.count_if(~seen).alias("false_positive"), F.count_if(seen & ~hit).alias("false_negative"))
    person = F.when(hit & (F.trim("person_id") != ""), F.col("person_id"))
    own = boxes.join(known, "instance_id").groupBy("run", "instance_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count(person).alias("has"), F.min(person).alias("lo"), F.max(person).alias("hi"))
    own = own.select("run", "instance_id", "label", F.when((F.col("n") == F.col("has")) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("person_id"))
    total = own.groupBy("run").agg(F.count(F.lit(1)).alias("instances"), F.count_if(F.col("person_id").isNull()).alias("abstentions"))
    cells = own.where("person_id is not null").groupBy("run", "person_id", "label").agg(F.count(F.lit(1)).alias("k"))
    pairs = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    same = cells.groupBy("run").agg(pairs(F.col("k")).alias("same"))
    by = lambda g, name: cells.groupBy("run", g).agg(F.sum("k").alias("k")).groupBy("run").agg(pairs(F.col("k")).alias(name))
    clusters = cells.groupBy("run", "person_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    b = bindings.join(clusters, ["run", "person_id"], "left").groupBy("run").agg(F.count(F.lit(1)).alias("bindings"), F.count_if(F.col("lo").isNotNull() & ((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))).alias("false_bindings"), F.count_if(F.col("lo").isNull()).alias("binding_abstentions"))
    j = body
    for other in (total, same, by("person_id", "merged"), by("label", "alike"), b):
        j = j.join(other, "run", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    measured = lambda c: F.when(F.col("instances") >= 2, c)
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(a) + F.col(b), F.lit(0)).cast("double")), 6)
    return j.select("run", "true_positive", "false_positive", "false_negative", share("true_positive", "false_positive").alias("precision"), share("true_positive", "false_negative").alias("recall"), zero("instances").alias("instances"), measured(zero("merged") - zero("same")).alias("false_merge"), measured(zero("alike") - zero("same")).alias("false_split"), measured(F.col("abstentions")).alias("abstentions"), "bindings", "false_bindings", "binding_abstentions")


def detector_ab(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """accepted: whether the candidate merges no two people and binds no voice wrongly, is nowhere worse and somewhere better; null unless both are fully measured."""
    keys = ("false_merge", "false_split", "abstentions", "false_bindings", "binding_abstentions", "false_positive", "false_negative")
    side = lambda name, mark: runs.where(F.col("run") == name).select(*(F.col(k).alias(f"{mark}_{k}") for k in keys))
    j = side(baseline, "a").crossJoin(side(candidate, "b"))  # a row each
    no_worse, better = F.lit(True), F.lit(False)
    for k in keys:
        no_worse, better = no_worse & (F.col(f"b_{k}") <= F.col(f"a_{k}")), better | (F.col(f"b_{k}") < F.col(f"a_{k}"))
    measured = reduce(lambda a, c: a & F.col(c).isNotNull(), [f"{m}_{k}" for m in "ab" for k in keys], F.lit(True))
    return j.select(F.when(measured, (F.col("b_false_merge") == 0) & (F.col("b_false_bindings") == 0) & no_worse & better).alias("accepted"), *(F.col(f"b_{k}").alias(k) for k in keys))
