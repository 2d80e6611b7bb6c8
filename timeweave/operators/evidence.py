"""Text evidence: cue lexicons, questions, personal data, terms, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def language_mismatch(text: Column, own: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Three or more distinct marker words of another language, and more than twice as many hits as of the own one."""
    toks = F.regexp_extract_all(t.fold(F.coalesce(text, F.lit(""))), F.lit(t.sql_pattern(r"\b[a-z]+\b")), F.lit(0))
    hits = lambda ws: F.filter(toks, lambda x: F.array_contains(F.array(*map(F.lit, ws)), x))
    a, b = hits(own), hits(other)
    return (F.size(F.array_distinct(b)) >= 3) & (F.size(b) > 2 * F.size(a))


def private_findings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rule, number in the text, length and SHA-256 of every finding; never the value."""
    found = F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("v")) for n, p in t.PRIVATE.items()))
    each = df.select(key, F.explode(found).alias("f")).select(key, "f.rule", F.posexplode("f.v").alias("k", "v"))
    return each.select(key, "rule", "k", F.length("v").alias("length"), F.sha2("v", 256).alias("sha256"))


def topic_keywords(df: DataFrame, key: str, text: str = "text", k: int = 5) -> DataFrame:
    """The k commonest terms of each text; ties by first place, then by name. Texts are dealt out by key before they are cut, so that terms are counted and ranked where they are."""
    # sixteen parts for each part of the input: what a task holds of the terms does not grow with the table
    toks = df.select(key, text).repartition(16 * df.rdd.getNumPartitions(), key).select(key, F.posexplode(t.tokens(F.col(text))).alias("pos", "term")).where(F.length("term") >= 3).where(~F.col("term").isin(*t.STOP_WORDS))
    n = toks.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first", "term"))).where(F.col("rank") <= k).select(key, "rank", "term", "n")


def claim_check(claims: DataFrame) -> DataFrame:
    """claim_id, unsupported numbers, literal: whether the claim's numbers are in its source text, and its quote is a part of it."""
    numbers = lambda x: F.array_distinct(F.regexp_extract_all(F.col(x), F.lit("[0-9]+"), F.lit(0)))
    lost = F.array_sort(F.array_except(numbers("claim"), numbers("source_text")))
    return claims.select("claim_id", F.array_join(lost, ",").alias("unsupported"), F.col("source_text").contains(F.col("quote")).alias("literal"))


def sentences(df: DataFrame, key: str, text: str = "text", most_chars: int = 100, most_words: int = 14, k: int = 4) -> DataFrame:
    """The first k complete sentences that are short enough for a title."""
    # a run without an end is matched too, and passed over: else each of its places would be tried as a start, up to its end
    each = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[^.!?\n]++[.!?]?"), F.lit(0))).alias("pos", "s")).where(F.col("s").rlike("[.!?]$")).withColumn("s", F.trim("s"))
    fit = each.where((F.length("s") <= most_chars) & (F.size(F.split("s", " +")) <= most_words) & (F.length("s") > 1))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("rank") <= k).select(key, "rank", F.col("s").alias("sentence"))


def pair_similarity(rows: DataFrame, key: str, group: str, terms: str) -> DataFrame:
    """Jaccard of the terms of neighbouring rows of a group, by order of key."""
    w = Window.partitionBy(group).orderBy(key)
    return rows.withColumn("before", F.lag(terms).over(w)).select(group, key, F.round(t.jaccard(F.col(terms), F.col("before")), 6).alias("similarity"))


def entities(df: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """name, mentions, n_docs, first_doc of the names that the pattern's group finds; alias_of: the one longer name that begins with it, null if there are several.

    A longer name meets shorter ones at its own beginnings of `least` or more letters, so no group of names is paired.
    """
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("name"))
    n = found.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(key).alias("n_docs"), F.min(key).alias("first_doc"))
    heads = n.where(F.length("name") > least).select(F.col("name").alias("longer"), F.explode(F.expr(f"transform(sequence({least}, length(name) - 1), k -> substring(name, 1, k))")).alias("name"))
    alias = heads.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("longer").alias("longer"))
    return n.join(alias, "name", "left").select("name", "mentions", "n_docs", "first_doc", F.when(F.col("k") == 1, F.col("longer")).alias("alias_of"))


# Methods whose text was read from a picture.
OCR_METHODS = ("tesseract_keyframe", "tesseract_candidate_frame_s8")


def normalize_ocr(rows: DataFrame) -> DataFrame:
    """Adds measured, original_text and normalized_text (lower case, single spaces), both null unless the text was read by a known method and not by hand; rows without a time of zero or more go.

    rows: observed_at (seconds), text, method, state, by_hand. Compatibility forms of characters stay as they are: Spark has no function for them.
    """
    when = F.col("observed_at").cast("double")
    good = F.coalesce(~F.isnan(when) & (when >= 0) & (when < float("inf")), F.lit(False))
    measured = F.coalesce(F.col("method").isin(*OCR_METHODS), F.lit(False)) & (F.coalesce("state", F.lit("")) != "not_measured") & ~F.coalesce("by_hand", F.lit(False))
    text = F.when(F.col("measured"), F.coalesce("text", F.lit("")))
    return rows.where(good).withColumn("measured", measured).withColumn("original_text", text).withColumn("normalized_text", t.squeeze(F.lower("original_text")))
