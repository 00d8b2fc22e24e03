"""The semantic answer cache and the feedback that steers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.vector import similarity_join
from lakeline.operators.folds import number_runs

DAY = 86400
#: What a new answer brings along beside its text.
UPSERTED = ("question_vec", "images", "source_doc_ids")


def best_cache_match(questions: DataFrame, cache: DataFrame, least: float = 0.9) -> DataFrame:
    """``q_id, cache_id, sim, nearest``: the most similar entry if it reaches ``least`` (else null) and, in any case, how
    near the nearest is. Every question is returned."""
    top = similarity_join(questions, "q_id", "vec", cache, "cache_id", "question_vec", top=1).select("q_id", F.col("item_id").alias("cache_id"), F.round("sim", 9).alias("sim"))
    hit = F.col("sim") >= least
    return questions.select("q_id").join(top, "q_id", "left").select("q_id", F.when(hit, F.col("cache_id")).alias("cache_id"), F.when(hit, F.col("sim")).alias("sim"), F.col("sim").alias("nearest"))


def feedback_net(questions: DataFrame, feedback: DataFrame, least: float = 0.85) -> DataFrame:
    """``q_id, net``: dislikes less likes of the same user's feedback on similar questions; 0 where there is none."""
    pairs = similarity_join(questions, "q_id", "vec", feedback, "feedback_id", "question_vec", least=least, scope="user_id")
    net = pairs.join(feedback.select(F.col("feedback_id").alias("item_id"), "rating"), "item_id").groupBy("q_id").agg(F.sum(-F.col("rating")).alias("net"))
    return questions.select("q_id").join(net, "q_id", "left").select("q_id", F.coalesce("net", F.lit(0)).cast("long").alias("net"))


def nearest_feedback(questions: DataFrame, feedback: DataFrame, since: int, least: float = 0.75, n: int = 30) -> DataFrame:
    """``q_id, feedback_id, sim, place``: the same user's feedback since a time on similar questions, nearest first."""
    recent = feedback.where(F.col("created") >= since)
    own = similarity_join(questions, "q_id", "vec", recent, "feedback_id", "question_vec", least=least, scope="user_id").select("q_id", F.col("item_id").alias("feedback_id"), "sim")
    w = Window.partitionBy("q_id").orderBy(F.round("sim", 9).desc(), "feedback_id")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def cache_route(sim: Column, net: Column, high: float = 0.97) -> Column:
    return F.when(sim.isNull(), "MISS").when(net > 0, "BYPASS").when((sim >= high) | (net < 0), "FAST").otherwise("VALIDATE")


def answer_from_cache(questions: DataFrame, cache: DataFrame, feedback: DataFrame) -> DataFrame:
    """``q_id, cache_id, net, route``: how each question is answered from the cache, if at all."""
    m = best_cache_match(questions, cache).join(feedback_net(questions, feedback), "q_id")
    return m.select("q_id", "cache_id", "net", cache_route(F.col("sim"), F.col("net")).alias("route"))


def cache_upsert(cache: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Entries whose lower-cased question equals a new trimmed, lower-cased question take its answer and keep their hits;
    other new questions are added with no hits. ``new`` needs question, answer, new_id; of equal questions the last
    new_id counts. Columns of UPSERTED that ``new`` has are taken over too, those it lacks stay out."""
    more = [c for c in UPSERTED if c in new.columns]
    n = new.withColumn("k", F.lower(F.trim("question"))).groupBy("k").agg(F.max_by(F.struct("question", "answer", "new_id", *more), "new_id").alias("n"))
    both = cache.withColumn("k", F.lower("question")).join(n, "k", "full_outer")
    old, hit = F.col("cache_id").isNotNull(), F.col("n").isNotNull()
    return both.select(
        F.coalesce("cache_id", "n.new_id").alias("cache_id"),
        F.when(old, F.col("question")).otherwise(F.trim("n.question")).alias("question"),
        F.coalesce("n.answer", "answer").alias("answer"),
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        "last_hit",
        F.when(hit, F.lit(now)).alias("updated"),
        *(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c) if c in cache.columns else None).alias(c) for c in more),
    )


def cache_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the number of hits and keep the latest hit of each entry; ``hits`` needs cache_id, at."""
    per = hits.groupBy("cache_id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return cache.join(per, "cache_id", "left").withColumn("hit_count", (F.col("hit_count") + F.coalesce("n", F.lit(0))).cast("long")).withColumn("last_hit", F.greatest("last_hit", "at")).drop("n", "at")


def cache_expire(cache: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Drop entries that are older than ``days`` and were not hit within them."""
    cut = now - days * DAY
    return cache.where(~((F.col("created") < cut) & (F.col("last_hit").isNull() | (F.col("last_hit") < cut))))


def cache_invalidate(cache: DataFrame, docs: DataFrame, untracked: bool = True) -> DataFrame:
    """Drop entries that name one of ``docs(doc_id)`` as source, and those without sources if ``untracked``."""
    named = cache.select("cache_id", F.explode(F.split("source_doc_ids", ",")).alias("doc")).join(docs.select(F.col("doc_id").cast("string").alias("doc")), "doc", "left_semi").select("cache_id").distinct()
    kept = cache.join(named, "cache_id", "left_anti")
    return kept.where("source_doc_ids IS NOT NULL") if untracked else kept


def normalize_cache(cache: DataFrame) -> DataFrame:
    wrapped = F.when(F.col("source_doc_ids").startswith(","), F.col("source_doc_ids")).otherwise(F.concat(F.lit(","), "source_doc_ids", F.lit(",")))
    return cache.withColumn("last_hit", F.when(F.col("hit_count") > 0, F.col("last_hit"))).withColumn("source_doc_ids", wrapped)


def lookup_stats(lookups: DataFrame, sliding: int = 1800, absolute: int = 7200) -> DataFrame:
    """``key, hits, misses``: a lookup hits if the key was used within ``sliding`` seconds and loaded within ``absolute``.

    ``lookups`` needs key and at (seconds). The lookups of a key stream in order through a task that carries the times of
    its loading and last use.
    """

    def step(s, at):
        _, loaded, last = s
        if loaded is not None and at - last < sliding and at - loaded < absolute:
            return 1, loaded, at
        return 0, at, at

    told = number_runs(lookups, "key", "at", {"at": F.col("at")}, (0, None, None), step, "hit")
    return told.groupBy("key").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


def hit_rate(stats: DataFrame) -> DataFrame:
    """Adds ``rate``: the share of hits, 0 where there was no lookup."""
    n = F.col("hits") + F.col("misses")
    return stats.withColumn("rate", F.when(n > 0, F.col("hits") / n).otherwise(F.lit(0.0)))


def serve_from_cache(questions: DataFrame, cache: DataFrame, feedback: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): ``q_id, route, answer`` of the questions, the answer where it is served at once, and the entries
    with the hits of those that served; ``answer_from_cache`` and then ``cache_hits``."""
    routed = answer_from_cache(questions, cache, feedback)
    served = routed.join(cache.select("cache_id", "answer"), "cache_id", "left").select("q_id", "route", "cache_id", F.when(F.col("route") == "FAST", F.col("answer")).alias("answer"))
    hits = routed.where("route = 'FAST'").select("cache_id", F.lit(now).cast("long").alias("at"))
    return served, cache_hits(cache, hits)


def rate_quota(events: DataFrame, permits: int, window: int = 60) -> DataFrame:
    """Adds ``allowed`` and ``retry_after`` to ``events(client, at, event_id)``: fixed windows of ``window`` seconds."""
    slot = F.floor(F.col("at") / window)
    rn = F.row_number().over(Window.partitionBy("client", slot).orderBy("at", "event_id"))
    ok = rn <= permits
    return events.withColumn("allowed", ok).withColumn("retry_after", F.when(~ok, (slot + 1) * window - F.col("at")).cast("long"))
