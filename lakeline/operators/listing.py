"""Listings: projections, filters, validation, ordering, paging and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = {0: "Pending", 1: "Processing", 2: "Ready", 3: "Failed", 4: "Stale"}
PUBLIC = {"documents": ["doc_id", "user_id", "file_name", "status", "created"], "chunks": ["chunk_id", "doc_id", "chunk_idx", "header", "page", "content"], "users": ["user_id", "full_name", "email", "role"]}
DAY = 86400


def decode_enum(col: Column, names: dict[int, str]) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), list(names.items())[1:], F.when(col == next(iter(names)), names[next(iter(names))]))


def project_public(df: DataFrame, kind: str) -> DataFrame:
    """The columns that users may see; a status number becomes its name. Vectors are never among them."""
    out = df.select(PUBLIC[kind])
    return out.withColumn("status", decode_enum(F.col("status"), STATUS)) if "status" in out.columns else out


def search_contains(df: DataFrame, col: str, needle: str | None, literal: bool = False) -> DataFrame:
    """Rows whose column contains the needle, ignoring case; a blank needle keeps all. ``%`` and ``_`` of the needle are
    wildcards unless ``literal``."""
    if not (needle or "").strip():
        return df
    return df.where(F.contains(F.lower(col), F.lower(F.lit(needle)))) if literal else df.where(F.col(col).ilike(f"%{needle}%"))


def search_any(df: DataFrame, cols: list[str], needle: str | None) -> DataFrame:
    if not (needle or "").strip():
        return df
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False)) for c in cols]))


def ieq(a: Column, b: Column) -> Column:
    """Equal but for case, the rule by which file names are unique; ``%`` and ``_`` are plain characters here, while the
    pattern match ``a.ilike(b)`` would take them as wildcards."""
    return F.lower(a) == F.lower(b)


def name_taken(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """``request_id, taken``: whether the user of each request ``(request_id, user_id, file_name)`` has a document of that
    name (ignoring case) in ``docs(user_id, file_name)``."""
    had = docs.select("user_id", F.lower("file_name").alias("_n"), F.lit(True).alias("_had")).distinct()
    x = requests.withColumn("_n", F.lower("file_name")).join(had, ["user_id", "_n"], "left")
    return x.select("request_id", F.coalesce("_had", F.lit(False)).alias("taken"))


def ids_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of keys, however often it is there."""
    return df.join(ids.select(key), key, "left_semi")


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: whether ``other`` has a row of equal keys; a null key never has."""
    found = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def new_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``file_id, doc_id, file_name``: for each new file with the bytes of one of the user's documents, the first such."""
    had = existing.groupBy("user_id", "content_hash").agg(F.min(F.struct("doc_id", "file_name")).alias("d"))
    return new.join(had, ["user_id", "content_hash"]).select("file_id", "d.doc_id", "d.file_name")


def selectable_docs(docs: DataFrame) -> DataFrame:
    """Documents that are neither waiting nor being processed (statuses 0 and 1)."""
    return docs.where(~F.col("status").isin(0, 1))


def may_see(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """``request_id, allowed``: whether the user of each request ``(request_id, session_id, user_id, is_admin)`` owns the
    session or is an admin; null where there is no such session."""
    x = requests.join(sessions.select("session_id", F.col("user_id").alias("owner"), F.lit(True).alias("there")), "session_id", "left")
    return x.select("request_id", F.when(F.col("there"), F.coalesce(F.col("is_admin"), F.lit(False)) | F.col("owner").eqNullSafe(F.col("user_id"))).alias("allowed"))


def filter_sessions(df: DataFrame, user_id: int | None = None, archived: bool | None = False, since: int | None = None, until: int | None = None) -> DataFrame:
    """Sessions of a user, archived or not (None: all), made from ``since`` up to the end of the day after ``until``."""
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    if archived is not None:
        df = df.where(F.col("is_archived") == archived)
    if since is not None:
        df = df.where(F.col("created") >= since)
    return df if until is None else df.where(F.col("created") <= until + DAY)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule is a condition that must not hold."""
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def feedback_rules(categories: list[str], longest: int = 500) -> dict[str, Column]:
    return {
        "message_id": F.col("message_id").isNull(),
        "rating": ~F.coalesce(F.col("rating").isin(1, -1), F.lit(False)),
        "categories": F.size(F.array_except("categories", F.array(*map(F.lit, categories)))) > 0,
        "reason": F.length("reason") > longest,
    }


def question_rules(longest: int = 2000) -> dict[str, Column]:
    return {"empty": F.coalesce(F.trim("question") == "", F.lit(True)), "long": F.length("question") > longest}


def user_rules() -> dict[str, Column]:
    code = F.col("personnel_code")
    return {
        "name": F.coalesce(F.trim("full_name") == "", F.lit(True)) | (F.length("full_name") > 100),
        "email": ~F.coalesce(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length("email") <= 256), F.lit(False)),
        "code": ~F.coalesce(code.rlike(r"^\S{6,50}$") & code.rlike(r"\p{L}") & code.rlike(r"\d"), F.lit(False)),
    }


def order_sessions(by: str = "activity", asc: bool = False) -> list[Column]:
    """Pinned first, the latest pin first, then by title or by last activity; ties by session_id."""
    key = F.col("title") if by == "title" else F.coalesce("updated", "created")
    return [F.col("is_pinned").desc(), F.col("pinned_at").desc_nulls_first(), key.asc() if asc else key.desc(), F.col("session_id").asc()]


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20, clamp: int | None = 100) -> DataFrame:
    """One page with ``total``, ``has_next`` and ``has_prev``; the page is cut by offset and limit, only the count is global."""
    page, size = max(1, page), max(1, min(size, clamp) if clamp else size)
    total = df.agg(F.count("*").alias("total"))  # one row
    part = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("has_next", F.lit(page * size) < F.col("total")).withColumn("has_prev", F.lit(page > 1))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def take_last(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def head_n(df: DataFrame, n: int, cut: int, key: str, order: str, col: str) -> DataFrame:
    """The first ``n`` rows of each key with a text column cut to ``cut`` signs."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn").withColumn(col, F.left(col, F.lit(cut)))


def answer_question_pairs(messages: DataFrame) -> DataFrame:
    """Each answer with the question it answers; answers without a link are left out."""
    a = messages.where("role = 1 AND response_to IS NOT NULL").select(F.col("message_id").alias("answer_id"), F.col("response_to").alias("question_id"), F.col("content").alias("answer"))
    q = messages.where("role = 0").select(F.col("message_id").alias("question_id"), F.col("content").alias("question"))
    return a.join(q, "question_id")


def session_with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.join(messages.select("session_id", "message_id", "turn", "role", "content"), "session_id", "left")


def orphan_questions(messages: DataFrame) -> DataFrame:
    """User messages that no answer refers to."""
    answered = messages.where("response_to IS NOT NULL").select(F.col("response_to").alias("message_id")).distinct()
    return messages.where("role = 0").join(answered, "message_id", "left_anti")


def popular_questions(messages: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent user questions by normalised text; shown is the shortest variant, ties go to the first seen."""
    from lakeline.functions.text import normalize_question

    own = messages.where("role = 0").select("message_id", F.trim("content").alias("q")).where((F.length("q") > 10) & (F.length("q") < 200))
    per = own.groupBy(normalize_question(F.col("q")).alias("norm")).agg(F.count("*").alias("n"), F.min("message_id").alias("first"), F.min(F.struct(F.length("q"), "message_id", "q")).alias("s"))
    return per.orderBy(F.col("n").desc(), "first").limit(n).select(F.col("s.q").alias("question"), "n")


def users_with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    per = roles.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return users.join(per, "user_id", "left")
