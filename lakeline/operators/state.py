"""State changes as functions of tables: ``new_state = f(state, changes)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.text import array_minus, format_matches, json_string_array


def feedback_insert(requests: DataFrame, messages: DataFrame, sessions: DataFrame, given: DataFrame) -> DataFrame:
    """``request_id, status, question, answer`` for each request ``(request_id, user_id, message_id, is_admin)``.

    The first failing check counts: the message is there, it is an answer, the session is the user's or the user an
    admin, no feedback was given before (in ``given(user_id, message_id)`` or by an earlier request), the answer is linked
    to a question, and that is there.
    """
    m = messages.select("message_id", "session_id", "role", "content", "response_to")
    q = messages.where("role = 0").select(F.col("message_id").alias("response_to"), F.col("content").alias("question"))
    x = requests.join(m, "message_id", "left").join(sessions.select("session_id", F.col("user_id").alias("owner")), "session_id", "left").join(q, "response_to", "left")
    x = x.join(given.select("user_id", "message_id", F.lit(True).alias("given")).distinct(), ["user_id", "message_id"], "left")
    checks = (
        F.when(F.col("role").isNull(), "no message").when(F.col("role") != 1, "no answer").when(~F.col("is_admin") & ~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)), "forbidden")
        .when(F.col("given"), "already given").when(F.col("response_to").isNull(), "no link").when(F.col("question").isNull(), "no question").otherwise("ok")
    )
    x = x.withColumn("status", checks)
    first = F.row_number().over(Window.partitionBy("user_id", "message_id", "status").orderBy("request_id"))
    x = x.withColumn("status", F.when((F.col("status") == "ok") & (first > 1), "already given").otherwise(F.col("status")))
    return x.select("request_id", "status", F.when(F.col("status") == "ok", F.col("question")).alias("question"), F.when(F.col("status") == "ok", F.col("content")).alias("answer"))


def swap_document(chunks: DataFrame, new: DataFrame, failed: DataFrame) -> DataFrame:
    """Replace all chunks of the documents in ``new``; documents in ``failed(doc_id)`` keep their old ones."""
    good = new.join(failed, "doc_id", "left_anti")
    return chunks.join(good.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(good)


def cascade_delete(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of ``gone(doc_id)``."""
    return docs.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def unlink_answers(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages without those of ``gone(message_id)``; answers to them lose their link."""
    lost = gone.select(F.col("message_id").alias("response_to"), F.lit(True).alias("lost")).distinct()
    left = messages.join(gone.select("message_id"), "message_id", "left_anti").join(lost, "response_to", "left")
    return left.withColumn("response_to", F.when(F.col("lost").isNull(), F.col("response_to"))).drop("lost")


def session_transition(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Sessions after ``actions(session_id, action, at)`` in order: archive and pin exclude each other, rename gives the
    first 60 characters of the column ``title``, where there is one. Each property follows from the last action that
    concerns it, so a session's actions are never brought together; of actions at one time the last by name counts."""
    titled = "title" in actions.columns
    last = lambda *kinds: F.max(F.when(F.col("action").isin(*kinds), F.struct("at", "action")))
    renamed = F.max(F.when((F.col("action") == "rename") & (F.trim("title") != ""), F.struct("at", F.left(F.trim("title"), F.lit(60)).alias("title")))) if titled else F.lit(None).cast("struct<at:long,title:string>")
    per = actions.groupBy("session_id").agg(last("archive", "unarchive", "pin").alias("a"), last("pin", "unpin", "archive").alias("p"), F.max("at").alias("last"), renamed.alias("t"))
    x = sessions.join(per, "session_id", "left")
    pinned = F.col("p.action") == "pin"
    return x.select(
        "session_id", "user_id", F.coalesce("t.title", "title").alias("title"), F.coalesce(F.col("a.action") == "archive", F.col("is_archived")).alias("is_archived"), F.coalesce(pinned, F.col("is_pinned")).alias("is_pinned"),
        F.when(F.col("p").isNull(), F.col("pinned_at")).when(pinned, F.col("p.at")).cast("long").alias("pinned_at"), "created", F.coalesce("last", "updated").cast("long").alias("updated"),
    )


def bump_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """``session_id, title, updated`` of all sessions after ``turns(session_id, question, at)``: the last turn is the last
    activity, and a session without a title, or that was not there, is named by the first 60 characters of its first
    question."""
    per = turns.groupBy("session_id").agg(F.max("at").alias("last"), F.min_by(F.left(F.trim("question"), F.lit(60)), F.struct("at", "question")).alias("first"))
    x = sessions.select("session_id", "title", "updated").join(per, "session_id", "full_outer")
    return x.select("session_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "first").alias("title"), F.greatest("updated", "last").alias("updated"))


def cascade_users(users: DataFrame, sessions: DataFrame, messages: DataFrame, docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All five tables without the users of ``gone(user_id)`` and what is theirs: sessions with messages, documents with
    chunks. Answers elsewhere that referred to a lost question keep their text and lose the link."""
    out = {"users": users.join(gone, "user_id", "left_anti"), "sessions": sessions.join(gone, "user_id", "left_anti")}
    lost = messages.join(sessions.join(gone, "user_id", "left_semi").select("session_id"), "session_id", "left_semi").select("message_id")
    out["messages"] = unlink_answers(messages, lost)
    out["docs"], out["chunks"] = cascade_delete(docs, chunks, docs.join(gone, "user_id", "left_semi").select("doc_id"))
    return out


def delete_batch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, outcome`` of each distinct id: deleted, processing or not found."""
    x = ids.select("doc_id").distinct().join(docs.select("doc_id", "status"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("status").isNull(), "not found").when(F.col("status") == 1, "processing").otherwise("deleted").alias("outcome"))


def reprocess_batch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``queued, skipped, not_found`` of the distinct ids; pending and running documents are skipped."""
    x = ids.select("doc_id").distinct().join(docs.select("doc_id", "status"), "doc_id", "left")
    return x.agg(F.count_if(F.col("status") >= 2).alias("queued"), F.count_if(F.col("status") < 2).alias("skipped"), F.count_if(F.col("status").isNull()).alias("not_found"))


def drop_dead_images(messages: DataFrame, gone: Column) -> DataFrame:
    """Remove paths of the array ``gone`` from the JSON list ``images_json``; an empty list becomes null, text that is no
    list stays as it is."""
    parsed = F.from_json("images_json", "array<string>")
    left = array_minus(json_string_array(F.col("images_json")), gone)
    return messages.withColumn("images_json", F.when(parsed.isNull(), F.col("images_json")).when(F.size(left) > 0, F.to_json(left)))


def admit_uploads(existing: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, outcome`` of each file ``(file_id, user_id, file_name, content_hash, kind)`` in order of file_id.

    A name that the user has (ignoring case) or an earlier file takes is a conflict, then an unknown kind, then bytes
    that the user has or an earlier file with another name brings; else the file waits to be processed.
    """
    n = existing.select("user_id", F.lower("file_name").alias("k"), F.lit(True).alias("name_taken")).distinct()
    h = existing.groupBy("user_id", "content_hash").agg(F.min("file_name").alias("same_as"))
    x = files.withColumn("k", F.lower("file_name")).join(n, ["user_id", "k"], "left").join(h, ["user_id", "content_hash"], "left")
    early = F.row_number().over(Window.partitionBy("user_id", "k").orderBy("file_id")) > 1
    twin = F.row_number().over(Window.partitionBy("user_id", "content_hash").orderBy("file_id")) > 1
    out = F.when(F.col("name_taken") | early, "name conflict").when(F.col("kind").isNull(), "unknown type").when(F.col("same_as").isNotNull() | twin, "content conflict").otherwise("Pending")
    return x.select("file_id", out.alias("outcome"))


def admit_checked(existing: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, outcome, same_as``: ``admit_uploads`` of files that also have ``format`` (as found in the bytes) and
    ``size``: behind an unknown kind, bytes that don't fit the kind are ``wrong content``. ``same_as`` names the file that
    has the same bytes, the user's or else the first in the batch."""
    h = existing.groupBy("user_id", "content_hash").agg(F.min("file_name").alias("had"))
    first = F.first("file_name").over(Window.partitionBy("user_id", "content_hash").orderBy("file_id"))
    x = files.withColumn("_first", first).join(h, ["user_id", "content_hash"], "left").join(admit_uploads(existing, files), "file_id")
    wrong = F.col("outcome").isin("Pending", "content conflict") & ~F.coalesce(format_matches(F.col("format"), F.col("kind"), F.col("size")), F.lit(False))
    out = F.when(wrong, "wrong content").otherwise(F.col("outcome"))
    return x.select("file_id", out.alias("outcome"), F.when(out == "content conflict", F.coalesce("had", "_first")).alias("same_as"))


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``user_id, outcome`` of each change ``(user_id, new_email, new_code)``."""
    code = users.groupBy(F.col("personnel_code").alias("new_code")).agg(F.min("user_id").alias("code_owner"))
    mail = users.groupBy(F.lower("email").alias("m")).agg(F.min("user_id").alias("mail_owner"))
    x = changes.join(users.select("user_id", "role", "email"), "user_id", "left").join(code, "new_code", "left").join(mail, F.lower("new_email") == F.col("m"), "left")
    out = F.when(F.col("role").isNull(), "not found").when(F.col("role") == "Admin", "forbidden").when(F.col("code_owner") != F.col("user_id"), "code taken").when((F.lower("new_email") != F.lower("email")) & (F.col("mail_owner") != F.col("user_id")), "email taken").otherwise("ok")
    return x.select("user_id", out.alias("outcome"))


def delete_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    x = ids.select("user_id").distinct().join(users.select("user_id", "role"), "user_id", "left")
    return x.agg(F.count_if(F.col("role") != "Admin").alias("deleted"), F.count_if(F.col("role") == "Admin").alias("admins"), F.count_if(F.col("role").isNull()).alias("not_found"))
