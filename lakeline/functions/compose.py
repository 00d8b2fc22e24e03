"""Columns that put chunks, prompts and model answers together or take them apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeline.functions.text import CONTEXT_MARK, clip, inline_captions

#: Complaint codes with their labels, and the words around the parts of an earlier complaint.
CATEGORY_LABELS = {
    "wrong_info": "Yanlış bilgi",
    "missing_info": "Eksik bilgi",
    "nonsense": "Anlamsız cevap",
    "doc_mismatch": "Belgeyle uyuşmuyor",
    "image_issue": "Görsel yanlış / eksik",
}
EARLIER_QUESTION, EARLIER_ANSWER, CATEGORIES, REASON = "Önceki soru", "Verilen yanlış cevap", "Şikayet kategorileri", "Kullanıcı açıklaması"


def blank(s: Column) -> Column:
    """Null, empty, or white space of any kind only."""
    return F.coalesce(s.rlike(r"^[\s\p{Z}\x{85}]*$"), F.lit(True))


def let(value: Column, one: Callable[[Column], Column]) -> Column:
    """``one(value)`` with the value computed once, however often ``one`` names it, within lambdas too."""
    return F.get(F.transform(F.array(value), one), F.lit(0))


def each_marker(s: Column, opening: str, one: Callable[[Column], Column]) -> Column:
    """Cut ``s`` behind every ``opening`` and put what ``one`` makes of each piece in place of opening and piece."""
    return let(F.split(s, opening), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), "")))


def unfenced(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"^```(?:json)?\s*|\s*```$", "")


def parse_flag(s: Column, key: str) -> Column:
    """Whether a model's JSON object holds ``key`` with the literal true; anything else, the text "true" too, is false."""
    return F.coalesce(F.from_json(unfenced(s), f"`{key}` boolean")[key], F.lit(False))


def parse_contexts(s: Column, n: Column) -> Column:
    """``n`` contexts by position from a JSON array of ``{"context": …}`` or strings: at most 300 characters each, empty
    where missing or blank; what is more than ``n`` or no array counts for nothing."""
    given = F.from_json(unfenced(s), "array<variant>")

    def one(i: Column) -> Column:
        x = F.get(given, i)
        kind = F.schema_of_variant(x)
        v = F.when(kind.startswith("OBJECT"), F.try_variant_get(x, "$.context", "string")).when(~kind.startswith("ARRAY"), F.try_variant_get(x, "$", "string"))
        return F.when(blank(v), "").otherwise(F.left(v, F.lit(300)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one)).otherwise(F.array().cast("array<string>"))


def search_texts(question: Column, enriched: Column, last_answer: Column, standalone: Column) -> tuple[Column, Column]:
    """(text query, text to embed). A question that leans on the conversation is embedded with the first 600 characters
    of the last answer; else its enriched form counts, or the question itself where that is blank or null."""
    rich = F.when(~blank(enriched), enriched)
    boost = F.when(~F.coalesce(standalone, F.lit(False)) & ~blank(last_answer), F.concat_ws(" ", rich, F.left(last_answer, F.lit(600))))
    return F.coalesce(rich, question), F.coalesce(boost, rich, question)


def embed_text(context: Column, clean: Column, content: Column, captions: Column) -> Column:
    """Context, clean text (or the content where there is none) and the captions that are not blank, by one blank."""
    told = F.array_join(F.filter(captions, lambda c: ~blank(c)), " ")
    return F.concat_ws(" ", F.nullif(context, F.lit("")), F.coalesce(F.nullif(clean, F.lit("")), content), F.nullif(told, F.lit("")))


def final_content(context: Column, content: Column, captions: Column) -> Column:
    """The stored text of a chunk: its context behind the mark, then the content with captions in its image markers."""
    head = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(f"{CONTEXT_MARK} "), context, F.lit("\n\n"))).otherwise("")
    return F.concat(head, inline_captions(content, captions))


def chunk_text(header: Column, md: Column, clean: Column) -> tuple[Column, Column]:
    """(markdown, clean text) with the header in front, in bold and a paragraph of its own in the former."""
    return (
        F.when(blank(header), md).otherwise(F.concat(F.lit("**"), header, F.lit("**\n\n"), md)),
        F.when(blank(header), clean).otherwise(F.concat(header, F.lit(" "), clean)),
    )


def dedup_img_paths(s: Column, paths: Column, hashes: Column) -> tuple[Column, Column]:
    """(text, paths) with paths of one hash reduced to the first and ``[IMG:n…]`` renumbered to match; a null or empty
    hash is unique, numbers that name no path stay, and without repeats nothing changes."""
    keys = F.transform(paths, lambda p, i: F.coalesce(F.concat(F.lit("h"), F.nullif(F.get(hashes, i), F.lit(""))), F.concat(F.lit("#"), i.cast("string"))))
    kept = F.array_distinct(keys)

    def one(p: Column) -> Column:
        old = F.regexp_extract(p, r"^\d+", 0)
        new = F.array_position(kept, F.get(keys, F.try_to_number(old, F.lit("999999999")).cast("int") - 1))
        return F.concat(F.lit("[IMG:"), F.coalesce(F.when(new > 0, new.cast("string")), old), F.regexp_replace(p, r"^\d+", ""))

    same = F.coalesce(F.size(kept) == F.size(paths), F.lit(True))
    return (
        F.when(same, F.coalesce(s, F.lit(""))).otherwise(each_marker(F.coalesce(s, F.lit("")), r"\[IMG:(?=\d+[^\]]*\])", one)),
        F.when(same, paths).otherwise(F.transform(kept, lambda k: F.get(paths, (F.array_position(keys, k) - 1).cast("int")))),
    )


def resolve_page_images(md: Column, figures: Column, embedded: Column) -> Column:
    """``[IMG_REF:i]`` and ``[[EMBED_IMG_i]]`` (from 0) become ``[IMG_PATH:…]``; a reference out of range stays, an
    embedded one goes; figures that the page does not name then follow at its end, one a line."""
    at = lambda p, a: F.get(a, F.try_to_number(F.regexp_extract(p, r"^\d+", 0), F.lit("999999999")).cast("int"))
    path = lambda x: F.concat(F.lit("[IMG_PATH:"), x, F.lit("]"))
    s = each_marker(md, r"\[IMG_REF:(?=\d+\])", lambda p: F.coalesce(F.concat(path(at(p, figures)), F.regexp_replace(p, r"^\d+\]", "")), F.concat(F.lit("[IMG_REF:"), p)))
    s = each_marker(s, r"\[\[EMBED_IMG_(?=\d+\]\])", lambda p: F.concat(F.coalesce(path(at(p, embedded)), F.lit("")), F.regexp_replace(p, r"^\d+\]\]", "")))
    return let(s, lambda done: F.concat_ws("\n", done, F.filter(F.transform(F.coalesce(figures, F.array().cast("array<string>")), path), lambda m: ~done.contains(m))))


def clean_text(kind: Column, text: Column, items: Column, headers: Column, rows: Column) -> Column:
    """A block without markup: a table's headers (not the placeholders ``colN``) and cells, a list's items, nothing for
    a rule, else the text."""
    real = F.filter(headers, lambda h, i: h != F.concat(F.lit("col"), (i + 1).cast("string")))
    table = F.trim(F.concat(F.array_join(real, " "), F.array_join(F.transform(rows, lambda r: F.concat(F.lit(" "), F.array_join(r, " "))), "")))
    return F.when(kind == "table", F.coalesce(table, F.lit(""))).when(kind == "list", F.array_join(items, " ")).when(kind == "rule", "").otherwise(text)


def render_block(kind: Column, raw: Column, text: Column, items: Column, ordered: Column, start: Column, images: Column) -> Column:
    """A block as markdown: its own slice where there is one, else by kind; markers of its images follow, a line each.
    A split list counts on from ``start`` (items before it)."""
    marks = F.array_join(F.transform(images, lambda p: F.concat(F.lit("[IMG_PATH:"), p, F.lit("]\n"))), "")
    some = F.size(images) > 0

    def add(s: Column) -> Column:
        return F.when(some, F.concat(s, F.when((s == "") | s.endswith("\n"), "").otherwise("\n"), marks)).otherwise(s)

    end = lambda s: F.regexp_replace(s, r"\s+$", "")
    quote = F.concat(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"), F.lit("\n"))
    listed = F.array_join(F.transform(items, lambda x, i: F.concat(F.when(ordered, F.concat((start + i + 1).cast("string"), F.lit(". "))).otherwise("- "), x, F.lit("\n"))), "")
    return (
        F.when(F.coalesce(raw, F.lit("")) != "", end(add(raw))).when(kind.isin("quote", "alert"), end(add(quote))).when(kind == "list", end(add(listed)))
        .when(kind == "code", add(F.concat(F.lit("```\n"), text, F.lit("\n```")))).when(kind == "math", add(F.concat(F.lit("$$\n"), text, F.lit("\n$$"))))
        .when(kind == "rule", add(F.lit("---"))).otherwise(add(text))
    )


def category_label(code: Column) -> Column:
    """The label of a complaint's code; unknown codes stand for themselves."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))[code], code)


def feedback_prompt(items: Column) -> Column:
    """The numbered complaints of an array of ``(question, answer, reason, categories)``; empty for none."""

    def one(x: Column, i: Column) -> Column:
        quoted = lambda name, s, n: F.concat(F.lit(f"{name}: \""), clip(F.coalesce(s, F.lit("")), n), F.lit('"\n'))
        return F.concat(
            (i + 1).cast("string"), F.lit(". "), quoted(EARLIER_QUESTION, x["question"], 200), F.lit("   "), quoted(EARLIER_ANSWER, x["answer"], 300),
            F.when(F.size(x["categories"]) > 0, F.concat(F.lit(f"   {CATEGORIES}: "), F.array_join(F.transform(x["categories"], category_label), ", "), F.lit("\n"))).otherwise(""),
            F.when(~blank(x["reason"]), F.concat(F.lit("   "), quoted(REASON, x["reason"], 300))).otherwise(""),
        )

    return F.array_join(F.transform(items, one), "\n")
