"""Scalar functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marker in front of a chunk's context, and how an answer says that there is none.
CONTEXT_MARK = "**[Bağlam]:**"
REJECTION = r"^\W*\[NO_ANSWER\][\W_]*"


def normalize_ws(s: Column) -> Column:
    """Runs of blank, tab and line ends become one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def normalize_question(s: Column) -> Column:
    """Lower case; letters, decimal digits and white space stay."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}\s]", ""))


def clip(s: Column, n: int, suffix: str = "…") -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit(suffix))).otherwise(s)


def count_tokens(s: Column) -> Column:
    """Words between white space; the default measure of length."""
    return F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))


def clip_to_tokens(s: Column, budget: int) -> Column:
    """The longest prefix of at most ``budget`` words."""
    return F.regexp_extract(s, rf"^\s*(?:\S+\s+){{0,{budget - 1}}}\S*", 0)


def split_context(s: Column) -> tuple[Column, Column]:
    """(context, body): the context stands between the marker and the first blank line."""
    cut = F.locate("\n\n", s)
    marked = F.coalesce(s.startswith(CONTEXT_MARK) & (cut > 0), F.lit(False))
    return F.when(marked, F.substr(s, F.lit(1), cut + 1)).otherwise(F.lit("")), F.when(marked, F.substr(s, cut + 2)).otherwise(s)


def strip_img_markers(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\[IMG:\d+[^\]]*\]", ""))


def renumber_img_paths(s: Column) -> tuple[Column, Column]:
    """``[IMG_PATH:p]`` becomes ``[IMG:k]``, k the first-seen rank of the trimmed path; second value: the paths."""
    paths = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\[IMG_PATH:([^\]]*)\]"), 1), lambda p: F.trim(p)))
    parts = F.split(s, r"\[IMG_PATH:")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("[IMG:"), F.array_position(paths, F.trim(F.substring_index(p, "]", 1))), F.substr(p, F.locate("]", p))))
    return F.concat(parts[0], F.array_join(rest, "")), paths


def shift_img_numbers(s: Column, by: Column) -> Column:
    """``[IMG:m…]`` becomes ``[IMG:m+by…]``."""
    parts = F.split(s, r"\[IMG:(?=\d)")
    moved = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("[IMG:"), (F.regexp_extract(p, r"^\d+", 0).cast("int") + by).cast("string"), F.regexp_replace(p, r"^\d+", "")))
    return F.concat(parts[0], F.array_join(moved, ""))


def inline_captions(s: Column, captions: Column) -> Column:
    """``[IMG:n]`` becomes ``[IMG:n — caption]`` where caption n of the array is there and not blank."""
    parts = F.split(s, r"\[IMG:(?=\d+\])")

    def one(p: Column) -> Column:
        n = F.regexp_extract(p, r"^\d+", 0)
        cap = F.trim(F.try_element_at(captions, F.when(n.cast("int") > 0, n.cast("int"))))
        return F.concat(F.lit("[IMG:"), n, F.when(F.coalesce(cap, F.lit("")) != "", F.concat(F.lit(" — "), cap)).otherwise(""), F.regexp_replace(p, r"^\d+", ""))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def is_rejection(s: Column) -> Column:
    return F.coalesce(F.trim(s) == "", F.lit(True)) | s.rlike(f"(?i){REJECTION}")


def strip_no_answer(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"(?i){REJECTION}", ""))


def strip_source_refs(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?i)\s*\(\s*KAYNAK\s*\[?\d+\]?\s*\)", ""))


def json_string_array(s: Column) -> Column:
    """The strings of a JSON array; anything else gives an empty array."""
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def array_minus(a: Column, gone: Column) -> Column:
    """Members of ``a`` not in ``gone``, ignoring case; order and repeats stay."""
    low = F.transform(gone, lambda g: F.lower(g))
    return F.filter(a, lambda x: ~F.array_contains(low, F.lower(x)))


def escape_cell(s: Column) -> Column:
    r"""Escape ``\`` and ``|``; line ends become blanks."""
    return F.trim(F.regexp_replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"[\r\n]", " "))


def header_path(texts: Column) -> Column:
    """Texts joined by `` > `` without those whose letters equal the letters of the one before."""
    key = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]", ""))
    kept = F.filter(texts, lambda x, i: (i == 0) | (key(x) != key(F.coalesce(F.get(texts, i - 1), F.lit("")))))
    return F.array_join(kept, " > ")


def head_mid_tail(s: Column, head: int = 250, mid: int = 125, tail: int = 125) -> Column:
    """Three samples of a text longer than the samples and 40 signs, else the text."""
    n = F.length(s)
    gap = F.lit("\n[...]\n")
    return F.when(n > head + mid + tail + 40, F.concat(F.left(s, F.lit(head)), gap, F.substr(s, F.floor(n / 2 - mid / 2).cast("int") + 1, F.lit(mid)), gap, F.right(s, F.lit(tail)))).otherwise(s)


def is_page_number(s: Column) -> Column:
    return F.trim(s).rlike(r"^\d{1,4}$")


def structure_meta(s: Column) -> tuple[Column, Column, Column, Column]:
    """(table lines, list items, has a code fence, words) of a chunk."""
    lines = F.transform(F.split(s, "\n"), lambda l: F.trim(l))
    return (
        F.size(F.filter(lines, lambda x: x.startswith("|") & ~x.contains("---"))),
        F.size(F.filter(lines, lambda x: x.rlike(r"^([-*] |([1-9]|1[0-2])\. )"))),
        s.contains("```"),
        count_tokens(s),
    )


def quality_badge(score: Column) -> Column:
    return F.when(score < 0.4, "critical").when(score < 0.65, "medium").otherwise("none")


def will_cache(standalone: Column, rejected: Column, validated: Column, score: Column, issues: Column) -> Column:
    return standalone & ~rejected & validated & ((score >= 0.65) | ((score >= 0.4) & (issues == 0)))


def format_size(n: Column) -> Column:
    """Bytes as B, KB or MB; the last two with one decimal."""
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1 << 20), 1), F.lit(" MB")))


def doc_format(content: Column) -> Column:
    """Pdf, Ooxml, Ole, Rtf, MarkupText or Unknown by the first bytes."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(8)))
    text = F.upper(F.regexp_replace(F.decode(F.substr(content, F.lit(1), F.lit(256)), "ISO-8859-1"), "^(ï»¿)?\\s*", ""))
    markup = text.startswith("MIME-VERSION:") | text.startswith("MESSAGE-ID:") | text.startswith("FROM:") | text.contains("MULTIPART/RELATED") | text.startswith("<!DOCTYPE") | text.startswith("<HTML")
    return F.when(head.startswith("255044462D"), "Pdf").when(head.startswith("504B0304"), "Ooxml").when(head == "D0CF11E0A1B11AE1", "Ole").when(head.startswith("7B5C727466"), "Rtf").when(markup, "MarkupText").otherwise("Unknown")


def format_matches(fmt: Column, kind: Column, size: Column) -> Column:
    """Whether a detected format fits the declared type; CSV and files below five bytes are not checked."""
    return (size < 5) | F.when(kind == "Pdf", fmt == "Pdf").when(kind.isin("Docx", "Xlsx"), fmt == "Ooxml").when(kind == "Doc", fmt.isin("Ole", "Rtf", "MarkupText")).otherwise(kind == "Csv")


def image_format(content: Column) -> Column:
    h = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E47"), "png").when(h.startswith("47494638"), "gif").when(h.startswith("52494646") & (F.substr(h, F.lit(17), F.lit(8)) == "57454250"), "webp")
        .when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").otherwise("png")
    )


def mime_to_type(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "Pdf").when(mime == "application/msword", "Doc").when(mime == "text/csv", "Csv").when(mime.contains("wordprocessingml"), "Docx").when(mime.contains("spreadsheetml"), "Xlsx")


def normalize_image_md(s: Column) -> Column:
    """Unwrap nested image markdown (five levels at most) and drop white space within its URL."""
    for _ in range(5):
        s = F.regexp_replace(s, r"!\[[^\]]*\]\(\s*(!\[[^\]]*\]\([^()]*\))\s*\)", "$1")
    for _ in range(8):  # white space runs within one URL
        s = F.regexp_replace(s, r"(!\[[^\]]*\]\([^()\s]*)\s+([^()]*\))", "$1$2")
    return s


def parse_options(s: Column, most: int = 5) -> Column:
    """Options divided by ``|`` without list marks and quotes; those of 6 to 249 signs that don't end with a colon."""
    one = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^([-*•]|\d+[.)])\s+", "")), "^[\"'“”](.*)[\"'“”]$", "$1")
    return F.slice(F.filter(F.transform(F.split(s, r"\|"), one), lambda x: (F.length(x) > 5) & (F.length(x) < 250) & ~x.endswith(":")), 1, most)


def topic_name(file_name: Column) -> Column:
    """A file name as words: no extension, dashes and capitals inside words divide, lower case."""
    bare = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), r"[-_]+", " ")
    return F.lower(normalize_ws(F.regexp_replace(bare, r"(?<=\p{Ll})(?=\p{Lu})", " ")))


def resolve_image_refs(s: Column, paths: Column, captions: Column, word: str = "image") -> Column:
    """``[[IMG-k…]]`` becomes ``![caption](/uploads/path)`` by the arrays; unknown numbers are removed."""
    parts = F.split(s, r"\[\[\s*IMG-(?=\d+[^\]]*\]\])")

    def one(p: Column) -> Column:
        k = F.regexp_extract(p, r"^\d+", 0).cast("int")
        path, cap = F.try_element_at(paths, F.when(k > 0, k)), F.trim(F.try_element_at(captions, F.when(k > 0, k)))
        alt = F.translate(F.when(F.coalesce(cap, F.lit("")) == "", word).otherwise(clip(cap, 200, "...")), "[]", "()")
        return F.concat(F.when(path.isNotNull(), F.concat(F.lit("!["), alt, F.lit("](/uploads/"), path, F.lit(")"))).otherwise(""), F.regexp_replace(p, r"^\d+[^\]]*\]\]", ""))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def recursive_split(s: Column, most: int) -> Column:
    """Pieces of at most ``most`` words: paragraphs are packed while they fit, longer ones are cut into runs of words."""
    words = F.filter(F.split(s, r"\s+"), lambda x: x != "")
    runs = lambda p: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(count_tokens(p) / most) - 1, F.lit(0)).cast("int")),
        lambda i: F.array_join(F.slice(F.filter(F.split(p, r"\s+"), lambda x: x != ""), i * most + 1, most), " "),
    )
    parts = F.filter(F.flatten(F.transform(F.split(s, r"\n\s*\n|\n"), lambda p: F.when(count_tokens(p) <= most, F.array(F.trim(p))).otherwise(runs(p)))), lambda p: p != "")
    empty = F.expr("cast(array() as array<string>)")

    def step(done, p):
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(count_tokens(last) + count_tokens(p) <= most, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), p)))).otherwise(F.concat(done, F.array(p)))

    return F.when(F.size(words) == 0, empty).otherwise(F.aggregate(parts, empty, step))


def content_hash(content: Column, least: int = 0) -> Column:
    """SHA-256 of bytes in upper-case hex; null for fewer than ``least`` bytes, as pictures of under 64 are."""
    return F.when(F.octet_length(content) >= least, F.upper(F.sha2(content.cast("binary"), 256)))


def months_ago(now: Column, months: int) -> Column:
    """Seconds of the time so many months before; a day that the month lacks is its last."""
    return F.unix_timestamp(F.timestamp_seconds(now) - F.make_interval(months=F.lit(months)))


def day_end(day: Column) -> Column:
    """Seconds of the last moment that still counts to a day given by its first."""
    return day + 86400


def format_date(seconds: Column) -> Column:
    """Day, Turkish month name and year."""
    months = F.array(*map(F.lit, "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split()))
    ts = F.timestamp_seconds(seconds)
    return F.concat_ws(" ", F.day(ts), F.element_at(months, F.month(ts)), F.year(ts))
