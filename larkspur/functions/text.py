"""Text Columns: tokens, counts, ids, keys, Markdown. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.schema import DOC_CATEGORIES, TYPE_DIRS

# The token patterns.
TERMS = r"([a-z]+|[0-9]+|[一-鿿])"
CJK = r"([㐀-䶿一-鿿])"
ASCII_WORDS = r"([A-Za-z0-9]+)"
APPROX = r"([\p{L}\p{N}&&[\u0000-⺀]]+|[^\s])"


def bm25_terms(text: Column) -> Column:
    """lower-cased ASCII letter runs, digit runs, single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERMS), F.lit(1))


def token_count(text: Column) -> Column:
    """CJK characters (with extension A) and ASCII word runs; null is 0."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.regexp_extract_all(t, F.lit(CJK), F.lit(1))) + F.size(F.regexp_extract_all(t, F.lit(ASCII_WORDS), F.lit(1)))


def approx_tokens(text: Column) -> Column:
    """runs of letters and digits below U+2E80; every other character that is no blank by itself."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(APPROX), F.lit(1))


def strip_blanks(text: Column) -> Column:
    """without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def role_alias(role: Column) -> Column:
    """F28."""
    return F.when(role == "assistant", "ai").otherwise(role)


def mask(value: Column, keep: int = 4) -> Column:
    """the first characters, then three stars; blank stays blank."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.substring(value, 1, keep), F.lit("***")))


def content_id(text: Column) -> Column:
    """md5 of the content."""
    return F.md5(text.cast("binary"))


def session_id(user: Column, time: Column, n_messages: Column) -> Column:
    """sess_ and 20 hex digits of user|time|length."""
    return F.concat(F.lit("sess_"), F.substring(F.md5(F.concat_ws("|", user, time, n_messages.cast("string")).cast("binary")), 1, 20))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """F22 in a batch engine: an id from the natural key, so that a retried task makes the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256), 1, 24))


def snowflake_parts(value: Column, epoch_ms: int = 1704067200000) -> Column:
    """(millis, datacenter, worker, sequence) of a 64-bit id."""
    v = value.cast("bigint")
    return F.struct(
        (F.shiftright(v, 22) + F.lit(epoch_ms)).alias("millis"),
        F.shiftright(v, 17).bitwiseAND(F.lit(31)).cast("int").alias("datacenter"),
        F.shiftright(v, 12).bitwiseAND(F.lit(31)).cast("int").alias("worker"),
        v.bitwiseAND(F.lit(4095)).cast("int").alias("sequence"),
    )


#: The namespace of RFC 4122 for object ids.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
UUID = r"^\{?(?:urn:uuid:)?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def point_id(value: Column) -> Column:
    """UUIDs and unsigned integers as they are, else a version-5 UUID of the text."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), value.cast("binary")))
    variant = F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16)
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(variant), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(value.rlike(UUID) | value.rlike("^[0-9]+$"), value).otherwise(made)


def item_key(content: Column, *ids: Column) -> Column:
    """the first truthy id, else the content."""
    return F.coalesce(first_truthy(*ids), F.concat(F.lit("content:"), content))


def type_or_default(memory_type: Column, category: Column) -> Column:
    """A blank type follows from the category; later lists win."""
    by_category = {c: t for t, cs in DOC_CATEGORIES.items() for c in cs}
    mapped = reduce(lambda w, kv: w.when(category == kv[0], kv[1]), by_category.items(), F.when(F.lit(False), ""))
    return F.coalesce(F.when(memory_type != "", memory_type), mapped, F.lit(""))


def type_dir(memory_type: Column) -> Column:
    return reduce(lambda w, kv: w.when(memory_type == kv[0], kv[1]), TYPE_DIRS.items(), F.when(F.lit(False), "")).otherwise("Memory")


def safe_name(value: Column) -> Column:
    """Runs of anything but word characters, - and . become one underscore."""
    out = F.regexp_replace(F.trim(value), r"(?U)[^\w\-.]+", "_")
    return F.when(out == "", "_").otherwise(out)


def object_key(prefix: str, user: Column, memory_type: Column, category: Column) -> Column:
    """prefix/user/Type Memory/category.md."""
    kind = type_dir(type_or_default(memory_type, category))
    return F.concat_ws("/", F.lit(prefix.strip("/")), safe_name(user), kind, F.concat(safe_name(category), F.lit(".md")))


def render_section(memory_type: Column, category: Column, summary: Column, bullets: Column) -> Column:
    """title, summary and bullets; blank bullets are left out, none at all is said so."""
    shown = F.transform(F.filter(bullets, lambda b: F.trim(b) != ""), lambda b: F.concat(F.lit("- "), b))
    body = F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise("- (暂无)")
    return F.concat(F.lit("# "), type_dir(memory_type), F.lit(" / "), category, F.lit("\n\n## 摘要\n"), F.trim(summary), F.lit("\n\n## 详细记忆\n"), body, F.lit("\n"))


def normalise_markdown(markdown: Column, memory_type: Column, category: Column) -> Column:
    """unwraps a leading fence; adds a header where there is none."""
    t = F.regexp_replace(markdown, r"(?s)^\s+|\s+$", "")
    inner = F.regexp_extract(t, r"(?s)^```(?:markdown)?\s*(.*?)\s*```", 1)
    t = F.when(t.rlike(r"(?s)^```(?:markdown)?\s*.*?\s*```"), F.regexp_replace(inner, r"(?s)^\s+|\s+$", "")).otherwise(t)
    header = F.concat(F.lit("# "), F.initcap(memory_type), F.lit(" Memory / "), category, F.lit("\n\n"))
    return F.when(F.startswith(t, F.lit("#")), F.concat(t, F.lit("\n"))).otherwise(F.concat(header, t, F.lit("\n")))


# What the evaluation files call the two speakers.
FIRST_SPEAKER = ("speakera", "a", "male", "boy", "boyfriend")
SECOND_SPEAKER = ("speakerb", "b", "female", "girl", "girlfriend", "ai")


def speaker(value: Column, first: Column, second: Column) -> Column:
    """(speaker, fixed)."""
    plain = F.translate(F.lower(F.trim(value)), " _", "")
    a, b = plain.isin(*FIRST_SPEAKER), plain.isin(*SECOND_SPEAKER)
    return F.struct(F.when(a, first).when(b, second).otherwise(value).alias("speaker"), F.coalesce(a | b, F.lit(False)).alias("fixed"))
