"""Text functions as column expressions; everything here stays in the JVM but for ``repair_math``.

Null texts give null unless stated otherwise; empty texts give empty results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import CATEGORIES

WORD = r"([\p{L}\p{N}]+)"
# What sets paragraphs apart, image links, formulas, and characters of a text layer that can't be converted.
BLANK_LINE = r"\n\s*\n"
IMAGE_LINK = r"!\[[^\]]*\]\((images/[^)]+)\)"
FORMULA = r"(?s)(\$\$.+?\$\$|\$[^$\n]+\$)"
BROKEN_LAYER = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{1D400}-\x{1D7FF}]|\(cid:"

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def paragraphs(c: Column) -> Column:
    """Blank-line separated paragraphs, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(c, BLANK_LINE), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))


def cjk_bigrams(c: Column) -> Column:
    """Tokens, with runs of Han characters as overlapping pairs: an option for texts without word breaks."""
    han = r"^[\x{3400}-\x{9FFF}]{3,}$"
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([\x{3400}-\x{9FFF}]+|[\p{L}\p{N}&&[^\x{3400}-\x{9FFF}]]+)"), F.lit(1))
    return F.flatten(F.transform(parts, lambda t: F.when(t.rlike(han), pairs(t)).otherwise(F.array(t))))


def fingerprint(source: Column, chunk_index: Column, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of source, index and text, joined by NUL; nulls count as empty, a null index as 0."""
    parts = [F.coalesce(source, F.lit("")), F.coalesce(chunk_index, F.lit(0)).cast("string"), F.coalesce(text, F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, 16)


def path_parts(path: Column) -> Column:
    """Path parts, split at both separators."""
    return F.split(path, r"[/\\]")


def basename(path: Column) -> Column:
    """What follows the last backslash, if there is one, else the last slash."""
    return F.when(F.contains(path, F.lit("\\")), F.substring_index(path, "\\", -1)).otherwise(F.substring_index(path, "/", -1))


def category_of(path: Column) -> Column:
    """Category by the path's directory names (the file's name doesn't count); empty if none is known."""
    dirs = F.concat_ws("/", F.transform(F.slice(path_parts(path), 1, F.greatest(F.size(path_parts(path)) - 1, F.lit(0))), F.lower))
    out = F.lit("")
    for key, category in reversed(CATEGORIES):
        out = F.when(F.contains(dirs, F.lit(key)), category).otherwise(out)
    return F.when(path.isNotNull(), out)


def ligatures(c: Column) -> Column:
    for bad, good in LIGATURES.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


# A formula between dollar signs, and single letters set apart by a blank each.
_SPAN = re.compile(r"(\$\$?)(.+?)\1", re.S)
_APART = re.compile(r"(?<![A-Za-z\\])[A-Za-z](?:\s[A-Za-z](?![A-Za-z]))+")


def join_spaced_letters(text: str) -> str:
    """Single letters set apart by blanks inside formulas, put together again."""
    return _SPAN.sub(lambda span: _APART.sub(lambda run: "".join(run[0].split()), span[0]), text)


@F.pandas_udf(StringType())
def repair_math(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or "$" not in t else join_spaced_letters(t))


def normalize(c: Column) -> Column:
    """Ligatures spelled out and formulas put together; Python only sees texts with a dollar sign."""
    plain = ligatures(c)
    return F.when(F.contains(plain, F.lit("$")), repair_math(plain)).otherwise(plain)


def formula_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(FORMULA), F.lit(1)))


def image_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE_LINK), F.lit(1))


def formula_delimiters(c: Column) -> Column:
    """The other count: pairs of display delimiters, and what is left of single ones in pairs."""
    displays = F.regexp_count(c, F.lit(r"\$\$"))
    return F.floor(displays / 2) + F.floor((F.regexp_count(c, F.lit(r"\$")) - 2 * displays) / 2)


def html_escape(c: Column) -> Column:
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def needs_ocr(c: Column, min_chars: int = 500) -> Column:
    """Whether a text layer is missing or holds little but one repeated line."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\f\x0b\x{85}\x{2028}\x{2029}]"), compact), lambda x: F.length(x) >= 3)
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))

    def run(a, x):  # over sorted lines: runs of equal ones, their number and the longest
        now = F.when(x == a.last, a.run + 1).otherwise(1)
        return F.struct(x.alias("last"), now.alias("run"), (a.kinds + F.when(now == 1, 1).otherwise(0)).alias("kinds"), F.greatest(a.modal, now).alias("modal"))

    runs = F.aggregate(F.array_sort(lines), F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("kinds"), F.lit(0).alias("modal")), run)
    few = (runs.kinds <= F.greatest(F.lit(3), F.floor(n / 8))) | (runs.modal / n >= 0.85)
    short = ~((n == 1) & (F.length(F.element_at(F.concat(lines, F.array(F.lit(""))), 1)) >= 30))
    return F.when(total < min_chars, short).otherwise((n >= 8) & few)


def conversion_profile(c: Column, stem: Column) -> Column:
    """(lang, method) to convert a PDF with, by its text layer; by the file's name if that is empty."""
    dense = compact(F.coalesce(c, F.lit("")))
    cjk = F.length(dense) - F.length(F.regexp_replace(dense, r"[\x{3400}-\x{9FFF}]", ""))
    ch = F.when(dense != "", cjk / F.length(dense) >= 0.15).otherwise(stem.rlike(r"[\x{3400}-\x{9FFF}]"))
    broken = (dense != "") & c.rlike(BROKEN_LAYER)
    return F.struct(F.when(ch, "ch").otherwise("en").alias("lang"), F.when(ch | F.coalesce(broken, F.lit(False)), "ocr").otherwise("auto").alias("method"))


def cache_key(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")).cast("binary")), 1, 16)


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes or a text's."""
    return F.sha2(content.cast("binary"), 256)


def host_source(url: Column, prefix: str = "page-") -> Column:
    """Source name of a page: prefix and host, without characters that file names can't have, cut at 80; null for other schemes."""
    host = F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    name = F.substring(F.regexp_replace(F.concat(F.lit(prefix), host), r'[\\/:*?"<>|]', "_"), 1, 80)
    return F.when(url.startswith("http://") | url.startswith("https://"), name)


def iso_stamp(ts: Column) -> Column:
    """UTC to the second, with a Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_index(c: Column, mark: str) -> Column:
    """1-based place of the last ``mark``, 0 for none."""
    at = F.instr(F.reverse(c), mark[::-1])
    return F.when(at > 0, F.length(c) - at - len(mark) + 2).otherwise(0)


def snippet(c: Column, chars: int = 500, least: int = 200) -> Column:
    """The first ``chars`` characters, cut after the last sentence end, line break or blank beyond ``least``, and three dots; shorter texts as they are."""
    cut = F.substring(c, 1, chars)
    last = F.greatest(*(last_index(cut, m) for m in (". ", "。", "\n", " ")))
    return F.when(F.length(c) > chars, F.concat(F.when(last > least + 1, F.substring(cut, F.lit(1), last)).otherwise(cut), F.lit("..."))).otherwise(c)


def one_line(c: Column, chars: int = 200) -> Column:
    return F.concat(F.replace(F.substring(c, 1, chars), F.lit("\n"), F.lit(" ")), F.lit("..."))


def like_filter(c: Column, pattern: str) -> Column:
    """Case-sensitive containment in which % and _ of the input are wildcards; a plain substring is pushed to the scan as such."""
    return c.like(f"%{pattern}%") if re.search(r"[%_\\]", pattern) else c.contains(pattern)
