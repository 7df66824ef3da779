"""Lines, words and sizes of texts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The upper bounds (exclusive) of the size buckets.
BUCKETS = [10, 30, 100, 300, 1000, 3000]


def lines_read(text: Column) -> Column:
    """Lines as a reader sees them: a final line break opens no line, an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - text.endswith("\n").cast("int"))


def lines_split(text: Column) -> Column:
    """Pieces between line breaks: one more than there are breaks."""
    return F.size(F.split(text, "\n", -1))


def size_bucket(lines: Column) -> Column:
    """`0-10`, `10-30` and so on; null for null."""
    out = F.lit(f"{BUCKETS[-1]}+")
    for low, high in reversed(list(zip([0, *BUCKETS], BUCKETS, strict=False))):
        out = F.when(lines < high, f"{low}-{high}").otherwise(out)
    return F.when(lines.isNotNull(), out)


def pair_bucket(before: Column, after: Column) -> Column:
    """By the longer side; null if either side is unknown (greatest() alone would skip nulls)."""
    return F.when(before.isNotNull() & after.isNotNull(), size_bucket(F.greatest(before, after)))


def word_set(text: Column, stop: Sequence[str] = ()) -> Column:
    """The distinct runs of letters and digits in lower case, without the words of `stop`."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else words


def shares_no_word(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(word_set(a), word_set(b))


def within_bytes(text: Column, least: int, most: int) -> Column:
    """The text if its UTF-8 bytes are between the bounds, else null."""
    return F.when(F.octet_length(text).between(least, most), text)


def display_width(line: Column, tab: int = 4) -> Column:
    """Columns a line takes on a screen: tabs reach the next multiple of `tab`, wide characters take two."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}]"
    return F.aggregate(
        F.filter(F.split(line, ""), lambda c: c != ""),
        F.lit(0),
        lambda at, c: F.when(c == "\t", (F.floor(at / tab) + 1) * tab).when(F.regexp(c, F.lit(wide)), at + 2).otherwise(at + 1).cast("int"),
    )


def leading_blanks(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def trailing_blanks(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"[ \t]*$", 0))


def portable_hash(text: Column) -> Column:
    """60 bits of MD5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def thousands(number: Column) -> Column:
    """A whole number with `{,}` between thousands, as typesetting wants it."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("{,}"))


def percent(part: Column, total: Column) -> Column:
    return 100.0 * part / F.greatest(total, F.lit(1))


def share_or_dash(part: Column, total: Column) -> Column:
    return F.when(total == 0, "-").otherwise(F.format_string("%.1f", 100.0 * part / total))


def utf16_to_byte(text: Column, offset: Column) -> Column:
    """The offset in UTF-8 bytes of an offset in UTF-16 units; null beyond the end and within a pair of units."""
    wide = F.encode(text, "UTF-16BE")
    head = F.substring(wide, F.lit(1), offset.cast("int") * 2)
    # Half of a pair can't be decoded, so its first unit is looked at: D800 to DBFF.
    last = F.hex(F.substring(head, offset.cast("int") * 2 - 1, F.lit(1)))
    whole = (offset >= 0) & (offset * 2 <= F.octet_length(wide)) & ((offset == 0) | ~last.between("D8", "DB"))
    return F.when(whole, F.octet_length(F.encode(F.decode(F.when(whole, head), "UTF-16BE"), "UTF-8")))
