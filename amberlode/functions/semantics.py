"""Scalar rules of the asset model as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by media kind, spellings of one extension, sources of weak dates.
IMAGE_EXT = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "gif", "webp", "bmp", "dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2")
VIDEO_EXT = ("mov", "mp4", "m4v", "avi", "mkv", "3gp", "mts", "m2ts", "webm")
SAME_EXT = {"jpeg": "jpg", "tiff": "tif", "heif": "heic"}
WEAK_SOURCES = ("mtime", "filename", "unknown")
DEGENERATE_BITS = (4, 60)


def live(deleted_at: Column) -> Column:
    return deleted_at.isNull()


def extension(path: Column) -> Column:
    """Lower-case extension without dot, one spelling for each kind."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = ext
    for a, b in SAME_EXT.items():
        out = F.when(ext == a, b).otherwise(out)
    return out


def media_kind(ext: Column) -> Column:
    return F.when(ext.isin(*IMAGE_EXT), "image").when(ext.isin(*VIDEO_EXT), "video").otherwise("other")


def rendered(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def canonical_path(hash_: Column, captured_at: Column, ext: Column) -> Column:
    """YYYY/MM/YYYYMMDD-HHMMSS_hash10.ext, or unknown/h2/h10.ext without a date."""
    name = F.concat(F.substring(hash_, 1, 10), F.lit("."), ext)
    dated = F.concat(F.date_format(captured_at, "yyyy/MM/yyyyMMdd-HHmmss"), F.lit("_"), name)
    return F.when(captured_at.isNull(), F.concat(F.lit("unknown/"), F.substring(hash_, 1, 2), F.lit("/"), name)).otherwise(dated)


def filename_date(name: Column) -> Column:
    """Noon of the first year-month-day in a name, with a month and a day that a calendar has; null if there is none or it isn't a date."""
    pattern = r"((?:19|20)[0-9]{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12][0-9]|3[01])"
    year, month, day = (F.regexp_extract(name, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", F.try_make_timestamp_ntz(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), F.lit(12), F.lit(0), F.lit(0)))


def plausible(ts: Column, this_year: int) -> Column:
    """After 1970 and not past the next year."""
    return ts.isNotNull() & (F.year(ts) > 1970) & (F.year(ts) <= this_year + 1)


def capture_time(sources: list[tuple[str, Column]], this_year: int) -> Column:
    """Struct of the first plausible time and its label, in the order given; unknown if none is."""
    out = F.struct(F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("unknown").alias("label"))
    for label, ts in reversed(sources):
        out = F.when(plausible(ts, this_year), F.struct(ts.cast("timestamp_ntz").alias("at"), F.lit(label).alias("label"))).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Bytes to base 1024 with one decimal, halves to even; whole bytes below 1024."""
    out = F.concat(F.format_string("%.1f", F.bround(n / 1024.0**4, 1)), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(n / 1024.0**k, 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def parse_size(text: Column) -> Column:
    """'1.8TB' to bytes, base 1024; null if it can't be read."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)B?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)B?\s*$", 2))
    power = F.when(unit == "", 0).otherwise(F.position(unit, F.lit("KMGTP")))
    return (number * F.pow(F.lit(1024.0), power)).cast("bigint")


def placement_score(hash_: Column, replica: Column, weight: Column) -> Column:
    """Weighted rendezvous score: -w / ln(u), u from the first 64 bits of sha-256 of 'hash:replica'."""
    top = F.conv(F.substring(F.sha2(F.concat_ws(":", hash_, replica), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return -weight / F.log((top.cast("double") + 1.0) / F.lit(18446744073709551617.0))


def dhash_bits(cell) -> Column:
    """Difference hash of a 9 x 8 grid as a signed 64-bit number; cell(index) gives a grey value, rows first."""
    def bit(p: Column) -> Column:
        at = F.floor(p / 8).cast("int") * 9 + p % 8
        return (cell(at) > cell(at + 1)).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, p: F.shiftleft(acc, 1).bitwiseOR(bit(p)))


def hash_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def degenerate(bits: Column) -> Column:
    n = F.bit_count(bits)
    return (n <= DEGENERATE_BITS[0]) | (n >= DEGENERATE_BITS[1])


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.bround(100.0 * done / total).cast("int"))).otherwise(0)


def stale_days(last: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))) / 86400).cast("bigint")


def days_since(at: Column, now: Column) -> Column:
    """Days between two times with their fraction."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0


def library_path(path: Column, prefix: str) -> Column:
    """Path below a library's prefix; other paths stay whole."""
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)


def marker(text: Column) -> Column:
    """Identity marker (replica, uuid) of a storage; null if it can't be read or has no uuid."""
    said = F.from_json(text, "replica string, uuid string", {"mode": "PERMISSIVE"})
    return F.when(said["uuid"].isNotNull(), said)
