"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, as in a catalog that compares by ASCII."""
    return F.translate(text, _UPPER, _LOWER)


def contains_literal(text: Column, wanted: str) -> Column:
    """Whether ``text`` holds the trimmed ``wanted`` literally, ASCII case aside; a blank one matches all."""
    wanted = wanted.strip()
    low = "".join(c.lower() if c in _UPPER else c for c in wanted)
    return F.contains(ascii_lower(text), F.lit(low)) if wanted else F.lit(True)


def live() -> Column:
    """Rows that are not deleted."""
    return F.col("deleted_at").isNull()


def shown_at() -> Column:
    """When an asset counts as taken: its own time, else the file's."""
    return F.coalesce("taken_at", "mtime")


def local_time(seconds: Column, tz: str) -> Column:
    """Wall-clock timestamp in ``tz`` of epoch seconds (the session runs in UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)


def day_bounds(day: Column, tz: str) -> tuple[Column, Column]:
    """First and last epoch second of a calendar day (date) in ``tz``."""
    at = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), tz))
    return at(day), at(F.date_add(day, 1)) - 1


def megabytes(mb: Column) -> Column:
    """Bytes of a size in MB, rounded; null for none or less."""
    size = F.round(mb * 1048576).cast("long")
    return F.when(size > 0, size)


def pixels(width: Column, height: Column) -> Column:
    """Area with missing and negative sides as 0, wide enough not to overflow."""
    side = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("decimal(19,0)")
    return (side(width) * side(height)).cast("decimal(38,0)")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def unsigned(x: Column) -> Column:
    """A long's bits as unsigned decimal text."""
    return F.conv(F.hex(x), 16, 10)


def _fold(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays. The norm is an array's element, as Spark would work it out anew for each element of ``v`` else."""
    divided = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(v)), divided), F.lit(0))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine similarity; 0 for other lengths, empty vectors and zero norms."""
    na, nb = norm(a), norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > eps) & (nb > eps)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gps_decimal(dms: Column, ref: Column) -> Column:
    """Signed degrees of (num, den) rationals for degrees, minutes and seconds; null if one is missing or has a zero denominator."""
    part = lambda i: F.try_element_at(dms, F.lit(i))
    value = lambda i: F.when(part(i)["den"] != 0, part(i)["num"] / part(i)["den"])
    degrees = value(1) + value(2) / 60 + value(3) / 3600
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -degrees).otherwise(degrees)


def human_bytes(size: Column) -> Column:
    """Size with a unit from B to TB: no decimals from 10 on, one below."""
    scaled = lambda unit, power: F.when(
        size / float(1024**power) >= 10, F.format_string(f"%.0f {unit}", size / float(1024**power))
    ).otherwise(F.format_string(f"%.1f {unit}", size / float(1024**power)))
    out = F.when(size >= 1024**4, scaled("TB", 4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = out.when(size >= 1024**power, scaled(unit, power))
    return out.otherwise(F.format_string("%d B", size))


def thumb_key(root_id: Column, rel_path: Column) -> Column:
    """First 16 hex digits of SHA-1 over the root id (8 bytes, little end first), a bar and the path."""
    big = F.lpad(F.hex(root_id), 16, "0")
    little = F.concat(*(F.substring(big, 15 - 2 * i, 2) for i in range(8)))
    return F.substring(F.sha1(F.concat(F.unhex(little), F.lit("|").cast("binary"), rel_path.cast("binary"))), 1, 16)


def thumb_path(key: Column) -> Column:
    """Place of a thumbnail: two leading digits as folder."""
    return F.concat(F.substring(key, 1, 2), F.lit("/"), key, F.lit(".webp"))


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """struct(width, height) as seen: orientations 6 and 8 swap the sides."""
    turned = F.coalesce(orientation.isin(6, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def exif_seconds(text: Column, tz: str) -> Column:
    """Epoch seconds of 'yyyy:MM:dd HH:mm:ss' in ``tz``; null for anything else. An ambiguous hour takes the earlier time."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss")), tz))


def exif_text(text: Column) -> Column:
    """Text without trailing NULs and blanks around; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(text, "\\x00+$", "")), F.lit(""))


def box_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(x, y, w, h) with sides of at least 0."""
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(x2 - x1, F.lit(0.0)).alias("w"), F.greatest(y2 - y1, F.lit(0.0)).alias("h"))


def grey_cells(data: Column, width: Column, height: Column, channels: Column, columns: int = 9, rows: int = 8) -> Column:
    """Mean grey of each cell of a grid over an image's bytes (blue, green, red first), row by row."""
    at = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("double")
    grey = lambda p: F.when(channels == 1, at(p)).otherwise(0.114 * at(p * channels) + 0.587 * at(p * channels + 1) + 0.299 * at(p * channels + 2))
    low = lambda n, size, count: F.floor(n * size / count).cast("int")
    high = lambda n, size, count: F.greatest(F.ceil((n + 1) * size / count).cast("int"), low(n, size, count) + 1)

    def cell(n: Column) -> Column:
        y, x = F.floor(n / columns), n % columns
        ys = F.sequence(low(y, height, rows), high(y, height, rows) - 1)
        xs = F.sequence(low(x, width, columns), high(x, width, columns) - 1)
        values = F.flatten(F.transform(ys, lambda j: F.transform(xs, lambda i: grey((j * width + i).cast("int")))))
        return _fold(values) / F.size(values)

    return F.transform(F.sequence(F.lit(0), F.lit(columns * rows - 1)), cell)


def gradient_hash(cells: Column, columns: int = 9, rows: int = 8) -> Column:
    """64 bits, one for each pair of neighbours in a row of ``grey_cells``: set where it gets brighter."""
    spots = F.array(*(F.lit(r * columns + c) for r in range(rows) for c in range(columns - 1)))
    bit = lambda n: F.when(F.get(cells, n) < F.get(cells, n + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(F.transform(spots, bit), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
