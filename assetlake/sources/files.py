"""Reading folders of image files and their raw metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as E


def scan_assets(spark: SparkSession, root_id: int, path: str) -> DataFrame:
    """A listing (``schemas.LISTED`` and path) of the image files under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    bare = F.regexp_replace("path", "^file:/*", "/")
    root = "/" + path.removeprefix("file:").strip("/")
    rel = F.substring(bare, len(root) + 2, 1_000_000)
    name = F.element_at(F.split(rel, "/"), -1)
    extension = E.ascii_lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    listed = files.select(F.lit(root_id).cast("long").alias("root_id"), rel.alias("rel_path"), name.alias("filename"), extension.alias("extension"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"), "path")
    return listed.where(F.col("extension").isin(*schemas.EXTENSIONS) & (F.col("rel_path") != ""))


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, width, height, nChannels, data) of images; what cannot be decoded has null sides."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(paths)
    side = lambda c: F.when(F.col(f"image.{c}") >= 0, F.col(f"image.{c}").cast("long"))
    return raw.select(F.col("image.origin").alias("path"), side("width").alias("width"), side("height").alias("height"), "image.nChannels", "image.data")


def probe_dimensions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, width, height)."""
    return read_images(spark, paths).select("path", "width", "height")


def image_hashes(images: DataFrame) -> DataFrame:
    """(path, dhash) by the gradient of box means on a 9 x 8 grid; null where nothing was decoded."""
    usable = F.col("width").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)
    cells = E.grey_cells(F.col("data"), F.col("width"), F.col("height"), F.col("nChannels"))
    return images.select("path", F.when(usable, E.gradient_hash(cells)).alias("dhash"))


def normalise_exif(raw: DataFrame, tz: str) -> DataFrame:
    """Typed metadata (id, taken_at, orientation, gps, camera) of raw tags.

    ``raw``: id, datetime_original, make, model strings, orientations array<int>,
    latitude and longitude array<struct<num,den>>, and their references.
    """
    return raw.select(
        "id",
        E.exif_seconds(F.col("datetime_original"), tz).alias("taken_at"),
        F.get("orientations", F.lit(0)).cast("long").alias("orientation"),
        E.gps_decimal(F.col("latitude"), F.col("latitude_ref")).alias("gps_lat"),
        E.gps_decimal(F.col("longitude"), F.col("longitude_ref")).alias("gps_lng"),
        E.exif_text(F.col("make")).alias("camera_make"),
        E.exif_text(F.col("model")).alias("camera_model"),
    )


def normal_root(path: Column) -> Column:
    """Normal form of an absolute root path; null for a relative one.

    Drive letters in upper case, backslashes on drive and network paths, no
    separators at the end but for the root of a drive or the file system.
    """
    p = F.trim(path)
    back = F.translate(p, "/", "\\")
    drive = p.rlike(r"^[A-Za-z]:[\\/]")
    network = back.startswith("\\\\") & ~p.startswith("//")
    trimmed = F.regexp_replace(back, r"\\+$", "")
    local = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.substring(trimmed, 2, 100_000))
    return (
        F.when(drive, F.when(F.length(trimmed) == 2, F.concat(local, F.lit("\\"))).otherwise(local))
        .when(network, trimmed)
        .when(p.startswith("/"), F.when(p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", "")))
    )


def root_type(normal: Column) -> Column:
    """'network' for \\\\server\\share paths, else 'local'."""
    return F.when(normal.startswith("\\\\"), "network").otherwise("local")
