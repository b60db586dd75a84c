"""Known answers of the column expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assetlake.functions import expressions as E
from assetlake.operators import tags
from assetlake.sources import files


def one(spark, column, **values):
    base = spark.range(1).select(*(F.expr(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return base.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "wanted", "hit"), [("IMG_1.JPG", "img_1", True), ("100%.png", "0%", True), ("a_b", "a%b", False), ("É.png", "é", False), ("x\\y", "\\", True), ("x", "  ", True)])
def test_literal_substring(spark, text, wanted, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(E.contains_literal(F.col("t"), wanted)).first()[0] is hit


def test_hamming_and_unsigned(spark):
    assert one(spark, E.hamming(F.col("a"), F.col("b")), a="5L", b="-1L") == 62
    assert one(spark, E.unsigned(F.col("a")), a="-1L") == str(2**64 - 1)


@pytest.mark.parametrize(("dms", "ref", "wanted"), [("(31,1),(12,1),(36,1)", "'N'", 31.21), ("(31,1),(12,1),(36,1)", "'s'", -31.21), ("(31,1),(12,0),(36,1)", "'N'", None), ("(31,1),(12,1)", "'W'", None)])
def test_gps(spark, dms, ref, wanted):
    array = "array(" + ",".join(f"named_struct('num', {p.strip('()').split(',')[0]}, 'den', {p.strip('()').split(',')[1]})" for p in dms.replace("),(", ")|(").split("|")) + ")"
    got = one(spark, E.gps_decimal(F.col("d"), F.col("r")), d=array, r=ref)
    assert got == pytest.approx(wanted) if wanted is not None else got is None


@pytest.mark.parametrize(("size", "text"), [("0L", "0 B"), ("1023L", "1023 B"), ("1536L", "1.5 KB"), ("10240L", "10 KB"), ("5242880L", "5.0 MB"), ("3 * 1099511627776L", "3.0 TB")])
def test_human_bytes(spark, size, text):
    assert one(spark, E.human_bytes(F.col("s")), s=size) == text


def test_thumb_key(spark):
    wanted = hashlib.sha1((300).to_bytes(8, "little") + b"|a/b.jpg").hexdigest()[:16]
    assert one(spark, E.thumb_key(F.col("r"), F.col("p")), r="300L", p="'a/b.jpg'") == wanted
    assert one(spark, E.thumb_path(E.thumb_key(F.col("r"), F.col("p"))), r="300L", p="'a/b.jpg'") == f"{wanted[:2]}/{wanted}.webp"


def test_exif(spark):
    assert one(spark, E.exif_seconds(F.col("t"), "UTC"), t="'2026:06:16 12:34:56'") == 1781613296
    assert one(spark, E.exif_seconds(F.col("t"), "UTC"), t="'not a date'") is None
    assert one(spark, E.exif_text(F.col("t")), t="concat(' Canon ', char(0), char(0))") == "Canon"
    assert one(spark, E.exif_text(F.col("t")), t="'  '") is None


@pytest.mark.parametrize(
    ("path", "wanted", "kind"),
    [("d:\\photos", "D:\\photos", "local"), ("D:\\", "D:\\", "local"), ("d:/a/b/", "D:\\a\\b", "local"), ("\\\\nas\\share\\", "\\\\nas\\share", "network"), ("/", "/", "local"), ("/home/me/", "/home/me", "local"), ("photos", None, "local")],
)
def test_roots(spark, path, wanted, kind):
    got = spark.createDataFrame([(path,)], "p string").select(files.normal_root(F.col("p")).alias("n")).withColumn("k", files.root_type(F.col("n"))).first()
    assert (got[0], got[1]) == (wanted, kind)


def test_tag_strings(spark):
    assert one(spark, tags.split_tags(F.col("t")), t="'a | b｜a，，c'") == ["a", "b", "c"]
    assert [tuple(x) for x in one(spark, tags.rank_scores(F.col("t")), t="array('a', 'b')")] == [("a", 0.95), ("b", 0.94)]


def test_rule_tags(spark):
    rule = tags.rule_tags(*(F.col(c) for c in "rgbwh"))
    assert [x[0] for x in one(spark, rule, r="10D", g="20D", b="200D", w="10L", h="100L")] == ["蓝色", "天空"]
    assert [x[0] for x in one(spark, rule, r="10D", g="10D", b="10D", w="10L", h="100L")] == ["照片"]


def test_cosine_edges(spark):
    assert one(spark, E.cosine(F.col("a"), F.col("b")), a="array(1D, 0D)", b="array(1D)") == 0.0
    assert one(spark, E.cosine(F.col("a"), F.col("b")), a="array(0D, 0D)", b="array(1D, 0D)") == 0.0
    assert one(spark, E.cosine(F.col("a"), F.col("b")), a="array(2D, 0D)", b="array(1D, 0D)") == 1.0
