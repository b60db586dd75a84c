"""Tags of assets: clouds, lookups, replacement, and scores of taggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .graph import written
from .numbering import greatest, numbered

LARGEST_CLOUD = 500
#: Most tags that are sent to each task, some 16 MB.
MOST_SENT = 200_000


def tag_cloud(tags: DataFrame, links: DataFrame, limit: int = LARGEST_CLOUD, assets: DataFrame | None = None) -> DataFrame:
    """Tags by number of links, unused ones included; with ``assets`` only links of live ones count."""
    counted = links if assets is None else links.join(assets.where(E.live()).select(F.col("id").alias("image_id")), "image_id", "left_semi")
    n = counted.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    cloud = tags.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("links"))
    return cloud.orderBy(F.desc("links"), "name").limit(min(max(limit, 1), LARGEST_CLOUD))


def tag_by_name(tags: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The named tag with its number of links."""
    one = tags.where(F.col("name") == name)
    return one.join(links, one["id"] == links["tag_id"], "left").groupBy(one["id"], one["name"]).agg(F.count(links["tag_id"]).alias("links"))


def images_with_all(links: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    """Images that carry every named tag; repeated names count once."""
    wanted = sorted(set(names))
    chosen = tags.where(F.col("name").isin(*wanted)).select(F.col("id").alias("tag_id"))
    return links.join(chosen, "tag_id").groupBy("image_id").agg(F.countDistinct("tag_id").alias("n")).where(F.col("n") == len(wanted)).select("image_id")


#: Ids of one bitmap, as Spark's bitmap functions deal them.
_BITS = 32_768


def tag_bitmaps(links: DataFrame) -> DataFrame:
    """(tag_id, bucket, bits): which images carry a tag, as one bitmap for each 32,768 ids; built once and kept."""
    return links.groupBy("tag_id", F.bitmap_bucket_number("image_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("image_id")).alias("bits"))


def lists_of_tags(bitmaps: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_id, bucket, bits): the images that carry all tags of each list (list_id, tag_id), by bit operations; what has none is left out.

    A list meets its tags' bitmaps only, one for each bucket, however many images they hold.
    """
    asked = lists.select("list_id", "tag_id").distinct()
    size = asked.groupBy("list_id").agg(F.count(F.lit(1)).alias("tags"))
    met = asked.join(bitmaps, "tag_id").groupBy("list_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.join(size, "list_id").where((F.col("n") == F.col("tags")) & (F.bitmap_count("bits") > 0)).select("list_id", "bucket", "bits")


def image_counts(found: DataFrame) -> DataFrame:
    """(list_id, images) of ``lists_of_tags``."""
    return found.groupBy("list_id").agg(F.sum(F.bitmap_count("bits")).alias("images"))


def list_classes(lists: DataFrame) -> DataFrame:
    """(list_id, rep): the least list_id with the same tags."""
    tags = lists.groupBy("list_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    return tags.join(tags.groupBy("tags").agg(F.min("list_id").alias("rep")), "tags").select("list_id", "rep")


def counts_of_lists(bitmaps: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_id, images): the images that carry all tags of each list; lists with the same tags are looked up once."""
    classes = written(list_classes(lists))
    asked = lists.join(classes.where("list_id = rep").select("list_id"), "list_id", "left_semi")
    found = image_counts(lists_of_tags(bitmaps, asked)).withColumnRenamed("list_id", "rep")
    return classes.join(found, "rep").select("list_id", "images")


def images_in(found: DataFrame) -> DataFrame:
    """(list_id, image_id): the bits of ``lists_of_tags`` as ids."""
    byte = lambda i: F.conv(F.hex(F.substring("bits", i + 1, 1)), 16, 10).cast("int")
    held = found.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(_BITS // 8 - 1)), lambda i: byte(i) != 0)))
    bits = held.select("list_id", "bucket", "at", byte(F.col("at")).alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    place = (F.col("at") * 8 + F.col("bit")).cast("long")
    image_id = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * _BITS + place + 1).otherwise(F.col("bucket") * _BITS - place)
    return bits.where(F.expr("getbit(byte, bit) = 1")).select("list_id", image_id.alias("image_id"))


def tags_of_image(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Each image's tags with their rank: by score, then name."""
    named = links.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "name", "source"))
    return named.select("image_id", "name", "source", "score", rank.alias("rank"))


def images_of_tag(assets: DataFrame, links: DataFrame, tags: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Live images of a tag by score, then time; an image that several sources tagged comes once, with its best score."""
    one = links.join(tags.where(F.col("name") == name).select(F.col("id").alias("tag_id")), "tag_id").groupBy(F.col("image_id").alias("id")).agg(F.max("score").alias("score"))
    found = assets.where(E.live()).join(one, "id").select("id", "score", "mtime")
    return found.orderBy(F.desc("score"), F.desc("mtime"), F.desc("id")).limit(min(max(limit, 1), 500))


def images_of_tag_total(assets: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct live images of every tag."""
    live = assets.where(E.live()).select(F.col("id").alias("image_id"))
    n = links.join(live, "image_id", "left_semi").groupBy(F.col("tag_id").alias("id")).agg(F.countDistinct("image_id").alias("n"))
    return tags.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("images"))


def upsert_tags(tags: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``tags`` with the names of ``new`` (name, source, category): known ones take the source, and the category if it has one."""
    once = new.groupBy("name").agg(F.max("source").alias("new_source"), F.max("category").alias("new_category"))
    merged = tags.join(once, "name", "full_outer")
    known = merged.where("id is not null").select("id", "name", F.coalesce("new_source", "source").alias("source"), F.coalesce("new_category", "category").alias("category"), "created_at")
    fresh = numbered(merged.where("id is null").select("name", "new_source", "new_category"), ["name"], greatest(tags))
    return known.unionByName(fresh.select("id", "name", F.col("new_source").alias("source"), F.col("new_category").alias("category"), F.lit(now).cast("long").alias("created_at")))


def replace_ai_tags(links: DataFrame, tags: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(tags, links) with the machine tags of the images of ``new`` (image_id, name, score, category) replaced by it.

    Names are trimmed, blank ones dropped, scores kept within 0 and 1; the best
    score of a repeated name stays.
    """
    clean = new.select("image_id", F.trim("name").alias("name"), E.clamp(F.col("score"), 0.0, 1.0).alias("score"), "category").where("name != ''")
    all_tags = upsert_tags(tags, clean.select("name", F.lit("ai").alias("source"), "category"), now)
    touched = new.select("image_id").distinct().withColumn("touched", F.lit(True))
    kept = links.join(touched, "image_id", "left").where("touched is null or source != 'ai'").select(links.columns)
    scored = clean.groupBy("image_id", "name").agg(F.max("score").alias("score"))
    added = scored.join(all_tags.select(F.col("id").alias("tag_id"), "name"), "name").select("image_id", "tag_id", F.lit("ai").alias("source"), "score", F.lit(now).cast("long").alias("created_at"))
    return all_tags, kept.unionByName(added)


def clear_ai_tags(links: DataFrame, tags: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, tags, assets) without machine tags and without tags that nothing carries; tagging is pending again."""
    kept = links.where("source != 'ai'")
    used = tags.join(kept.select(F.col("tag_id").alias("id")), "id", "left_semi")
    again = E.live() & (F.col("thumb_status") == "ready")
    return kept, used, assets.withColumn("tag_status", F.when(again, F.lit("pending")).otherwise(F.col("tag_status")))


def ocr_tags(recognised: DataFrame, name: str = "text") -> DataFrame:
    """(image_id, name, score, source) for images whose recognised text is not blank."""
    return recognised.where(F.trim(F.coalesce("ocr_text", F.lit(""))) != "").select(F.col("id").alias("image_id"), F.lit(name).alias("name"), F.lit(1.0).alias("score"), F.lit("ocr").alias("source"))


def attach_ocr_tags(links: DataFrame, tags: DataFrame, recognised: DataFrame, now: int, name: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tags, links) with the tag ``name`` on all images whose recognised text is not blank; who has it already keeps it once."""
    found = ocr_tags(recognised, name)
    all_tags = upsert_tags(tags, found.select("name", "source", F.lit(None).cast("string").alias("category")).distinct(), now)
    named = found.join(all_tags.select(F.col("id").alias("tag_id"), "name"), "name").select("image_id", "tag_id", "source", "score", F.lit(now).cast("long").alias("created_at"))
    fresh = named.dropDuplicates(["image_id"]).join(links, ["image_id", "tag_id", "source"], "left_anti")
    return all_tags, links.unionByName(fresh.select(links.columns))


def split_tags(text: Column) -> Column:
    """Distinct trimmed parts of a tag string, in order; bars and commas of wide width separate like a bar."""
    parts = F.split(F.translate(text, "｜，", "||"), "\\|")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def rank_scores(names: Column, most: int = 24) -> Column:
    """array<struct(name, score)> of the first ``most`` names, falling from 0.95 by 0.01 down to 0.5."""
    score = lambda i: F.round(F.greatest(F.lit(0.5), F.lit(0.95) - i * F.lit(0.01)), 3)
    return F.transform(F.slice(names, 1, most), lambda x, i: F.struct(x.alias("name"), score(i).alias("score")))


def with_names(links: DataFrame, tags: DataFrame) -> DataFrame:
    """``links`` (tag_id, ...) with the ``name`` of their tags.

    A tag has as many links as it likes, so links dealt out by tag would meet in
    few tasks: the tags go to all tasks while they are few, as counted.
    """
    known = written(tags.select(F.col("id").alias("tag_id"), "name"))
    return links.join(F.broadcast(known) if known.count() <= MOST_SENT else known, "tag_id")


def best_per_tag(scored: DataFrame, most: int = 12) -> DataFrame:
    """Each image's best tags (image_id, name, score, rank): the best score of a name, then the best names.

    An image has few rows of a name, so they are dealt out by image before they
    are put together: a scan's task would hold all that it reads else.
    """
    best = scored.repartition("image_id").groupBy("image_id", "name").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


# Fixed values: (name, score, category) of the tags that colour and shape give.
RULE_TAGS = {
    "blue": (("蓝色", 0.82, "color"), ("天空", 0.66, "scene")),
    "warm": (("暖色", 0.76, "color"), ("日落", 0.58, "scene")),
    "green": (("绿色", 0.78, "color"), ("森林", 0.58, "scene")),
    "square": (("方形", 0.5, "shape"),),
    "other": (("照片", 0.6, "type"),),
}


def rule_tags(red: Column, green: Column, blue: Column, width: Column, height: Column) -> Column:
    """array<struct(name, score, category)> by thresholds on mean colour and sides; the last kind where no other holds."""
    holds = {  # fixed values: the thresholds
        "blue": (blue > red * 1.08) & (blue > green * 1.02),
        "warm": (red > blue * 1.08) & (red > green),
        "green": (green > red * 1.04) & (green > blue * 1.04),
        "square": F.abs(width - height) < 8,
    }
    tag = lambda t: F.struct(F.lit(t[0]).alias("name"), F.lit(t[1]).alias("score"), F.lit(t[2]).alias("category"))
    made = F.array(*(F.when(rule, tag(t)) for kind, rule in holds.items() for t in RULE_TAGS[kind]))
    kept = F.filter(made, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*(tag(t) for t in RULE_TAGS["other"])))


def zero_shot(vectors: DataFrame, prompts: DataFrame, most: int = 8, digits: int | None = None) -> DataFrame:
    """The best prompts (name, embedding) of each image (image_id, embedding) with (dot + 1) / 2 as score, rounded to ``digits`` before it is ranked.

    The prompt table is a small fixed set: it is broadcast while Spark's size
    limit allows, and the ranking keeps ``most`` rows per image and task.
    """
    pairs = vectors.select("image_id", "embedding").join(prompts.select("name", F.col("embedding").alias("prompt")))
    score = E.clamp((E.dot(F.col("embedding"), F.col("prompt")) + 1) / 2, 0.0, 1.0)
    score = score if digits is None else F.round(score, digits)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "name"))
    return pairs.select("image_id", "name", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= most)
