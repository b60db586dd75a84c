"""Exact and near duplicates by content digests and 64-bit signatures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from .graph import connected_components, multiplied, written
from .numbering import greatest, numbered

#: Hamming thresholds from identical to loosely similar, and the default.
THRESHOLD_PRESETS = (0, 1, 2, 5, 7, 14)
DEFAULT_THRESHOLD = 2
#: Rows of one band key that meet in one place; beyond, the key is split into blocks.
BLOCK_ROWS = 4096


def content_hash(files: DataFrame) -> DataFrame:
    """(path, content_hash) of a ``binaryFile`` table; unreadable content has none and stays in the backlog."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"))


def exact_groups(assets: DataFrame) -> DataFrame:
    """Live assets with equal content: (content_hash, ids ascending) for two and more."""
    hashed = assets.where(E.live() & F.col("content_hash").isNotNull())
    return hashed.groupBy("content_hash").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def exact_items(assets: DataFrame) -> DataFrame:
    """The same as rows (group_id, id): a group is named by its least id."""
    hashed = assets.where(E.live() & F.col("content_hash").isNotNull())
    groups = hashed.groupBy("content_hash").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(groups, "content_hash").select("group_id", "id")


def _bands(t: int) -> tuple[int, int]:
    """(bands, bands that must agree) so that keys stay near 20 bits."""
    if t <= 2:
        return t + 1, 1
    extra = 3
    return t + extra, extra


def _parts(h: Column, t: int) -> list[Column]:
    """The bands of a signature's bits."""
    bands, _ = _bands(t)
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1 if edges[i + 1] - edges[i] < 64 else -1)) for i in range(bands)]


def _first_key(a: Column, b: Column, subset: Column, t: int) -> Column:
    """Whether ``subset`` is the number of the first key that both signatures have."""
    bands, agree = _bands(t)
    same = F.filter(F.array(*(F.when(x == 0, F.lit(n)) for n, x in enumerate(_parts(a.bitwiseXOR(b), t)))), lambda x: x.isNotNull())
    labels = F.array(*(F.lit(",".join(map(str, chosen))) for chosen in combinations(range(bands), agree)))
    return F.get(labels, subset) == F.array_join(F.slice(same, 1, agree).cast("array<string>"), ",")


def _keys(h: Column, t: int) -> Column:
    """Keys of a signature: two within ``t`` bits share at least one (pigeonhole over bands)."""
    bands, agree = _bands(t)
    band = _parts(h, t)
    return F.array(*(F.struct(F.lit(n).alias("subset"), F.xxhash64(*(band[i] for i in chosen)).alias("bits")) for n, chosen in enumerate(combinations(range(bands), agree))))


def _heavy(keyed: DataFrame) -> DataFrame:
    """(key, blocks) of the keys with more rows than a block takes."""
    return keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")


def _with_blocks(keyed: DataFrame, heavy: DataFrame) -> DataFrame:
    """``keyed`` with the number of blocks of its key."""
    return keyed.join(heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def hamming_pairs(hashes: DataFrame, t: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs of distinct signatures of ``hashes`` (id, dhash) within ``t`` bits: (a, b, distance) with a < b.

    Equal signatures are collapsed to their least id first, as ``hash_classes``
    tells. Candidates share a band key, and keys with many signatures are cut
    into blocks that meet pairwise. A pair that meets under several keys counts
    under the first of them only, so no pair has to be looked for among others.
    """
    # the signatures are read several times below and can be costly to make
    reps = written(hashes.where("dhash is not null").groupBy("dhash").agg(F.min("id").alias("id")))
    keyed = reps.select("id", "dhash", F.explode(_keys(F.col("dhash"), t)).alias("key"))
    keyed = _with_blocks(keyed, _heavy(keyed)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = keyed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.col("block").alias("i"), F.col("mate").alias("j"), F.col("id").alias("a"), F.col("dhash").alias("ha"))
    right = keyed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.col("mate").alias("i"), F.col("block").alias("j"), F.col("id").alias("b"), F.col("dhash").alias("hb"))
    distance = E.hamming(F.col("ha"), F.col("hb"))
    met = multiplied(left).join(multiplied(right), ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (distance <= t))
    return met.where(_first_key(F.col("ha"), F.col("hb"), F.col("key.subset"), t)).select("a", "b", distance.alias("distance"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(id, dhash, rep): the least id with the same signature."""
    known = hashes.where("dhash is not null").select("id", "dhash")
    return known.join(known.groupBy("dhash").agg(F.min("id").alias("rep")), "dhash").select("id", "dhash", "rep")


def hamming_search(hashes: DataFrame, probes: DataFrame, t: int) -> DataFrame:
    """(probe_id, id, distance) of all signatures within ``t`` bits of each probe (probe_id, dhash), itself included."""
    keys = hashes.where("dhash is not null").select("id", "dhash", F.explode(_keys(F.col("dhash"), t)).alias("key"))
    asked = probes.where("dhash is not null").select("probe_id", F.col("dhash").alias("wanted"), F.explode(_keys(F.col("dhash"), t)).alias("key"))
    heavy = _heavy(keys)  # a key with many signatures is cut into blocks, and its probes meet each of them
    keys = _with_blocks(keys, heavy).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = _with_blocks(asked, heavy).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    distance = E.hamming(F.col("dhash"), F.col("wanted"))
    met = multiplied(asked).join(multiplied(keys), ["key", "block"]).where((distance <= t) & _first_key(F.col("dhash"), F.col("wanted"), F.col("key.subset"), t))
    return met.select("probe_id", "id", distance.alias("distance"))


def neardup_groups(hashes: DataFrame, t: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Components of two and more assets under links of at most ``t`` bits: (group_id, id, dhash)."""
    hashes = written(hashes.select("id", "dhash"))
    classes = hash_classes(hashes)
    joined = connected_components(hamming_pairs(hashes, t).select("a", "b"))
    named = classes.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("group_id", F.coalesce("component", "rep"))
    several = named.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return named.join(several, "group_id").select("group_id", "id", "dhash")


def grouped_hashes(hashes: DataFrame, t: int = DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, keys) to be kept for ``extend_groups``: members (id, dhash, group_id) with groups of one too, and the band keys (key, id, dhash) of each distinct signature."""
    hashes = written(hashes.where("dhash is not null").select("id", "dhash"))
    classes = hash_classes(hashes)
    joined = connected_components(hamming_pairs(hashes, t).select("a", "b")).select(F.col("id").alias("rep"), "component")
    members = classes.join(joined, "rep", "left").select("id", "dhash", F.coalesce("component", "rep").alias("group_id"))
    return members, band_keys(hashes, t)


def band_keys(hashes: DataFrame, t: int) -> DataFrame:
    """(key, id, dhash) of the least id of each signature."""
    reps = hashes.groupBy("dhash").agg(F.min("id").alias("id"))
    return reps.select(F.explode(_keys(F.col("dhash"), t)).alias("key"), "id", "dhash")


def extend_groups(members: DataFrame, keys: DataFrame, new: DataFrame, t: int = DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, keys) after the signatures ``new`` (id, dhash; ids that are not members yet) have come.

    Only the new signatures look for keys, and among themselves for pairs; the
    old groups are not rebuilt: each is one node, which new links join to others.
    """
    new = written(new.where("dhash is not null").select("id", "dhash"))
    known = members.select("dhash", "group_id").distinct()  # equal signatures have one group
    placed = written(new.join(known, "dhash", "left"))
    fresh = written(placed.where("group_id is null").groupBy("dhash").agg(F.min("id").alias("id")))
    asked = written(band_keys(fresh, t))
    stored = keys.select("key", F.col("id").alias("old"), F.col("dhash").alias("had"))
    near = multiplied(asked).join(multiplied(stored), "key").where((E.hamming(F.col("dhash"), F.col("had")) <= t) & _first_key(F.col("dhash"), F.col("had"), F.col("key.subset"), t))
    near = near.select(F.col("id").alias("a"), "had").join(known.withColumnRenamed("dhash", "had"), "had").select("a", F.col("group_id").alias("b"))
    equal = placed.where("group_id is not null").select(F.col("id").alias("a"), F.col("group_id").alias("b"))  # a lesser id renames its group
    links = near.unionByName(equal).unionByName(hamming_pairs(fresh, t).select("a", "b"))
    joined = written(connected_components(links))
    own = placed.where("group_id is null").join(fresh.select("dhash", F.col("id").alias("rep")), "dhash").select("id", "dhash", F.col("rep").alias("group_id"))
    rows = members.select("id", "dhash", "group_id").unionByName(placed.where("group_id is not null").select("id", "dhash", "group_id")).unionByName(own)
    renamed = rows.join(joined.select(F.col("id").alias("group_id"), "component"), "group_id", "left")
    return renamed.select("id", "dhash", F.coalesce("component", "group_id").alias("group_id")), keys.select("key", "id", "dhash").unionByName(asked)


def with_similarity(items: DataFrame) -> DataFrame:
    """Items (group_id, id, dhash) with 1 - distance / 64 to the signature of the group's least id."""
    first = items.groupBy("group_id").agg(F.min_by("dhash", "id").alias("first"))
    return items.join(first, "group_id").select("group_id", "id", (1 - E.hamming(F.col("dhash"), F.col("first")) / 64).alias("similarity"))


def rebuild_groups(groups: DataFrame, items: DataFrame, new: DataFrame, method: str, threshold: float | None, now: int, suppress_dismissed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, items) with the open groups of ``method`` replaced by ``new`` (group_id, id, similarity); others stay.

    With ``suppress_dismissed`` a set of members that was dismissed does not come back.
    """
    members = lambda df, key, image: df.groupBy(key).agg(F.array_sort(F.collect_list(image)).alias("members"))
    stay = groups.where((F.col("method") != method) | (F.col("status") != "open"))
    kept_items = items.join(stay.select(F.col("id").alias("group_id")), "group_id", "left_semi").select(items.columns)
    if suppress_dismissed:
        dismissed = members(items.join(groups.where("status = 'dismissed'").select(F.col("id").alias("group_id")), "group_id", "left_semi"), "group_id", "image_id").select("members")
        again = members(new, "group_id", "id").join(dismissed, "members", "left_semi").select("group_id")
        new = new.join(again, "group_id", "left_anti")
    ids = numbered(new.select("group_id").distinct(), ["group_id"], greatest(groups), "new_id")
    given = {"id": F.col("new_id"), "method": F.lit(method), "threshold": F.lit(threshold), "status": F.lit("open"), "created_at": F.lit(now)}
    made = ids.select(*(given.get(c, F.lit(None)).cast(groups.schema[c].dataType).alias(c) for c in groups.columns))
    rows = new.join(ids, "group_id").select(F.col("new_id").alias("group_id"), F.col("id").alias("image_id"), "similarity")
    return stay.unionByName(made), kept_items.unionByName(rows)


def find_groups(assets: DataFrame, method: str = "both", t: int = DEFAULT_THRESHOLD) -> DataFrame:
    """(method, group_id, id, similarity) by ``method``: exact, phash or both.

    The digests and signatures are read several times and can be costly to make, so they are written down once.
    """
    needed = {"exact": ["content_hash"], "phash": ["dhash"], "both": ["content_hash", "dhash"]}.get(method, [])
    if needed:
        assets = written(assets.where(E.live()).select("id", "deleted_at", *needed))
    parts = []
    if method in ("exact", "both"):
        parts.append(exact_items(assets).select(F.lit("exact").alias("method"), "group_id", "id", F.lit(1.0).alias("similarity")))
    if method in ("phash", "both"):
        parts.append(with_similarity(neardup_groups(assets, t)).select(F.lit("phash").alias("method"), "group_id", "id", "similarity"))
    if not parts:
        raise ValueError(f"no such method: {method}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pairwise_quality(truth: DataFrame, algo: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over pairs in equal groups of ``truth`` and ``algo`` (id, grp).

    Pairs are counted from the sizes of groups and of their overlaps, never listed.
    """
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long")
    size = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(pairs(F.col("n")).alias("p"))
    both = truth.select("id", F.col("grp").alias("t")).join(algo.select("id", F.col("grp").alias("a")), "id")
    row = size(both, "t", "a").withColumnRenamed("p", "tp").crossJoin(size(truth, "grp").withColumnRenamed("p", "in_truth")).crossJoin(size(algo, "grp").withColumnRenamed("p", "in_algo"))
    share = lambda whole: F.when(F.col(whole) == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col(whole))
    row = row.withColumns({"precision": share("in_algo"), "recall": share("in_truth")})
    total = F.col("precision") + F.col("recall")
    return row.select("tp", (F.col("in_algo") - F.col("tp")).alias("fp"), (F.col("in_truth") - F.col("tp")).alias("fn"), "precision", "recall", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total).alias("f1"))
