"""Faces: replacement, clustering by cosine similarity, and clusters' labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as E
from . import lists
from .graph import connected_components, written
from .numbering import greatest, numbered

THRESHOLD = 0.82


def replace_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """``faces`` with all faces of the images of ``new`` (image_id, bbox_json, confidence) replaced by it, unclustered."""
    kept = faces.join(new.select("image_id").distinct(), "image_id", "left_anti").select(faces.columns)
    box = F.from_json("bbox_json", schemas.BOX)
    fresh = numbered(new, ["image_id", F.desc("confidence"), "bbox_json"], greatest(faces))
    given = {
        "id": F.col("id"),
        "image_id": F.col("image_id"),
        "bbox": F.struct(*(F.coalesce(box[c], F.lit(0.0)).alias(c) for c in "xywh")),
        "confidence": E.clamp(F.col("confidence"), 0.0, 1.0),
    }
    return kept.unionByName(fresh.select(*(given.get(c, F.lit(None)).cast(faces.schema[c].dataType).alias(c) for c in faces.columns)))


def _unit(vectors: DataFrame) -> DataFrame:
    """(id, vector) of the usable vectors (id, embedding), of length 1."""
    return vectors.where((F.size("embedding") > 0) & (E.norm(F.col("embedding")) > 1e-12)).select("id", E.l2_normalise(F.col("embedding")).alias("vector"))


#: Links that a task holds before it puts them together.
_MOST_LINKS = 1 << 20


def _met(unit: DataFrame, threshold: float, forest: bool) -> DataFrame | None:
    """What the shelves of ``unit`` (id, vector) hold: all pairs at the threshold, or a spanning forest of them; none without vectors.

    A vector visits its own shelf and the later ones with lists whose members it
    can reach: vectors at a cosine of t are sqrt(2 - 2t) apart.
    """
    unit = written(unit)
    points = lists.pivots(unit)
    if not len(points):
        return None
    members = written(lists.dealt(unit, points))
    known = lists.shelved(lists.list_sizes(members).orderBy("list").toPandas(), points)
    members = lists.on_shelves(members, known)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + lists.SLACK
    radius = known["radius"].to_numpy()

    def compare(block: pd.DataFrame, own: np.ndarray, probes: pd.DataFrame, asked: np.ndarray, tiles) -> pd.DataFrame:
        ids, others = block["id"].to_numpy(), probes["id"].to_numpy()
        same = (probes["home"] == block["shelf"].iloc[0]).to_numpy()
        short, wanted = own.astype(np.float32), asked.astype(np.float32)
        room = (own.shape[1] + 8) * 2.0**-22  # of a product of unit vectors in single precision
        parts, n = [], 0
        for held, place in tiles:
            products = short[held] @ wanted[place].T
            if products.max() < threshold - room:
                continue
            hits = np.flatnonzero(products >= np.float32(threshold - room))
            near = products.ravel()[hits] < threshold + room
            i, j = np.divmod(hits, len(place))
            i, j = held[i], place[j]
            kept = ~same[j] | (ids[i] < others[j])
            i, j, near = i[kept], j[kept], near[kept]
            for at in range(0, len(i), lists.ROWS * 16):
                a, b, unsure = (x[at : at + lists.ROWS * 16] for x in (i, j, near))
                exact = np.full(len(a), np.inf)
                looked = unsure if forest else np.ones(len(a), bool)
                exact[looked] = (own[a[looked]] * asked[b[looked]]).sum(1)
                good = exact >= threshold - 1e-12
                parts.append((ids[a[good]], others[b[good]]) if forest else (ids[a[good]], others[b[good]], exact[good]))
                n += int(good.sum())
                if forest and n > _MOST_LINKS:
                    parts = [_forest(parts)]
                    n = len(parts[0][0])
        if forest:
            a, b = _forest(parts)
            return pd.DataFrame({"a": a, "b": b})
        a, b, similarity = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similarity})

    probes = members.select("id", "vector", F.col("shelf").alias("home"))
    return lists.compared(members, points, known, probes, "id", lambda rows, far: far - radius[None, :] <= reach, compare, _LINKS if forest else _PAIRS, "home")


_PAIRS, _LINKS = "a long, b long, similarity double", "a long, b long"


def _forest(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One spanning forest of links in parts (a, b)."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _spanning(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) do, each to the least node of its part."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        low = low[low]
        if (low == label).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[label[moved]], nodes[moved]
        label = low


def cosine_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) with a < b of all vectors (id, embedding) at or over ``threshold``; exact, and as many rows as there are such pairs."""
    found = _met(_unit(vectors), threshold, False)
    return vectors.sparkSession.createDataFrame([], _PAIRS) if found is None else found


def cosine_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with the same components as ``cosine_pairs``: equal vectors are one, and a shelf and a part of its visitors give a spanning forest, so dense groups stay small."""
    unit = written(_unit(vectors))
    classes = written(unit.groupBy("vector").agg(F.min("id").alias("id")))
    equal = unit.join(classes.withColumnRenamed("id", "b"), "vector").where("id != b").select(F.col("id").alias("a"), "b")
    found = _met(classes.select("id", "vector"), threshold, True)
    return equal if found is None else equal.unionByName(found.select("a", "b"))


def cluster_faces(faces: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(faces with cluster_id, clusters) from the components of similar vectors (face_id, embedding).

    A cluster is named by its least face; faces without a usable vector are
    clusters of their own; vectors of faces that are gone don't count. A cluster
    takes the label, of those in ``prior`` (id, label), that its least labelled
    face had; its sample is its least face's image.
    """
    own = vectors.join(faces.select(F.col("id").alias("face_id")), "face_id", "left_semi").select(F.col("face_id").alias("id"), "embedding")
    joined = connected_components(cosine_links(own, threshold))
    named = faces.join(joined, "id", "left").withColumn("new_cluster", F.coalesce("component", "id"))
    if prior is not None:
        old = prior.where("label is not null").select(F.col("id").alias("cluster_id"), F.col("label").alias("old_label"))
        named = named.join(old, "cluster_id", "left")
    else:
        named = named.withColumn("old_label", F.lit(None).cast("string"))
    labelled = F.when(F.col("old_label").isNotNull(), F.col("id"))
    clusters = named.groupBy(F.col("new_cluster").alias("id")).agg(F.min_by("old_label", labelled).alias("label"), F.min_by("image_id", "id").alias("sample_image_id"), F.count(F.lit(1)).alias("face_count"))
    return named.withColumn("cluster_id", F.col("new_cluster")).select(faces.columns), clusters


def refresh_clusters(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with their present numbers of faces, and the image of the surest face as sample."""
    now = faces.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max_by("image_id", F.struct("confidence", -F.col("id"))).alias("sample"))
    joined = clusters.join(now, "id", "left")
    value = {"face_count": F.coalesce("n", F.lit(0)), "sample_image_id": F.col("sample")}
    return joined.select(*(value.get(c, F.col(c)).alias(c) for c in clusters.columns))


def merge_clusters(faces: DataFrame, clusters: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(faces, clusters) with the source's faces in the target and the source gone."""
    moved = faces.withColumn("cluster_id", F.when(F.col("cluster_id") == source, F.lit(target).cast("long")).otherwise(F.col("cluster_id")))
    return moved, refresh_clusters(moved, clusters.where(F.col("id") != source))


def rename_cluster(clusters: DataFrame, cluster_id: int, label: str | None) -> DataFrame:
    """The label is trimmed; a blank one is none."""
    clean = (label or "").strip() or None
    return clusters.withColumn("label", F.when(F.col("id") == cluster_id, F.lit(clean)).otherwise(F.col("label")))


def list_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters with faces: labelled ones first, then by size."""
    return clusters.where("face_count > 0").orderBy(F.col("label").isNull(), F.desc("face_count"), "id")


def faces_of_images(faces: DataFrame) -> DataFrame:
    """Faces with their rank in the image: by confidence, then id."""
    return faces.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("confidence"), "id")))


def images_of_cluster(assets: DataFrame, faces: DataFrame, cluster_id: int) -> DataFrame:
    """Live images of a cluster, newest first, each once."""
    held = faces.where(F.col("cluster_id") == cluster_id).select(F.col("image_id").alias("id"))
    return assets.where(E.live()).join(held, "id", "left_semi").orderBy(F.desc("mtime"), F.desc("id"))


def images_per_cluster(assets: DataFrame, faces: DataFrame) -> DataFrame:
    """(cluster_id, images): distinct live images of every cluster."""
    live = assets.where(E.live()).select(F.col("id").alias("image_id"))
    return faces.where("cluster_id is not null").join(live, "image_id", "left_semi").groupBy("cluster_id").agg(F.countDistinct("image_id").alias("images"))
