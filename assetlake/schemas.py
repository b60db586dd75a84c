"""Explicit schemas of the catalog's tables and the allowed values of their text enumerations."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_L, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
VECTOR = T.ArrayType(T.FloatType(), False)
BOX = _table(x=_D, y=_D, w=_D, h=_D)
ROOTS = _table(id=_L, path=_S, label=_S, type=_S, enabled=_B, last_scan_at=_L, created_at=_L, settings_json=_S)
#: What a listing of files brings for each of them.
LISTED = ("root_id", "rel_path", "filename", "extension", "size_bytes", "mtime")
METADATA = ("width", "height", "orientation", "taken_at", "gps_lat", "gps_lng", "camera_make", "camera_model")
ASSETS = _table(
    id=_L, root_id=_L, rel_path=_S, filename=_S, extension=_S, size_bytes=_L, mtime=_L,
    width=_L, height=_L, orientation=_L, taken_at=_L, gps_lat=_D, gps_lng=_D, camera_make=_S, camera_model=_S,
    thumb_status=_S, thumb_hash=_S, thumb_error=_S, content_hash=_S, phash=_L, dhash=_L, hash_status=_S,
    tag_status=_S, embedding_status=_S, ocr_status=_S, ocr_text=_S, face_status=_S, indexed_at=_L, deleted_at=_L,
)
#: Values of a new or changed asset, per derived column.
FRESH = {
    "thumb_status": "pending", "thumb_hash": None, "thumb_error": None, "content_hash": None, "phash": None, "dhash": None, "hash_status": "pending",
    "tag_status": "pending", "embedding_status": "pending", "ocr_status": "disabled", "ocr_text": None, "face_status": "disabled",
}
GROUPS = _table(id=_L, method=_S, threshold=_D, keep_image_id=_L, status=_S, created_at=_L, resolved_at=_L)
GROUP_ITEMS = _table(group_id=_L, image_id=_L, similarity=_D)
TAGS = _table(id=_L, name=_S, source=_S, category=_S, created_at=_L)
TAG_LINKS = _table(image_id=_L, tag_id=_L, source=_S, score=_D, created_at=_L)
FACES = _table(id=_L, image_id=_L, cluster_id=_L, bbox=BOX, confidence=_D)
UNDO_LOG = _table(id=_L, action=_S, payload_json=_S, can_undo_until=_L, undone_at=_L, created_at=_L)
UNDO_ITEMS = T.StructType([T.StructField("items", T.ArrayType(_table(imageId=_L, originalPath=_S, permanent=_B)))])
ALBUMS = _table(id=_L, name=_S, filter_json=_S, icon=_S, sort_order=_L, created_at=_L)

# Allowed texts per enumeration.
STATUSES = {
    "thumb_status": ("pending", "ready", "failed"),
    "hash_status": ("pending", "ready", "failed"),
    "tag_status": ("pending", "ready", "failed"),
    "embedding_status": ("pending", "ready", "failed"),
    "ocr_status": ("disabled", "pending", "ready", "failed"),
    "face_status": ("disabled", "pending", "ready", "failed"),
}
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "bmp", "tiff", "tif", "gif")
METHODS = ("exact", "phash")
