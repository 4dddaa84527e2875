"""The canonical decision row."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _M = StringType(), MapType(StringType(), StringType())
OPTION = _struct(key=_S, text=_S)
ASSET = _struct(kind=_S, path=_S, sha256=_S, source_member=_S)
SOURCE = _struct(repo=_S, revision=_S, row=_S, group=_S, original_split=_S, attrs=_M)
MEDIA = _struct(kind=_S, path=_S, sha256=_S, duration_seconds=DoubleType(), assets=ArrayType(ASSET), attrs=_M)
QUESTION = _struct(type=_S, instructions=_S, options=ArrayType(OPTION))
GOLD = _struct(key=_S, provenance=_S)
DECISION = _struct(id=_S, split=_S, modality=_S, task_family=_S, source=SOURCE, media=MEDIA, state=_S, question=QUESTION, gold=GOLD, label_quality=_S, usage=_S, content_sha256=_S, group_sha256=_S, constituent_ids=ArrayType(_S), extra=_M)

#: Fixed values.
MODALITIES = ["text", "image", "image_sequence", "video"]
QUESTION_TYPES = ["choice", "noul", "score"]
