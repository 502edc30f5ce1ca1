"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "scores": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(fields: str) -> T.StructType:
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CORPUS = _struct("text string, label string, extra string")
FEEDBACK = _struct(
    "ts timestamp, id string, text string, label string, offensive_score double, model_label string, action string"
)
INCOMING = _struct(
    "id string, seq long, ts timestamp, room string, text string, client_id string, username string, "
    "is_audio boolean, guard_on boolean"
)
MESSAGE = _struct(
    "id string, text string, client_id string, username string, timestamp string, date timestamp, "
    "revealed boolean, reported boolean, is_audio boolean, "
    "label string, label_display string, offensive_score double, safe_score double, "
    "is_offensive boolean, bucket string, all_scores scores, transliterated string, "
    "user_classification string"
)
RULES = _struct("stage int, ord int, pattern string, replacement string")
LEXICON = _struct("term string, pos int")
