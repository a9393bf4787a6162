"""Messages with attachments and files of images, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of file that are read as images.
IMAGE_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/webp", "image/gif")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif")


def is_image(content_type: Column, filename: Column) -> Column:
    """By the content type before any parameter; where there is none, by the extension of the name."""
    kind = F.trim(F.substring_index(content_type, ";", 1))
    extension = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    by_name = F.coalesce(extension.isin(*IMAGE_EXTENSIONS), F.lit(False))
    return F.when(F.coalesce(content_type, F.lit("")) == "", by_name).otherwise(kind.isin(*IMAGE_TYPES))


def image_messages(messages: DataFrame) -> DataFrame:
    """Messages (message_id, created_at, attachments: array<struct<content_type, filename>>) with an image, the oldest first."""
    kept = messages.where(F.exists(F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType)), lambda a: is_image(a["content_type"], a["filename"])))
    return kept.orderBy("created_at", "message_id")


def page_before(messages: DataFrame, before: int | None = None, n: int = 100) -> DataFrame:
    """The `n` newest messages, by id, before a cursor: the last id of the page before."""
    own = messages if before is None else messages.where(F.col("message_id") < before)
    return own.orderBy(F.desc("message_id")).limit(n)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of images below a path: path, modified_at, length and file_hash (sha256 of the bytes, lowercase hex)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(is_image(F.lit(None).cast("string"), name)).select("path", F.col("modificationTime").alias("modified_at"), "length", file_hash(F.col("content")).alias("file_hash"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


#: The events that are known from the start.
EVENT_TYPES = (
    ("polar_invasion", "Polar Invasion", ["polar invasion", "invasion polaire"]),
    ("elite_wars", "Elite Wars", ["elite wars"]),
    ("wasteland_showdown", "Wasteland Showdown", ["wasteland showdown"]),
    ("battle_frenzy", "Battle Frenzy", ["battle frenzy"]),
    ("void_war", "Void War", ["void war"]),
    ("ironblood_battlefield", "Ironblood Battlefield", ["ironblood battlefield"]),
)


def seed_event_types(spark: SparkSession, present: DataFrame | None = None) -> DataFrame:
    """Event types (code, display_name, layout_version, title_aliases) with the known ones; those win over present rows."""
    kind = "code string, display_name string, layout_version string, title_aliases array<string>"
    seed = spark.createDataFrame([(code, name, "v1", list(titles)) for code, name, titles in EVENT_TYPES], kind)
    return seed if present is None else present.join(F.broadcast(seed.select("code")), "code", "left_anti").unionByName(seed)
