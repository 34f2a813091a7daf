"""Image index from a listing of paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.columns import uniform
from surety.plans.joins import attach_groups
from surety.plans.sketch import first_rows

# Image suffixes and index columns.
SUFFIXES = (".png", ".jpg", ".jpeg", ".JPG", ".PNG", ".bmp")
COLUMNS = ["category", "split", "defect_type", "path", "label", "mask_path", "image_id"]
GOOD = "good"


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths under a root through the binary-file source; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path"))


def _parts(paths: DataFrame) -> DataFrame:
    """Split ``.../<category>/<split>/<folder>/<file>`` into columns."""
    piece = F.split("path", "/")
    return paths.select(
        "path", F.element_at(piece, -4).alias("category"), F.element_at(piece, -3).alias("split"),
        F.element_at(piece, -2).alias("defect_type"),
        F.regexp_replace(F.element_at(piece, -1), r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("suffix"))


def available_categories(paths: DataFrame) -> DataFrame:
    """Categories that have a test split."""
    return _parts(paths).where(F.col("split") == "test").select("category").distinct().orderBy(
        "category")


def mask_table(masks: DataFrame) -> DataFrame:
    """Mask files keyed by category, defect type and the image stem they belong to.

    ``<stem>_mask.png`` comes first, then ``<stem>.png``, then ``<stem>_mask`` with the image's
    own suffix.
    """
    m = _parts(masks).where(F.col("split") == "ground_truth")
    masked = F.col("stem").endswith("_mask")
    own = F.regexp_replace("stem", "_mask$", "")
    as_mask = m.where(masked).select(
        "category", "defect_type", own.alias("stem"), F.col("path").alias("mask_path"),
        F.col("suffix").alias("mask_suffix"),
        F.when(F.col("suffix") == ".png", 0).otherwise(2).alias("priority"))
    as_plain = m.where(F.col("suffix") == ".png").select(
        "category", "defect_type", "stem", F.col("path").alias("mask_path"),
        F.col("suffix").alias("mask_suffix"), F.lit(1).alias("priority"))
    return as_mask.unionByName(as_plain)


def attach_masks(index: DataFrame, masks: DataFrame) -> DataFrame:
    """The preferred existing mask of each image; none for good images."""
    keys = ["category", "defect_type", "stem"]
    wanted = index.where(F.col("defect_type") != GOOD).select(*keys, "suffix", "image_id")
    fits = (F.col("priority") < 2) | (F.col("mask_suffix") == F.col("suffix"))
    found = wanted.join(mask_table(masks), keys).where(fits).groupBy("image_id").agg(
        F.min_by("mask_path", "priority").alias("mask_path"))
    return index.join(found, "image_id", "left").withColumn(
        "mask_path", F.coalesce("mask_path", F.lit("")))


def take_per_folder(index: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """A seeded draw of at most ``n`` images from each folder; all of them without ``n``."""
    if n is None:
        return index
    keys = ["category", "split", "defect_type"]
    drawn = index.withColumn("_u", uniform(seed, *keys, "image_id"))
    return first_rows(drawn, keys, ["_u", "image_id"], n).drop("_u")


def build_index(paths: DataFrame, masks: DataFrame | None = None,
                categories: Sequence[str] | None = None,
                splits: Sequence[str] = ("train", "test"), test_per_folder: int | None = None,
                other_per_folder: int | None = None, seed: int = 42) -> DataFrame:
    """The image index, with at most so many images per folder of the test and of other splits.

    A requested category without a test split raises, and so does an empty index.
    """
    images = _parts(paths).where(F.col("suffix").isin(*SUFFIXES) & F.col("split").isin(
        *splits))
    if categories is not None:
        present = {r["category"] for r in available_categories(paths).where(
            F.col("category").isin(*categories)).collect()}    # at most the names asked for
        missing = sorted(set(categories) - present)
        if missing:
            raise FileNotFoundError(f"categories missing: {missing}")
        images = images.where(F.col("category").isin(*categories))
    else:
        images = attach_groups(images, available_categories(paths), ["category"], "left_semi")
    if not images.limit(1).count():
        raise RuntimeError("the index is empty")
    index = images.withColumns({
        "label": F.when(F.col("defect_type") == GOOD, 0).otherwise(1),
        "image_id": F.concat_ws("/", "category", "split", "defect_type", "stem")})
    is_test = F.col("split") == "test"
    index = take_per_folder(index.where(is_test), test_per_folder, seed).unionByName(
        take_per_folder(index.where(~is_test), other_per_folder, seed))
    if masks is None:
        index = index.withColumn("mask_path", F.lit(""))
    else:
        index = attach_masks(index, masks)
    return index.select(*COLUMNS)


def synthetic_pool(index: DataFrame, n: int, group: str = "category",
                   row: str = "image_id") -> DataFrame:
    """The first ``2n`` rows of each group, every second one marked for synthesis."""
    return (first_rows(index, [group], [row], 2 * n, "_r")
            .withColumns({"synthetic_anomaly": ((F.col("_r") - 1) % 2).cast("int"),
                          "split": F.lit("synthetic")}).drop("_r"))


def merge_flag(records: DataFrame, pool: DataFrame, row: str = "image_id") -> DataFrame:
    """Put the synthetic flag back on scored records."""
    return records.join(pool.select(row, "synthetic_anomaly"), row)
