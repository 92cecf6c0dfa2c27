"""Display records, score labels and score rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinshelf.params import DISPLAY_DESCRIPTION_LENGTH, SEARCH_DESCRIPTION_LENGTH

# Labels of the score bands, for both profiles.
REASONS = {
    "production": (
        (0.7, "Very similar content and themes"),
        (0.5, "Similar themes and writing style"),
        (0.3, "Shared categories and topics"),
    ),
    "simple": (
        (0.7, "Very similar content and themes"),
        (0.5, "Similar themes and style"),
        (0.3, "Shared categories and topics"),
    ),
}
REASON_OTHERWISE = "Related content"

ESSENTIAL = ["id", "title", "authors", "similarity_score", "reason"]
RECORD = ["id", "title", "slug", "cover_local_path", "authors", "categories",
          "description", "rating", "rating_count"]


def ellipsis(text: Column, length: int, always: bool) -> Column:
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return cut if always else F.when(F.length(text) > length, cut).otherwise(text)


def reason(score: Column, profile: str = "production") -> Column:
    label = F.lit(REASON_OTHERWISE)
    for bound, text in reversed(REASONS[profile]):
        label = F.when(score > bound, text).otherwise(label)
    return label


def shown_score(score: Column) -> Column:
    return F.round(score, 3)


def display(catalogue: DataFrame, profile: str = "production") -> DataFrame:
    """Nine-field record with the defaults for missing values.

    The simple profile always appends the ellipsis.
    """
    return _record(catalogue, DISPLAY_DESCRIPTION_LENGTH, always=profile == "simple")


def search_record(catalogue: DataFrame) -> DataFrame:
    return _record(catalogue, SEARCH_DESCRIPTION_LENGTH, always=True)


def _record(catalogue: DataFrame, length: int, always: bool) -> DataFrame:
    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value))

    return catalogue.select(
        "id",
        "title",
        default("slug", "").alias("slug"),
        default("cover_local_path", "").alias("cover_local_path"),
        default("authors", "Unknown").alias("authors"),
        default("categories", "General").alias("categories"),
        ellipsis(F.col("description"), length, always).alias("description"),
        default("average_rating", 0.0).alias("rating"),
        F.coalesce(F.col("rating_count"), F.lit(0).cast("bigint")).alias("rating_count"),
    )
