"""Releases of services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.functions.releases import parse_release, release_order

NO_RELEASE = "v0.0.0"


def latest_release(tags: DataFrame) -> DataFrame:
    """The highest release of each ``service, branch``.

    A branch ``stable-X.Y`` prefers releases of X.Y. Both rules are one sort key, so this is a single
    aggregation.
    """
    tag, branch = F.col("tag"), F.col("branch")
    release = parse_release(tag)
    line = F.concat(F.lit("v"), F.try_element_at(F.split(branch, "-"), F.lit(2)))
    after = F.substr(tag, F.length(line) + 1, F.lit(1))
    on_line = branch.startswith("stable-") & tag.startswith(line) & after.isin("", ".", "-")
    usable = tag.startswith("v") & release.isNotNull()
    order = F.when(
        usable, F.struct(F.coalesce(on_line, F.lit(False)).alias("on_line"), release_order(release).alias("release"))
    )
    return tags.groupBy("service", "branch").agg(
        F.coalesce(F.max_by("tag", order), F.lit(NO_RELEASE)).alias("tag")
    )


def unparsable_releases(tags: DataFrame) -> DataFrame:
    """Version tags that are no releases."""
    return tags.where(F.col("tag").startswith("v") & parse_release(F.col("tag")).isNull())


def rank_releases(tags: DataFrame) -> DataFrame:
    """Parsed releases, sorted by service and release."""
    release = F.col("release")
    return (
        tags.withColumn("release", parse_release(F.col("tag")))
        .where(F.col("tag").startswith("v") & release.isNotNull())
        .orderBy("service", release_order(release))
        .select("service", "branch", "tag", "release.*")
    )
