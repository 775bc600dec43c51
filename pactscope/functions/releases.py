"""Release tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEASE = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([^-]*))?$"


def parse_release(tag: Column) -> Column:
    """Struct of major, minor, patch and prerelease text; null for other texts."""
    major, minor, patch = (F.regexp_extract(tag, RELEASE, i).try_cast("bigint") for i in (1, 2, 3))
    parsed = F.struct(
        major.alias("major"),
        minor.alias("minor"),
        patch.alias("patch"),
        F.regexp_extract(tag, RELEASE, 4).alias("pre"),
    )
    return F.when(major.isNotNull() & minor.isNotNull() & patch.isNotNull(), parsed)


def release_order(release: Column) -> Column:
    """Sort key of a parsed release: a prerelease comes before its release."""
    return F.when(
        release.isNotNull(),
        F.struct(release.major, release.minor, release.patch, (release.pre == "").alias("final"), release.pre),
    )
