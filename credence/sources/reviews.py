"""Expert-reviewed news: review list, article files, optional engagement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.schema import ORDER
from credence.sources import paths
from credence.sources.standard import standardize

# ---- fixed values -----------------------------------------------------------
SUBSETS = ("HealthStory", "HealthRelease")
FAKE_BELOW = 3
REVIEW_SCHEMA = "news_id string, rating string, news_source string, source string"
CONTENT_SCHEMA = "title string, text string"
ENGAGEMENT_SCHEMA = "tweets array<string>, replies array<string>, retweets array<string>"
# -----------------------------------------------------------------------------


def assemble_reviews(
    reviews: DataFrame,
    content: DataFrame,
    engagement: DataFrame | None,
    *,
    dataset="fakehealth",
    fake_below=FAKE_BELOW,
    has_network=False,
) -> DataFrame:
    """Reviews inner-joined to articles, left-joined to engagement counts.

    All three are keyed by ``(subset, news_id)``. ``reviews`` carries the order
    column; ``engagement`` carries the three counts. A review without an article
    is left out; an article without engagement keeps null counts.
    """
    key = ["subset", "news_id"]
    joined = reviews.join(content, key, "inner")
    if engagement is not None:
        joined = joined.join(engagement, key, "left")
    rating = F.col("rating").try_cast("double")
    blank_to_null = F.when(F.col("news_source") != "", F.col("news_source"))
    return standardize(
        joined.withColumns(
            {
                "id": F.concat_ws("_", F.lit(dataset), "subset", "news_id"),
                "dataset": F.lit(dataset),
                "label": (rating < fake_below).cast("int"),
                "label_raw": F.col("rating").cast("string"),
                "source": F.coalesce(blank_to_null, F.col("source")),
                "has_network": F.lit(has_network),
            }
        )
    )


def load_fakehealth(
    root, subsets=SUBSETS, fake_below=FAKE_BELOW, *, spark: SparkSession | None = None
) -> DataFrame:
    """``reviews/<subset>.json``, ``content/<subset>/<id>.json``,
    ``engagements/<subset>/<id>.json`` (optional), ``user_network/`` (optional)."""
    spark = spark or SparkSession.active()
    root = str(root)
    nested = paths.join(root, "dataset")
    if paths.exists(spark, nested):
        root = nested
    engagement_root = next(
        (
            p
            for p in (paths.join(root, d) for d in ("engagements", "engagement"))
            if paths.exists(spark, p)
        ),
        None,
    )

    found = []
    for subset in subsets:
        review_file = paths.join(root, "reviews", f"{subset}.json")
        content_dir = paths.join(root, "content", subset)
        if paths.exists(spark, review_file) and paths.exists(spark, content_dir):
            found.append(subset)
        else:
            print(f"[fakehealth] {subset} left out: needs {review_file} and {content_dir}")
    if not found:
        raise FileNotFoundError(f"no review corpus under {root}")

    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    json = spark.read.option("multiLine", True)

    part = F.array_position(F.array(*map(F.lit, found)), stem)
    reviews = (
        json.schema(REVIEW_SCHEMA)
        .json([paths.join(root, "reviews", f"{s}.json") for s in found])
        .select(
            "*",
            stem.alias("subset"),
            F.struct(
                part.cast("int").alias("part"),
                F.lit("").alias("file"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(ORDER),
        )
    )
    content = json.schema(CONTENT_SCHEMA).json(
        [paths.join(root, "content", s) for s in found]
    ).select("title", "text", folder.alias("subset"), stem.alias("news_id"))

    engagement = None
    if engagement_root:
        dirs = [paths.join(engagement_root, s) for s in found]
        dirs = [d for d in dirs if paths.exists(spark, d)]
        if dirs:
            counts = {
                f"n_{c}": F.coalesce(F.size(c), F.lit(0)).cast("double")
                for c in ("tweets", "replies", "retweets")
            }
            engagement = json.schema(ENGAGEMENT_SCHEMA).json(dirs).select(
                folder.alias("subset"),
                stem.alias("news_id"),
                *[v.alias(k) for k, v in counts.items()],
            )
    return assemble_reviews(
        reviews,
        content,
        engagement,
        fake_below=fake_below,
        has_network=paths.exists(spark, paths.join(root, "user_network")),
    )
