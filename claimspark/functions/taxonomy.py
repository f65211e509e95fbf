"""Constant tables: domains and their topics, sentiments, column names of review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the 2014 review files and their names here.
REVIEW_COLUMNS = {
    "overall": "rating",
    "unixReviewTime": "timestamp",
    "reviewText": "review",
    "reviewerName": "user_name",
    "reviewerID": "user_id",
    "asin": "item_id",
    "summary": "review_title",
}
SENTIMENTS = ("positive", "negative", "neutral")
#: The accepted topics of each domain. Repairs of other topics are given as tables.
TOPICS = {
    "Toys": ("age", "assembly", "battery", "durability", "educational", "engagement", "functionality", "materials", "price", "safety"),
    "Clothes": ("appearance", "care", "comfort", "construction", "functionality", "fit", "material", "price", "service", "shipping"),
    "Beauty": ("color", "compatibility", "efficacy", "ingredients", "longevity", "packaging", "price", "scent", "service", "texture"),
    "Sports": ("comfort", "durability", "fit", "material", "performance", "portability", "price", "safety", "service", "usability"),
    "Cell": ("battery", "camera", "display", "durability", "performance", "price", "service", "software", "specs", "usability"),
}


def topics(spark: SparkSession, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """domain, topic, topic_id (place in alphabetical order)."""
    rows = [(d, t, i) for d, ts in (domains or TOPICS).items() for i, t in enumerate(sorted(ts))]
    return spark.createDataFrame(rows, "domain string, topic string, topic_id int")
