"""Session settings that the jobs of this package profit from."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Text assembly compiles to long methods. HotSpot never compiles methods above 8,000
    # bytes, so such stages run faster as separate, shorter methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply the settings to a running session.

    `folder` is for intermediate tables, and must be shared by all executors; it is taken where
    the session names none in `spark.checkpoint.dir`.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if folder is not None and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark
