import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from locusframe.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


RECORD_DDL = (
    "row_id long, gene_symbol string, gene_id string, gene_type string, qtl_chr string, "
    "qtl_pos double, qtl_ci_lo double, qtl_ci_hi double, qtl_lod double, qtl_pval double, cis boolean"
)


@pytest.fixture(scope="session")
def make_records(spark):
    """Records from dicts of the columns that matter to a test."""
    names = [part.split()[0] for part in RECORD_DDL.split(", ")]

    def make(rows):
        full = [{"row_id": i, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([[r.get(n) for n in names] for r in full], RECORD_DDL)

    return make
