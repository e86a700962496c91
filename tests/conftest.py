import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("wh"))).config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def job(**values):
    """A listing with everything at its default but what is given."""
    row = {
        "id": None, "source": "green", "source_id": "1", "url": "http://x", "found_on": [], "title": "", "company": "", "description": "", "description_snippet": "", "workplace": "", "prefecture": None,
        "prefecture_name": None, "city": None, "remote": None, "wage": {"min": None, "max": None, "unit": None, "raw": ""}, "employment_type": None, "date_posted": None, "language": [], "matched_keyword": None,
        "scraped_at": None, "source_urls": {}, "source_ids": {}, "detail_status": None, "quality_flags": [], "first_seen_at": None, "last_seen_at": None, "_ord": 0,
    }
    return {**row, **values}


def listings(spark, *rows):
    from lodestrata.functions.schema import LISTING

    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(LISTING)
    data = [tuple(Row(**job(**{"_ord": i, **r})["wage"]) if f == "wage" else job(**{"_ord": i, **r})[f] for f in schema.names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)
