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


#: Documents with every odd case: null, empty, repeated rows, ties, a long text, columns of clashing names.
def odd_docs(spark, words=None):
    import random

    r = random.Random(3)
    words = words or ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(120)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
        if i % 3 == 0:
            rows.append((100 + i, t.upper()))  # a copy but for case
        if i % 4 == 0:
            w = t.split()
            w[30] = "changed"
            rows.append((200 + i, " ".join(w)))  # a near copy
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "one two"), (None, "no id here at all but text"), (305, text(3000)), (306, "é ü ß 日本 😀 " * 5), (7, base[7]), (307, "x" * 500), (308, "12 34 56")]
    return spark.createDataFrame([(a, b, "en", "s", 1, 2, "k") for a, b in rows], "doc_id long, text string, lang string, source string, node long, h long, key string")
