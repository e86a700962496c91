"""Output formats hold every listing; order statistics against sorts."""

import json
import random

from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.operators import output, resolve, sample

from .conftest import listings


def rows(n):
    return [{"source": "large" if i % 3 else "small", "source_id": str(i), "url": f"https://example.com/{i}", "title": f"role {i}", "company": "A|B\nC", "found_on": [], "description_snippet": "Useful details.", "language": ["english"], "date_posted": f"2026-07-{1 + i % 20:02d}", "wage": {"min": 1, "max": 2, "unit": "monthly", "raw": "1-2"} if i % 2 else {"min": None, "max": None, "unit": None, "raw": ""}} for i in range(n)]


def test_every_listing_is_written(spark, tmp_path):
    df = resolve.numbered(listings(spark, *rows(120)))
    stats = {"scanned_at": "2026-07-23", "total": 120, "sources": 2, "raw_total": 130, "filtered": 10, "merged": 0}
    text = output.format_rows(df, "markdown", stats)
    lines = [x for x in text.splitlines() if x.startswith("| ") and "| # |" not in x]
    assert len(lines) == 120 and [int(x.split("|")[1]) for x in lines] == list(range(1, 121))
    assert "130 read, 10 filtered out" in text and "A\\|B C" in lines[0] and "| 1-2 |" in text and "| — |" in text
    table = output.format_rows(df, "table", stats)
    assert table.count("https://example.com/") == 120 and table.startswith("120 listings")
    loaded = json.loads(output.format_rows(df, "json", stats))
    assert len(loaded) == 120 and [r["_ord"] for r in loaded] == list(range(120)) and loaded[0]["city"] is None
    assert json.loads(output.format_rows(df.limit(0), "json")) == []
    output.write_lines(df, "markdown", str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 120


def test_command_line_writes_all(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    listings(spark, *rows(1000)).write.parquet(path)
    for name in ("json", "markdown", "table", "llm"):
        out = tmp_path / name
        assert cli.main(["scan", path, "--as-of", "2026-07-23", "--days", "60", "--no-dedup", "--format", name, "--output", str(out)]) == 0
        text = out.read_text()
        if name == "json":
            assert len(json.loads(text)) == 1000
        elif name == "llm":
            assert text.startswith("# 50 of 1000 listings") and "... 950 more" in text
        else:
            assert text.count("https://example.com/") == 1000


def test_briefing_is_balanced_and_has_what_a_ranker_needs(spark):
    df = listings(spark, *({"source": s, "source_id": str(i), "title": f"{s} role {i}", "company": "Example", "description_snippet": "Useful role details.", "language": ["english"], "url": f"u/{s}/{i}"} for s, i in (("large", 1), ("large", 2), ("large", 3), ("small", 1), ("small", 2))))
    text = output.briefing(df, {"total": 5, "names": ["large", "small"]}, 4)
    titles = [x for x in text.splitlines() if x.startswith("[")]
    assert ["large role 1" in titles[0], "small role 1" in titles[1], len(titles)] == [True, True, 4]
    assert "Useful role details." in text and "Languages: english" in text and "... 1 more" in text


def test_ranks_of_skewed_groups(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([None, *range(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, k int").repartition(7)
    got = sample.ranked(df, ["v", "k"], ["g"]).collect()
    for g in ("hot", "a", "b", None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [x["k"] for x in sorted((x for x in got if x["g"] == g), key=lambda x: x["_rank"])] == [x[2] for x in own]
        assert {x["_total"] for x in got if x["g"] == g} == {len(own)}
    assert sorted(x["_rank"] for x in sample.ranked(df, ["v"]).collect()) == list(range(3000))
    assert sample.ranked(df.limit(0), ["v"], ["g"]).count() == 0
    median = {x["g"]: x["value"] for x in sample.quantiles(df, "v", [0.5], ["g"]).collect()}
    for g in ("hot", "a", "b", None):
        own = sorted(x[1] for x in data if x[0] == g and x[1] is not None)
        assert median[g] == own[(len(own) - 1) // 2]


def test_stride_of_every_size(spark):
    sizes = [*range(1, 26), 39, 40, 41, 100, 777]
    df = spark.createDataFrame([(str(n), i) for n in sizes for i in range(n)], "source string, _ord int")
    for per in (1, 2, 7, 20):
        got = {}
        for x in sample.stride_sample(df, per).collect():
            got.setdefault(int(x["source"]), set()).add(x["_ord"])
        want = {n: {0} if per == 1 else set(range(n)) if n <= per else {round(p * (n - 1) / (per - 1)) for p in range(per)} for n in sizes}
        assert got == want


def test_no_window_holds_a_source(spark):
    """Rows meet in tasks by range, and the balanced sample is cut before its shuffle."""
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("_ord"))
    plan = sample.balanced_sample(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
    assert "Window [" not in sample.ranked(df, ["_ord"], ["source"]).select("_ord")._jdf.queryExecution().executedPlan().toString().split("Join")[0]
