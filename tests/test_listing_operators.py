from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geo, text
from lodestrata.operators import coverage, delta, enrich, filtering, output, quality, resolve, sample
from lodestrata.operators.normalize import normalize_listings
from lodestrata.sources import catalog

from .conftest import listings


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1).orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    day = "2026-07-23"
    good = [day, "2026-07-23T04:00:00Z", "2026-07-23T23:30:00-09:00", "July 23, 2026", "jul 23, 2026", "2026/7/23", "2026年7月23日", "20260723", " 2026-07-23 ", "2026-7-23"]
    assert column(spark, good, text.normalize_date) == [day] * len(good)
    assert column(spark, ["2026-07", "2026", "soon", "", None, "2026-13-01", "July 32, 2026"], text.normalize_date) == [None] * 7


def test_text(spark):
    assert column(spark, ["  Backend　 Engineer \n", None, "ＡＢＣ"], text.clean_text) == ["Backend Engineer", "", "ABC"]
    a, b = column(spark, ["株式会社 ＫＯＭＯＤＯ", "KOMODO Inc."], text.canonical_text)
    assert a == b == "komodo"
    assert column(spark, ["C++", "Straße Co., Ltd.", "incubator"], text.canonical_text) == ["c", "strasse", "incubator"]
    assert column(spark, ["incubator"], text.analysis_text) == ["ubator"]
    assert column(spark, ["Name | a tagline", "Name | abc"], text.normalize_company) == ["Name", "Name | abc"]
    assert column(spark, ["Part time contract", "international", "正社員", "x"], text.infer_employment) == ["parttime", "intern", "fulltime", None]
    assert column(spark, ["Englisch", "Bilingual, English", "N2 レベル", "python3"], text.infer_languages) == [[], ["bilingual", "english"], ["japanese"], ["japanese"]]
    as_of = F.lit("2026-07-23").cast("date")
    assert column(spark, ["4 days ago", "2 hours ago", "1 month ago", "?"], lambda c: text.relative_date(c, as_of)) == ["2026-07-19", "2026-07-23", "2026-06-23", None]
    assert column(spark, ["Chiba, Tokyo", "premier", "京都市", "Ōsaka", ""], geo.detect_region) == ["chiba", "mie", "kyoto", "osaka", None]
    assert column(spark, ["<p>a<br>b &amp; c</p><script>x</script>"], text.html_to_text) == ["a b & c"]


def test_signals(spark):
    got = column(spark, ["Overseas applicants are welcome. Visa sponsorship available.", "nothing"], text.signals)
    assert {(s["kind"], s["value"], s["evidence"]) for s in got[0]} == {("visa", "possible_support", "Visa sponsorship available."), ("overseas", "supported", "Overseas applicants are welcome.")}
    assert got[1] == []


def test_normalize_row(spark):
    df = listings(spark, {"title": "  Backend   Engineer ", "company": "Example 株式会社", "workplace": "東京都 港区・ハイブリッド勤務", "description_snippet": "正社員。English and Japanese required.", "date_posted": "July 23, 2026", "quality_flags": ["own", "missing_date"]})
    r = normalize_listings(df).first()
    assert (r["title"], r["prefecture"], r["prefecture_name"], r["remote"], r["employment_type"], r["date_posted"]) == ("Backend Engineer", "tokyo", "Tokyo", True, "fulltime", "2026-07-23")
    assert r["language"] == ["english", "japanese"] and r["source_urls"] == {"green": "http://x"} and r["quality_flags"] == ["own"]


def test_filter_reasons(spark):
    base = {"title": "Software Engineer", "company": "Example", "workplace": "Tokyo", "prefecture": "tokyo", "employment_type": "fulltime", "date_posted": "2026-07-20", "language": ["bilingual"]}
    as_of = date(2026, 7, 23)

    def reason(row=(), **o):
        return filtering.apply_filter(listings(spark, {**base, **dict(row)}), filtering.FilterOptions(as_of, **o)).first()["filter_reason"]

    assert reason(days=30, language="english", keywords=["software"]) is None
    assert reason(keywords=["Sales"], prefecture="osaka") == "keyword_mismatch"
    assert reason(prefecture="osaka") == "prefecture_mismatch"
    assert reason({"prefecture": None}, prefecture="osaka") == "unknown_prefecture"
    assert reason(employment_types=["contract"]) == "employment_type_mismatch"
    assert reason({"employment_type": None}, employment_types=["contract"]) == "unknown_employment_type"
    assert reason(language="japanese") == "language_mismatch"
    assert reason({"date_posted": "2026-06-01"}, days=30) == "before_date_window"
    assert reason({"date_posted": "2026-07-24"}, days=30) == "after_date_window"
    assert reason({"date_posted": None}, days=30) is None
    assert reason({"date_posted": None}, days=30, include_unknown_dates=False) == "unknown_date"
    assert reason(keywords=["+++"]) is None  # canonically empty


def test_resolve(spark):
    rows = [
        {"source": "tokyodev", "source_id": "1", "title": "Gameplay Engineer", "company": "Komodo", "date_posted": "2026-07-01", "source_ids": {"tokyodev": "1"}, "source_urls": {"tokyodev": "a"}},
        {"source": "japandev", "source_id": "2", "title": "Gameplay  Engineer", "company": "KOMODO Inc.", "prefecture": "tokyo", "date_posted": "2026-07-03", "description": "longer", "source_ids": {"japandev": "2"}, "source_urls": {"japandev": "b"}},
        {"source": "green", "source_id": "3", "title": "Gameplay Engineer", "company": "Komodo", "prefecture": "osaka", "source_ids": {"green": "3"}, "source_urls": {"green": "c"}},
        {"source": "tokyodev", "source_id": "1", "title": "again"},
        {"source": "green", "source_id": "9", "title": "", "company": "Komodo"},
    ]
    out = sorted(resolve.resolve(listings(spark, *rows)).collect(), key=lambda r: r["_ord"])
    assert [r["merged_rows"] for r in out] == [2, 1, 1]
    assert out[0]["found_on"] == ["tokyodev", "japandev"] and out[0]["source_ids"] == {"tokyodev": "1", "japandev": "2"}
    assert (out[0]["prefecture"], out[0]["date_posted"], out[0]["description"]) == ("tokyo", "2026-07-03", "longer")
    assert out[1]["prefecture"] == "osaka"
    same = [{"source": "green", "source_id": str(i), "title": "T", "company": "C"} for i in (1, 2)]
    assert resolve.resolve(listings(spark, *same)).count() == 2


def test_pages(spark):
    schema = "source string, keyword string, context string, page int, rows int, added int, dates array<string>, has_next boolean, total_pages int, date_ordered boolean, server_date_filtered boolean, stop_on_no_new boolean, no_new_tolerance int"

    def stop(*pages, **o):
        rows = [("s", "k", "", p.get("page", i + 1), p.get("rows", 10), p.get("added", 10), p.get("dates", []), p.get("has_next"), p.get("total"), p.get("ordered", False), p.get("filtered", False), p.get("repeat", False), p.get("tolerance", 1)) for i, p in enumerate(pages)]
        options = coverage.PageOptions(**{"cutoff": date(2026, 6, 23), **o})
        got = coverage.first_stop(coverage.decide(spark.createDataFrame(rows, schema), options)).collect()
        return (got[0]["page"], got[0]["reason"], got[0]["coverage_complete"]) if got else None

    assert coverage.page_budget(coverage.PageOptions(max_pages=12)) == 12
    assert coverage.page_budget(coverage.PageOptions(per_source={"a": 250}), "a") == 250
    assert stop({"dates": ["2026-06-22", "2026-07-01"], "ordered": True}, {"dates": ["2026-06-22", "2026-06-01"], "ordered": True}) == (2, "date_boundary", True)
    assert stop({}, {}, auto=False, pages=2) == (2, "page_limit", False)
    assert stop({}, {}, {}, max_pages=3) == (3, "safety_cap", False)
    assert stop({"added": 0, "has_next": False, "repeat": True}) == (1, "source_end", True)
    assert stop({"added": 0, "has_next": True, "repeat": True}) == (1, "repeated_page", False)
    assert stop(*({"added": a, "repeat": True, "has_next": True, "tolerance": 3} for a in (0, 5, 0, 0, 0))) == (5, "repeated_page", False)
    assert stop({"rows": 0, "filtered": True}) == (1, "server_filtered_end", True)
    assert stop(*({"rows": 0, "added": 0, "has_next": True, "repeat": True, "tolerance": 3} for _ in range(3))) == (3, "repeated_page", False)
    assert stop({"total": 1}) == (1, "source_end", True)
    assert stop({}) is None
    old = spark.createDataFrame([("s", "k", "", 250, False), ("s", "done", "", 3, True)], "source string, keyword string, context string, page int, complete boolean")
    more = spark.createDataFrame([("s", "k", "", 1, False), ("s", "done", "", 9, False)], "source string, keyword string, context string, page int, coverage_complete boolean")
    assert {(r["keyword"], r["page"], r["complete"]) for r in coverage.advance_checkpoint(old, more).collect()} == {("k", 250, False), ("done", 3, True)}


POSTING = """<script type="application/ld+json">//<!--
{"@context": "x", "@type": "JobPosting", "title": "Engineer", "description": "<p>Build <b>things</b></p>", "datePosted": "2026-07-21T10:00:00+09:00", "employmentType": ["FULL_TIME"],
 "hiringOrganization": {"name": "Example"}, "jobLocation": {"address": {"addressRegion": "Tokyo", "addressLocality": "Minato"}}, "jobLocationType": "TELECOMMUTE",
 "baseSalary": {"currency": "JPY", "value": {"minValue": 6000000, "maxValue": 9000000, "unitText": "YEAR"}}}
//--></script>"""


def test_enrich(spark):
    df = listings(spark, {"source_id": "1", "title": "x"}, {"source_id": "2", "title": "y"}, {"source_id": "3", "title": "z"}, {"source_id": "4", "title": "w"})
    pages = spark.createDataFrame([("green", "1", 200, POSTING), ("green", "2", 200, "<p>none</p>"), ("green", "3", 403, POSTING)], "source string, source_id string, http_status int, html string")
    got = {r["source_id"]: r for r in enrich.apply_postings(df, pages).collect()}
    r = got["1"]
    assert (r["title"], r["company"], r["date_posted"], r["employment_type"], r["prefecture"], r["remote"], r["description"], r["workplace"]) == ("Engineer", "Example", "2026-07-21", "fulltime", "tokyo", True, "Build things", "Tokyo, Minato")
    assert (r["wage"]["min"], r["wage"]["max"], r["wage"]["unit"], r["wage"]["raw"]) == (6000000, 9000000, "annual", "JPY 6000000 9000000 YEAR")
    assert [got[k]["detail_status"] for k in "1234"] == ["enriched", "structured_data_unavailable", "http_403", None]
    assert enrich.find_posting(f'<script type="application/ld+json">[{{"a":1}},{{"b":2}}]</script>{POSTING}')["title"] == "Engineer"


CARD = """<article class="job-card"><div class="job-card__header-info"><a href="/en/jobs/detail/12345">Example Company</a></div>
<h2 class="job-card__title"><a href="/en/jobs/detail/12345?from=list">Platform Engineer</a></h2>
<dl class="job-card__detail"><dt>Location</dt><dd><a>Asia</a><a>Japan</a><a>Tokyo</a></dd><dt>Job Description</dt><dd>Build a platform.</dd></dl>
<p class="text-end text-secondary">Activated: 2026-07-23</p></article>"""


def test_sources(spark):
    pages = spark.createDataFrame([(1, "a", CARD), (2, "b", CARD), (3, "b", None)], "page_id long, keyword string, html string")
    (r,) = catalog.parse_pages(pages, "daijob").collect()
    assert (r["source_id"], r["title"], r["company"], r["workplace"], r["description_snippet"], r["date_posted"], r["matched_keyword"], r["language"]) == ("12345", "Platform Engineer", "Example Company", "Asia, Japan, Tokyo", "Build a platform.", "2026-07-23", "a", ["bilingual"])
    assert r["url"] == "https://www.daijob.com/en/jobs/detail/12345"
    assert len(catalog.select_sources()[0]) == 9 and catalog.SOURCES["linkedin"].status == "experimental"
    assert catalog.select_sources(["green", "nope"]) == (["green"], ["unknown source: nope"])
    cache = {"ROOT_QUERY": {"projectIndexPageJobPostIndex": {'searchedJobPostsUsingOffset({"input":{"pageNumber":2}})': {"jobPosts": [{"jobPost": {"__ref": "JobPost:1"}}], "totalCount": 25}}}, "JobPost:1": {"id": "1"}, "JobPost:999": {"id": "999"}}
    rows, total, more = catalog.offset_page(cache, 2)
    assert [x[0] for x in rows] == ["1"] and total == 25 and more
    board = spark.createDataFrame([("1301012345678", "職種 エンジニア 職種解説 事業所名 店 就業場所 東京都 賃金 月給 200,000円〜250,000円 受付年月日：2024年1月5日")], "number string, body string")
    r = catalog.parse_board_rows(board).first()
    assert (r["title"], r["company"], r["workplace"], r["prefecture"], r["date_posted"], r["job_number"]) == ("エンジニア", "店", "東京都", "tokyo", "2024-01-05", "13010-123456-78")
    assert (r["wage"]["min"], r["wage"]["max"], r["wage"]["unit"]) == (200000, 250000, "monthly")


def test_samples_and_outputs(spark):
    df = listings(spark, *({"source": s, "source_id": str(i), "title": f"{s}|{i}"} for s, i in (("large", 1), ("large", 2), ("large", 3), ("small", 1), ("small", 2))))
    got = sample.balanced_sample(df, 4).select("source", "source_id").collect()
    assert [tuple(r) for r in got] == [("large", "1"), ("small", "1"), ("large", "2"), ("small", "2")]
    assert {r["source"]: r["sampled"] for r in sample.source_summary(df, sample.stride_sample(df, 2)).collect()} == {"large": 2, "small": 2}
    assert "large\\|1" in output.format_rows(df, "markdown") and "... 3 more" in output.briefing(df, {"total": 5}, 2)
    assert len(output.flat(df).columns) == 24
    with pytest.raises(ValueError):
        output.format_rows(df, "nope")
    page = output.audit_page(df.withColumn("title", F.lit("</script>")), sample.source_summary(df, df))
    assert page.count("</script>") == 2


def test_delta(spark):
    df = listings(spark, {"id": "a", "company": "", "source_ids": {"green": "1"}, "title": "T"}, {"id": "b", "company": "X"})
    docs = delta.documents(df)
    import json

    first = json.loads(docs.where("id = 'a'").first()["doc"])
    assert first["company"] == "Unknown company" and first["qualityFlags"] == ["missing_company"] and list(first) == sorted(first)
    assert delta.changed(docs, docs).count() == 0
    assert [r["n"] for r in delta.export_chunks(docs, docs).collect()] == [0]
    assert delta.export_chunks(docs, docs.limit(0), 1).count() == 2
    assert delta.manifest(docs).first()["checksum"] == delta.manifest(docs.repartition(7)).first()["checksum"]
    assert len(delta.signature("1", b"x", "s")) == 64 and delta.run_id("2026-07-25T00:00:00Z", "a" * 64) == "listings-2026-07-25T00-00-00Z-" + "a" * 12


def test_quality(spark):
    df = listings(spark, {"title": "T", "company": "A Inc", "date_posted": "2026-07-01"}, {"title": "t", "company": "A", "source": "other", "date_posted": "bad"}, {"date_posted": None})
    c = {r["field"]: (r["present"], r["rate"]) for r in quality.completeness(df).collect()}
    assert c["title"] == (2, 0.6667) and c["wage"] == (0, 0.0)
    assert tuple(quality.date_metrics(df, date(2026, 6, 1), date(2026, 7, 30)).first()) == (1, 1, 1, 1, 0, 0)
    assert quality.cross_source_groups(df).count() == 1
    assert quality.report(df, date(2026, 6, 1), date(2026, 7, 30)).count() == 3


def test_source_local_filters(spark):
    df = listings(spark, {"title": "英語", "prefecture": "osaka"}, {"title": "x", "workplace": "東京都", "prefecture": "osaka"}, {"title": "English teacher", "prefecture": "tokyo"})
    assert filtering.board_filter(df, "tokyo").count() == 2 and filtering.board_filter(df, None, True).count() == 2
    assert filtering.plain_keyword(df, "ENGLISH").count() == 1 and filtering.plain_keyword(df, "").count() == 3
