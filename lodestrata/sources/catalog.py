"""The source catalog and parsers of captured pages into raw listings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.schema import listing_id
from . import html

RAW = "source string, source_id string, url string, title string, company string, description_snippet string, workplace string, date_posted string, employment_type string, wage_raw string, language array<string>, matched_keyword string, _ord bigint"


@dataclass
class Source:
    """What is known of a source, and how its cards are read; selectors are tried in order."""

    name: str
    description: str
    status: str = "active"
    requires_browser: bool = False
    base: str = ""
    cards: str = ""
    id_pattern: str = ""
    link: tuple[str, ...] = ("a",)
    title: tuple[str, ...] = ()
    company: tuple[str, ...] = ()
    workplace: tuple[str, ...] = ()
    date: tuple[str, ...] = ()
    employment: tuple[str, ...] = ()
    wage: tuple[str, ...] = ()
    terms: dict[str, str] = field(default_factory=dict)  # label of a dt to a field
    climb: int = 0  # levels from a link card to the row around it
    language: tuple[str, ...] = ()
    place: str = ""
    supports: tuple[str, ...] = ()
    parser: Callable[[str], list[dict]] | None = None


# Parsers of sources whose pages hold data rather than cards.


def state_json(page: str) -> dict | None:
    """The state that a page embeds for its own scripts."""
    m = re.search(r'<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.+?)</script', page or "", re.S)
    try:
        return json.loads(m[1]) if m else None
    except ValueError:
        return None


def offset_page(cache: dict, page: int, size: int = 10) -> tuple[list[tuple[str, dict, dict | None]], int, bool]:
    """(id, post, company) of one result page of a normalised cache, the total and whether more pages follow."""
    index = (cache.get("ROOT_QUERY") or {}).get("projectIndexPageJobPostIndex") or {}
    found = next((v for k, v in index.items() if k.startswith("searchedJobPostsUsingOffset") and f'"pageNumber":{page}' in k), None)
    if not isinstance(found, dict):
        return [], 0, False
    follow = lambda x: cache.get(x["__ref"]) if isinstance(x, dict) and "__ref" in x else x
    rows = []
    for item in found.get("jobPosts") or []:
        post = follow(item.get("jobPost"))
        if isinstance(post, dict) and post.get("id"):
            company = follow(post["company"]) if isinstance(post.get("company"), dict) else None
            rows.append((str(post["id"]), post, company if isinstance(company, dict) else None))
    total = int(found.get("totalCount") or len(rows))
    return rows, total, page * size < total


# Hiring types of one source, first match counts.
HIRING = {"MID_CAREER": "fulltime", "NEW_GRADUATE": "fulltime", "INTERNSHIP": "intern", "SIDE_JOB": "parttime", "PART_TIME": "parttime", "CONTRACT": "contract", "OUTSOURCING": "freelance", "FREELANCE": "freelance"}


def _posts(page: str) -> list[dict]:
    state = state_json(page) or {}
    props = (state.get("props") or {}).get("pageProps") or {}
    cache = props.get("__APOLLO_STATE__") or state.get("__APOLLO_STATE__") or {}
    marks = re.findall(r'\\?"pageNumber\\?":(\d+)', json.dumps(list(((cache.get("ROOT_QUERY") or {}).get("projectIndexPageJobPostIndex") or {}))))
    rows, _, _ = offset_page(cache, int(marks[0]) if marks else 1)
    return [
        {"source_id": i, "url": f"/projects/{i}", "title": p.get("title"), "company": (c or {}).get("name"), "date_posted": p.get("publishedAt"), "workplace": p.get("location"), "description_snippet": p.get("description"), "employment_type": next((HIRING[h] for h in [p.get("hiringType"), *(p.get("hiringTypes") or [])] if h in HIRING), None)}
        for i, p, c in rows
    ]


def _walk_posts(page: str) -> list[dict]:
    """All job-shaped objects anywhere in the state."""
    out, stack = {}, [state_json(page)]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            key = x.get("id") or x.get("slug")
            if x.get("title") and key and (x.get("company") or x.get("startup") or x.get("jobType") or x.get("compensation")):
                org = x.get("company") or x.get("startup")
                out.setdefault(str(key), {"source_id": str(key), "url": f"/jobs/{key}", "title": x["title"], "company": org.get("name") if isinstance(org, dict) else org, "wage_raw": x.get("compensation"), "workplace": ", ".join(x["locationNames"]) if isinstance(x.get("locationNames"), list) else None})
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return list(out.values())


CONTRACTS = {"full": "fulltime", "part": "parttime", "contract": "contract", "freelance": "freelance", "intern": "intern"}


def _hits(page: str) -> list[dict]:
    """Hits of a search service, as JSON."""
    try:
        tree = json.loads(page)
    except (TypeError, ValueError):
        return []
    hits = tree.get("hits") or [h for r in tree.get("results") or [] for h in r.get("hits") or []]
    out = []
    for h in hits:
        org = h.get("company")
        kind = str(h.get("contract_type") or h.get("employment_type") or "").lower()
        name = h.get("company_name") or (org.get("name") if isinstance(org, dict) else org)
        out.append({"source_id": str(h.get("objectID") or ""), "url": f"/jobs/{h.get('slug') or h.get('objectID')}", "title": h.get("title"), "company": name, "date_posted": h.get("published_at") or h.get("job_post_date"), "workplace": h.get("location"), "description_snippet": html.parse(h.get("description") or h.get("intro")).text(" "), "employment_type": next((v for k, v in CONTRACTS.items() if k in kind), None)})
    return [x for x in out if x["source_id"]]


# Names, kinds and selectors of the sources.
SOURCES = {
    s.name: s
    for s in (
        Source("hellowork", "Public government job board", requires_browser=True, base="https://www.hellowork.mhlw.go.jp", supports=("keyword", "prefecture", "english")),
        Source("linkedin", "Guest listing pages of a professional network", "experimental", base="https://www.linkedin.com", cards="li, .base-card", link=("a.base-card__full-link", "a.base-card"), id_pattern=r"-(\d{8,})(?:\?|$)", title=("h3.base-search-card__title", "h3"), company=("h4.base-search-card__subtitle", "h4"), workplace=("span.job-search-card__location",), date=("time",), supports=("keyword", "days")),
        Source("tokyodev", "English-first software jobs, one page", base="https://www.tokyodev.com", cards="a[href^=/companies/]", id_pattern=r"/companies/([^/]+/jobs/[^/?#]+)", title=("h3", ".job-title"), language=("english",), place="Japan"),
        Source("japandev", "English-first software jobs, search hits", base="https://japan-dev.com", language=("english",), parser=_hits),
        Source("daijob", "Bilingual professional jobs", base="https://www.daijob.com", cards="article.job-card", id_pattern=r"/en/jobs/detail/(\d+)", link=("h2.job-card__title a", "a[href*=/en/jobs/detail/]"), company=(".job-card__header-info a",), date=("p.text-end.text-secondary",), terms={"Location": "workplace", "Job Description": "description_snippet"}, language=("bilingual",), place="Japan", supports=("keyword",)),
        Source("gaijinpot", "General jobs for speakers of English", base="https://jobs.gaijinpot.com", cards="div.card[data-href^=/en/job/]", id_pattern=r"/en/job/(\d+)", link=("h3.card-heading a",), employment=(".card-label .label",), terms={"Company": "company", "Location": "workplace", "Salary": "wage_raw", "Post Date": "date_posted", "Work Type": "employment_type"}, language=("english",)),
        Source("jobsinjapan", "General jobs for speakers of English, relative dates", base="https://jobsinjapan.com", cards="article.noo_job", id_pattern=r"/jobs/(\d+)/", link=("h3.loop-item-title a",), company=(".company-name",), workplace=(".job-location",), employment=(".loop-job-type a.job-type",), date=(".job-date-ago",), language=("english",)),
        Source("green", "IT and start-up jobs", base="https://www.green-japan.com", cards="a[href^=/company/]", id_pattern=r"^/company/(\d+/job/\d+)"),
        Source("forkwell", "Jobs for engineers", base="https://jobs.forkwell.com", cards="a.job-list__link", id_pattern=r"^/([A-Za-z0-9_-]+/jobs/\d+)", title=("span",), company=(".avatar__detail",), workplace=("li.list-inline-item",), climb=2),
        Source("wantedly", "Jobs by interest, embedded state", base="https://www.wantedly.com", language=("bilingual",), parser=_posts),
        Source("indeed", "Best effort, often blocked", "experimental", True, "https://jp.indeed.com", cards="[data-jk]", id_pattern=r"jk=([0-9a-f]+)", title=("h2", "h2 span"), company=("[data-testid=company-name]", ".companyName"), workplace=("[data-testid=text-location]", ".companyLocation"), wage=(".salary-snippet-container", ".salary-snippet")),
        Source("careercross", "Bilingual professional jobs, new ones only", "experimental", base="https://www.careercross.com", cards="div.new-job a[href*=/en/job/detail-]", id_pattern=r"/en/job/detail-(\d+)", language=("bilingual",)),
        Source("jrecin", "Research positions", "experimental", base="https://jrecin.jst.go.jp", cards="a[href*=SeekJorDetail]", id_pattern=r"id=([A-Z0-9]+)", language=("bilingual",)),
        Source("otta", "Recruiting page of one company", "experimental", base="https://en-gage.net", cards="a[href*=work_]", id_pattern=r"/(work_\d+)/", language=("bilingual",)),
        Source("wellfound", "Start-up jobs, embedded state", "experimental", base="https://wellfound.com", language=("bilingual",), parser=_walk_posts),
        Source("doda", "General jobs", "experimental", base="https://doda.jp", cards="article, .jobCard, .layoutList", id_pattern=r"jobId-(\d+)", link=("a[href*=JobSearchDetail]", "a[href*=jobId-]"), title=("h3", ".jobListHead"), company=(".company", ".companyName", "h2"), workplace=(".workplace", ".area", ".jobListArea", "dd.area"), wage=(".salary", ".income", ".jobListIncome", "dd.income")),
        Source("enworld", "Recruiter's listing shell", "experimental", base="https://www.enworld.com", cards="a[href*=/job-details/], a[href*=/jobs/]", id_pattern=r"/(?:job-details|jobs)/([A-Za-z0-9_-]+)", language=("english",)),
    )
}


def register_source(source: Source) -> None:
    """Add a source, or put another one in its place."""
    SOURCES[source.name] = source


def list_sources(spark: SparkSession) -> DataFrame:
    """name, description, status, requires_browser, supports."""
    rows = [(s.name, s.description, s.status, s.requires_browser, list(s.supports)) for s in SOURCES.values()]
    return spark.createDataFrame(rows, "name string, description string, status string, requires_browser boolean, supports array<string>")


def select_sources(wanted: str | list[str] = "all") -> tuple[list[str], list[str]]:
    """Names that a selection means, and warnings about unknown ones."""
    if wanted == "all":
        return [k for k, s in SOURCES.items() if s.status == "active"], []
    if wanted == "all-including-experimental" or wanted == ["all-including-experimental"]:
        return list(SOURCES), []
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    return [n for n in names if n in SOURCES], [f"unknown source: {n}" for n in names if n not in SOURCES]


def _text(card: html.Node, selectors: tuple[str, ...]) -> str:
    node = card.first(*selectors) if selectors else None
    return node.text(" ") if node else ""


def parse_cards(s: Source, page: str) -> list[dict]:
    """Raw listings of one page, the first card of each id."""
    if s.parser:
        return s.parser(page)
    out: dict[str, dict] = {}
    for card in html.parse(page).all(s.cards) if s.cards else []:
        link = card if card.tag == "a" else card.first(*s.link)
        href = (link.attrs.get("href") if link else "") or card.attrs.get("data-href", "")
        found = re.search(s.id_pattern, href) or (card.attrs.get("data-jk") and re.match("(.*)", card.attrs["data-jk"]))
        if not found or found[1] in out:
            continue
        row = card.up(s.climb)
        title = (_text(card, s.title) or (link.text(" ") if link else ""))[:200]
        got = {"source_id": found[1], "url": href if href.startswith("http") else s.base + href.split("?")[0], "title": title}
        got |= {"company": next((t for n in (row.all(", ".join(s.company)) if s.company else []) if (t := n.text(" ")) and t != title), ""), "workplace": _text(row, s.workplace), "employment_type": _text(row, s.employment), "wage_raw": _text(row, s.wage)}
        day = row.first(*s.date) if s.date else None
        if day:
            shown = day.attrs.get("datetime") or day.text(" ")
            exact = re.search(r"\d{4}-\d{2}-\d{2}", shown)
            got["date_posted"] = exact[0] if exact else shown
        for term in row.all("dt"):
            name = next((v for k, v in s.terms.items() if k in term.text(" ")), None)
            value = term.next_of("dd")
            if name and value:
                parts = [a.text(" ") for a in value.all("a")] if name == "workplace" else []
                got[name] = (", ".join(p for p in parts if p) or value.text(" "))[:400]
        if s.name == "tokyodev":
            got["company"] = found[1].split("/")[0].replace("-", " ").title()
        out[found[1]] = got
    return list(out.values())


def parse_pages(pages: DataFrame, source: str) -> DataFrame:
    """Raw listings of captured pages(page_id, keyword, html); the first keyword that meets an id keeps it."""
    s = SOURCES[source]
    fields = [x.split()[0] for x in RAW.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, keyword, body in zip(batch["page_id"], batch["keyword"], batch["html"], strict=True):
                for i, got in enumerate(parse_cards(s, body or "")):
                    rows.append({**dict.fromkeys(fields), "source": s.name, "language": list(s.language), "matched_keyword": keyword or None, "_ord": (int(page_id) << 16) + i, **got, "workplace": got.get("workplace") or s.place})
            yield pd.DataFrame(rows, columns=fields)

    from ..operators.resolve import native_dedup

    return native_dedup(pages.select("page_id", "keyword", "html").mapInPandas(work, RAW))


# Labels of the row text of the public job board, in Japanese.
LABELS = ("職種", "仕事の内容", "仕事内容", "事業所名", "就業場所", "賃金", "就業時間", "休日", "求人番号", "画像あり", "受付年月日", "紹介期限日")


def parse_board_rows(rows: DataFrame) -> DataFrame:
    """Listings of the public job board's row texts(number, body), in Spark expressions only."""
    t = F.trim(F.regexp_replace("body", r"(?U)\s+", " "))

    def labelled(label: str):
        stops = "|".join(x for x in LABELS if x != label)
        return F.trim(F.regexp_extract(t, f"{label}(.+?)(?=(?:{stops})|$)", 1))

    day = r"受付年月日\s*[：:]\s*(\d{4})年(\d{1,2})月(\d{1,2})日"
    date = F.try_to_date(F.concat_ws("-", *(F.regexp_extract(t, day, i) for i in (1, 2, 3))), "yyyy-M-d")
    named = F.regexp_extract(t, r"賃金[^円]*?([\d,]+\s*円(?:\s*[〜～~]\s*[\d,]+\s*円)?)", 1)
    kind = F.regexp_extract(t, r"(月給|時給|日給|年俸)[^円]*?[\d,]+\s*円", 1)
    raw = F.regexp_replace(F.when(named != "", named).otherwise(kind), r"(?U)\s+", "")
    numbers = text.numbers_in(raw)
    low = F.get(numbers, 0)
    unit = F.when(F.contains(t, F.lit("月給")) | (low > 100000), "monthly").when(F.contains(t, F.lit("時給")), "hourly").when(F.contains(t, F.lit("年俸")), "annual").otherwise("monthly")
    n = F.col("number")
    shown = F.when(F.char_length(n) >= 13, F.concat_ws("-", F.substring(n, 1, 5), F.substring(n, 6, 6), F.substr(n, F.lit(12)))).otherwise(n)
    return rows.select(
        F.lit("hellowork").alias("source"),
        n.alias("source_id"),
        listing_id(F.lit("hellowork"), n).alias("id"),
        F.substring(F.regexp_replace(labelled("職種"), r"\s*職種解説\s*$", ""), 1, 200).alias("title"),
        F.substring(labelled("事業所名"), 1, 200).alias("company"),
        F.substring(labelled("就業場所"), 1, 200).alias("workplace"),
        geo.code_to_slug(F.substring(n, 1, 2)).alias("prefecture"),
        geo.code_to_name(F.substring(n, 1, 2)).alias("prefecture_name"),
        F.struct(low.alias("min"), F.get(numbers, F.size(numbers) - 1).alias("max"), F.when(raw != "", unit).alias("unit"), raw.alias("raw")).alias("wage"),
        F.date_format(date, "yyyy-MM-dd").alias("date_posted"),
        F.substring(t, 1, 400).alias("description_snippet"),
        shown.alias("job_number"),
    )


def request_plan(spark: SparkSession, keywords: list[str], levels: list[str], kinds: list[str]) -> DataFrame:
    """All combinations of a sweep, a few of each."""
    one = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    return one(keywords, "keyword").crossJoin(one(levels, "level")).crossJoin(one(kinds, "kind"))
