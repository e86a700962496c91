"""Output formats of listings: every row in each but the briefing, which is a sample."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import balanced_sample, ranked

#: Columns of the flat form, and those of them that hold JSON.
FLAT = [
    "id", "source", "source_id", "url", "found_on", "title", "company", "description_snippet", "workplace", "prefecture", "prefecture_name", "city", "remote",
    "wage_min", "wage_max", "wage_unit", "wage_raw", "employment_type", "date_posted", "language", "matched_keyword", "source_urls", "source_ids", "quality_flags",
]
AS_JSON = ("found_on", "language", "source_urls", "source_ids", "quality_flags")


def flat(df: DataFrame) -> DataFrame:
    """24 flat columns: the wage in four, arrays and maps as JSON."""

    def column(name: str) -> Column:
        if name.startswith("wage_"):
            return F.col(f"wage.{name[5:]}").alias(name)
        return (F.to_json(name) if name in AS_JSON else F.col(name)).alias(name)

    return df.select(*map(column, FLAT))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select("id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def _text(c: Column, width: int | None = None) -> Column:
    plain = F.coalesce(c.cast("string"), F.lit(""))
    return plain if width is None else F.substring(plain, 1, width)


def _place() -> Column:
    return F.when(_text(F.col("prefecture_name")) != "", F.col("prefecture_name")).otherwise(_text(F.col("workplace")))


def _sources() -> Column:
    return F.when(F.size(F.coalesce("found_on", F.array().cast("array<string>"))) > 0, F.array_join("found_on", ", ")).otherwise(_text(F.col("source")))


def _wage(missing: str) -> Column:
    return F.when(_text(F.col("wage.raw")) != "", F.col("wage.raw")).otherwise(missing)


def _cell(c: Column, width: int | None = None) -> Column:
    return F.replace(F.replace(_text(c, width), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _markdown() -> Column:
    cells = [(F.col("_rank") + 1).cast("string"), _cell(_sources()), _cell(F.col("title"), 50), _cell(F.col("company"), 30), _cell(_place(), 30), _cell(_wage("\u2014")), _text(F.col("url"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _table() -> Column:
    wide = lambda c, n: F.rpad(_text(c, n), n, " ")
    rows = [
        F.concat(F.lit("  "), F.concat_ws(" | ", wide(F.col("title"), 60), wide(F.col("company"), 25), _text(F.col("source")))),
        F.concat(F.lit("    at "), wide(_place(), 50), F.lit(" for "), _wage("\u2014")),
        F.concat(F.lit("    "), _text(F.col("url"), 120)),
        F.lit(""),
    ]
    return F.concat_ws("\n", *rows)


#: How a listing stands in each format, and what stands between two listings.
_ROWS = {"markdown": (_markdown, "\n"), "table": (_table, "\n"), "json": (lambda: F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), ",\n")}


def lines(df: DataFrame, name: str) -> DataFrame:
    """value: every listing of df in a format, in the order of _ord; markdown has its number."""
    if name not in _ROWS:
        raise ValueError(f"unknown format {name!r}")
    make, _ = _ROWS[name]
    if name != "markdown":
        return df.orderBy("_ord").select(make().alias("value"))
    return ranked(df, ["_ord"]).orderBy("_rank").select(make().alias("value"))


def heading(name: str, stats: dict) -> str:
    """What stands before the listings: when, how many, and how many were left out or merged."""
    at, total = stats.get("scanned_at", ""), stats.get("total", 0)
    if name == "markdown":
        counts = f"**Total:** {total} listings from {stats.get('sources', 0)} sources, {stats.get('raw_total', total)} read, {stats.get('filtered', 0)} filtered out, {stats.get('merged', 0)} merged"
        return f"# Scan {at}\n{counts}\n\n| # | Source | Title | Company | Location | Wage | URL |\n|---|---|---|---|---|---|---|\n"
    return f"{total} listings, {at}\n\n" if name == "table" else "[\n"


def stream(df: DataFrame, name: str, stats: dict | None = None) -> Iterator[str]:
    """The whole output of a format in pieces; one partition of the listings is held at a time.

    df is ordered by _ord; there is no limit to how many listings are written.
    """
    rows = lines(df, name)
    yield heading(name, stats or {})
    between = ""
    for r in rows.toLocalIterator(prefetchPartitions=True):
        yield between + r["value"]
        between = _ROWS[name][1]
    yield "\n]\n" if name == "json" else "\n"


def write_lines(df: DataFrame, name: str, path: str) -> None:
    """The listings of a format as text files, part after part in order; for those too many for one file."""
    lines(df, name).write.mode("overwrite").text(path)


def format_rows(df: DataFrame, name: str, stats: dict | None = None) -> str:
    """stream() as one string."""
    return "".join(stream(df, name, stats))


def briefing(df: DataFrame, stats: dict | None = None, n: int = 50) -> str:
    """Text blocks of at most n listings, in rounds over the sources, for a reader that ranks them; says how many there are in all.

    The only format that is a sample.
    """
    stats = stats or {}
    chosen = balanced_sample(df, n).select(
        _text(F.col("title")).alias("title"), _text(F.col("company")).alias("company"), _place().alias("place"), _wage("wage unknown").alias("wage"), _text(F.col("date_posted")).alias("posted"), _sources().alias("sources"),
        F.array_join(F.coalesce("language", F.array().cast("array<string>")), ", ").alias("language"), _text(F.col("description_snippet"), 400).alias("snippet"), _text(F.col("url")).alias("url"),
    ).collect()
    total = stats.get("total", len(chosen))
    out = [f"# {len(chosen)} of {total} listings", f"# Scan {stats.get('scanned_at', '')}", f"# Sources: {', '.join(stats.get('names', []))}", ""]
    for i, r in enumerate(chosen, 1):
        out += [f"[{i}] {r['title']}", f"    {r['company']}, {r['place'] or 'unknown place'}", f"    {r['wage']}, posted {r['posted'] or '?'}, from {r['sources']}"]
        out += [f"    Languages: {r['language']}"] * bool(r["language"]) + [f"    {r['snippet']}"] * bool(r["snippet"]) + [f"    {r['url']}", ""]
    if total > len(chosen):
        out.append(f"... {total - len(chosen)} more")
    return "\n".join(out)


def audit_page(sample: DataFrame, summary: DataFrame, title: str = "Sample audit") -> str:
    """A self-contained page to review a sample; the data stand in it as JSON that can't end its script."""
    data = {"rows": [r.asDict(True) for r in sample.collect()], "sources": [r.asDict() for r in summary.collect()]}
    blob = json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul id="rows"></ul>
<button id="save">Export</button><script type="application/json" id="data">{blob}</script><script>
const data = JSON.parse(document.getElementById("data").textContent), marks = JSON.parse(localStorage.getItem(document.title) || "{{}}");
for (const r of data.rows) {{ const li = document.createElement("li"), box = document.createElement("input"); box.type = "checkbox"; box.checked = !!marks[r.id];
box.onchange = () => {{ marks[r.id] = box.checked; localStorage.setItem(document.title, JSON.stringify(marks)); }}; li.append(box, " " + r.source + ": " + r.title); document.getElementById("rows").append(li); }}
document.getElementById("save").onclick = () => {{ const a = document.createElement("a"); a.href = URL.createObjectURL(new Blob([JSON.stringify(marks)])); a.download = "review.json"; a.click(); }};
</script>"""
