"""Batches of builds: discovery, fan-out, states, reports."""

from __future__ import annotations

import ast
import html.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_failures(builds: DataFrame, since: Column) -> DataFrame:
    """Failed builds that began at or after ``since``; a row whose date does not parse is left out."""
    at = F.try_to_timestamp("begin_date", F.lit("yyyy-MM-dd HH:mm:ss"))
    return builds.withColumn("began", at).filter((F.col("status") == "failed") & F.col("began").isNotNull() & (F.col("began") >= since))


def fan_out(packages: DataFrame, processed: DataFrame) -> DataFrame:
    """Failed packages (build, arch, spec) that no earlier run has processed, each once."""
    return packages.filter("status = 'failed'").select("build", "arch", "spec").distinct().join(processed.select("build", "arch", "spec"), ["build", "arch", "spec"], "left_anti")


def retry_state(state: Column, retries: Column, limit: int) -> Column:
    return F.when(state.startswith("FAILED_") & (retries >= limit), "FAILED_PERMANENT").otherwise(state)


#: Names that a spec may have for a project below a segment.
PREFIX_RULES = [("hal-api-", "/hal/api/"), ("capi-ui-", "/api/"), ("capi-", "/api/")]


def spec_to_project(specs: DataFrame, projects: DataFrame) -> DataFrame:
    """spec, project, status: the one project of that base name, else by the first prefix that fits; several are ambiguous."""
    base = projects.select("project", F.substring_index("project", "/", -1).alias("base"))
    exact = specs.join(base, specs["spec"] == base["base"]).groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.min("project").alias("p"))
    rest, segment = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, must in reversed(PREFIX_RULES):
        rest = F.when(F.col("spec").startswith(prefix), F.expr(f"substring(spec, {len(prefix) + 1})")).otherwise(rest)
        segment = F.when(F.col("spec").startswith(prefix), F.lit(must)).otherwise(segment)
    asked = specs.withColumn("rest", rest).withColumn("segment", segment).filter("rest is not null")
    near = asked.join(base, asked["rest"] == base["base"]).filter(F.col("project").contains(F.col("segment"))).groupBy("spec").agg(F.count(F.lit(1)).alias("m"), F.min("project").alias("near"))
    df = specs.join(exact, "spec", "left").join(near, "spec", "left")
    n = F.coalesce("n", "m", F.lit(0))
    return df.select("spec", F.when(n == 1, F.coalesce("p", "near")).alias("project"), F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("missing").alias("status"))


def commit_patchsets(changes: DataFrame) -> DataFrame:
    """commit, change, number: patch sets of review changes (number, patchSets: array of number, revision)."""
    return changes.select(F.col("number").alias("change"), F.explode("patchSets").alias("p")).select(F.col("p.revision").alias("commit"), "change", F.col("p.number").alias("number"))


def daily_counts(units: DataFrame) -> DataFrame:
    s = F.col("state")
    return units.agg(F.count(F.lit(1)).alias("units"), F.count_if(s.startswith("DONE")).alias("done"), F.count_if(s.startswith("FAILED")).alias("failed"), F.count_if(s.startswith("SKIPPED")).alias("skipped"), F.count_if(F.coalesce(F.col("patch_status").endswith("_context_available"), F.lit(False))).alias("contexts"))


def folded_arches(rows: DataFrame, order: list[str]) -> DataFrame:
    """build, arches: configured ones in their order, then others by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("arch")), F.lit(0)), F.lit(len(order) + 1))
    return rows.select("build", "arch", rank.alias("rank")).distinct().groupBy("build").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "arch"))), lambda x: x["arch"]), ", ").alias("arches"))


def failed_packages(logs: DataFrame) -> DataFrame:
    """build, fail_pkg, spec, dest from full logs (build, text); the first of equal names stays."""
    pattern = r"fail_pkg:\s*([^,]+),\s*spec_name:\s*([^,\s]+)(?:,\s*dest_file:\s*(\S+))?"
    get = lambda i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
    df = logs.select("build", F.posexplode(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c"))).alias("i", "x"))
    df = df.select("build", "i", F.trim("x.a").alias("fail_pkg"), F.col("x.b").alias("spec"), F.nullif("x.c", F.lit("")).alias("dest"))
    return df.groupBy("build", "fail_pkg", "spec").agg(F.min_by("dest", "i").alias("dest"))


def package_commits(logs: DataFrame) -> DataFrame:
    """build, project, commit, error from the one line that holds a literal dictionary; parsed by batches of rows."""
    line = F.regexp_extract("text", r"build_pkg_list_dic:\s*([^\n]*)", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for build, raw in zip(b["build"], b["raw"]):
                if not raw:
                    rows.append((build, None, None, "BUILD_PKG_LIST_MISSING"))
                    continue
                try:
                    found = ast.literal_eval(raw)
                except (SyntaxError, ValueError, MemoryError, RecursionError):
                    found = None
                if not isinstance(found, dict):
                    rows.append((build, None, None, "BUILD_PKG_LIST_UNREADABLE"))
                    continue
                rows += [(build, k, v, None) for k, v in found.items() if isinstance(k, str) and isinstance(v, str)]
            yield pd.DataFrame(rows, columns=["build", "project", "commit", "error"], dtype=object)

    return logs.select(F.col("build").cast("string").alias("build"), line.alias("raw")).mapInPandas(run, "build string, project string, commit string, error string")


class _Tables(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, str | None, str | None, str]] = []
        self.table = self.row = 0
        self.cell = -1
        self.open = False
        self.href: str | None = None
        self.classes: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self._end()
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th"):
            self._end()
            self.cell, self.open, self.href, self.classes, self.text = self.cell + 1, True, None, None, []
        if self.open and tag in ("td", "th", "a", "span"):
            a = dict(attrs)
            self.href = self.href or (a.get("href") if tag == "a" else None)
            self.classes = self.classes or a.get("class")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data):
        if self.open:
            self.text.append(data)

    def _end(self):
        if self.open:
            self.rows.append((self.row, self.cell, self.href, self.classes, " ".join(" ".join(self.text).split())))
            self.open = False


def table_cells(pages: DataFrame, key: str, html_column: str) -> DataFrame:
    """key, row, cell, href, classes, text of every table cell; HTML has no expression in Spark, so batches of rows are parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b["key"], b["page"]):
                p = _Tables()
                p.feed(page or "")
                p.close()
                out += [(k, *r) for r in p.rows]
            yield pd.DataFrame(out, columns=["key", "row", "cell", "href", "classes", "text"])

    return pages.select(F.col(key).cast("string").alias("key"), F.col(html_column).alias("page")).mapInPandas(run, "key string, row int, cell int, href string, classes string, text string")


def build_list(cells: DataFrame) -> DataFrame:
    """Builds of a list page: rows of four cells or more with a numeric id, a status class and a date that parses."""
    get = lambda i, c: F.max(F.when(F.col("cell") == i, F.col(c)))
    df = cells.groupBy("key", "row").agg(get(0, "text").alias("build_id"), get(1, "text").alias("version"), get(2, "text").alias("begin_date"), get(3, "classes").alias("status_class"), get(0, "href").alias("url"), F.max("cell").alias("last"))
    status = F.when(F.col("status_class").rlike(r"\bfailed\b"), "failed").when(F.col("status_class").rlike(r"\bsuccessful\b"), "successful")
    return df.withColumn("status", status).filter((F.col("last") >= 3) & F.col("build_id").rlike(r"^\d+$") & F.col("status").isNotNull() & F.try_to_timestamp("begin_date", F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()).select("key", "build_id", "version", "begin_date", "status", "url")


def links(pages: DataFrame, key: str, html_column: str) -> DataFrame:
    """key, place, href of every link."""
    hrefs = F.regexp_extract_all(html_column, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    return pages.select(key, F.posexplode(F.transform(hrefs, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))).alias("place", "href"))
