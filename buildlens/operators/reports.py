"""Reports and their inputs: states, URLs, command lines, build logs, manifests, package pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import error_code, slug
from buildlens.operators.gates import first_of

#: Statuses of one triage by the state that they lead to.
STATES = {
    "FAILED_LOG": ["COOKIE_MISSING", "COOKIE_UNREADABLE", "COOKIE_EXPIRED", "QUICKBUILD_DOWNLOAD_FAILED", "DOWNLOAD_LINK_NOT_FOUND", "PACKAGE_BUILDLOG_DOWNLOAD_FAILED"],
    "FAILED_ANALYZE": ["ANALYZER_FAILED"],
    "FAILED_SOURCE": ["FAILED_SOURCE", "SOURCE_DIR_UNSAFE", "GERRIT_QUERY_FAILED", "GERRIT_CHANGE_NOT_FOUND", "GERRIT_CHANGE_AMBIGUOUS", "PATCHSET_REVISION_NOT_FOUND"],
    "FAILED_PATCH": ["PATCH_SUGGEST_FAILED"],
    "NEEDS_INPUT": ["NEEDS_PACKAGE_SELECTION", "FAILED_PACKAGE_NOT_FOUND", "FAILED_PACKAGE_AMBIGUOUS", "PROJECT_COMMIT_NOT_FOUND", "PROJECT_COMMIT_AMBIGUOUS"],
}
LEAVING = r"Leaving the logs in (\S+/logs/fail/[^/\s]+/log\.txt)"
RSP_TOKENS, RSP_INCLUDES, RSP_DEFINES, RSP_OBJECTS = 200, 10, 20, 30


def triage_state(status: Column) -> Column:
    return first_of(*[(status.isin(*names), state) for state, names in STATES.items()], otherwise="FAILED_REPORT")


def since(argument: Column, hours: int, now: Column) -> Column:
    """The given ISO time, else so many hours before now."""
    return F.coalesce(F.try_to_timestamp(argument), now - F.make_interval(hours=F.lit(hours)))


def shell_words(text: Column) -> Column:
    """Words of a command line; quoted parts hold together and lose their quotes."""
    words = F.regexp_extract_all(text, F.lit(r"""((?:[^\s"']|"[^"]*"|'[^']*')+)"""), F.lit(1))
    return F.transform(words, lambda w: F.regexp_replace(w, r"""["']""", ""))


def response_flags(text: Column) -> dict[str, Column]:
    """What a response file says to the linker, of its first 200 words: libraries, their paths, some flags, the first ten -I, twenty
    -D and thirty objects."""
    words = F.slice(shell_words(text), 1, RSP_TOKENS)
    some = lambda holds, most=RSP_TOKENS: F.slice(F.filter(words, holds), 1, most)
    return {
        "libraries": some(lambda w: w.startswith("-l")),
        "library_paths": some(lambda w: w.startswith("-L")),
        "flags": some(lambda w: w.isin("-Werror", "-fPIC", "-shared")),
        "includes": some(lambda w: w.startswith("-I"), RSP_INCLUDES),
        "defines": some(lambda w: w.startswith("-D"), RSP_DEFINES),
        "objects": some(lambda w: w.rlike(r"\.[oa]$"), RSP_OBJECTS),
    }


def expanded_commands(commands: DataFrame, files: DataFrame) -> DataFrame:
    """log_id, id, rsp, found, degraded of each response file that a command names (rsp_files); a command with one that is not
    there is degraded, and the file has null flags. files: log_id, rsp, text."""
    df = commands.select("log_id", "id", F.explode("rsp_files").alias("rsp")).join(files, ["log_id", "rsp"], "left")
    missing = df.groupBy("log_id", "id").agg(F.bool_or(F.col("text").isNull()).alias("degraded"))
    flags = response_flags(F.col("text"))
    return df.join(missing, ["log_id", "id"]).select("log_id", "id", "rsp", F.col("text").isNotNull().alias("found"), "degraded", *[F.array_join(c, " ").alias(n) for n, c in flags.items()])


def normal_build_log(text: Column) -> Column:
    """A build's log with what differs from run to run replaced: build root, temporary names, times, carriage returns, blanks at ends."""
    out = F.regexp_replace(text, r"\r", "")
    out = F.regexp_replace(out, r"/\S*?/BUILD/", "<BUILD>/")
    out = F.regexp_replace(out, r"/tmp/[^\s:]+", "<TMP>")
    out = F.regexp_replace(out, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TIME>")
    return F.regexp_replace(out, r"(?m)[ \t]+$", "")


def without_build_prefix(path: Column) -> Column:
    """A path without build directory, the package's own directory below it, a line number, and dots and slashes ahead."""
    out = F.regexp_replace(path, r"^.*/BUILD/(?:[^/]+-\d[^/]*/)?", "")
    return F.regexp_replace(F.regexp_replace(out, r":\d+(?::\d+)?$", ""), r"^[./]+", "")


def touched_name(path: Column, touched: Column) -> Column:
    """The longest touched file that is the path or an end of it, else the path."""
    plain = without_build_prefix(path)
    hits = F.filter(touched, lambda t: (plain == t) | F.endswith(plain, F.concat(F.lit("/"), t)))
    longest = F.try_element_at(F.array_sort(F.transform(hits, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), F.lit(1))["t"]
    return F.coalesce(longest, plain)


def normal_dependency(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def declared(required: Column, dependency: Column) -> Column:
    """Whether some requirement contains the dependency, white space and case aside."""
    return F.exists(required, lambda r: F.contains(normal_dependency(r), normal_dependency(dependency)))


def failure_logs(runs: DataFrame) -> DataFrame:
    """run, log: the last log that a build says it leaves behind (run, text)."""
    found = F.regexp_extract_all("text", F.lit(LEAVING), F.lit(1))
    return runs.select("run", F.try_element_at(found, F.lit(-1)).alias("log"))


def package_log_url(page: Column, package: Column) -> Column:
    """Where a package's log lies below a report page; blanks are %20."""
    return F.concat(F.regexp_extract(page, r"^(https?://[^?#]*/)", 1), F.lit("logs/fail/"), F.replace(F.url_encode(package), F.lit("+"), F.lit("%20")), F.lit("/log.txt"))


def frame_source(html: Column) -> Column:
    """src of the first iframe, with entities read."""
    return F.replace(F.nullif(F.regexp_extract(html, r"(?i)<iframe\s[^>]*src=\"([^\"]*)\"", 1), F.lit("")), F.lit("&amp;"), F.lit("&"))


def status_of_classes(classes: Column) -> Column:
    return F.when(classes.rlike(r"\bfailed\b"), "failed").when(classes.rlike(r"\bsuccessful\b"), "successful")


def snapshot_name(text: Column) -> Column:
    """A version without the word before its number, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(?:snapshot|build)[:\s]+", ""), r"\s+", " "))


def package_report(cells: DataFrame) -> DataFrame:
    """key, package, status, url of report tables (cells as ``triage.table_cells`` gives): rows whose third cell links a result."""
    get = lambda i, c: F.max(F.when(F.col("cell") == i, F.col(c)))
    df = cells.groupBy("key", "row").agg(get(0, "text").alias("package"), get(2, "text").alias("result"), get(2, "href").alias("url"))
    status = F.lower(F.trim("result"))
    return df.filter(F.col("url").isNotNull() & status.isin("failed", "succeeded")).select("key", "package", status.alias("status"), "url")


def selected_package(asks: DataFrame, failed: DataFrame) -> DataFrame:
    """build, spec, status: the named package if it failed once, the only one if none is named, else what hinders. asks: build,
    wanted (null: none named); failed: build, spec."""
    df = asks.join(failed, "build", "left").groupBy("build", "wanted").agg(F.count("spec").alias("n"), F.count_if(F.col("spec") == F.col("wanted")).alias("hits"), F.min("spec").alias("only"))
    named = F.col("wanted").isNotNull()
    status = first_of((named & (F.col("hits") == 1), "selected"), (named & (F.col("hits") > 1), "FAILED_PACKAGE_AMBIGUOUS"), (named, "FAILED_PACKAGE_NOT_FOUND"), (F.col("n") == 1, "selected"), (F.col("n") == 0, "FAILED_PACKAGE_NOT_FOUND"), otherwise="NEEDS_PACKAGE_SELECTION")
    return df.select("build", "wanted", F.when(status == "selected", F.coalesce("wanted", "only")).alias("spec"), status.alias("status"))


def manifest(units: DataFrame) -> DataFrame:
    """unit, line: one JSON object for each unit (unit, state, error), its error parted into code and message."""
    code, message = error_code(F.col("error"))
    return units.select("unit", F.to_json(F.struct(code.alias("error_code"), message.alias("error_message"), F.col("state").alias("state"), F.col("unit").alias("unit"))).alias("line"))


def daily_report(counts: DataFrame, folded: DataFrame) -> DataFrame:
    """report: headline counts, then a line for each build with its architectures (build, arches)."""
    rows = folded.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("build", "arches"))), lambda x: F.concat(F.lit("| "), x["build"].cast("string"), F.lit(" | "), x["arches"], F.lit(" |"))), "\n").alias("rows"))
    head = F.concat(*[x for c in ("units", "done", "failed", "skipped", "contexts") for x in (F.lit(f"- {c}: "), F.col(c).cast("string"), F.lit("\n"))])
    return counts.crossJoin(rows).select(F.concat(F.lit("# Daily report\n"), head, F.lit("\n| build | arches |\n"), "rows").alias("report"))


def suggestion_files(suggestions: DataFrame) -> DataFrame:
    """log_id, name, content of numbered advice (log_id, id, suggester, title), in order of events."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("log_id").orderBy("id", "suggester"))
    return suggestions.withColumn("place", place).select("log_id", F.concat(F.format_string("%02d_", "place"), slug(F.col("suggester")), F.lit(".md")).alias("name"), F.concat(F.lit("# "), "title").alias("content"))
