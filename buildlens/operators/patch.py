"""Contexts and edits for patches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AROUND, JOIN_GAP, MOST_LINES = 8, 2, 400


def source_windows(places: DataFrame) -> DataFrame:
    """Windows of eight lines about each diagnostic (key, line, n_lines), joined where two lines or fewer lie between; 400 lines
    in all of a file, of which the last window may be cut."""
    df = places.select("key", "line", "n_lines", F.greatest(F.lit(1), F.col("line") - AROUND).alias("a"), F.least(F.col("n_lines"), F.col("line") + AROUND).alias("z")).filter("line between 1 and n_lines")
    w = Window.partitionBy("key").orderBy("a", "line")
    seen = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.when(seen.isNull() | (F.col("a") > seen + JOIN_GAP + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.groupBy("key", "island").agg(F.min("a").alias("start_line"), F.max("z").alias("end_line"), F.array_sort(F.collect_set("line")).alias("lines"))
    before = F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1).over(Window.partitionBy("key").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("room", F.lit(MOST_LINES) - before).filter("room > 0")
    return df.select("key", "start_line", F.least(F.col("end_line"), F.col("start_line") + F.col("room") - 1).cast("int").alias("end_line"), "lines")


def context_level(kind: Column, located: Column, matches: Column) -> Column:
    return F.when(~kind.isin("compiler", "werror"), "n/a").when(~located, "C").when(matches == 1, "A").otherwise("B")


def context_mode(ready: Column, clusters: Column, survivors: Column, spec: Column) -> Column:
    return F.when(spec, "spec").when(ready > 0, "fix_all").when(clusters > 0, "clusters").when(survivors >= 2, "multi").otherwise("single")


def suppressed(message: Column, line: Column) -> Column:
    """A source line made of closing signs alone, or with none of the message's names in it."""
    closers = line.rlike(r"^[\s\)\]\};,]*$")
    names = F.filter(F.regexp_extract_all(message, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda t: t.rlike("_|[a-z][A-Z]|[0-9]"))
    return F.when(closers, "structural").when((F.size(names) > 0) & ~F.exists(names, lambda t: F.contains(line, t)), "no_token")


def locate(text: str, old: str, line: int | None) -> int | None:
    """The place of the old text: its only one, or the one nearest to the line; a tie or none is no place."""
    places, at = [], text.find(old) if old else -1
    while at >= 0:
        places.append(at)
        at = text.find(old, at + 1)
    if len(places) <= 1 or not line:
        return places[0] if len(places) == 1 else None
    by = sorted((abs(text.count("\n", 0, p) + 1 - line), p) for p in places)
    return None if by[0][0] == by[1][0] else by[0][1]


def applied_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file, status, diff: a file's edits (old, new, line) put in from the end on, as a unified diff; no place, or two edits
    that overlap, and the file is left as it is. A file and its edits are one group."""

    def run(f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if f.empty or e.empty:
            return pd.DataFrame({"file": [], "status": [], "diff": []}, dtype=object)
        name, text = f["file"].iloc[0], f["text"].iloc[0]
        found = [(locate(text, o, None if pd.isna(n) else int(n)), o, w) for o, w, n in zip(e["old"], e["new"], e["line"])]
        status, diff = "applied", ""
        if any(p is None for p, _, _ in found):
            status = "not_located"
        else:
            found.sort()
            if any(a[0] + len(a[1]) > b[0] for a, b in zip(found, found[1:])):
                status = "overlap"
            else:
                out = text
                for p, o, w in reversed(found):
                    out = out[:p] + w + out[p + len(o) :]
                diff = "".join(difflib.unified_diff(text.splitlines(True), out.splitlines(True), f"a/{name}", f"b/{name}"))
        return pd.DataFrame({"file": [name], "status": [status], "diff": [diff]})

    return files.select("file", "text").groupBy("file").cogroup(edits.select("file", "old", "new", "line").groupBy("file")).applyInPandas(run, "file string, status string, diff string")


def suggestions(ev: DataFrame) -> DataFrame:
    """log_id, id, suggester, title: advice by kind of event."""
    kind = F.col("kind")
    name = F.when(kind == "depsolve", "depsolve").when(kind == "linker_missing", "linker_missing").when(kind == "linker_undef", "linker_undef").when(kind == "patch", "patch_failed").when(kind == "spec_script", "spec_script").when(kind.isin("compiler", "werror"), "compile_error").otherwise("fallback")
    need = F.nullif(F.regexp_extract("message", "(?i)nothing provides (.+?)(?: needed by|$)", 1), F.lit(""))
    title = F.when(kind == "depsolve", F.concat(F.lit("Add BuildRequires: "), need)).when(kind == "linker_missing", F.concat(F.lit("Add BuildRequires: lib"), F.regexp_replace("library", "^lib", ""), F.lit("-devel"))).when(kind == "linker_undef", F.concat(F.lit("Resolve symbol "), "symbol")).otherwise(F.concat(F.lit("Look at "), kind))
    return ev.select("log_id", "id", name.alias("suggester"), title.alias("title"))


def brace_end(lines: DataFrame) -> DataFrame:
    """key, end_line: the first line (key, line_no, text) at which every brace opened so far is closed."""
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    w = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("depth", F.sum(count("{") - count("}")).over(w)).withColumn("opened", F.max(count("{")).over(w) > 0)
    return df.filter("opened and depth <= 0").groupBy("key").agg(F.min("line_no").alias("end_line"))


def spec_sections(lines: DataFrame) -> DataFrame:
    """Lines of a spec (spec, line_no, text) with the section that they stand in; before the first header: preamble."""
    header = F.nullif(F.regexp_extract("text", r"^%(prep|build|install|check|clean|files|description|package|changelog|post|postun|pre|preun)\b", 1), F.lit(""))
    w = Window.partitionBy("spec").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(header, True).over(w), F.lit("preamble")))


def build_requires(lines: DataFrame) -> DataFrame:
    """spec, requirement: of every BuildRequires line, comments off, parted at commas."""
    value = F.regexp_extract("text", r"^BuildRequires:\s*([^#]*)", 1)
    return lines.filter(F.col("text").rlike(r"^BuildRequires:")).select("spec", F.explode(F.transform(F.split(value, ","), lambda v: F.trim(v))).alias("requirement")).filter("requirement <> ''")
