"""What surrounds a cause: source contexts, header declarations, symbols, specs, the last command of a phase; evidence by kind.

Sources are rows (root, path, line_no, text), specs rows (spec, line_no, text). Names meet names by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.operators.packet import evidence_route, level

#: Patterns of sources and specs.
FUNCTION = r"^\s*(?:[A-Za-z_][\w:<>,~*&\s]+\s+)+([A-Za-z_~]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$"
QUOTED = "[`'\"]([A-Za-z_]\\w*)[`'\"]"
HEADER, SOURCE = r"\.(?:h|hh|hpp|hxx)$", r"\.(?:c|cc|cpp|cxx|S|cu|h|hpp)$"
TAG = r"^\s*(BuildRequires|Patch\d*|Source\d*)\s*:\s*(.*?)\s*$"
SECTIONS = "prep|build|install|check|clean|files|package|description|changelog|preun|postun|pretrans|posttrans|pre|post"
TOP_LEVEL = rf"^\s*%({SECTIONS})\b"
FLAG_ASSIGN = r"\b(?:export\s+)?(?:CFLAGS|CXXFLAGS)\b\s*(?:=|\+=)"
CONSUMER = r"^\s*(?:%(?:cmake|configure|make|meson)\b|(?:cmake|configure|make|meson|ninja)(?:\s|$))"
CLANG_IF = r"^\s*%if\s+%\{toolchain_is\s+clang\}\s*$"
DEPENDENCY = r"nothing provides\s+(.+?)(?:\s+needed by\s+(\S+))?$"
SHELL, PHASE = r"^\+\s+(.+?)\s*$", rf"^\+\s+%({SECTIONS})\b"
WINDOW, HEADERS = 30, 5


def group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


# Sources


def functions_of(lines: DataFrame) -> DataFrame:
    """root, path, name, start_line, end_line: function headers, each to the line at which its braces are closed again.

    A line at which the depth falls closes each depth that it falls through, so there are no more closings than closing braces.
    A header whose first brace does not close on its own line ends at the next closing of the depth that it stood at: of one
    window over file and depth, in which headers and closings are together.
    """
    place = Window.partitionBy("root", "path").orderBy("line_no")
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    df = lines.withColumn("net", count("{") - count("}")).withColumn("opens", F.col("text").contains("{")).withColumn("name", group(F.col("text"), FUNCTION, 1))
    df = df.withColumn("depth", F.sum("net").over(place)).withColumn("before", F.col("depth") - F.col("net"))
    first_open = F.first(F.when(F.col("opens"), F.struct(F.col("line_no").alias("line"), "depth")), True).over(place.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("open", first_open)
    starts = df.filter("name is not null and open is not null").select("root", "path", F.col("before").alias("level"), F.col("open.line").alias("at"), F.struct("name", F.col("line_no").alias("start_line"), F.col("open.line").alias("open_line"), F.col("open.depth").alias("open_depth")).alias("header"), F.lit(None).cast("int").alias("closing"))
    falls = df.filter("depth < before").select("root", "path", F.explode(F.expr("sequence(depth, before - 1)")).alias("level"), F.col("line_no").alias("at"), F.lit(None).cast(starts.schema["header"].dataType).alias("header"), F.col("line_no").cast("int").alias("closing"))
    behind = Window.partitionBy("root", "path", "level").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    met = starts.unionByName(falls).withColumn("next", F.first("closing", True).over(behind)).filter("header is not null")
    end = F.when(F.col("header.open_depth") <= F.col("level"), F.col("header.open_line")).otherwise(F.col("next")).cast("int")
    return met.select("root", "path", "header.name", "header.start_line", end.alias("end_line")).filter("end_line is not null")


def holding(asks: DataFrame, functions: DataFrame) -> DataFrame:
    """log_id, id, f (start_line, end_line) of asks (log_id, id, root, path, line): the function of the file that holds the line and
    starts first.

    Only functions that end behind all that start before them can be that; of these, starts and ends ascend together, so it is the
    next one that ends at the line or behind, if it starts by then: one window over each file's asks and functions.
    """
    ahead = Window.partitionBy("root", "path").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    furthest = functions.withColumn("reached", F.max("end_line").over(ahead)).filter("reached is null or end_line > reached")
    held = furthest.select("root", "path", F.col("end_line").alias("at"), F.struct("start_line", "end_line").alias("f"))
    kind = asks.select(F.struct("log_id", "id").alias("ask")).schema["ask"].dataType
    asked = asks.filter("line is not null").select("root", "path", F.col("line").alias("at"), F.lit(None).cast(held.schema["f"].dataType).alias("f"), F.struct("log_id", "id").alias("ask"))
    behind = Window.partitionBy("root", "path").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    met = held.withColumn("ask", F.lit(None).cast(kind)).unionByName(asked).withColumn("f", F.first("f", True).over(behind)).filter("ask is not null")
    return met.filter("f.start_line <= at").select("ask.log_id", "ask.id", "f")


def source_contexts(asks: DataFrame, lines: DataFrame) -> DataFrame:
    """log_id, id, path, start_line, end_line, method, degraded of asks (log_id, id, root, path, line, symbol): the function that
    has the symbol's name, or holds the line, whichever comes first in the file; else the lines about it, which is degraded.
    An ask whose file is not there gives no row. Asks that are equal but for log_id and id are met once, so the window of a file
    holds its places, however many ask for them."""
    what = F.struct("root", "path", "line", "symbol")
    places = asks.select("root", "path", "line", "symbol").distinct().select("*", F.lit(0).alias("log_id"), what.alias("id"))
    met = _contexts_of(places, lines).drop("log_id", "path").withColumnRenamed("id", "place")
    return asks.select("log_id", "id", "path", what.alias("place")).join(met, "place").drop("place")


def _contexts_of(asks: DataFrame, lines: DataFrame) -> DataFrame:
    """The contexts of distinct asks."""
    length = lines.groupBy("root", "path").agg(F.max("line_no").alias("n_lines"))
    df = asks.join(length, ["root", "path"])
    functions = functions_of(lines)
    named = functions.groupBy("root", "path", F.col("name").alias("symbol")).agg(F.min(F.struct("start_line", "end_line")).alias("f"))
    met = asks.join(named, ["root", "path", "symbol"]).select("log_id", "id", "f").unionByName(holding(asks, functions))
    first = met.groupBy("log_id", "id").agg(F.min("f").alias("f"))
    df = df.join(first, ["log_id", "id"], "left")
    centre = F.coalesce("line", F.lit(1))
    return df.select(
        "log_id",
        "id",
        "path",
        F.coalesce("f.start_line", F.greatest(F.lit(1), centre - WINDOW)).cast("int").alias("start_line"),
        F.coalesce("f.end_line", F.least(F.col("n_lines"), centre + WINDOW)).cast("int").alias("end_line"),
        F.when(F.col("f").isNotNull(), "regex_brace").otherwise("line_window").alias("method"),
        F.col("f").isNull().alias("degraded"),
    )


def words_of(lines: DataFrame, files: str) -> DataFrame:
    """root, path, word, line: the first line of each file of that kind on which each word stands."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))
    return lines.filter(F.col("path").rlike(files)).select("root", "path", "line_no", F.explode(words).alias("word")).groupBy("root", "path", "word").agg(F.min("line_no").alias("line"))


def header_declarations(asks: DataFrame, lines: DataFrame, most: int = HEADERS) -> DataFrame:
    """log_id, id, path, line: the first five headers, by path, in which the quoted symbol stands as a whole word."""
    met = asks.filter("symbol is not null").select("log_id", "id", "root", F.col("symbol").alias("word")).join(words_of(lines, HEADER), ["root", "word"])
    place = F.row_number().over(Window.partitionBy("log_id", "id").orderBy("path"))
    return met.withColumn("place", place).filter(F.col("place") <= most).select("log_id", "id", "path", "line")


def symbol_contexts(asks: DataFrame, lines: DataFrame) -> DataFrame:
    """log_id, id, path: the first source, by path, that contains the symbol. Its longest word finds the lines."""
    parts = F.regexp_extract_all("symbol", F.lit(r"\w+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("word")))), 1)["word"]
    asked = asks.filter("symbol is not null").select("log_id", "id", "root", "symbol", longest.alias("word"))
    every = lines.filter(F.col("path").rlike(SOURCE)).select("root", "path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    met = asked.join(every, ["root", "word"]).filter(F.contains("text", "symbol"))
    return met.groupBy("log_id", "id").agg(F.min("path").alias("path"))


# Specs


def located_spec(packages: DataFrame, files: DataFrame) -> DataFrame:
    """root, package, spec, status: the spec of the package's name if there is one, else the only one of the tree."""
    specs = files.filter(F.col("path").endswith(".spec")).withColumn("base", F.substring_index("path", "/", -1))
    df = packages.join(specs, "root", "left").withColumn("exact", F.coalesce(F.col("base") == F.concat("package", F.lit(".spec")), F.lit(False)))
    n = df.groupBy("root", "package").agg(F.count("path").alias("n"), F.count_if("exact").alias("e"), F.min(F.when(F.col("exact"), F.col("path"))).alias("own"), F.min("path").alias("any"))
    status = F.when(F.col("e") == 1, "exact").when(F.col("e") > 1, "ambiguous").when(F.col("n") == 1, "only").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    return n.select("root", "package", F.when(status == "exact", F.col("own")).when(status == "only", F.col("any")).alias("spec"), status.alias("status"))


def spec_tags(lines: DataFrame) -> DataFrame:
    """spec, place, tag, number, value of BuildRequires (a row for each entry), Patch and Source tags, comments off. Lines that
    end in a backslash must be joined already."""
    plain = F.regexp_replace(F.when(~F.ltrim("text").startswith("#"), F.col("text")), r"\s+#.*$", "")
    df = lines.select("spec", "line_no", group(plain, TAG, 1).alias("name"), F.regexp_extract(plain, TAG, 2).alias("raw")).filter("name is not null")
    values = F.when(F.col("name") == "BuildRequires", F.filter(F.transform(F.split("raw", ","), lambda v: F.trim(v)), lambda v: v != "")).otherwise(F.array("raw"))
    df = df.select("spec", "line_no", "name", F.posexplode(values).alias("i", "value"))
    return df.select("spec", (F.row_number().over(Window.partitionBy("spec").orderBy("line_no", "i")) - 1).alias("place"), F.regexp_replace("name", r"\d+$", "").alias("tag"), F.regexp_extract("name", r"(\d+)$", 1).try_cast("int").alias("number"), "value")


def spec_section(lines: DataFrame, name: str) -> DataFrame:
    """spec, start_line, end_line, body of the first section of that name, up to the next top-level header."""
    is_own = F.lower(F.regexp_extract("text", r"^\s*%([A-Za-z][A-Za-z0-9_]*)\b", 1)) == name.lstrip("%").lower()
    of = Window.partitionBy("spec")
    df = lines.withColumn("first", F.min(F.when(is_own, F.col("line_no"))).over(of)).filter("first is not null")
    df = df.withColumn("next", F.min(F.when((F.col("line_no") > F.col("first")) & F.lower("text").rlike(TOP_LEVEL), F.col("line_no"))).over(of))
    body = df.filter("line_no > first and (next is null or line_no < next)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return body.groupBy("spec", "first", "next").agg(F.max("line_no").alias("end_line"), F.regexp_replace(text, r"^\n+|\n+$", "").alias("body")).select("spec", (F.col("first") + 1).alias("start_line"), "end_line", "body")


def spec_warnings(lines: DataFrame) -> DataFrame:
    """spec, warnings: what the plain reading of a spec leaves open."""
    some = lambda c, name: F.when(F.bool_or(c), name)
    text = F.col("text")
    return lines.groupBy("spec").agg(F.array_join(F.array_compact(F.array(some(text.contains("%{"), "macros_present_not_expanded"), some(text.rlike(r"^\s*%if"), "conditionals_present_not_evaluated"), some(text.rlike(r"^\s*%package\b"), "subpackages_present_not_resolved"))), ",").alias("warnings"))


def toolchain_flag_point(lines: DataFrame, options: list[str]) -> DataFrame:
    """spec, insert_after, advisory: where options that the toolchain does not know can be stripped in %build: after the last
    assignment of compiler flags that has one, before the first command that uses the flags, in an existing guarded block if
    there is one between. Else why not."""
    of = Window.partitionBy("spec")
    least = lambda c: F.min(F.when(c, F.col("line_no"))).over(of)
    text, line = F.col("text"), F.col("line_no")
    df = lines.withColumn("build", least(text.rlike(r"^\s*%build\b")))
    df = df.withColumn("stop", least((line > F.col("build")) & text.rlike(TOP_LEVEL)))
    inside = (line > F.col("build")) & (F.col("stop").isNull() | (line < F.col("stop")))
    option = F.lit(False)
    for o in options:
        option |= text.contains(o)
    assigns = inside & text.rlike(FLAG_ASSIGN) & ~text.contains("${CFLAGS/") & ~text.contains("${CXXFLAGS/") & option
    df = df.withColumn("flags", F.max(F.when(assigns, line)).over(of)).withColumn("consumer", least(inside & text.rlike(CONSUMER)))
    between = (line > F.col("flags")) & (line < F.col("consumer"))
    df = df.withColumn("guard", least(between & text.rlike(CLANG_IF)))
    step = F.when(F.ltrim("text").startswith("%if"), 1).when(text.rlike(r"^\s*%endif\b"), -1).otherwise(0)
    in_guard = (line >= F.col("guard")) & (line < F.col("consumer"))
    df = df.withColumn("depth", F.sum(F.when(in_guard, step).otherwise(0)).over(of.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("closed", least(in_guard & text.rlike(r"^\s*%endif\b") & (F.col("depth") == 0)))
    one = df.groupBy("spec").agg(*[F.first(c).alias(c) for c in ("build", "flags", "consumer", "guard", "closed")])
    advisory = (
        F.when(F.col("build").isNull(), "no_build_section")
        .when(F.col("flags").isNull(), "options_not_found")
        .when(F.col("consumer").isNull(), "no_consumer")
        .when(F.col("flags") >= F.col("consumer"), "flags_after_consumer")
        .when(F.col("guard").isNotNull() & F.col("closed").isNull(), "unsafe_block")
    )
    return one.select("spec", F.when(advisory.isNull(), F.coalesce(F.col("closed") - 1, F.col("flags"))).alias("insert_after"), advisory.alias("advisory"))


def last_commands(lines: DataFrame, phases: DataFrame) -> DataFrame:
    """log_id, phase, last_command, output_lines: the last shell command of a log's phase and how many lines follow it up to the
    next. lines: log_id, line_no, text; phases: log_id, phase (as %build). A phase without a marker is the whole log."""
    marker = F.lower(group(F.col("text"), PHASE, 1))
    own = F.lower(F.regexp_replace("phase", "^%", ""))
    of = Window.partitionBy("log_id", "phase")
    df = lines.withColumn("marker", marker).join(phases, "log_id").withColumn("own", own)
    df = df.withColumn("start", F.min(F.when(F.col("marker") == F.col("own"), F.col("line_no"))).over(of))
    df = df.withColumn("stop", F.min(F.when(F.col("marker").isNotNull() & (F.col("line_no") > F.col("start")), F.col("line_no"))).over(of))
    df = df.filter("start is null or (line_no > start and (stop is null or line_no < stop))")
    df = df.withColumn("command", F.when(F.col("marker").isNull(), group(F.col("text"), SHELL, 1)))
    df = df.withColumn("at", F.max(F.when(F.col("command").isNotNull(), F.col("line_no"))).over(of))
    after = df.filter("line_no > at").groupBy("log_id", "phase").agg(F.min(F.when(F.col("text").rlike(SHELL), F.col("line_no"))).alias("next"), F.max("line_no").alias("end"))
    one = df.filter("line_no = at").select("log_id", "phase", F.col("command").alias("last_command"), "at")
    return one.join(after, ["log_id", "phase"], "left").select("log_id", "phase", "last_command", F.coalesce(F.coalesce(F.col("next") - 1, F.col("end")) - F.col("at"), F.lit(0)).cast("int").alias("output_lines"))


# By kind


def missing_dependency(message: Column) -> tuple[Column, Column]:
    """What is missing, else the whole message, and what needs it."""
    return F.coalesce(group(message, DEPENDENCY, 1), F.trim(message)), group(message, DEPENDENCY, 2)


def granted(semantic_class: Column, pool: Column) -> Column:
    """Undefined references alone ask for the level that looks for symbols."""
    return F.least(F.when(semantic_class == "undefined_reference", 900).otherwise(600), pool)


def collected(cand: DataFrame, contexts: DataFrame, headers: DataFrame, symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """log_id, id, collector, level, contains, degraded, warnings, methods of causes (with kind, message, symbol, granted).

    contexts, headers, symbols as above; specs: log_id, spec, warnings. What a level does not ask for is not in ``contains``.
    """
    ctx = contexts.select("log_id", "id", "method", F.col("degraded").alias("ctx_degraded"))
    hdr = headers.groupBy("log_id", "id").agg(F.count(F.lit(1)).alias("n_headers"))
    sym = symbols.select("log_id", "id", F.lit(True).alias("has_symbol"))
    df = cand.join(ctx, ["log_id", "id"], "left").join(hdr, ["log_id", "id"], "left").join(sym, ["log_id", "id"], "left").join(specs.select("log_id", "spec"), "log_id", "left")
    route, lvl = evidence_route(F.col("kind")), level(F.col("granted"))
    is_ = lambda r, at=1: (route == r) & (lvl >= at)
    spec, ctx_there = F.col("spec").isNotNull(), F.col("method").isNotNull()
    wants_symbol = is_("link", 3) & F.col("symbol").isNotNull()
    put = lambda when, name: F.when(when, F.lit(name))
    contains = F.array_compact(
        F.array(
            put(route.isNotNull(), "primary_error"),
            put(is_("compile"), "command_summary"),
            put(is_("compile", 2) & ctx_there, "source_snippet"),
            put(is_("compile", 3), "header_declarations"),
            put(is_("link"), "link_command"),
            put((is_("link", 2) | is_("deps", 2) | is_("spec", 3)) & spec, "spec_buildrequires"),
            put(wants_symbol & F.col("has_symbol"), "symbol_context"),
            put(is_("spec") & spec, "spec_section_text"),
            put(is_("spec") & spec, "spec_parse_status"),
            put(is_("spec", 2) & spec, "failure_context"),
            put(is_("spec", 3) & spec, "spec_patches"),
            put(is_("spec", 3) & spec, "spec_sources"),
            put(is_("deps"), "missing_dependency"),
        )
    )
    warnings = F.array_compact(
        F.array(
            put(is_("compile", 2) & ~ctx_there, "source_file_unavailable"),
            put(wants_symbol & F.col("has_symbol").isNull(), "symbol_context_unavailable"),
            put((is_("spec") | is_("deps", 2)) & ~spec, "spec_file_unavailable"),
        )
    )
    degraded = (F.size(warnings) > 0) | (is_("compile", 2) & F.coalesce("ctx_degraded", F.lit(False)))
    return df.select("log_id", "id", route.alias("collector"), F.when(route.isNotNull(), lvl).alias("level"), contains.alias("contains"), degraded.alias("degraded"), warnings.alias("warnings"), F.when(is_("compile", 2), F.col("method")).alias("method"), F.coalesce("n_headers", F.lit(0)).alias("n_headers"))
