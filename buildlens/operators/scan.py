"""Log lines to phases, commands and diagnostic events, by parts of logs.

What a line says by itself is worked out where it is read. Then lines are dealt by log and range of line numbers, a part. Windows
see a part alone; what a part hands to those behind it, the carry, is one row: its last marker and command, how many commands
and events it has, whether a command goes on at its end. Carries are composed in order, and joined back to the parts' lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from buildlens.functions import patterns as P
from buildlens.operators.ends import ending

#: Lines of a part. A log of fewer is one; one of many millions is dealt over many tasks.
PART_LINES = 100_000


def in_order() -> WindowSpec:
    return Window.partitionBy("log_id").orderBy("line_no")


def part_of(line_no: Column) -> Column:
    return F.floor((line_no - 1) / PART_LINES).cast("int")


def in_part(name: str = "part") -> WindowSpec:
    return Window.partitionBy("log_id", name).orderBy("line_no")


def up_to(w: WindowSpec, last: int) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def parts_before(name: str = "part") -> WindowSpec:
    """Over carries, one row for each part: all parts of the log that come before."""
    return up_to(Window.partitionBy("log_id").orderBy(name), -1)


def last_of(value: Column, given: Column | None = None) -> Column:
    """Of a part: the value of its last line that has one."""
    return F.max_by(value, F.when(value.isNotNull() if given is None else given, F.col("line_no")))


def last_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the last row of the log before this one that has one. Needs log_id and line_no; rows
    of a log are windowed by parts."""
    df = rows.withColumn("_part", part_of(F.col("line_no"))).withColumn("_value", value)
    df = df.withColumn("_own", F.last("_value", True).over(up_to(in_part("_part"), -1)))
    carry = df.groupBy("log_id", "_part").agg(last_of(F.col("_value")).alias("_last"))
    carry = carry.select("log_id", "_part", F.last("_last", True).over(parts_before("_part")).alias("_before"))
    return df.join(carry, ["log_id", "_part"]).withColumn(name, F.coalesce("_own", "_before")).drop("_part", "_value", "_own", "_before")


def group(text: Column, pattern: str, n: int) -> Column:
    """The n-th group where the pattern is found, else null; an optional group that took no part is null too."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def normalise(lines: DataFrame) -> DataFrame:
    """text without ANSI codes and the leading seconds, which go to gbs_seconds."""
    raw, plain = F.col("raw_text"), F.col("_plain")
    timed = plain.startswith("[")
    df = lines.withColumn("_plain", F.when(raw.contains("\u001b"), F.regexp_replace(raw, P.ANSI, "")).otherwise(raw))
    df = df.withColumn("text", F.when(timed, F.regexp_replace(plain, P.SECONDS, "")).otherwise(plain))
    return df.withColumn("gbs_seconds", F.when(timed, group(plain, P.SECONDS, 1)).try_cast("int")).drop("_plain")


def with_offsets(lines: DataFrame) -> DataFrame:
    """raw_offset: bytes of the lines before, each with its line feed."""
    df = lines.withColumn("_part", part_of(F.col("line_no"))).withColumn("_size", F.octet_length("raw_text") + 1)
    df = df.withColumn("_own", F.sum("_size").over(up_to(in_part("_part"), -1)))
    carry = df.groupBy("log_id", "_part").agg(F.sum("_size").alias("_all"))
    carry = carry.select("log_id", "_part", F.sum("_all").over(parts_before("_part")).alias("_before"))
    offset = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return df.join(carry, ["log_id", "_part"]).withColumn("raw_offset", offset.cast("long")).drop("_part", "_size", "_own", "_before")


def dealt(lines: DataFrame) -> DataFrame:
    """Lines by log and part. The number of partitions is the session's, and stays: what follows works hard on few bytes, so
    partitions are not to be taken together by their size."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.withColumn("part", part_of(F.col("line_no"))).repartition(n, "log_id", "part")


def annotate(read: DataFrame) -> DataFrame:
    """Lines, as ``classify`` gives them, with is_continuation, phase, command_no so far, tool of the last command, and events_before:
    the number of events of the log's parts before.

    A line goes on a command if the last line before it that is a phase marker, a command, or does not end in a
    backslash, is a command that ends in one. In a part, lines up to the first such one depend on the part before.
    """
    df = dealt(read.withColumn("is_event", F.col("fact").isNotNull()))  # the carry needs no more of a fact, and so does not shuffle it
    settles = F.col("marker").isNotNull() | F.col("is_command") | ~F.col("goes_on")
    open_end = F.when(settles, F.col("is_command") & F.col("goes_on"))
    own = up_to(in_part(), 0)
    df = df.withColumn("own_open", F.last(open_end, True).over(up_to(in_part(), -1)))
    df = df.withColumn("own_phase", F.last("marker", True).over(own)).withColumn("own_commands", F.sum(F.col("is_command").cast("int")).over(own))
    df = df.withColumn("own_tool", F.last(F.when(F.col("is_command"), F.struct("tool")), True).over(own))
    is_event = F.col("is_event")
    carry = df.groupBy("log_id", "part").agg(
        last_of(F.col("marker")).alias("marker"),
        last_of(open_end, settles).alias("open_end"),
        last_of(F.struct("tool"), F.col("is_command")).alias("tool"),
        F.count_if("is_command").alias("commands"),
        F.count_if(is_event & ~F.col("own_open")).alias("events"),
        F.count_if(is_event & F.col("own_open").isNull()).alias("if_closed"),  # events unless a command goes on from the part before
    )
    ahead = parts_before()
    carry = carry.select("log_id", "part", "events", "if_closed", F.last("marker", True).over(ahead).alias("phase_in"), F.last("open_end", True).over(ahead).alias("open_in"), F.last("tool", True).over(ahead).alias("tool_in"), F.coalesce(F.sum("commands").over(ahead), F.lit(0)).alias("commands_in"))
    certain = F.col("events") + F.when(F.coalesce("open_in", F.lit(False)), 0).otherwise(F.col("if_closed"))
    carry = carry.withColumn("events_before", F.coalesce(F.sum(certain).over(ahead), F.lit(0))).drop("events", "if_closed")
    df = df.join(carry, ["log_id", "part"])
    goes = F.col("marker").isNull() & ~F.col("is_command") & F.coalesce("own_open", "open_in", F.lit(False))
    df = df.withColumn("is_continuation", goes).withColumn("phase", F.coalesce("own_phase", "phase_in")).withColumn("command_no", (F.col("own_commands") + F.col("commands_in")).cast("int"))
    return df.withColumn("tool", F.coalesce("own_tool", "tool_in")["tool"]).drop("own_open", "own_phase", "own_commands", "own_tool", "phase_in", "open_in", "tool_in", "commands_in", "is_event")


def scanned(lines: DataFrame) -> DataFrame:
    return annotate(classify(normalise(lines)))


def phases(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("marker").isNotNull()).select("log_id", F.col("marker").alias("phase"), "line_no")


def numbered(letter: str, no: Column) -> Column:
    """The letter and a number from 0 with three digits at least; a formatter would cost many times as much an event."""
    digits = no.cast("string")
    return F.concat(F.lit(letter), F.when(no < 1000, F.lpad(digits, 3, "0")).otherwise(digits))


def command_id(no: Column) -> Column:
    return F.when(no > 0, numbered("C", no))


def commands(annotated: DataFrame) -> DataFrame:
    """One row for each command: its lines joined, shortened to 200 with head and tail, whole if under 500, and its tool."""
    part = F.trim(F.regexp_replace(F.when(F.col("is_command"), group(F.col("text"), P.COMMAND, 1)).otherwise(F.col("text")), P.CONTINUES, ""))
    rows = annotated.filter("is_command or is_continuation").select("log_id", "command_no", "line_no", "phase", "is_command", part.alias("part"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), lambda p: p != ""), " ")
    df = rows.groupBy("log_id", "command_no").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("is_command"), F.col("phase"))).alias("phase"), F.count(F.lit(1)).cast("int").alias("n_lines"), joined.alias("argv"))
    plain = F.trim(F.regexp_replace("argv", r"\s+", " "))
    short = F.when(F.length(plain) <= 200, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, 100)), F.lit(" ... "), F.ltrim(F.right(plain, F.lit(95)))))
    df = df.withColumn("argv_short", short)
    return df.select("log_id", command_id(F.col("command_no")).alias("id"), "line_no", "phase", "n_lines", "argv_short", F.when(F.length("argv") < 500, F.col("argv")).alias("argv_full"), tool_of(F.col("argv_short")).alias("tool"), F.regexp_extract_all("argv", F.lit(P.RESPONSE_FILE), F.lit(1)).alias("rsp_files"))


def tool_of(argv: Column) -> Column:
    """Base name of the first word; quoted executables keep their quotes out."""
    return F.nullif(F.substring_index(F.regexp_replace(F.regexp_extract(argv, r"^\s*(\"[^\"]*\"|'[^']*'|\S+)", 1), "[\"']", ""), "/", -1), F.lit(""))


def _patch() -> Column:
    """Which patch pattern is the first found, from 1."""
    which = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(P.PATCH, 1))):
        which = F.when(F.col("text").rlike(pattern), i).otherwise(which)
    return which


def _patch_group(name: str) -> Column:
    """A group of the pattern found."""
    out = F.lit(None).cast("string")
    for i, (pattern, names) in enumerate(P.PATCH, 1):
        if name in names:
            out = F.when(F.col("patch") == i, group(F.col("text"), pattern, names.index(name) + 1)).otherwise(out)
    return out


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The whole and all groups of the first place where the pattern is found, in one go; null where it is not. Groups that took no
    part are empty."""
    flags, body = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    between = "\u0001"
    marked = F.regexp_replace(text, rf"{flags}\A[\s\S]*?{body}[\s\S]*\z", between + between.join(f"${i}" for i in range(1, n + 1)))
    each = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.call_function("regexp_extract", text, F.lit(pattern), i))
    one_by_one = F.when(text.rlike(pattern), each)
    return F.when(text.contains(between), one_by_one).when(marked.startswith(between), F.split(marked, between))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a line, in an array that is exploded: a plain column would be copied into
    every place that names it. The array is a column of its own, and the outer explode infers no filter that would work it out again."""
    df = df.withColumn("_xs", F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", F.explode_outer("_xs").alias("_x")).select("*", *[f"_x.{n}" for n in columns]).drop("_xs", "_x")


#: Of some kinds, the pattern whose first group is what their event has of the line.
TAKEN = {"make_cascade": P.MAKE, "linker_missing": P.MISSING_LIBRARY, "linker_undef": P.UNDEFINED, "rpm_phase": P.RPM_PHASE, "unknown_option": P.UNKNOWN_OPTION}


def classify(lines: DataFrame) -> DataFrame:
    """What each line says by itself: marker (the phase that starts), is_command, goes_on (it ends in a backslash), tool (of a
    command), and fact: what it is as an event, if it goes on no command. No shuffle.

    The first branch of an ordered case decides the kind. A pattern is tried only where the words are that each of its matches has,
    and what a kind takes from its line is read in a step of its own: steps of much code are never compiled to machine code.
    """
    text, low = F.col("text"), F.col("low")
    marker = F.when(text.startswith("+"), group(text, P.PHASE, 1)).when(text.startswith("Executing("), group(text, P.EXECUTING, 1))
    df = lines.withColumn("marker", marker)
    df = df.withColumn("is_command", F.col("marker").isNull() & text.startswith("+") & text.rlike(P.COMMAND)).withColumn("goes_on", text.contains("\\") & text.rlike(P.CONTINUES))
    df = df.withColumn("tool", F.when(F.col("is_command"), tool_of(group(text, P.COMMAND, 1))))
    df = _once(df, low=F.when(F.col("marker").isNull() & ~F.col("is_command"), F.lower("text")))  # null: no words, so no event
    patches = low.contains("patch") | low.contains("hunk")
    places = (low.contains("error:") | low.contains("warning:")) & (low.contains(".c") | low.contains(".s") | low.contains(".h"))
    df = _once(df, patch=F.when(patches, _patch()), place=F.when(places, _groups(text, P.COMPILER, 5)))
    compiler = F.col("place").isNotNull()
    kind = (
        F.when(low.contains("nothing provides"), "depsolve")
        .when(F.col("patch").isNotNull(), "patch")
        .when(low.contains("file not found:") | low.contains("installed (but unpackaged) file(s) found"), "install_missing")
        .when(low.contains("-wunknown-warning-option") & text.rlike(P.UNKNOWN_OPTION), "unknown_option")
        .when(compiler & low.contains("-werror"), "werror_located")
        .when(low.contains("all warnings being treated as errors") | (low.contains("[-werror") & text.rlike(P.WERROR)), "werror")
        .when(low.contains("cannot find -l") & text.rlike(P.MISSING_LIBRARY), "linker_missing")
        .when(low.contains("undefined reference") & text.rlike(P.UNDEFINED), "linker_undef")
        .when(compiler, "compiler")
        .when(low.contains("bad exit status") & text.rlike(P.RPM_PHASE), "rpm_phase")
        .when(low.contains("*** ") & text.rlike(P.MAKE), "make_cascade")
        .when(low.contains("spec file") & low.contains("error"), "spec_script")
        .when(low.contains("error:") | low.contains("fatal:"), "raw_error")
    )
    df = _once(df, branch=kind)
    branch = F.col("branch")
    of = lambda name, value: F.when(branch == name, value)
    taken = F.lit(None).cast("string")
    for name, pattern in TAKEN.items():
        taken = F.when(branch == name, group(text, pattern, 1)).otherwise(taken)
    df = _once(df, taken=taken, **{f"patch_{n}": of("patch", _patch_group(n)) for n in ("num", "total", "line", "file")})
    located = branch.isin("werror_located", "compiler")
    at = lambda n: F.when(located, F.nullif(F.col("place")[n], F.lit("")))
    message = (
        F.when(located, F.col("place")[5])
        .when((branch == "patch") & low.contains("can't find file to patch"), F.concat(F.lit("error: patch failed: "), text))
        .when((branch == "patch") & low.contains("hunk") & low.contains("ignored") & ~low.startswith("hunk"), F.concat(F.lit("Hunk #"), F.coalesce("patch_num", F.lit("1")), F.lit(" FAILED: "), text))
        .otherwise(text)
    )
    fact = F.struct(
        F.when(branch.isin("unknown_option", "werror_located"), "werror").otherwise(branch).alias("kind"),
        F.when(F.lower(at(4)) == "warning", "warning").otherwise("error").alias("severity"),
        message.alias("message"),
        at(1).alias("file"),
        at(2).try_cast("int").alias("line"),
        at(3).try_cast("int").alias("column"),
        of("make_cascade", F.col("taken")).alias("target"),
        of("linker_missing", F.col("taken")).alias("library"),
        of("linker_undef", F.col("taken")).alias("symbol"),
        of("rpm_phase", F.col("taken")).alias("exit_phase"),
        of("unknown_option", F.col("taken")).alias("warning_option"),
        *[f"patch_{n}" for n in ("num", "total", "line", "file")],
        F.when(located, F.lower(at(1)).endswith(".s")).alias("is_assembler"),
    )
    return df.withColumn("fact", F.when(branch.isNotNull(), fact)).drop("low", "patch", "place", "branch", "taken", *[f"patch_{n}" for n in ("num", "total", "line", "file")])


FACTS = ("kind", "severity", "message", "line_no", "phase", "command_id", "file", "line", "column", "target", "tool", "library", "symbol", "exit_phase", "warning_option", "patch_num", "patch_total", "patch_line", "patch_file", "is_assembler")


def events(annotated: DataFrame) -> DataFrame:
    """Diagnostic events: the facts of lines that go on no command; seq and id count them in each log."""
    df = annotated.filter("fact is not null and not is_continuation")
    df = df.withColumn("seq", (F.col("events_before") + F.row_number().over(in_part())).cast("int")).withColumn("command_id", command_id(F.col("command_no")))
    own = {"line_no", "phase", "command_id", "tool"}
    return df.select("log_id", numbered("E", F.col("seq")).alias("id"), "seq", *[F.col(c) if c in own else F.col(f"fact.{c}").alias(c) for c in FACTS])


def patch_parents(ev: DataFrame) -> DataFrame:
    """log_id, id, patch_parent of a failed %prep: the last patch event before it in that phase. Only these two kinds are windowed."""
    patch = (F.col("kind") == "patch") & (F.col("phase") == "%prep")
    failed = (F.col("kind") == "rpm_phase") & (F.col("exit_phase") == "%prep")
    rows = ev.filter(patch | failed).select("log_id", "line_no", "id", patch.alias("is_patch"))
    df = last_before(rows, F.when(F.col("is_patch"), F.col("id")), "patch_parent")
    return df.filter("not coalesce(is_patch, false) and patch_parent is not null").select("log_id", "id", "patch_parent")


def cascade_parents(ev: DataFrame) -> DataFrame:
    """log_id, id, cascade_parent: the one source event whose object a failed make target ends with.

    Object names, which have no slash, are looked up in the target's last segment. Of each file that fits, the latest event before
    the cascade counts, found by a window over the file's events and the cascades that ask for it; two events make none the parent.
    """
    base = F.substring_index("file", "/", -1)
    sources = ev.filter(F.col("file").isNotNull() & F.col("file").rlike(P.SOURCE_FILE)).select("log_id", "file", "seq", F.col("id").alias("event"), base.alias("base"))
    names = sources.select("log_id", "file", F.explode(F.array(F.concat(F.regexp_replace("base", r"\.[^.]*$", ""), F.lit(".o")), F.concat("base", F.lit(".o")))).alias("object")).distinct()
    targets = ev.filter("kind = 'make_cascade' and target is not null").select("log_id", F.struct("id", "seq").alias("ask"), F.substring_index("target", "/", -1).alias("text"))
    met = ending(names.withColumnRenamed("object", "name"), targets, "log_id").withColumnRenamed("name", "object")
    asked = met.join(names, ["log_id", "object"]).select("log_id", "file", "ask.seq", "ask.id").distinct()
    both = sources.select("log_id", "file", "seq", "event", F.lit(None).cast("string").alias("id")).unionByName(asked.withColumn("event", F.lit(None).cast("string")))
    by_file = Window.partitionBy("log_id", "file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("parent", F.last("event", True).over(by_file)).filter("id is not null and parent is not null")
    return latest.groupBy("log_id", "id").agg(F.min("parent").alias("cascade_parent"), F.max("parent").alias("other")).filter("cascade_parent = other").drop("other")


#: Kinds of events that may have a parent.
ASKING = ("rpm_phase", "make_cascade")


def parents_of(ev: DataFrame) -> DataFrame:
    """log_id, id, parent: of a failed %prep or a failed make target, which are events of different kinds, so one join brings both."""
    return patch_parents(ev).withColumnRenamed("patch_parent", "parent").unionByName(cascade_parents(ev).withColumnRenamed("cascade_parent", "parent"))


def with_parents(ev: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """parent, from ``parents_of``. Only events of the kinds that may have one are joined."""
    asks = F.coalesce(F.col("kind").isin(*ASKING), F.lit(False))
    met = ev.filter(asks).join(parents_of(ev) if parents is None else parents, ["log_id", "id"], "left")
    return met.unionByName(ev.filter(~asks).withColumn("parent", F.lit(None).cast("string")))


def failed_phases(ev: DataFrame) -> DataFrame:
    """log_id, failed_phase: the phase of the log's last event that has one and is no make cascade."""
    return ev.groupBy("log_id").agg(F.max_by("phase", F.when((F.col("kind") != "make_cascade") & F.col("phase").isNotNull(), F.col("line_no"))).alias("failed_phase"))


def with_failed_phase(ev: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """failed_phase of the log, from ``failed_phases``."""
    return ev.join(failed_phases(ev) if phases is None else phases, "log_id")


def cascade_summary(ev: DataFrame) -> DataFrame:
    """log_id, summary: each failed make target -> its parent, in order."""
    rows = ev.filter("kind = 'make_cascade'")
    pairs = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" -> ", F.coalesce("target", F.lit("<unknown>")), F.coalesce("parent", F.lit("unlinked"))).alias("s"))))
    return rows.groupBy("log_id").agg(F.concat(F.lit("make cascade: "), F.array_join(F.transform(pairs, lambda x: x["s"]), "; ")).alias("summary"))


def log_window(lines: DataFrame, around: DataFrame, ahead: int = 30, after: int = 20) -> DataFrame:
    """Lines from ``ahead`` before to ``after`` after of the given lines (log_id, at): each asks for its lines by number, so the join is by equality."""
    wanted = around.select("log_id", "at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - ahead), F.col("at") + after)).alias("line_no"))
    return wanted.join(lines, ["log_id", "line_no"])
