"""A rule library as data: first match, verdicts with evidence, and why a candidate still needs a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.operators import rule_index

#: Rows of a library that stand in the plan.
IN_PLAN = 100
LINKERS = ["ld", "lld", "gold", "clang", "clang++", "gcc", "g++"]
QUOTE = "['`\"]"
WARN_INFO, WARN = ["warning:", "info:"], ["warning:"]
ASK = "; for more context run expand."
#: id, category, tier, kinds, [(pattern, group names)], tools, outside warning blocks, negatives, confidence, evidence of the second tier.
#: Fixed values, in order of precedence. The answers' wording is this library's own and may be changed.
RULES = [
    ("depsolve_nothing_provides", "depsolve_failure", "tier1", ["depsolve"], [("nothing provides (.+?)(?: needed by|$)", ["requirement"])], None, False, ["warning only", "info:"], 0.96, ["missing_dependency", "spec_buildrequires"]),
    ("patch_failed_standard", "patch_failed", "tier1", ["patch"], [(r"Patch\s*#?(\d+)\s*(?:\(.*\))?\s*failed", ["num"])], None, False, WARN_INFO, 0.96, None),
    ("patch_failed_hunk", "patch_failed", "tier1", ["patch"], [(r"Hunk\s*#?(\d+)\s*FAILED", ["num"])], None, False, WARN_INFO, 0.95, None),
    ("patch_failed_at_line", "patch_failed", "tier1", ["patch"], [(r"patch:?\s*\*\*\*\*\s*malformed patch at line (\d+)", ["line"]), (r"patch failed:\s*([^\s]+):(\d+)", ["file", "line"])], None, False, WARN_INFO, 0.95, None),
    ("patch_failed_rpm", "patch_failed", "tier1", ["patch"], [("error: patch failed", []), (r"error:\s*Patch[\d:]+\s*failed", [])], None, False, WARN_INFO, 0.95, None),
    ("linker_missing_library", "linker_missing_lib", "tier1", ["linker_missing"], [("cannot find -l([A-Za-z0-9_.+-]+)", ["library"])], LINKERS, True, WARN_INFO, 0.97, ["link_command", "spec_buildrequires"]),
    ("install_file_not_found", "install_file_missing", "tier1", ["install_missing"], [(r"File not found:\s*(.+)", ["path"]), (r"Installed \(but unpackaged\) file\(s\) found", [])], None, False, WARN_INFO, 0.96, None),
    ("compile_no_member_tier2", "compile_error", "tier2", ["compiler"], [("(?:has no member named|no member named) ['`\"]?([A-Za-z_][A-Za-z0-9_]*)", ["member"])], None, False, WARN, 0.88, ["primary_error", "command_summary", "source_snippet"]),
    ("compile_undeclared_identifier_tier2", "compile_error", "tier2", ["compiler"], [(f"{QUOTE}([A-Za-z_][A-Za-z0-9_]*){QUOTE} (?:undeclared|was not declared in this scope)", ["identifier"]), (r"\b([A-Za-z_][A-Za-z0-9_]*) was not declared in this scope", ["identifier"]), (f"undeclared identifier {QUOTE}([A-Za-z_][A-Za-z0-9_]*){QUOTE}", ["identifier"])], None, False, WARN, 0.86, ["primary_error", "command_summary", "source_snippet"]),
    ("linker_undefined_reference_tier2", "undefined_reference", "tier2", ["linker_undef"], [("undefined reference to [`'\"](.+?)[`'\"]", ["symbol"])], LINKERS, False, WARN, 0.87, ["primary_error", "link_command", "symbol_context"]),
    ("rpm_phase_failure_tier2", "rpm_phase_failure", "tier2", ["rpm_phase"], [(r"Bad exit status from .*\((%\w+)\)", ["phase"])], None, False, WARN, 0.86, ["primary_error", "spec_section_text", "failure_context"]),
    ("spec_script_parse_error_tier2", "spec_script_error", "tier2", ["spec_script"], [("spec file.*error[: ]+(.+)", ["reason"])], None, False, WARN, 0.86, ["primary_error", "spec_section_text", "spec_parse_status"]),
]
ANSWERS = {
    "depsolve_failure": ("A BuildRequires may be missing or a repository off" + ASK, "{requirement} has no provider; the spec's BuildRequires are at hand: add it or enable its repository."),
    "patch_failed": ("A patch usually does not fit this source version" + ASK, None),
    "linker_missing_lib": ("A library is usually not installed or its path missing" + ASK, "The linker lacks lib{library}; check its name, path and BuildRequires."),
    "install_file_missing": ("The file list may differ from what is installed" + ASK, None),
    "compile_error": (None, "Compilation failed at {member}{identifier}; check its declaration and headers."),
    "undefined_reference": (None, "{symbol} stays unresolved; check the objects linked and the libraries."),
    "rpm_phase_failure": (None, "The script of {phase} failed; check its last command."),
    "spec_script_error": (None, "The spec does not parse: {reason}."),
}
SCHEMA = "rule_ord int, regex_ord int, rule string, category string, tier string, kind string, regex string, names array<string>, tools array<string>, outside_warning_block boolean, negative string, confidence double, tier1 boolean, tier1_template string, tier2 boolean, tier2_evidence array<string>, tier2_template string"


def rule_rows(rules: list = RULES, answers: dict = ANSWERS) -> list[tuple]:
    out = []
    for i, (name, category, tier, kinds, regexes, tools, outside, negatives, confidence, evidence) in enumerate(rules):
        one, two = answers.get(category, (None, None))
        for kind in kinds:
            for j, (regex, names) in enumerate(regexes):
                out.append((i, j, name, category, tier, kind, "(?i)" + regex, names, tools, outside, "(?i)" + "|".join(negatives), confidence, tier == "tier1" and one is not None, one, evidence is not None, evidence, two))
    return out


def rule_frame(spark: SparkSession, rules: list = RULES, answers: dict = ANSWERS) -> DataFrame:
    """A row for each rule, kind and pattern; the library is written by hand and so is small."""
    return spark.createDataFrame(rule_rows(rules, answers), SCHEMA)


def rule_violations(frame: DataFrame) -> DataFrame:
    """rule, violation: what a first-tier rule must not be."""
    allowed = ["depsolve_failure", "patch_failed", "linker_missing_lib", "install_file_missing"]
    one = frame.filter("tier = 'tier1'").dropDuplicates(["rule"])
    most = F.when(F.col("category") == "patch_failed", 150).otherwise(300)
    checks = F.array(F.when(~F.col("category").isin(*allowed), "category"), F.when(F.col("confidence") < 0.95, "confidence"), F.when(F.length("tier1_template") > most, "template too long"), F.when(~F.col("tier1_template").rlike(r"\b(may|usually|suggest)\b"), "template not cautious"), F.when(~F.col("tier1_template").contains("expand"), "template without expand"))
    return one.select("rule", F.explode(F.array_compact(checks)).alias("violation"))


def _hits(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with each rule of their kind of which a pattern is found and no negative one.

    Patterns of a library of a few rows stand in the plan as constants and are compiled once; a larger one is looked up by an index.
    """
    if rules.limit(IN_PLAN + 1).count() > IN_PLAN:
        return rule_index.hits(ev, rules)
    rows = rules.select("kind", "rule_ord", "regex_ord", "regex", "negative").collect()
    found = [F.when((F.col("kind") == r["kind"]) & F.col("message").rlike(r["regex"]) & ~F.col("message").rlike(r["negative"]), F.struct(F.lit(r["rule_ord"]).alias("rule_ord"), F.lit(r["regex_ord"]).alias("regex_ord"))) for r in rows]
    if not found:
        return ev.join(rules, "kind").filter(F.lit(False))
    met = ev.select("*", F.explode(F.array_compact(F.array(*found))).alias("_hit")).select(*ev.columns, "_hit.rule_ord", "_hit.regex_ord")
    return met.join(F.broadcast(rules), ["kind", "rule_ord", "regex_ord"])


def context_holds(full: bool) -> Column:
    """Severity, tool and warning block; the full match lets another tool pass for undefined references."""
    tool = F.col("tools").isNull() | F.coalesce(F.array_contains("tools", F.col("tool")), F.lit(False))
    if full:
        tool |= F.col("category") == "undefined_reference"
    return (F.col("severity") == "error") & tool & ~(F.col("outside_warning_block") & F.col("in_warning_block"))


def captures() -> Column:
    return F.map_from_arrays(F.col("names"), F.expr("transform(names, (n, i) -> regexp_extract(message, regex, i + 1))"))


def quick_match(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """The first event of a log, by line, that a first-tier rule answers, with the first such rule. Needs in_warning_block."""
    hit = _hits(ev, rules.filter("tier = 'tier1'")).filter(context_holds(False))
    first = Window.partitionBy("log_id").orderBy("seq", "rule_ord", "regex_ord")
    df = hit.withColumn("n", F.row_number().over(first)).filter("n = 1").withColumn("captures", captures())
    return df.select("log_id", F.col("id").alias("event_id"), "kind", "rule", "category", "confidence", F.map_values("captures").alias("captured"), F.col("tier1_template").alias("direct_answer"))


def full_verdicts(cand: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of each candidate: a direct answer of the first rule that gives one, else the first rule that came near and why it fell short.

    Needs score, parent, in_warning_block, and contains and degraded of the evidence collected.
    """
    df = cand
    met = _hits(df, rules).withColumn("n", F.row_number().over(Window.partitionBy("log_id", "id", "rule").orderBy("regex_ord"))).filter("n = 1")
    holds, terminal = context_holds(True), F.col("parent").isNull()
    enough = F.size(F.array_except(F.coalesce("tier2_evidence", F.array().cast("array<string>")), "contains")) == 0
    verdict = F.when(holds & F.col("tier1") & (F.col("confidence") >= 0.95) & terminal & ~F.col("degraded"), "direct_tier1").when(holds & F.col("tier2") & (F.col("confidence") >= 0.85) & terminal & enough, "direct_tier2").otherwise("needs_llm")
    score = F.round("score", 4)
    short = (
        F.when(F.col("tier2") & (score < 0.85), "confidence_below_tier2_threshold")
        .when(F.col("tier1") & (score < 0.95), "confidence_below_tier1_threshold")
        .when(~terminal, "event_not_terminal")
        .when(F.col("tier2") & ~enough, "missing_required_evidence")
        .when(F.col("tier1") & F.col("degraded"), "evidence_degraded")
        .when(~holds, "required_context_not_met")
        .otherwise("direct_answer_requirements_not_met")
    )
    met = met.withColumn("verdict", verdict).withColumn("short", short).withColumn("captures", captures())
    best = Window.partitionBy("log_id", "id").orderBy(F.col("verdict") == "needs_llm", "rule_ord")
    first = met.withColumn("n", F.row_number().over(best)).filter("n = 1")
    chosen = first.select("log_id", "id", "rule", "verdict", "short", F.when(F.col("verdict") == "direct_tier1", F.col("tier1_template")).when(F.col("verdict") == "direct_tier2", F.col("tier2_template")).alias("template"), "captures")
    out = df.select("log_id", "id", "kind", "contains").join(chosen, ["log_id", "id"], "left")
    from buildlens.functions.text import filled

    answer = F.regexp_replace(filled(F.col("template"), F.col("captures")), r"\{(member|identifier)\}", "")
    return out.select("log_id", "id", "kind", F.array_join(F.array_sort("contains"), ",").alias("contains"), "rule", F.coalesce("verdict", F.lit("needs_llm")).alias("verdict"), F.when(F.coalesce("verdict", F.lit("needs_llm")) == "needs_llm", F.coalesce("short", F.lit("no_pattern_match"))).alias("failure_reason"), answer.alias("direct_answer"))
