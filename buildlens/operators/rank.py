"""Events to semantic classes, scores and the first three causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.functions import patterns as P

SCORE_STEP = 0.05


def warning_block(ev: DataFrame) -> DataFrame:
    """in_warning_block: within three lines an event is a warning, and none but this one an error."""
    near = Window.partitionBy("log_id").orderBy("line_no").rangeBetween(-3, 3)
    message = F.lower(F.coalesce("message", F.lit("")))
    warns = ((F.col("severity") == "warning") | message.contains("warning:")).cast("int")
    fails = ((F.col("severity") == "error") | message.contains("error:")).cast("int")
    return ev.withColumn("in_warning_block", (F.max(warns).over(near) == 1) & (F.sum(fails).over(near) - fails == 0))


def semantic_class() -> Column:
    """The linkers' two kinds have classes of their own; else the first class of which a pattern is in the message."""
    out = F.when(F.col("kind") == "linker_undef", "undefined_reference").when(F.col("kind") == "linker_missing", "missing_lib")
    for name, *_, pats in P.SEMANTICS:
        if name in P.BY_MESSAGE:
            out = out.when(F.col("message").rlike("(?i)" + "|".join(pats)), name)
    return out.otherwise("generic_error")


def _by_class(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, v in values.items():
        out = F.when(F.col("semantic_class") == name, F.lit(float(v))).otherwise(out)
    return out


def classified(ev: DataFrame) -> DataFrame:
    """Needs failed_phase. The generic class has more confidence for an event of a command in the failed phase."""
    df = ev.withColumn("semantic_class", semantic_class())
    gate = F.col("command_id").isNotNull() & F.col("phase").eqNullSafe(F.col("failed_phase")) & ~F.col("kind").isin("make_cascade", "rpm_phase")
    base = _by_class({s[0]: s[1] for s in P.SEMANTICS})
    gated = next(s[2] for s in P.SEMANTICS if s[0] == "generic_error")
    df = df.withColumn("context_satisfied", (F.col("semantic_class") == "generic_error") & gate)
    return df.withColumn("base", F.when(F.col("context_satisfied"), gated).otherwise(base)).withColumn("cascade", _by_class({s[0]: s[3] for s in P.SEMANTICS}))


def scored(ev: DataFrame) -> DataFrame:
    """score, its bucket and band. Needs parent, failed_phase, in_warning_block and the class."""
    has = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    located = (F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) != 0)
    total = (
        F.col("base")
        - F.when(F.col("kind") == "linker_undef", F.lit(0.0)).otherwise(F.col("cascade") * F.lit(0.3))
        + has(F.col("command_id").isNotNull(), 0.05)
        + has(located, 0.05)
        + has((F.col("kind") == "patch") & F.col("phase").eqNullSafe(F.col("failed_phase")), 0.1)
        - has(F.col("in_warning_block"), 0.3)
        - has(F.col("parent").isNotNull(), 0.4)
    )
    score = F.when((F.col("kind") == "make_cascade") & F.col("parent").isNotNull(), F.lit(0.1)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    df = ev.withColumn("score", score)
    df = df.withColumn("bucket", F.floor((F.col("score") + SCORE_STEP / 2) / SCORE_STEP).cast("int"))
    return df.withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.70, "medium_high").when(score >= 0.50, "medium").otherwise("low")


def reasons() -> Column:
    """The factors that made the score, each with its change, in order."""
    factor = lambda when, name, delta: F.when(when, F.struct(F.lit(name).alias("factor"), delta.alias("delta")))
    undef, linked = F.col("kind") == "linker_undef", (F.col("kind") == "make_cascade") & F.col("parent").isNotNull()
    located = (F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) != 0)
    every = F.array(
        factor(F.lit(True), "semantic_class", F.col("base")),
        factor(undef, "linker_undef_no_cascade_penalty", F.lit(0.0)),
        factor(~undef, "cascade_probability", -(F.col("cascade") * 0.3)),
        factor(F.col("command_id").isNotNull(), "has_command", F.lit(0.05)),
        factor(located, "has_location", F.lit(0.05)),
        factor((F.col("kind") == "patch") & F.col("phase").eqNullSafe(F.col("failed_phase")), "patch_failed_phase", F.lit(0.1)),
        factor(F.col("in_warning_block"), "warning_block", F.lit(-0.3)),
        factor(F.col("parent").isNotNull(), "parent_cascade", F.lit(-0.4)),
    )
    return F.when(linked, F.array(factor(F.lit(True), "make_cascade_parent", F.lit(0.1)))).otherwise(F.filter(every, lambda x: x.isNotNull()))


def top_causes(sc: DataFrame, k: int = 3) -> DataFrame:
    """The k first causes of each log: by score bucket, then severity, then score, then line."""
    severity = F.when(F.col("severity") == "fatal error", 3).when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    best = Window.partitionBy("log_id").orderBy(F.desc("bucket"), F.desc(severity), F.desc("score"), "line_no")
    where = F.when((F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) != 0), F.concat(F.lit(" at "), "file", F.lit(":"), F.col("line").cast("string"))).otherwise("")
    df = sc.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return df.withColumn("summary", F.concat("kind", F.lit(" "), "semantic_class", where, F.lit(" - "), F.trim("message"))).withColumn("is_terminal", F.col("parent").isNull())
