"""Budgets and evidence packets, one row for each log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import redacted, token_estimate

#: Shares of the budget.
HARD, SOFT = {"primary_error": 200, "command_summary": 120, "metadata": 80}, {"cascade_summary": 50, "top_k_text_summaries": 200, "raw_excerpt": 100}
TOTAL = 1400


def evidence_route(kind: Column) -> Column:
    return F.when(kind.isin("compiler", "werror"), "compile").when(kind.isin("linker_missing", "linker_undef"), "link").when(kind.isin("spec_script", "rpm_phase"), "spec").when(kind == "depsolve", "deps")


def level(granted: Column) -> Column:
    return F.when(granted >= 900, 3).when(granted >= 600, 2).otherwise(1)


def budget_pool(df: DataFrame, used: dict[str, Column], ask: Column, total: int = TOTAL) -> DataFrame:
    """pool, granted and left in closed form: what soft shares leave unused comes to the pool, then one grant is taken.

    conservation_total is the budget again, always.
    """
    taken = {k: F.least(F.greatest(c, F.lit(0)), F.lit(SOFT[k])) for k, c in used.items()}
    reclaimed = sum((F.lit(SOFT[k]) - c for k, c in taken.items()), F.lit(0))
    start = total - sum(HARD.values()) - sum(SOFT.values())
    df = df.withColumn("reclaimed", reclaimed).withColumn("pool", F.lit(start) + F.col("reclaimed"))
    df = df.withColumn("granted", F.least(ask, F.col("pool"))).withColumn("left", F.col("pool") - F.col("granted"))
    pending = sum(v for k, v in SOFT.items() if k not in used)
    return df.withColumn("conservation_total", F.lit(sum(HARD.values()) + pending) + sum(taken.values(), F.lit(0)) + F.col("left") + F.col("granted"))


def cause_lists(top: DataFrame) -> DataFrame:
    """log_id, causes: the first causes of each log in order, each as JSON, redacted."""
    cause = F.to_json(F.struct("rank", F.col("id").alias("event_id"), "kind", "semantic_class", F.round("score", 4).alias("confidence"), "band", redacted(F.col("summary")).alias("summary")))
    return top.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cause.alias("cause")))), lambda x: x["cause"]).alias("causes"))


def causes(top: DataFrame) -> DataFrame:
    """The same as one JSON array."""
    return cause_lists(top).withColumn("causes", F.concat(F.lit("["), F.array_join("causes", ","), F.lit("]")))


def excerpts(windows: DataFrame) -> DataFrame:
    """log_id, excerpt: the lines about the first cause (log_id, line_no, text), end to end."""
    return windows.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("excerpt"))


def prompts(primary: Column, cause: Column, phase: Column, paths: Column) -> Column:
    """What a model is asked: primary error, first cause and paths in compact JSON. The wording is this library's own."""
    lines = [F.lit("Find the root cause of the failed build in this packet and propose the smallest repair."), F.concat(F.lit("Failed phase: "), F.coalesce(phase, F.lit("none"))), F.concat(F.lit("Primary error: "), primary), F.concat(F.lit("Top candidate: "), cause), F.concat(F.lit("Evidence paths: "), F.to_json(F.slice(paths, 1, 5)))]
    return redacted(F.concat_ws("\n", *lines))


def packets(top: DataFrame, verdicts: DataFrame, quick: DataFrame, cascades: DataFrame, evidence: DataFrame, windows: DataFrame, commands: DataFrame) -> DataFrame:
    """One packet for each log.

    A quick answer if there is one, else the first cause's verdict. Evidence of its collector; without a collector the lines
    about the cause, cut to 600 tokens, take its place. degraded_reasons in order: that, then the collector's warnings. The
    prompt is for packets without an answer. evidence: as ``evidence.collected`` gives; windows: log_id, line_no, text;
    commands: log_id, id, argv_short.
    """
    first = top.filter("rank = 1").select("log_id", "id", "kind", "semantic_class", "score", "severity", "message", "phase", "failed_phase", "file", "line", "command_id")
    full = verdicts.select("log_id", "id", F.col("rule").alias("full_rule"), F.col("verdict").alias("full_verdict"), "failure_reason", F.col("direct_answer").alias("full_answer"))
    fast_rows = quick.select("log_id", F.col("rule").alias("quick_rule"), F.col("direct_answer").alias("quick_answer"))
    held = evidence.select("log_id", "id", "collector", "level", "contains", "warnings")
    argv = commands.select("log_id", F.col("id").alias("command_id"), F.col("argv_short").alias("command"))
    df = first.join(causes(top), "log_id").join(full, ["log_id", "id"], "left").join(fast_rows, "log_id", "left").join(cascades.withColumnRenamed("summary", "cascades"), "log_id", "left")
    df = df.join(held, ["log_id", "id"], "left").join(argv, ["log_id", "command_id"], "left").join(excerpts(windows), "log_id", "left")
    fast = F.col("quick_rule").isNotNull()
    tier = F.when(fast, "tier1").when(F.col("full_verdict") == "direct_tier1", "tier1").when(F.col("full_verdict") == "direct_tier2", "tier2")
    fallback = ~fast & F.col("collector").isNull()
    primary = F.to_json(F.struct(F.col("id").alias("id"), "kind", "severity", "message", "phase", "file", "line"))
    cause = F.to_json(F.struct(F.lit(1).alias("rank"), F.col("id").alias("event_id"), "kind", "semantic_class", F.round("score", 4).alias("confidence")))
    df = df.select(
        "log_id",
        "failed_phase",
        F.when(tier.isNotNull(), "direct_answer").otherwise("needs_llm").alias("verdict"),
        F.when(fast, "fast_path").otherwise("full_path").alias("via"),
        tier.alias("matched_tier"),
        F.coalesce("quick_rule", F.when(tier.isNotNull(), F.col("full_rule"))).alias("matched_pattern"),
        F.when(tier.isNull(), F.col("failure_reason")).alias("failure_reason"),
        F.when(fast, F.col("quick_answer")).when(tier.isNotNull(), F.col("full_answer")).alias("direct_answer"),
        F.when(fast, F.lit("")).otherwise(F.coalesce("cascades", F.lit(""))).alias("cascade_summary"),
        "causes",
        primary.alias("primary_error"),
        F.when(~fast, F.col("command")).alias("command"),
        F.when(~fast, F.col("collector")).alias("collector"),
        F.when(~fast, F.array_join(F.array_sort("contains"), ",")).alias("contains"),
        F.when(fallback, F.coalesce("excerpt", "message")).alias("excerpt"),
        F.when(tier.isNull(), prompts(primary, cause, F.col("failed_phase"), F.array_compact(F.array("file")))).alias("prompt"),
        F.array_join(F.concat(F.when(fallback, F.array(F.lit("fallback_raw_context_used"))).otherwise(F.array().cast("array<string>")), F.when(fast | F.col("warnings").isNull(), F.array().cast("array<string>")).otherwise(F.col("warnings"))), ",").alias("degraded_reasons"),
        F.when(F.col("semantic_class") == "undefined_reference", 900).otherwise(600).alias("ask"),
    )
    df = df.withColumn("excerpt", fit(F.col("excerpt"), 600))
    used = {"cascade_summary": F.when(F.col("cascade_summary") == "", 1).otherwise(token_estimate(F.col("cascade_summary"))), "top_k_text_summaries": token_estimate(F.col("causes")), "raw_excerpt": F.when(F.col("excerpt").isNull(), 0).otherwise(token_estimate(F.col("excerpt")))}
    ask = F.when(F.col("collector").isNull(), 0).otherwise(F.col("ask"))
    return budget_pool(df, used, ask).drop("ask")


def markdown() -> Column:
    """A packet for readers, its sections in a fixed order; empty ones are left out."""
    f = F.col
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    head = F.concat(F.lit("# Build failure\n- Verdict: "), f("verdict"), F.lit("\n- Failed phase: "), F.coalesce("failed_phase", F.lit("none")), F.lit("\n- Matched tier: "), F.coalesce("matched_tier", F.lit("none")))
    return redacted(F.concat_ws("\n\n", head, part("Primary error", f("primary_error")), part("Evidence", F.concat_ws("\n", "contains", "excerpt")), part("Causes", f("causes")), part("Cascades", f("cascade_summary")), part("Prompt", f("prompt"))))


def section_tokens() -> dict[str, Column]:
    """Tokens of a packet's sections; an absent one has none."""
    size = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 0).otherwise(token_estimate(F.col(c)))
    return {name: size(c) for name, c in (("primary_tokens", "primary_error"), ("cause_tokens", "causes"), ("cascade_tokens", "cascade_summary"), ("excerpt_tokens", "excerpt"), ("prompt_tokens", "prompt"))}


#: White space that is cut off at the end of a text.
BLANKS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+$"
TRUNCATED = "\n[truncated]"


def fit(text: Column, most: int | Column, marker: str = TRUNCATED) -> Column:
    """The text cut in proportion to its tokens, then by sixteen characters again and again, until it fits; the marker comes on top.

    A fold over as many steps as the cut text has sixteens; a step after the one that fits does nothing. Null stays null.
    """
    most = F.lit(most) if isinstance(most, int) else most
    stripped = lambda t: F.regexp_replace(t, BLANKS, "")
    share = F.greatest(F.lit(1), F.floor(F.length(text) * (most / token_estimate(text))).cast("int"))
    start = F.struct(stripped(F.substring(text, F.lit(1), share)).alias("cut"), F.lit(False).alias("fits"))

    def step(state: Column, _: Column) -> Column:
        fits = (state["cut"] == "") | (token_estimate(state["cut"]) <= most)
        shorter = stripped(F.substring(state["cut"], F.lit(1), F.greatest(F.lit(0), F.length(state["cut"]) - 16)))
        return F.when(state["fits"], state).when(fits, F.struct(state["cut"].alias("cut"), F.lit(True).alias("fits"))).otherwise(F.struct(shorter.alias("cut"), F.lit(False).alias("fits")))

    cut = F.aggregate(F.sequence(F.lit(0), F.floor(share / 16).cast("int")), start, step, lambda state: F.concat(state["cut"], F.lit(marker)))
    return F.when(text.isNull(), None).when(most <= 0, F.lit("")).when(token_estimate(text) <= most, text).otherwise(cut)


#: What a packet over its budget gives up, in order: section, how, and how much of it stays. ``lines`` keeps the last lines,
#: ``tokens`` cuts texts, ``over`` clears a section of more tokens than that, ``first`` keeps the first causes.
LADDER = [
    ("extra_window", "lines", 30),
    ("extra_window", "tokens", 0),
    ("excerpt", "lines", 30),
    ("cascade_summary", "over", 50),
    ("snippets", "tokens", 120),
    ("excerpt", "tokens", 120),
    ("causes", "first", 1),
    ("snippets", "tokens", 40),
    ("excerpt", "tokens", 40),
    ("snippets", "tokens", 0),
]
#: Sections that the ladder cuts, and those that stay as they are.
SECTIONS = ("extra_window", "excerpt", "cascade_summary", "snippets", "causes")
FIXED = ("primary_error", "command", "direct_answer")


def _size(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(token_estimate(text))


def _size_of(section: str, value: Column) -> Column:
    return F.aggregate(F.coalesce(value, F.array().cast("array<string>")), F.lit(0), lambda n, t: n + _size(t)) if section in ("snippets", "causes") else _size(value)


def _cut(section: str, value: Column, how: Column, keep: Column) -> Column:
    """A section after one step of the ladder."""
    if section == "snippets":
        return F.transform(value, lambda t: fit(t, keep))
    if section == "causes":
        return F.slice(value, F.lit(1), keep)
    lines = F.split(value, "\n")
    last = F.when(F.size(lines) > keep, F.concat(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - keep + 1), keep), "\n"), F.lit(TRUNCATED))).otherwise(value)
    return F.when(how == "lines", last).when(how == "over", F.when(_size(value) > keep, F.lit("")).otherwise(value)).otherwise(fit(value, keep))


def within_budget(packets: DataFrame, most: int = 1800) -> DataFrame:
    """Packets cut by as many steps of the ladder as it takes to fit; the prompt is cut last. With used (tokens then), steps (how
    many changed something), over (it does not fit all the same) and, in degraded_reasons, that something was cut or could not be.

    A fold over the ladder in columns: a packet that fits passes the other steps as it is. snippets is an array of texts, causes
    one of JSON objects; sections that packets do not have are empty.
    """
    kind = {c: "array<string>" if c in ("snippets", "causes") else "string" for c in SECTIONS}
    df = packets
    for c in (*SECTIONS, *FIXED, "prompt", "degraded_reasons"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind.get(c, "string")))
    fixed = sum((_size(F.col(c)) for c in FIXED), F.lit(0))
    df = df.withColumn("_room", F.lit(most) - fixed).withColumn("_prompt", _size(F.col("prompt")))
    used = lambda s: sum((_size_of(c, s[c]) for c in SECTIONS), F.lit(0))
    start = F.struct(*[F.col(c) for c in SECTIONS], F.lit(0).alias("steps"))

    def step(state: Column, rung: Column) -> Column:
        def changed(section: str) -> Column:
            mine = rung["section"] == section
            return F.when(mine & state[section].isNotNull(), _cut(section, state[section], rung["how"], rung["keep"])).otherwise(state[section])

        after = F.struct(*[changed(c).alias(c) for c in SECTIONS], state["steps"].alias("steps"))
        return F.when(used(state) + F.col("_prompt") <= F.col("_room"), state).otherwise(after)

    def counted(state: Column, rung: Column) -> Column:
        after = F.array(step(state, rung))  # worked out once
        return F.transform(after, lambda x: F.struct(*[x[c].alias(c) for c in SECTIONS], (x["steps"] + F.when(_same(x, state), 0).otherwise(1)).alias("steps")))[0]

    ladder = F.array(*[F.struct(F.lit(c).alias("section"), F.lit(how).alias("how"), F.lit(keep).alias("keep")) for c, how, keep in LADDER])
    df = df.select("*", F.explode(F.array(F.aggregate(ladder, start, counted))).alias("_cut"))
    df = df.withColumn("_left", F.col("_room") - used(F.col("_cut")))
    over = F.col("_prompt") > F.col("_left")
    df = df.select("*", F.explode(F.array(F.when(over & (F.col("_prompt") > 0), fit(F.col("prompt"), F.greatest(F.lit(0), F.col("_left")))).otherwise(F.col("prompt")))).alias("_short"))
    df = df.withColumn("steps", F.col("_cut.steps") + F.when(F.col("prompt").isNotNull() & (F.col("_short") != F.col("prompt")), 1).otherwise(0))
    df = df.withColumn("used", (F.lit(most) - F.col("_left") + _size(F.col("_short"))).cast("int")).withColumn("over", F.col("used") > most)
    was_over = fixed + used(F.struct(*[F.col(c) for c in SECTIONS])) + F.col("_prompt") > most
    reasons = F.concat_ws(",", F.nullif(F.col("degraded_reasons"), F.lit("")), F.when(was_over, "packet_truncated_to_token_budget"), F.when(F.col("over"), "packet_could_not_truncate_to_budget"))
    df = df.withColumn("degraded_reasons", reasons)
    own = {c: F.col(f"_cut.{c}") for c in SECTIONS} | {"prompt": F.col("_short")}
    return df.select(*[own.get(c, F.col(c)).alias(c) for c in df.columns if not c.startswith("_")])


def _same(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for c in SECTIONS:
        out = out & a[c].eqNullSafe(b[c])
    return out


def compression_ratio(log_bytes: Column, tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(log_bytes / 4)) / tokens
