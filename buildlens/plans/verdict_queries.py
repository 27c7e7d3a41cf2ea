"""Queries of rules, verdicts, budgets and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.functions import text as T
from buildlens.functions.scratch import written
from buildlens.functions.stages import Stages
from buildlens.operators import packet, rank, rules, scan
from buildlens.plans.core import classified, events, linked, scan_once, scored, top, top_of
from buildlens.plans.sql import chain, q
from buildlens.plans import evidence_queries as E
from buildlens.plans.core import COMMANDS, SUMMARY
from buildlens.plans.synthetic import logl


def quick(s, d):
    return rules.quick_match(scored(s, d), rules.rule_frame(s))


def verdicts_of(s, top, held):
    """Verdicts on causes by the evidence that was collected of them."""
    return rules.full_verdicts(top.join(held.select("log_id", "id", "contains", "degraded"), ["log_id", "id"]), rules.rule_frame(s))


def verdicts(s, d):
    t = written(top(s, d), "top")
    return verdicts_of(s, t, E.collected_of(s, d, t))


def window_of(lines, top, rank):
    return scan.log_window(lines.select("log_id", "line_no", "text"), top.filter(F.col("rank") == rank).select("log_id", F.col("line_no").alias("at")))


def first_windows(s, d):
    """Lines about each log's first cause: the log is scanned once."""
    lines = classified(s, d)
    return window_of(lines, top_of(linked(scan.annotate(lines)), 1), 1)


def packets_and_parts(s, d, stages=None):
    """Packets of all logs, and the causes and lines that they come of: the log is scanned once."""
    stages = stages or Stages(s)
    lines, ev = scan_once(s, d, stages)
    t = stages.run("causes", rank.top_causes(ev, 3))
    held = stages.run("evidence", E.collected_of(s, d, t))
    quick_ = rules.quick_match(ev, rules.rule_frame(s))
    return packet.packets(t, verdicts_of(s, t, held), quick_, scan.cascade_summary(ev), held, window_of(lines, t, 1), scan.commands(lines)), t, lines


def all_packets(s, d):
    return packets_and_parts(s, d)[0]


def stage_rows(s, d):
    """How many rows each stage of the packets makes; the table has the milliseconds too, which differ from run to run."""
    stages = Stages(s)
    stages.run("packets", packets_and_parts(s, d, stages)[0])
    return stages.table().drop("ms")


def ladder_packets(s, d):
    """Packets with all sections that the ladder cuts: the window about the second cause, and the causes' messages for snippets."""
    p, t, lines = packets_and_parts(s, d)
    second = packet.excerpts(window_of(lines, t, 2)).withColumnRenamed("excerpt", "extra_window")
    texts = t.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]).alias("snippets"))
    return p.drop("causes").join(packet.cause_lists(t), "log_id").join(second, "log_id", "left").join(texts, "log_id")


def estimates(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.token_estimate(F.concat(F.lit("构建 "), "text")).alias("tokens"))


#: Tokens that packets are cut to here, so few that most need many steps.
MOST = 260
QUERIES = {
    "quick_match": lambda s, d: quick(s, d).withColumn("captured", F.array_join("captured", ",")),
    "full_verdict": lambda s, d: verdicts(s, d).select("log_id", "id", "kind", "contains", "rule", "verdict"),
    "needs_llm_reason": lambda s, d: verdicts(s, d).groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n")),
    "rule_hits": lambda s, d: rules._hits(scored(s, d), rules.rule_frame(s)).groupBy("rule").agg(F.count_distinct("log_id", "id").alias("n")),
    "packets": lambda s, d: all_packets(s, d).drop("pool", "granted", "left", "reclaimed", "conservation_total"),
    "packet_budget": lambda s, d: all_packets(s, d).select("log_id", F.col("conservation_total").cast("int").alias("conservation_total"), (F.col("granted") <= F.col("pool")).alias("within"), (F.col("pool") >= 650).alias("reclaimed")),
    "packet_sections": lambda s, d: all_packets(s, d).select("log_id", *[c.alias(n) for n, c in packet.section_tokens().items() if n in ("cause_tokens", "cascade_tokens")]),
    "packet_markdown": lambda s, d: all_packets(s, d).select("log_id", F.element_at(F.split(packet.markdown(), "\n\n## "), 1).alias("head"), F.array_join(F.transform(F.filter(F.split(packet.markdown(), "\n"), lambda x: x.startswith("## ")), lambda x: F.replace(x, F.lit("## "), F.lit(""))), ",").alias("sections")),
    "packet_shrunk": lambda s, d: packet.within_budget(ladder_packets(s, d), MOST).select("log_id", "steps", "used", "over", "excerpt", "extra_window", "cascade_summary", "prompt", "degraded_reasons", F.array_join("snippets", "|").alias("snippets"), F.array_join("causes", ",").alias("causes")),
    "stage_rows": stage_rows,
    "budget_pool": lambda s, d: packet.budget_pool(events(s, d).groupBy("log_id").agg(F.count(F.lit(1)).cast("int").alias("n")), {"cascade_summary": F.col("n") % 70, "top_k_text_summaries": F.col("n") % 250}, F.when(F.col("n") % 2 == 0, 900).otherwise(600)).select("log_id", "pool", "granted", "left", "conservation_total"),
    "evidence_route": lambda s, d: events(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("route", packet.evidence_route(F.col("kind"))),
    "token_estimate": estimates,
    "compression_ratio": lambda s, d: scan.with_offsets(logl(s, d)).groupBy("log_id").agg(F.max(F.col("raw_offset") + F.octet_length("raw_text") + 1).alias("bytes"), F.sum(T.token_estimate(F.col("raw_text"))).alias("tokens")).select("log_id", "tokens", packet.compression_ratio(F.col("bytes"), F.col("tokens")).alias("ratio")),
    "log_window": first_windows,
    "packet_fit": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", packet.fit(F.col("text"), 60).alias("text")),
    "acceptance": lambda s, d: all_packets(s, d).agg(F.avg((F.col("via") == "fast_path").cast("int")).alias("fast_rate"), F.avg((F.col("verdict") == "direct_answer").cast("int")).alias("direct_rate"), F.avg((F.col("conservation_total") == packet.TOTAL).cast("int")).alias("conserved")),
}

VALUES = ", ".join(f"({i}, {j}, {q(rule)}, {q(cat)}, {q(tier)}, {q(kind)}, {q(regex)}, {len(names)}, {'NULL::VARCHAR[]' if tools is None else str(tools)}, {outside}, {q(neg)}, {conf}::DOUBLE, {t1}, {'NULL' if a1 is None else q(a1)}, {t2}, {'NULL::VARCHAR[]' if need is None else str(need)}, {'NULL' if a2 is None else q(a2)})" for i, j, rule, cat, tier, kind, regex, names, tools, outside, neg, conf, t1, a1, t2, need, a2 in rules.rule_rows())
RULES = f"rules(rule_ord, regex_ord, rule, category, tier, kind, regex, n_names, tools, outside, negative, confidence, tier1, answer1, tier2, need, answer2) AS (VALUES {VALUES})"
HITS = "hits AS (SELECT s.*, r.* EXCLUDE (kind) FROM scored s JOIN rules r ON r.kind = s.kind WHERE regexp_matches(s.message, r.regex) AND NOT regexp_matches(s.message, r.negative))"
QUICK = "quick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq, rule_ord, regex_ord) AS n FROM hits WHERE tier = 'tier1' AND severity = 'error' AND (tools IS NULL OR coalesce(list_contains(tools, tool), false)) AND NOT (outside AND in_warning_block)) WHERE n = 1)"
EVIDENCE_CTES = (E.BODY, E.FUNCS, E.TOP_ASKS, E.TOP_CONTEXT, E.HEADERS)
HELD = f"held AS (SELECT t.*, CASE WHEN e.contains = '' THEN []::VARCHAR[] ELSE string_split(e.contains, ',') END AS contains, e.degraded FROM top t JOIN ({E.EVIDENCE_SELECT}) e ON e.log_id = t.log_id AND e.id = t.id)"
FULL = """met AS (SELECT *, CASE WHEN holds AND tier1 AND confidence >= 0.95 AND parent IS NULL AND NOT degraded THEN 'direct_tier1' WHEN holds AND tier2 AND confidence >= 0.85 AND parent IS NULL AND enough THEN 'direct_tier2' ELSE 'needs_llm' END AS verdict,
  CASE WHEN tier2 AND round(score, 4) < 0.85 THEN 'confidence_below_tier2_threshold' WHEN tier1 AND round(score, 4) < 0.95 THEN 'confidence_below_tier1_threshold' WHEN parent IS NOT NULL THEN 'event_not_terminal'
    WHEN tier2 AND NOT enough THEN 'missing_required_evidence' WHEN tier1 AND degraded THEN 'evidence_degraded' WHEN NOT holds THEN 'required_context_not_met' ELSE 'direct_answer_requirements_not_met' END AS short
  FROM (SELECT h.*, r.* EXCLUDE (kind), severity = 'error' AND (tools IS NULL OR coalesce(list_contains(tools, tool), false) OR category = 'undefined_reference') AND NOT (outside AND in_warning_block) AS holds,
    len(list_filter(coalesce(need, []), lambda x: NOT list_contains(contains, x))) = 0 AS enough, row_number() OVER (PARTITION BY h.log_id, h.id, r.rule ORDER BY r.regex_ord) AS n
    FROM held h JOIN rules r ON r.kind = h.kind WHERE regexp_matches(h.message, r.regex) AND NOT regexp_matches(h.message, r.negative)) WHERE n = 1),
full_ AS (SELECT h.log_id, h.id, h.kind, array_to_string(list_sort(h.contains), ',') AS contains, m.rule, coalesce(m.verdict, 'needs_llm') AS verdict, CASE WHEN coalesce(m.verdict, 'needs_llm') = 'needs_llm' THEN coalesce(m.short, 'no_pattern_match') END AS failure_reason
  FROM held h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, id ORDER BY verdict = 'needs_llm', rule_ord) AS k FROM met) WHERE k = 1) m ON m.log_id = h.log_id AND m.id = h.id)"""
TOKENS = lambda x: rf"greatest(1, ceil(len(regexp_extract_all({x}, '[一-鿿]')) / 1.5::DOUBLE + len(regexp_extract_all({x}, '[A-Za-z0-9_./+-]+')) / 0.75::DOUBLE + length(regexp_replace(regexp_replace({x}, '[一-鿿]', '', 'g'), '[A-Za-z0-9_./+-]+', '', 'g')) / 3.0::DOUBLE))::INTEGER"

STRIP = lambda x: f"regexp_replace({x}, {q(packet.BLANKS)}, '')"


def FIT(t, most):
    """The same cut of a text as ``packet.fit``."""
    share = f"greatest(1, floor(length({t}) * ({most} / {TOKENS(t)})))::INTEGER"
    start = STRIP(f"substring({t}, 1, {share})")
    shorter = STRIP("substring(a, 1, greatest(0, length(a) - 16))")
    steps = f"list_transform(range(0, {share} // 16 + 1), lambda i: '')"
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {most} <= 0 THEN '' WHEN {TOKENS(t)} <= {most} THEN {t} ELSE list_reduce(list_prepend({start}, {steps}), lambda a, x: CASE WHEN a = '' OR {TOKENS('a')} <= {most} THEN a ELSE {shorter} END) || chr(10) || '[truncated]' END"


WINDOW = lambda rank: f"SELECT t.log_id, string_agg(a.text, chr(10) ORDER BY a.line_no) AS text FROM top t JOIN annotated a ON a.log_id = t.log_id AND a.line_no BETWEEN t.line_no - 30 AND t.line_no + 20 WHERE t.rank = {rank} GROUP BY t.log_id"
PRIMARY = """'{"id":"' || t.id || '","kind":"' || t.kind || '","severity":"' || t.severity || '","message":' || to_json(t.message)::VARCHAR || coalesce(',"phase":"' || t.phase || '"', '') || coalesce(',"file":"' || t.file || '"', '') || coalesce(',"line":' || t.line, '') || '}'"""
FULL_ANSWERED = FULL.replace("m.rule, coalesce(m.verdict", "m.rule, m.answer, coalesce(m.verdict").replace("AS short\n", "AS short, CASE WHEN n_names > 0 THEN regexp_extract(message, regex, 1) ELSE '' END AS cap, CASE WHEN holds AND tier1 AND confidence >= 0.95 AND parent IS NULL AND NOT degraded THEN answer1 WHEN holds AND tier2 AND confidence >= 0.85 AND parent IS NULL AND enough THEN replace(replace(regexp_replace(answer2, '\\{[a-z]+\\}', chr(1)), chr(1), CASE WHEN n_names > 0 THEN regexp_extract(message, regex, 1) ELSE '' END), '{identifier}', '') END AS answer\n")
CAUSES = f"causes_ AS (SELECT log_id, to_json(list({{rank: rank, event_id: id, kind: kind, semantic_class: semantic_class, confidence: round(score, 4), band: band, summary: summary}} ORDER BY rank))::VARCHAR AS causes FROM (SELECT *, {SUMMARY} FROM top) GROUP BY log_id)"
def sql(select, *more, upto="top"):
    return chain(upto, "").rstrip() + ", " + ", ".join(more) + " " + select


ORACLES = {
    "quick_match": sql("SELECT log_id, id AS event_id, kind, rule, category, confidence, CASE n_names WHEN 0 THEN '' WHEN 1 THEN regexp_extract(message, regex, 1) ELSE regexp_extract(message, regex, 1) || ',' || regexp_extract(message, regex, 2) END AS captured, answer1 AS direct_answer FROM quick", RULES, HITS, QUICK),
    "full_verdict": sql("SELECT log_id, id, kind, contains, rule, verdict FROM full_", RULES, *EVIDENCE_CTES, HELD, FULL),
    "needs_llm_reason": sql("SELECT failure_reason, count(*) AS n FROM full_ GROUP BY ALL", RULES, *EVIDENCE_CTES, HELD, FULL),
    "rule_hits": sql("SELECT rule, count(DISTINCT (log_id, id)) AS n FROM hits GROUP BY rule", RULES, HITS),
    "budget_pool": chain("ev", "SELECT log_id, pool, least(CASE WHEN n % 2 = 0 THEN 900 ELSE 600 END, pool)::INTEGER AS granted, (pool - least(CASE WHEN n % 2 = 0 THEN 900 ELSE 600 END, pool))::INTEGER AS \"left\", 1400 AS conservation_total FROM (SELECT log_id, n, (650 + 50 - least(n % 70, 50) + 200 - least(n % 250, 200))::INTEGER AS pool FROM (SELECT log_id, count(*)::INTEGER AS n FROM ev GROUP BY log_id))"),
    "evidence_route": chain("ev", "SELECT kind, count(*) AS n, CASE WHEN kind IN ('compiler', 'werror') THEN 'compile' WHEN kind IN ('linker_missing', 'linker_undef') THEN 'link' WHEN kind IN ('spec_script', 'rpm_phase') THEN 'spec' WHEN kind = 'depsolve' THEN 'deps' END AS route FROM ev GROUP BY kind"),
    "token_estimate": "SELECT doc_id, " + TOKENS("x") + " AS tokens FROM (SELECT doc_id, '构建 ' || text AS x FROM documents)",
    "compression_ratio": chain("logl", f"SELECT log_id, sum({TOKENS('raw_text')})::BIGINT AS tokens, greatest(1, floor(sum(strlen(raw_text) + 1) / 4)) / sum({TOKENS('raw_text')}) AS ratio FROM logl GROUP BY log_id"),
    "packets": sql(f"""SELECT t.log_id, t.failed_phase, CASE WHEN fast OR f.verdict LIKE 'direct%' THEN 'direct_answer' ELSE 'needs_llm' END AS verdict, CASE WHEN fast THEN 'fast_path' ELSE 'full_path' END AS via,
      CASE WHEN fast OR f.verdict = 'direct_tier1' THEN 'tier1' WHEN f.verdict = 'direct_tier2' THEN 'tier2' END AS matched_tier, CASE WHEN fast THEN qk.rule WHEN f.verdict LIKE 'direct%' THEN f.rule END AS matched_pattern, CASE WHEN NOT fast AND f.verdict = 'needs_llm' THEN f.failure_reason END AS failure_reason, CASE WHEN fast THEN qk.answer1 ELSE f.answer END AS direct_answer,
      CASE WHEN fast THEN '' ELSE coalesce(cs.summary, '') END AS cascade_summary, ca.causes, CASE WHEN NOT fast THEN cm.argv_short END AS command, CASE WHEN NOT fast THEN ev_.collector END AS collector, CASE WHEN NOT fast THEN ev_.contains END AS contains,
      CASE WHEN fast THEN '' ELSE concat_ws(',', CASE WHEN ev_.collector IS NULL THEN 'fallback_raw_context_used' END, nullif(ev_.warnings, '')) END AS degraded_reasons,
      {PRIMARY} AS primary_error, CASE WHEN NOT fast AND f.verdict = 'needs_llm' THEN concat_ws(chr(10), 'Find the root cause of the failed build in this packet and propose the smallest repair.', 'Failed phase: ' || coalesce(t.failed_phase, 'none'), 'Primary error: ' || {PRIMARY},
        'Top candidate: {{"rank":1,"event_id":"' || t.id || '","kind":"' || t.kind || '","semantic_class":"' || t.semantic_class || '","confidence":' || round(t.score, 4) || '}}', 'Evidence paths: ' || CASE WHEN t.file IS NULL THEN '[]' ELSE '["' || t.file || '"]' END) END AS prompt,
      CASE WHEN NOT fast AND ev_.collector IS NULL THEN {FIT("coalesce(wd.text, t.message)", 600)} END AS excerpt
      FROM (SELECT t.*, EXISTS (SELECT 1 FROM quick k WHERE k.log_id = t.log_id) AS fast FROM top t WHERE rank = 1) t LEFT JOIN quick qk ON qk.log_id = t.log_id JOIN full_ f ON f.log_id = t.log_id AND f.id = t.id
      LEFT JOIN (SELECT log_id, 'make cascade: ' || string_agg(coalesce(target, '<unknown>') || ' -> ' || coalesce(parent, 'unlinked'), '; ' ORDER BY seq) AS summary FROM ev WHERE kind = 'make_cascade' GROUP BY log_id) cs ON cs.log_id = t.log_id
      LEFT JOIN commands cm ON cm.log_id = t.log_id AND cm.id = t.command_id LEFT JOIN causes_ ca ON ca.log_id = t.log_id JOIN ({E.EVIDENCE_SELECT}) ev_ ON ev_.log_id = t.log_id AND ev_.id = t.id LEFT JOIN ({WINDOW(1)}) wd ON wd.log_id = t.log_id""", RULES, HITS, QUICK, *EVIDENCE_CTES, HELD, FULL_ANSWERED, COMMANDS, CAUSES),
    "packet_budget": chain("top", "SELECT log_id, 1400 AS conservation_total, true AS within, true AS reclaimed FROM top WHERE rank = 1"),
    "packet_sections": sql(f"SELECT t.log_id, {TOKENS('ca.causes')} AS cause_tokens, CASE WHEN cascade = '' THEN 0 ELSE {TOKENS('cascade')} END AS cascade_tokens FROM (SELECT log_id, CASE WHEN log_id IN (SELECT log_id FROM quick) THEN '' ELSE coalesce((SELECT 'make cascade: ' || string_agg(coalesce(target, '<unknown>') || ' -> ' || coalesce(parent, 'unlinked'), '; ' ORDER BY seq) FROM ev WHERE ev.log_id = t.log_id AND kind = 'make_cascade'), '') END AS cascade FROM top t WHERE rank = 1) t JOIN causes_ ca USING (log_id)", RULES, HITS, QUICK, CAUSES),
    "log_window": chain("top", 'SELECT a.log_id, a.line_no, t.line_no AS "at", a.text FROM annotated a JOIN top t ON t.log_id = a.log_id AND t.rank = 1 AND a.line_no BETWEEN t.line_no - 30 AND t.line_no + 20'),
}
ORACLES |= {
    "acceptance": f"SELECT avg((via = 'fast_path')::INTEGER) AS fast_rate, avg((verdict = 'direct_answer')::INTEGER) AS direct_rate, 1.0::DOUBLE AS conserved FROM ({ORACLES['packets']})",
    "packet_markdown": f"""SELECT log_id, '# Build failure' || chr(10) || '- Verdict: ' || verdict || chr(10) || '- Failed phase: ' || coalesce(failed_phase, 'none') || chr(10) || '- Matched tier: ' || coalesce(matched_tier, 'none') AS head,
      concat_ws(',', 'Primary error', CASE WHEN via = 'full_path' THEN 'Evidence' END, 'Causes', CASE WHEN cascade_summary <> '' THEN 'Cascades' END, CASE WHEN verdict = 'needs_llm' THEN 'Prompt' END) AS sections FROM ({ORACLES['packets']})""",
}


def _ladder(base: str) -> str:
    """The ladder rung by rung: a select over each one before."""
    size = lambda x: f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE {TOKENS(x)} END"
    of_list = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: {size('y')})), 0)"
    used = " + ".join([size("extra_window"), size("excerpt"), size("cascade_summary"), of_list("snippets"), of_list("causes")])
    ctes, was = [f"l0 AS ({base})"], "l0"
    for i, (section, how, keep) in enumerate(packet.LADDER, 1):
        cut = {
            "lines": f"CASE WHEN len(string_split({section}, chr(10))) > {keep} THEN array_to_string(string_split({section}, chr(10))[-{keep}:], chr(10)) || chr(10) || '[truncated]' ELSE {section} END",
            "over": f"CASE WHEN {size(section)} > {keep} THEN '' ELSE {section} END",
            "first": f"{section}[1:{keep}]",
            "tokens": f"list_transform({section}, lambda z: {FIT('z', keep)})" if section == "snippets" else FIT(section, keep),
        }[how]
        ctes.append(f"l{i} AS (SELECT * EXCLUDE ({section}, steps, cut), cut AS {section}, steps + (cut IS DISTINCT FROM {section})::INTEGER AS steps FROM (SELECT *, CASE WHEN fixed + prompted + {used} <= {MOST} THEN {section} ELSE {cut} END AS cut FROM {was}))")
        was = f"l{i}"
    short = f"CASE WHEN prompted > room AND prompted > 0 THEN {FIT('prompt', 'greatest(0, room)')} ELSE prompt END"
    return "WITH " + ", ".join(ctes) + f""" SELECT log_id, steps + (coalesce(short <> prompt, false))::INTEGER AS steps, ({MOST} - room + {size('short')})::INTEGER AS used, {MOST} - room + {size('short')} > {MOST} AS over, excerpt, extra_window, cascade_summary, short AS prompt,
      concat_ws(',', nullif(degraded_reasons, ''), CASE WHEN was_used > {MOST} THEN 'packet_truncated_to_token_budget' END, CASE WHEN {MOST} - room + {size('short')} > {MOST} THEN 'packet_could_not_truncate_to_budget' END) AS degraded_reasons, array_to_string(snippets, '|') AS snippets, array_to_string(causes, ',') AS causes
      FROM (SELECT *, {short} AS short FROM (SELECT *, {MOST} - fixed - ({used}) AS room FROM {was} JOIN (SELECT log_id, fixed + prompted + {used} AS was_used FROM l0) USING (log_id)))"""


_SIZE = lambda x: f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE {TOKENS(x)} END"
CAUSE_LIST = CAUSES.replace("causes_ AS (", "(").replace("to_json(list(", "list(to_json(").replace(" ORDER BY rank))::VARCHAR AS causes", ")::VARCHAR ORDER BY rank) AS causes")
LADDER_BASE = f"""SELECT p.log_id, p.prompt, p.excerpt, p.cascade_summary, p.degraded_reasons, w.text AS extra_window, m.snippets, c.causes, {_SIZE('p.primary_error')} + {_SIZE('p.command')} + {_SIZE('p.direct_answer')} AS fixed, {_SIZE('p.prompt')} AS prompted, 0 AS steps
  FROM packed p LEFT JOIN ({WINDOW(2)}) w USING (log_id) JOIN (SELECT log_id, list(message ORDER BY rank) AS snippets FROM top GROUP BY log_id) m USING (log_id) JOIN {CAUSE_LIST} c USING (log_id)"""
ORACLES |= {
    "stage_rows": chain("top", "SELECT place::INTEGER AS place, stage, rows FROM (SELECT 0 AS place, 'lines' AS stage, count(*) AS rows FROM annotated UNION ALL SELECT 1, 'events', count(*) FROM ev UNION ALL SELECT 2, 'causes', count(*) FROM top UNION ALL SELECT 3, 'evidence', count(*) FROM top UNION ALL SELECT 4, 'packets', count(DISTINCT log_id) FROM top)"),
    "packet_fit": f"SELECT doc_id, {FIT('text', 60)} AS text FROM documents",
    "packet_shrunk": chain("top", "").rstrip() + f", packed AS ({ORACLES['packets']}) " + f"SELECT * FROM ({_ladder(LADDER_BASE)})",
}
