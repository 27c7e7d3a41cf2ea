"""The same queries in SQL, from common table expressions that build on each other."""

from __future__ import annotations

from buildlens.functions import patterns as P
from buildlens.plans import synthetic


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ex(pattern: str, n: int, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {n}), '')"


def has(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {q(pattern)})"


W = "PARTITION BY log_id ORDER BY line_no"
TOOL = lambda argv: f"nullif(regexp_replace(regexp_extract({argv}, {q(chr(94) + chr(92) + 's*(' + chr(92) + 'S+)')}, 1), '^.*/', ''), '')"
PLAIN = f"regexp_replace(raw_text, {q(P.ANSI)}, '', 'g')"

CTES = {
    "logl": synthetic.SQL,
    "plain": f"SELECT log_id, line_no, raw_text, regexp_replace({PLAIN}, {q(P.SECONDS)}, '') AS text, try_cast({ex(P.SECONDS, 1, PLAIN)} AS INTEGER) AS gbs_seconds FROM logl",
    "marked": f"""SELECT *, marker IS NULL AND {has(P.COMMAND)} AS is_command, {has(P.CONTINUES)} AS goes_on
      FROM (SELECT *, coalesce({ex(P.PHASE, 1)}, {ex(P.EXECUTING, 1)}) AS marker FROM plain)""",
    "anchored": f"""SELECT *, last_value(CASE WHEN marker IS NOT NULL OR is_command OR NOT goes_on THEN is_command AND goes_on END IGNORE NULLS)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM marked""",
    "annotated": f"""SELECT *, marker IS NULL AND NOT is_command AND coalesce(anchor, false) AS is_continuation,
      last_value(marker IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase,
      (sum(is_command::INTEGER) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS command_no,
      {TOOL(f"last_value(CASE WHEN is_command THEN regexp_extract(text, {q(P.COMMAND)}, 1) END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS tool FROM anchored""",
    "patched": "SELECT *, lower(text) AS low, CASE "
    + " ".join(f"WHEN {has(p)} THEN {i}" for i, (p, _) in enumerate(P.PATCH, 1))
    + " END AS patch, "
    + ", ".join("CASE " + " ".join(f"WHEN {has(p)} THEN {ex(p, names.index(n) + 1) if n in names else 'NULL'}" for p, names in P.PATCH) + f" END AS p_{n}" for n in ("num", "total", "line", "file"))
    + f" FROM annotated WHERE marker IS NULL AND NOT is_command AND NOT is_continuation AND {has(P.MARKERS, 'lower(text)')}",
    "branched": f"""SELECT * FROM (SELECT *, CASE
      WHEN contains(low, 'nothing provides') THEN 'depsolve' WHEN patch IS NOT NULL THEN 'patch'
      WHEN contains(low, 'file not found:') OR contains(low, 'installed (but unpackaged) file(s) found') THEN 'install_missing'
      WHEN contains(low, '-wunknown-warning-option') AND {has(P.UNKNOWN_OPTION)} THEN 'unknown_option'
      WHEN {has(P.COMPILER)} AND contains(low, '-werror') THEN 'werror_located'
      WHEN contains(low, 'all warnings being treated as errors') OR {has(P.WERROR)} THEN 'werror'
      WHEN {has(P.MISSING_LIBRARY)} THEN 'linker_missing' WHEN {has(P.UNDEFINED)} THEN 'linker_undef' WHEN {has(P.COMPILER)} THEN 'compiler'
      WHEN {has(P.RPM_PHASE)} THEN 'rpm_phase' WHEN {has(P.MAKE)} THEN 'make_cascade'
      WHEN contains(low, 'spec file') AND contains(low, 'error') THEN 'spec_script'
      WHEN contains(low, 'error:') OR contains(low, 'fatal:') THEN 'raw_error' END AS branch FROM patched) WHERE branch IS NOT NULL""",
    "events0": f"""SELECT log_id, 'E' || lpad(seq::VARCHAR, greatest(3, length(seq::VARCHAR))::INTEGER, '0') AS id, seq,
      CASE WHEN branch IN ('unknown_option', 'werror_located') THEN 'werror' ELSE branch END AS kind,
      CASE WHEN located AND lower({ex(P.COMPILER, 4)}) = 'warning' THEN 'warning' ELSE 'error' END AS severity,
      CASE WHEN located THEN regexp_extract(text, {q(P.COMPILER)}, 5)
        WHEN branch = 'patch' AND contains(low, 'can''t find file to patch') THEN 'error: patch failed: ' || text
        WHEN branch = 'patch' AND contains(low, 'hunk') AND contains(low, 'ignored') AND NOT starts_with(low, 'hunk') THEN 'Hunk #' || coalesce(p_num, '1') || ' FAILED: ' || text
        ELSE text END AS message,
      line_no, phase, CASE WHEN command_no > 0 THEN 'C' || lpad(command_no::VARCHAR, greatest(3, length(command_no::VARCHAR))::INTEGER, '0') END AS command_id,
      CASE WHEN located THEN {ex(P.COMPILER, 1)} END AS file, CASE WHEN located THEN try_cast({ex(P.COMPILER, 2)} AS INTEGER) END AS line,
      CASE WHEN located THEN try_cast({ex(P.COMPILER, 3)} AS INTEGER) END AS "column",
      CASE WHEN branch = 'make_cascade' THEN {ex(P.MAKE, 1)} END AS target, tool,
      CASE WHEN branch = 'linker_missing' THEN {ex(P.MISSING_LIBRARY, 1)} END AS library,
      CASE WHEN branch = 'linker_undef' THEN {ex(P.UNDEFINED, 1)} END AS symbol,
      CASE WHEN branch = 'rpm_phase' THEN {ex(P.RPM_PHASE, 1)} END AS exit_phase,
      CASE WHEN branch = 'unknown_option' THEN {ex(P.UNKNOWN_OPTION, 1)} END AS warning_option,
      CASE WHEN branch = 'patch' THEN p_num END AS patch_num,
      CASE WHEN located THEN lower({ex(P.COMPILER, 1)}) LIKE '%.s' END AS is_assembler
      FROM (SELECT *, branch IN ('werror_located', 'compiler') AS located, row_number() OVER ({W}) AS seq FROM branched)""",
    "sources": f"""SELECT log_id, file, seq, id AS event, regexp_replace(file, '^.*/', '') AS base FROM events0 WHERE file IS NOT NULL AND {has(P.SOURCE_FILE, 'file')}""",
    "asked": r"""SELECT c.log_id, c.id, s.file, max(s.seq) AS seq FROM events0 c JOIN sources s ON s.log_id = c.log_id AND s.seq < c.seq
      AND (ends_with(c.target, regexp_replace(s.base, '\.[^.]*$', '') || '.o') OR ends_with(c.target, s.base || '.o')) WHERE c.kind = 'make_cascade' GROUP BY ALL""",
    "cascades": """SELECT a.log_id, a.id, min(s.event) AS cascade_parent FROM asked a JOIN sources s ON s.log_id = a.log_id AND s.seq = a.seq GROUP BY ALL HAVING count(DISTINCT s.event) = 1""",
    "ev": f"""SELECT e.*, coalesce(CASE WHEN kind = 'rpm_phase' AND exit_phase = '%prep' THEN last_patch END, cascade_parent) AS parent,
      last_value(CASE WHEN kind <> 'make_cascade' THEN phase END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS failed_phase
      FROM (SELECT *, last_value(CASE WHEN kind = 'patch' AND phase = '%prep' THEN id END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_patch FROM events0) e
      LEFT JOIN cascades USING (log_id, id)""",
    "blocked": """SELECT e.*, (SELECT max((n.severity = 'warning' OR contains(lower(n.message), 'warning:'))::INTEGER) = 1
        AND sum((n.id <> e.id AND (n.severity = 'error' OR contains(lower(n.message), 'error:')))::INTEGER) = 0
        FROM ev n WHERE n.log_id = e.log_id AND abs(n.line_no - e.line_no) <= 3) AS in_warning_block FROM ev e""",
    "classed": "SELECT *, CASE WHEN kind = 'linker_undef' THEN 'undefined_reference' WHEN kind = 'linker_missing' THEN 'missing_lib' "
    + " ".join(f"WHEN {has('(?i)' + '|'.join(s[5]), 'message')} THEN '{s[0]}'" for s in P.SEMANTICS if s[0] in P.BY_MESSAGE)
    + " ELSE 'generic_error' END AS semantic_class FROM blocked",
    "based": "SELECT *, CASE WHEN context_satisfied THEN 0.70::DOUBLE ELSE CASE semantic_class "
    + " ".join(f"WHEN '{s[0]}' THEN {s[1]}::DOUBLE" for s in P.SEMANTICS)
    + " END END AS base, CASE semantic_class "
    + " ".join(f"WHEN '{s[0]}' THEN {s[3]}::DOUBLE" for s in P.SEMANTICS)
    + """ END AS cascade FROM (SELECT *, semantic_class = 'generic_error' AND command_id IS NOT NULL AND phase IS NOT DISTINCT FROM failed_phase
      AND kind NOT IN ('make_cascade', 'rpm_phase') AS context_satisfied FROM classed)""",
    "scored": """SELECT *, floor((score + 0.025::DOUBLE) / 0.05::DOUBLE)::INTEGER AS bucket,
      CASE WHEN score >= 0.85::DOUBLE THEN 'high' WHEN score >= 0.70::DOUBLE THEN 'medium_high' WHEN score >= 0.50::DOUBLE THEN 'medium' ELSE 'low' END AS band
      FROM (SELECT *, CASE WHEN kind = 'make_cascade' AND parent IS NOT NULL THEN 0.1::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        base - CASE WHEN kind = 'linker_undef' THEN 0.0::DOUBLE ELSE cascade * 0.3::DOUBLE END
        + CASE WHEN command_id IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN coalesce(file, '') <> '' AND coalesce(line, 0) <> 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN kind = 'patch' AND phase IS NOT DISTINCT FROM failed_phase THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
        - CASE WHEN in_warning_block THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
        - CASE WHEN parent IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)) END AS score FROM based)""",
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY bucket DESC, CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, score DESC, line_no)::INTEGER AS rank FROM scored) WHERE rank <= 3""",
}
ORDER = list(CTES)


def chain(upto: str, select: str) -> str:
    """The select over all expressions up to that one."""
    used = ORDER[: ORDER.index(upto) + 1]
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in used) + " " + select
