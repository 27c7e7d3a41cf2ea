"""Queries of the gates over facts made from the driver's event stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from buildlens.operators import gates as G
from buildlens.operators import state
from buildlens.plans.sql import q

def event():
    return F.col("event_id")


def events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("unit"))


def pick(values, column):
    """The value at the column's remainder; None is null."""
    return F.array(*[F.lit(v) for v in values])[(column % len(values)).cast("int")]


def sql_pick(values, expr):
    return "CASE " + f"({expr}) % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " END"


KINDS = ["BUILD_INVOCATION", "SECONDARY_TARGET_ADOPTED", "CONVERGENCE", "POLICY", "KB"]
STATUSES = [G.HELD, "READY", "", None]
REASONS = ["previous_evidence_missing", "worktree_dirty", "no_such_reason", None, "orphan_pass"]
ARCHES = ["aarch64", "armv7l", "x86_64", None, "mips", None, None]
STAGES = ["apply_failed", "apply_unexpected_paths", "no_effective_changes", "analyzer_failed", "gbs_build_failed", "build_timeout", "build_mutated_source", "infrastructure_failed", "toolchain_failed", None, "gbs_build_failed"]

#: A payload of each type that breaks no rule.
GOOD = {
    "REPRODUCE": {"arch_norm": "aarch64", "outcome": "matched", "evidence_local": "e", "evidence_sha256": "h", "synthetic_zero_error": False, "gbs_conf_sha256": "g", "ci_evidence_sha256_used": "c", "build_log": "b", "basis": None},
    "BUILD_INVOCATION": {"round_index": 1, "arch_norm": "armv7l"},
    "ORPHAN_PASS": {"round_index": 2, "arch_norm": "x86_64", "verification_id": "v", "worktree_path": "w", "reason": "ambiguous", "detected_at": "t"},
    "POLICY": {"round_index": 1, "verdict": "ok", "hits": [], "fix_strategy_initial": "a", "fix_strategy_final": "b", "edit_source_kind": "generated"},
    "DERIVE": {k: "x" for k in ("message_brief", "author_identity", "committer_identity", "author_date", "committer_date", "derived_commit_sha", "verified_tree_sha")},
    "PUSH": {"ref": "r", "ref_class": "review", "pushed_sha": "s", "result": "ok", "url": None, "at": "t"},
    "KB": {"kb_id": "k", "dedupe_hit": True, "status": "NEW", "at": "t"},
    "REVIEW": {"outcome": "pushed", "review_url": None, "degraded": False, "qb_event_id": 3, "at": "t"},
    "CONVERGENCE": {"round_index": 1, "arch_norm": "aarch64", "invocation_event_id": 5, "result": "FAIL", "verdict": "stalled", "reason": "same", "evidence_path": "p", "evidence_sha256": "h", "verification_id": None, "actual_changed_paths": ["a.c"], "previous_basis": "none", "at": "t"},
    "SECONDARY_TARGET_ADOPTED": {"arch_norm": "aarch64", "adopted_fingerprint": {"file": "a"}, "baseline_error_count": 1, "current_error_count": 1, "baseline_truncated": False, "current_truncated": False, "expected_reproduce_event_id": 9, "at": "t"},
    "WORKSPACE_CLEANUP": {"paths": ["a"], "reason": "r"},
    "WORKSPACE_RELEASE": {"paths": [], "reason": "r"},
}
DROP = object()
#: type, changes to its good payload, and what is then wrong with it, stated by hand.
BROKEN = [
    *[(kind, {}, []) for kind in GOOD],
    ("REPRODUCE", {"outcome": "baseline_pass"}, ["baseline_pass_needs_zero_error"]),
    ("REPRODUCE", {"outcome": "other", "arch_norm": "mips"}, ["value:outcome", "kind:arch_norm"]),
    ("REPRODUCE", {"basis": DROP, "build_log": ""}, ["missing:basis", "kind:build_log"]),
    ("BUILD_INVOCATION", {"round_index": 0}, ["kind:round_index"]),
    ("BUILD_INVOCATION", {"round_index": True}, ["kind:round_index"]),
    ("ORPHAN_PASS", {"reason": "lost", "detected_at": DROP}, ["value:reason", "missing:detected_at"]),
    ("POLICY", {"hits": "none", "edit_source_kind": "typed"}, ["kind:hits", "value:edit_source_kind"]),
    ("DERIVE", {"author_date": 5}, ["kind:author_date"]),
    ("PUSH", {"url": DROP, "result": "maybe"}, ["missing:url", "value:result"]),
    ("KB", {"status": "OLD", "dedupe_hit": "yes"}, ["value:status", "kind:dedupe_hit"]),
    ("REVIEW", {"outcome": "manual"}, ["manual_needs_degraded"]),
    ("CONVERGENCE", {"reason": "rebaselined"}, ["invocation_by_reason", "no_outcome_needs_n_a"]),
    ("CONVERGENCE", {"invocation_event_id": None}, ["invocation_by_reason"]),
    ("CONVERGENCE", {"reason": "rebaselined", "invocation_event_id": None, "result": "n_a", "verdict": "n_a", "evidence_path": None, "evidence_sha256": None}, []),
    ("CONVERGENCE", {"result": "PASS"}, ["pass_fields"]),
    ("CONVERGENCE", {"result": "PASS", "verdict": "n_a", "verification_id": "v", "evidence_path": None, "evidence_sha256": None}, []),
    ("CONVERGENCE", {"verdict": "n_a"}, ["fail_fields"]),
    ("CONVERGENCE", {"result": "n_a", "verdict": "n_a", "reason": "apply_failed"}, ["n_a_fields"]),
    ("CONVERGENCE", {"result": "none", "previous_basis": "guess"}, ["outcome_needs_result", "value:previous_basis"]),
    ("SECONDARY_TARGET_ADOPTED", {"current_truncated": True, "adopted_fingerprint": "f"}, ["truncated_evidence", "kind:adopted_fingerprint"]),
    ("WORKSPACE_CLEANUP", {"paths": "a"}, ["kind:paths"]),
    ("NO_SUCH_TYPE", {}, ["unknown_type"]),
]


def payload(kind: str, changes: dict) -> str:
    return json.dumps({k: v for k, v in (GOOD.get(kind, {}) | changes).items() if v is not DROP})


def payloads(s, d):
    at = (event() % len(BROKEN)).cast("int")
    return events(s, d).select("event_id", F.array(*[F.lit(k) for k, _, _ in BROKEN])[at].alias("event_type"), F.array(*[F.lit(payload(k, c)) for k, c, _ in BROKEN])[at].alias("payload"))


def fail_facts(s, d):
    return events(s, d).select(
        "event_id",
        pick(STAGES, event()).alias("stage"),
        (event() % 3 != 0).alias("has_evidence"),
        (event() % 13 != 0).alias("evidence_bound"),
        (event() % 17 != 0).alias("previous_bound"),
        pick(["auto", "needs_confirmation", "denied", "other"], F.floor(event() / 2)).alias("repair_allowed"),
        pick([None, "too risky"], event()).alias("error"),
        pick(["advance", "stalled", "regressed"], F.floor(event() / 3)).alias("verdict"),
        F.lit("by_convergence").alias("reason"),
        (event() % 5 == 0).alias("adoptable"),
    )


def verify_facts(s, d):
    return events(s, d).select("event_id", *[(event() % n != 0).alias(c) for c, n in (("edit_ok", 11),)], *[(event() % n == 0).alias(c) for c, n in (("no_changes", 13), ("apply_error", 17), ("whitespace_error", 19), ("timed_out", 23), ("mutated", 29))], F.when(event() % 7 == 0, F.array(F.lit("a.c"), F.lit("z.c"))).when(event() % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.c"))).alias("changed"), F.array(F.lit("a.c"), F.lit("b.c")).alias("allowed"), (event() % 3).cast("int").alias("exit_code"))


def relink_facts(s, d):
    return events(s, d).select("event_id", *[(event() % n != 0).alias(c) for c, n in (("worktree", 7), ("identity_equal", 11), ("marker_equal", 13), ("tree_equal", 17), ("clean", 5))], F.when(event() % 19 == 0, F.lit(None)).when(event() % 19 == 1, F.array(F.lit("/etc/a"))).when(event() % 19 == 2, F.array(F.lit("a/../b"))).otherwise(F.array(F.lit("a.c"))).alias("paths"))


def new_units(s, d):
    k = F.col("c_custkey")
    arches = ["standard-aarch64", "standard-armv7l", "emulator-x86_64", None]
    failed = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("standard-aarch64"), F.lit("emulator-x86_64")))
    return s.read.parquet(f"{d}/customer.parquet").select(k.alias("unit"), pick(arches, k).alias("primary_arch"), failed.alias("failed_arches"), (k % 5).cast("int").alias("max_rounds"), (k % 7).cast("int").alias("max_build_invocations"), *[(F.when(k % 11 == i, F.lit("")).otherwise(F.lit("x"))).alias(c) for i, c in enumerate(G.IDENTITY)])


def latest(s, d):
    return events(s, d).groupBy("unit").agg(F.max("event_id").alias("event_id")).select("unit", pick([G.HELD, G.REJECTED, "READY"], event()).alias("status"), pick(["previous_evidence_missing", "arch", None], F.floor(event() / 3)).alias("reason"), pick(["aarch64", None], F.floor(event() / 9)).alias("arch"))


LATEST = f"latest AS (SELECT unit, {sql_pick([G.HELD, G.REJECTED, 'READY'], 'e')} AS status, {sql_pick(['previous_evidence_missing', 'arch', None], 'e // 3')} AS reason, {sql_pick(['aarch64', None], 'e // 9')} AS arch FROM (SELECT user_id AS unit, max(event_id) AS e FROM events GROUP BY 1))"


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 40).alias("unit"), F.col("o_orderkey").alias("k"))


def links(s, d):
    k = F.col("k")
    return orders(s, d).filter(k % 3 == 0).select("unit", pick(["aarch64", "x86_64"], F.col("unit")).alias("arch"), k.alias("verification_id"), (k % 4).alias("round"))


def outcomes(s, d):
    """A convergence event for every pass but some, of which some name another round, another invocation, or stand twice."""
    k = F.col("k")
    one = orders(s, d).filter((k % 3 == 0) & (k % 501 != 0)).select("unit", pick(["aarch64", "x86_64"], F.col("unit")).alias("arch"), k.alias("event_id"), k.alias("verification_id"), F.when(k % 1002 == 6, F.lit(9)).otherwise(k % 4).alias("round"), F.lit("n_a").alias("verdict"), F.lit("PASS").alias("result"), (k + F.when(k % 999 == 3, 1).otherwise(0)).alias("invocation"))
    return one.union(one.filter("event_id % 1503 = 9"))


def invocations(s, d):
    return orders(s, d).select(F.col("k").alias("event_id"), "unit", pick(["aarch64", "x86_64"], F.col("unit")).alias("arch"), (F.col("k") % 4).alias("round"))


def adoption_inputs(s, d):
    u = F.col("unit")
    units = events(s, d).select("unit").distinct()
    asks = units.select("unit", F.lit("aarch64").alias("arch"), F.when(u % 7 == 0, F.lit(-1)).otherwise(u * 10 + 1).cast("long").alias("expected"), pick(["f", "g", None], u).alias("fingerprint"), (u % 4).alias("errors"), (u % 11 == 0).alias("truncated"))
    old = units.select("unit", F.lit("aarch64").alias("arch"), (u * 10).cast("long").alias("event_id"), F.lit("matched").alias("outcome"), F.lit("z").alias("fingerprint"), F.lit(99).cast("long").alias("errors"), F.lit(False).alias("truncated"))
    new = units.select("unit", F.lit("aarch64").alias("arch"), (u * 10 + 1).cast("long").alias("event_id"), F.when(u % 5 == 0, "matched").otherwise("different_failure").alias("outcome"), F.when(u % 3 == 2, "g").otherwise("f").alias("fingerprint"), (u % 2).alias("errors"), (u % 13 == 0).alias("truncated"))
    return asks, old.union(new), units.filter(u % 17 == 0).withColumn("arch", F.lit("aarch64"))


QUERIES = {
    "payload_violations": lambda s, d: state.payload_violations(payloads(s, d)),
    "gate_rows": lambda s, d: G.gate_rows(payloads(s, d).filter("event_type = 'BUILD_INVOCATION'")),
    "append_guard": lambda s, d: events(s, d).select(pick(KINDS, event()).alias("event_type"), pick(["PASS", "FAIL", None], event()).alias("result")).withColumn("refused", G.append_refused(F.col("event_type"), F.col("result"))).groupBy("event_type", "refused").agg(F.count(F.lit(1)).alias("n")),
    "status_guard": lambda s, d: events(s, d).select("event_id", G.status_refused(pick(STATUSES, event()), pick(REASONS, event()), pick(ARCHES, event())).alias("refused")),
    "rebaseline": lambda s, d: G.rebaseline_authorized(latest(s, d), F.lit("aarch64")),
    "unit_violations": lambda s, d: G.unit_violations(new_units(s, d)),
    "rejected_units": lambda s, d: G.rejected_units(events(s, d).select("unit").distinct().withColumn("reason", F.when(F.col("unit") % 9 == 0, "").otherwise("arch")), latest(s, d).filter("unit % 4 <> 0")),
    "request_idempotence": lambda s, d: G.requests_to_add(orders(s, d).filter("k % 2 = 0").select("unit", F.col("k").alias("request"), (F.col("k") % 5).alias("input"), (F.col("k") * 3).alias("seq")), orders(s, d).select("unit", F.col("k").alias("request"), (F.col("k") % 10).alias("input"))),
    "orphan_pass_new": lambda s, d: G.orphan_passes_to_add(orders(s, d).filter("k % 3 = 0").select("unit", F.col("k").alias("verification_id")), orders(s, d).select("unit", F.col("k").alias("verification_id"))),
    "linked_pass_complete": lambda s, d: G.linked_passes_complete(links(s, d), outcomes(s, d), invocations(s, d)),
    "unit_by_build": lambda s, d: G.units_by_build(orders(s, d).select("unit", F.col("k").alias("request")), orders(s, d).select(F.col("k").alias("request"), (F.col("k") % 900).alias("build"))),
    "rounds_with_pass": lambda s, d: G.rounds_with_pass(orders(s, d).select("unit", (F.col("k") % 6).alias("round"), (F.col("k") % 101).alias("edit")).distinct(), orders(s, d).filter("k % 5 = 0").select("unit", (F.col("k") % 101).alias("edit"), F.lit("PASS").alias("result"))),
    "failure_outcome": lambda s, d: G.failure_outcomes(fail_facts(s, d)).select("event_id", "step_result", "step_verdict", "step_reason"),
    "verify_outcome": lambda s, d: verify_facts(s, d).select("event_id", G.verify_outcome().alias("outcome"), F.array_join(G.unexpected_paths(F.col("changed"), F.col("allowed")), ",").alias("unexpected")),
    "relink_outcome": lambda s, d: relink_facts(s, d).select("event_id", G.relink_outcome().alias("outcome")),
    "adoption": lambda s, d: G.adoptions(*adoption_inputs(s, d)),
}

WRONG = ", ".join(f"({i}, {q(w)})" for i, (_, _, wrong) in enumerate(BROKEN) for w in wrong)
STAGE = f"CASE WHEN stage IN ('apply_failed', 'apply_unexpected_paths', 'no_effective_changes') THEN 'apply_failed' WHEN stage = 'analyzer_failed' OR (stage = 'gbs_build_failed' AND e % 3 = 0) THEN 'analyzer_failed' WHEN stage IN ('build_timeout', 'build_mutated_source', 'infrastructure_failed', 'toolchain_failed') THEN 'toolchain_failed' END"
ORDERS = "o AS (SELECT o_custkey % 40 AS unit, o_orderkey AS k, CASE (o_custkey % 40) % 2 WHEN 0 THEN 'aarch64' ELSE 'x86_64' END AS arch FROM orders)"
ORACLES = {
    "payload_violations": f"SELECT event_id, violation FROM events JOIN (VALUES {WRONG}) v(k, violation) ON event_id % {len(BROKEN)} = k",
    "gate_rows": "SELECT event_id, r::INTEGER AS round, 'armv7l' AS arch, NULL::VARCHAR AS verdict, NULL::BIGINT AS invocation, '{\"arch_norm\":\"armv7l\",\"round_index\":' || p || '}' AS payload FROM events JOIN (VALUES "
    + ", ".join(f"({i}, {c.get('round_index', 1) if c.get('round_index') is not True else 'NULL'}, '{str(c.get('round_index', 1)).lower()}')" for i, (k, c, _) in enumerate(BROKEN) if k == "BUILD_INVOCATION")
    + f") v(k, r, p) ON event_id % {len(BROKEN)} = k",
    "append_guard": f"SELECT event_type, CASE WHEN event_type = 'BUILD_INVOCATION' THEN 'needs_invocation_writer' WHEN event_type = 'SECONDARY_TARGET_ADOPTED' THEN 'needs_adoption_writer' WHEN event_type = 'CONVERGENCE' AND result = 'PASS' THEN 'needs_link_writer' END AS refused, count(*) AS n FROM (SELECT {sql_pick(KINDS, 'event_id')} AS event_type, {sql_pick(['PASS', 'FAIL', None], 'event_id')} AS result FROM events) GROUP BY ALL",
    "status_guard": f"SELECT event_id, CASE WHEN coalesce(status, '') = '' THEN 'empty_status' WHEN arch = 'mips' THEN 'unknown_arch' WHEN status = '{G.HELD}' AND coalesce(reason = 'no_such_reason', true) THEN 'invalid_held_reason' WHEN status = '{G.HELD}' AND reason IN ('previous_evidence_missing', 'orphan_pass') AND arch IS NULL THEN 'held_reason_needs_arch' END AS refused FROM (SELECT event_id, {sql_pick(STATUSES, 'event_id')} AS status, {sql_pick(REASONS, 'event_id')} AS reason, {sql_pick(ARCHES, 'event_id')} AS arch FROM events)",
    "rebaseline": f"WITH {LATEST} SELECT unit, coalesce(status = '{G.HELD}' AND reason = 'previous_evidence_missing' AND arch = 'aarch64', false) AS authorized FROM latest",
    "unit_violations": """WITH u AS (SELECT c_custkey AS unit, c_custkey AS k FROM customer)
      SELECT unit, 'primary_arch_not_allowed' AS violation FROM u WHERE k % 4 = 2 UNION ALL SELECT unit, 'primary_arch_did_not_fail' FROM u WHERE (k % 4 = 1) OR (k % 4 IN (0, 2) AND k % 6 = 0)
      UNION ALL SELECT unit, 'no_failed_arch' FROM u WHERE k % 6 = 0 UNION ALL SELECT unit, 'max_rounds' FROM u WHERE k % 5 = 0 UNION ALL SELECT unit, 'max_build_invocations' FROM u WHERE k % 7 = 0"""
    + "".join(f" UNION ALL SELECT unit, 'identity:{c}' FROM u WHERE k % 11 = {i}" for i, c in enumerate(G.IDENTITY)),
    "rejected_units": f"WITH {LATEST} SELECT u.unit, CASE WHEN u.unit % 9 = 0 THEN 'empty_reason' WHEN l.unit IS NULL THEN 'insert' WHEN l.status = '{G.REJECTED}' AND l.reason IS NOT DISTINCT FROM 'arch' AND l.arch IS NULL THEN 'no_op' ELSE 'conflict' END AS action FROM (SELECT DISTINCT user_id AS unit FROM events) u LEFT JOIN latest l ON l.unit = u.unit AND l.unit % 4 <> 0",
    "request_idempotence": "SELECT o_custkey % 40 AS unit, o_orderkey AS request, CASE WHEN o_orderkey % 2 = 1 THEN 'submit' WHEN o_orderkey % 5 = o_orderkey % 10 THEN 'same' ELSE 'conflict' END AS action, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 3 END AS seq FROM orders",
    "orphan_pass_new": "SELECT o_custkey % 40 AS unit, o_orderkey AS verification_id FROM orders WHERE o_orderkey % 3 <> 0",
    "linked_pass_complete": f"WITH {ORDERS} SELECT unit, arch, bool_and(k % 501 <> 0 AND k % 1503 <> 9 AND k % 1002 <> 6 AND (k % 999 <> 3 OR EXISTS (SELECT 1 FROM o i WHERE i.k = o.k + 1 AND i.unit = o.unit AND i.arch = o.arch AND i.k % 4 = o.k % 4))) AS complete FROM o WHERE k % 3 = 0 GROUP BY ALL",
    "unit_by_build": f"WITH {ORDERS} SELECT k % 900 AS build, min(unit) AS unit, count(DISTINCT unit) > 1 AS ambiguous FROM o GROUP BY ALL",
    "rounds_with_pass": f"WITH {ORDERS} SELECT DISTINCT unit, k % 101 AS edit, k % 6 AS round FROM o WHERE EXISTS (SELECT 1 FROM o p WHERE p.unit = o.unit AND p.k % 101 = o.k % 101 AND p.k % 5 = 0)",
    "failure_outcome": f"""SELECT e AS event_id, CASE WHEN why IN ('stage', 'current', 'previous') THEN 'n_a' ELSE 'FAIL' END AS step_result,
      CASE WHEN why IN ('stage', 'current', 'previous') THEN 'n_a' WHEN why = 'denied' THEN 'denied' WHEN verdict = 'stalled' AND e % 5 = 0 THEN 'advance' ELSE verdict END AS step_verdict,
      CASE why WHEN 'stage' THEN na WHEN 'current' THEN 'analyzer_failed' WHEN 'previous' THEN 'previous_evidence_missing' WHEN 'denied' THEN CASE WHEN e % 2 = 1 THEN 'too risky' ELSE 'repair denied by failure classifier' END ELSE 'by_convergence' END AS step_reason
      FROM (SELECT *, CASE WHEN na IS NOT NULL THEN 'stage' WHEN e % 13 = 0 THEN 'current' WHEN e % 17 = 0 THEN 'previous' WHEN (e // 2) % 4 >= 2 THEN 'denied' ELSE 'rest' END AS why
        FROM (SELECT *, {STAGE} AS na, {sql_pick(['advance', 'stalled', 'regressed'], 'e // 3')} AS verdict FROM (SELECT event_id AS e, {sql_pick(STAGES, 'event_id')} AS stage FROM events)))""",
    "verify_outcome": "SELECT e AS event_id, CASE WHEN e % 11 = 0 THEN 'apply_failed' WHEN e % 13 = 0 THEN 'no_effective_changes' WHEN e % 17 = 0 OR e % 19 = 0 THEN 'apply_failed' WHEN e % 7 = 0 THEN 'apply_unexpected_paths' WHEN e % 7 = 1 THEN 'no_effective_changes' WHEN e % 23 = 0 THEN 'build_timeout' WHEN e % 29 = 0 THEN 'build_mutated_source' WHEN e % 3 <> 0 THEN 'gbs_build_failed' ELSE 'PASS' END AS outcome, CASE WHEN e % 7 = 0 THEN 'z.c' ELSE '' END AS unexpected FROM (SELECT event_id AS e FROM events)",
    "relink_outcome": "SELECT e AS event_id, CASE WHEN e % 7 = 0 THEN 'worktree_damaged' WHEN e % 11 = 0 OR e % 13 = 0 OR e % 17 = 0 THEN 'hash_mismatch' WHEN e % 5 = 0 OR e % 19 <= 2 THEN 'worktree_damaged' ELSE 'relink' END AS outcome FROM (SELECT event_id AS e FROM events)",
    "adoption": "SELECT u AS unit, 'aarch64' AS arch, CASE WHEN u % 17 = 0 THEN 'adopted_before' WHEN u % 7 = 0 THEN 'reproduce_changed' WHEN u % 5 = 0 THEN 'reproduce_matched' WHEN u % 11 = 0 OR u % 13 = 0 THEN 'truncated' WHEN u % 3 <> 0 THEN 'other_fingerprint' WHEN u % 4 <> u % 2 THEN 'other_count' ELSE 'adopt' END AS decision FROM (SELECT DISTINCT user_id AS u FROM events)",
}
