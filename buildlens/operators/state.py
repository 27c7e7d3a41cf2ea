"""The append-only state store: latest rows, gates as queries whose result must be empty, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by the columns given. max_by is summed up before the shuffle, so long histories are no long groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def transitions(rows: DataFrame) -> DataFrame:
    """unit, seq, from_state, to_state of a status log (unit, at, log_id, status)."""
    w = Window.partitionBy("unit").orderBy("at", "log_id")
    return rows.select("unit", F.row_number().over(w).alias("seq"), F.lag("status").over(w).alias("from_state"), F.col("status").alias("to_state"))


def orphan_invocations(gates: DataFrame) -> DataFrame:
    """Invocations that no outcome names, by unit and round; gates: event_id, unit, round, event_type, invocation."""
    named = gates.filter("event_type <> 'BUILD_INVOCATION' and invocation is not null").select("unit", F.col("invocation").alias("event_id")).distinct()
    free = gates.filter("event_type = 'BUILD_INVOCATION'").join(named, ["unit", "event_id"], "left_anti")
    return free.groupBy("unit", "round").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def unlinked_passes(verifications: DataFrame, links: DataFrame) -> DataFrame:
    return verifications.filter("result = 'PASS'").join(links.select("verification_id").distinct(), "verification_id", "left_anti")


def attributed(passes: DataFrame, rounds: DataFrame) -> DataFrame:
    """Passes by how many rounds have their edit: none, one (the round), or several, which is inconsistent. Rounds are counted by
    unit and edit before passes meet them, so no pairs are made."""
    told = rounds.groupBy("unit", "edit").agg(F.count("round").alias("told"), F.min("round").alias("round"))
    n = passes.join(told, ["unit", "edit"], "left").groupBy("unit", "verification_id").agg(F.coalesce(F.sum("told"), F.lit(0)).alias("n"), F.min("round").alias("round"))
    kind = F.when(F.col("n") == 0, "non_campaign").when(F.col("n") == 1, "attributed").otherwise("inconsistent")
    return n.select("unit", "verification_id", kind.alias("attribution"), F.when(F.col("n") == 1, F.col("round")).alias("round"))


def as_of(events: DataFrame, asks: DataFrame) -> DataFrame:
    """For each ask (unit, event_id) the last event of its unit before it. One window over both, so no pairs are made."""
    both = events.select("unit", "event_id", F.col("event_id").alias("found")).unionByName(asks.select("unit", "event_id", F.lit(None).cast("long").alias("found"), F.lit(True).alias("ask")), allowMissingColumns=True)
    w = Window.partitionBy("unit").orderBy("event_id", F.col("ask").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("before", F.last("found", True).over(w)).filter("ask").select("unit", "event_id", "before")


def invocation_budget(units: DataFrame, gates: DataFrame) -> DataFrame:
    used = gates.filter("event_type = 'BUILD_INVOCATION'").groupBy("unit").agg(F.count(F.lit(1)).alias("used"))
    df = units.join(used, "unit", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return df.select("unit", "used", F.greatest(F.lit(0), F.col("max_invocations") - F.col("used")).alias("remaining"))


def next_round(units: DataFrame, rounds: DataFrame) -> DataFrame:
    """The round that may come next; null when the limit is reached or rounds have a gap."""
    n = rounds.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("most"))
    df = units.join(n, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("most", F.coalesce("most", F.lit(0)))
    return df.select("unit", "n", F.when((F.col("n") < F.col("max_rounds")) & (F.col("n") == F.col("most")), F.col("most") + 1).alias("next_round"))


#: Reasons that a history walk passes over.
SKIPPED = ["rebuild_recovered", "analyzer_failed", "apply_failed", "toolchain_failed"]


def history_basis(events: DataFrame) -> DataFrame:
    """What a unit's next comparison is based on: its newest event (unit, event_id, verdict, reason, result) that is not passed over.

    A substantive failure is the base itself; a pass or a new baseline sends back to the reproduction, as does an empty history.
    """
    stop = latest(events.filter(~((F.col("verdict") == "n_a") & F.coalesce(F.col("reason").isin(*SKIPPED), F.lit(False)))), ["unit"], "event_id")
    basis = F.when(F.col("verdict").isin("advance", "stalled", "regressed", "denied"), "prev_build").otherwise("reproduce")
    return events.select("unit").distinct().join(stop, "unit", "left").select("unit", F.col("event_id").alias("stop_event"), F.coalesce(basis, F.lit("reproduce")).alias("basis"))


def latest_results(requests: DataFrame, events: DataFrame) -> DataFrame:
    """The last RESULT of each unit's last request; none if only older requests have one."""
    last = requests.groupBy("unit").agg(F.max("request").alias("request"))
    return latest(last.join(events.filter("event_type = 'RESULT'"), "request").select("unit", "request", "event_id", "status"), ["unit"], "event_id", "status")


def reconcile(passes: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per unit and round what to do: one pass and one free invocation are linked anew; other passes stay orphans; free invocations alone get an outcome."""
    p = passes.filter("attribution = 'attributed'").groupBy("unit", "round").agg(F.count(F.lit(1)).alias("passes"))
    df = p.join(orphans.select("unit", "round", F.col("n").alias("free")), ["unit", "round"], "full").select("unit", "round", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("free", F.lit(0)).alias("free"))
    return df.withColumn("action", F.when((F.col("passes") == 1) & (F.col("free") == 1), "relinked").when(F.col("passes") > 0, "orphan_pass_held").otherwise("backfill"))


def reconciled(current: DataFrame, links: DataFrame, passes: DataFrame, orphans: DataFrame) -> DataFrame:
    """One result for each unit of current (unit, round, edit), and in how many rounds passes are held, linked anew, or invocations filled in.

    links: unit, edit, event_id of passes that are linked, null where the outcome is missing. passes: unit, round, attribution of those
    that are not. orphans: unit, round, n. The first of these holds: a half-linked pass, two links of the current edit or a pass of
    several rounds is an inconsistent state, of which nothing else is done; a pass that stays an orphan, in any round, holds the unit;
    the current edit is linked; it was linked anew; the unit proceeds.
    """
    half = links.join(current.select("unit", F.col("edit").alias("now")), "unit").groupBy("unit").agg(F.max(F.col("event_id").isNull()).alias("half"), F.count_if(F.col("edit") == F.col("now")).alias("linked"))
    torn = passes.groupBy("unit").agg(F.max(F.col("attribution") == "inconsistent").alias("torn"))
    each = reconcile(passes, orphans).join(current.select("unit", F.col("round").alias("now")), "unit")
    tell = lambda action: F.count_if(F.col("action") == action)
    acts = each.groupBy("unit").agg(tell("orphan_pass_held").alias("held"), tell("relinked").alias("relinked"), tell("backfill").alias("filled"), F.max((F.col("action") == "relinked") & (F.col("round") == F.col("now"))).alias("anew"))
    df = current.select("unit").join(half, "unit", "left").join(torn, "unit", "left").join(acts, "unit", "left")
    bad = F.coalesce("half", F.lit(False)) | (F.coalesce("linked", F.lit(0)) > 1) | F.coalesce("torn", F.lit(False))
    branch = F.when(bad, "state_inconsistent_held").when(F.col("held") > 0, "orphan_pass_held").when(F.col("linked") > 0, "linked_already").when(F.col("anew"), "relinked").otherwise("proceed")
    return df.select("unit", branch.alias("branch"), *[F.when(bad, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("held", "relinked", "filled")])


def binding_violations(gates: DataFrame) -> DataFrame:
    """Outcomes whose invocation does not exist, is of another type, or of another unit or round."""
    bound = gates.filter("invocation is not null").alias("o")
    inv = gates.select(F.col("event_id").alias("invocation"), F.col("event_type").alias("t"), F.col("unit").alias("u"), F.col("round").alias("r"))
    df = bound.join(inv, "invocation", "left")
    why = F.when(F.col("t").isNull(), "missing").when(F.col("t") != "BUILD_INVOCATION", "not_an_invocation").when(~F.col("u").eqNullSafe(F.col("unit")), "other_unit").when(~F.col("r").eqNullSafe(F.col("round")), "other_round")
    return df.withColumn("violation", why).filter("violation is not null").select("event_id", "violation")


def changed_identity(derived: DataFrame, fields: list[str]) -> DataFrame:
    """Units whose first-written fields do not stay the same."""
    return derived.groupBy("unit").agg(F.count_distinct(F.struct(*fields)).alias("versions")).filter("versions > 1")


def request_violations(events: DataFrame) -> DataFrame:
    """Requests with two build ids, and results before any binding (request, event_id, event_type, build)."""
    two = events.filter("event_type = 'BUILD_BOUND'").groupBy("request").agg(F.count_distinct("build").alias("n")).filter("n > 1").select("request", F.lit("two_builds").alias("violation"))
    first = events.filter("event_type = 'BUILD_BOUND'").groupBy("request").agg(F.min("event_id").alias("bound"))
    early = events.filter("event_type = 'RESULT'").join(first, "request", "left").filter("bound is null or event_id < bound").select("request", F.lit("result_unbound").alias("violation")).distinct()
    return two.unionByName(early)


def submit_gate(facts: DataFrame) -> DataFrame:
    """The first reason that holds a submission back, else dry_run or submit."""
    f = F.col
    out = (
        F.when(f("verification_id").isNull(), "no_record")
        .when(f("latest_status") != "ready", "latest_not_ready")
        .when(~f("status_verification").eqNullSafe(f("verification_id")), "other_verification")
        .when(~f("worktree"), "worktree_missing")
        .when(~f("head").eqNullSafe(f("sha")), "sha_mismatch")
        .when(f("dirty"), "dirty")
        .when(~f("enabled"), "submit_disabled")
        .when(f("duplicate"), "duplicate")
        .when(f("dry"), "dry_run")
        .otherwise("submit")
    )
    return facts.withColumn("outcome", out)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows that contradict what is stored; equal rows are neither. Inserts only, no update."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    met = new.join(old, keys)
    return new.join(existing.select(*keys), keys, "left_anti"), met.filter(~F.struct(*rest).eqNullSafe(F.col("_old"))).drop("_old")


def failure_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def submission_key(key: Column, tree: Column) -> Column:
    return F.sha2(F.concat_ws(":", key, tree), 256)


ROUND, ARCH, TEXT, FLAG, COUNT, LIST, OBJECT, ANY = "round", "arch", "text", "flag", "count", "list", "object", "any"
#: The keys that each event's payload must have, by what they hold, and the values of its closed fields.
PAYLOADS: dict[str, tuple[dict[str, str], dict[str, list[str]]]] = {
    "REPRODUCE": ({"arch_norm": ARCH, "outcome": TEXT, "evidence_local": TEXT, "evidence_sha256": TEXT, "synthetic_zero_error": FLAG, "gbs_conf_sha256": TEXT, "ci_evidence_sha256_used": TEXT, "build_log": TEXT, "basis": ANY}, {"outcome": ["matched", "different_failure", "baseline_pass"]}),
    "BUILD_INVOCATION": ({"round_index": ROUND, "arch_norm": ARCH}, {}),
    "ORPHAN_PASS": ({"round_index": ROUND, "arch_norm": ARCH, "verification_id": TEXT, "worktree_path": TEXT, "reason": TEXT, "detected_at": TEXT}, {"reason": ["link_failed", "hash_mismatch", "worktree_damaged", "ambiguous", "no_free_invocation_slot"]}),
    "POLICY": ({"round_index": ROUND, "verdict": ANY, "hits": LIST, "fix_strategy_initial": ANY, "fix_strategy_final": ANY, "edit_source_kind": TEXT}, {"edit_source_kind": ["t1_cherry_pick", "generated", "suppress"]}),
    "DERIVE": ({"message_brief": TEXT, "author_identity": TEXT, "committer_identity": TEXT, "author_date": TEXT, "committer_date": TEXT, "derived_commit_sha": TEXT, "verified_tree_sha": TEXT}, {}),
    "PUSH": ({"ref": TEXT, "ref_class": TEXT, "pushed_sha": TEXT, "result": TEXT, "url": ANY, "at": TEXT}, {"ref_class": ["sandbox", "review"], "result": ["ok", "failed"]}),
    "KB": ({"kb_id": TEXT, "dedupe_hit": FLAG, "status": TEXT, "at": TEXT}, {"status": ["NEW"]}),
    "REVIEW": ({"outcome": TEXT, "review_url": ANY, "degraded": FLAG, "qb_event_id": ANY, "at": TEXT}, {"outcome": ["pushed", "manual", "ineligible"]}),
    "CONVERGENCE": ({"round_index": ROUND, "arch_norm": ARCH, "invocation_event_id": ANY, "result": TEXT, "verdict": TEXT, "reason": TEXT, "evidence_path": ANY, "evidence_sha256": ANY, "verification_id": ANY, "actual_changed_paths": LIST, "previous_basis": TEXT, "at": TEXT}, {"verdict": ["advance", "stalled", "regressed", "denied", "n_a"], "previous_basis": ["reproduce", "prev_build", "synthetic_zero", "none"]}),
    "SECONDARY_TARGET_ADOPTED": ({"arch_norm": ARCH, "adopted_fingerprint": OBJECT, "baseline_error_count": COUNT, "current_error_count": COUNT, "baseline_truncated": FLAG, "current_truncated": FLAG, "expected_reproduce_event_id": COUNT, "at": TEXT}, {}),
    "WORKSPACE_CLEANUP": ({"paths": LIST, "reason": TEXT}, {}),
    "WORKSPACE_RELEASE": ({"paths": LIST, "reason": TEXT}, {}),
}
#: Reasons of convergence events that are no build's outcome.
NO_OUTCOME = ["orphan_invocation", "rebaselined", "apply_failed", "analyzer_failed", "toolchain_failed", "previous_evidence_missing"]


def payload_violations(gates: DataFrame) -> DataFrame:
    """event_id, violation: missing keys, values of another kind or outside closed fields, and fields that contradict each other,
    by event type, from the payload's JSON (event_id, event_type, payload). A payload that is no JSON object lacks every key."""
    get = lambda key: F.get_json_object("payload", f"$.{key}")
    kind_of = lambda key: F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), f"$.{key}", "variant"))
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    right = {
        ROUND: lambda k: (kind_of(k) == "BIGINT") & (get(k).try_cast("long") > 0),
        ARCH: lambda k: get(k).isin("aarch64", "armv7l", "x86_64"),
        TEXT: lambda k: (kind_of(k) == "STRING") & (get(k) != ""),
        FLAG: lambda k: kind_of(k) == "BOOLEAN",
        COUNT: lambda k: kind_of(k) == "BIGINT",
        LIST: lambda k: kind_of(k).startswith("ARRAY<"),
        OBJECT: lambda k: kind_of(k).startswith("OBJECT<"),
        ANY: lambda k: F.lit(True),
    }
    checks = []
    for kind, (needed, closed) in PAYLOADS.items():
        own = F.col("event_type") == kind
        for k, holds in needed.items():
            there = F.array_contains(keys, k)
            checks += [F.when(own & ~there, f"missing:{k}"), F.when(own & there & ~F.coalesce(right[holds](k), F.lit(False)), f"kind:{k}")]
        checks += [F.when(own & get(k).isNotNull() & ~get(k).isin(*v), f"value:{k}") for k, v in closed.items()]
    of = lambda kind, wrong, name: F.when((F.col("event_type") == kind) & F.coalesce(wrong, F.lit(False)), name)
    result, verdict, reason, invocation = get("result"), get("verdict"), get("reason"), get("invocation_event_id")
    evidence, verified = get("evidence_path").isNotNull() | get("evidence_sha256").isNotNull(), get("verification_id").isNotNull()
    checks += [
        F.when(~F.col("event_type").isin(*PAYLOADS), "unknown_type"),
        of("REPRODUCE", (get("outcome") == "baseline_pass") & (get("synthetic_zero_error") != "true"), "baseline_pass_needs_zero_error"),
        of("REVIEW", (get("outcome") == "manual") & (get("degraded") != "true"), "manual_needs_degraded"),
        of("SECONDARY_TARGET_ADOPTED", (get("baseline_truncated") != "false") | (get("current_truncated") != "false"), "truncated_evidence"),
        of("CONVERGENCE", (reason == "rebaselined") != invocation.isNull(), "invocation_by_reason"),
        of("CONVERGENCE", reason.isin(*NO_OUTCOME) & ((result != "n_a") | (verdict != "n_a")), "no_outcome_needs_n_a"),
        of("CONVERGENCE", ~reason.isin(*NO_OUTCOME) & ~result.isin("PASS", "FAIL"), "outcome_needs_result"),
        of("CONVERGENCE", (result == "PASS") & ((verdict != "n_a") | ~verified | evidence), "pass_fields"),
        of("CONVERGENCE", (result == "FAIL") & ((verdict == "n_a") | verified | get("evidence_path").isNull() | get("evidence_sha256").isNull()), "fail_fields"),
        of("CONVERGENCE", (result == "n_a") & (evidence | verified), "n_a_fields"),
    ]
    return gates.select("event_id", F.explode(F.array_distinct(F.array_compact(F.array(*checks)))).alias("violation"))
