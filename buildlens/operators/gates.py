"""Gates of the state store: what may be appended, and how a step's facts decide its outcome. Every gate is a column over facts
or a query whose result must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the store.
ARCHES = ["aarch64", "armv7l", "x86_64"]
HELD = "HELD_FOR_INVESTIGATION"
ARCH_HELD = ["previous_evidence_missing", "orphan_pass", "link_mismatch", "verification_mismatch", "state_inconsistent"]
HELD_REASONS = [*ARCH_HELD, "aggregate_mismatch", "edit_spec_rebind_mismatch", "worktree_dirty", "suppress_policy_recheck"]
REJECTED = "REJECTED_ARCH_NOT_ALLOWED"
IDENTITY = ["ci_system", "source_build_id", "project", "branch", "spec_name", "base_commit"]


def first_of(*rungs: tuple[Column, str | Column], otherwise: str | Column | None = None) -> Column:
    """The value of the first rung whose condition holds; a condition that is null does not."""
    out = None
    for holds, value in rungs:
        out = (F if out is None else out).when(F.coalesce(holds, F.lit(False)), value if isinstance(value, Column) else F.lit(value))
    return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def append_refused(event_type: Column, result: Column) -> Column:
    """Why the general append does not take an event; null: it does. Three kinds have writers of their own."""
    return first_of(
        (event_type == "BUILD_INVOCATION", "needs_invocation_writer"),
        (event_type == "SECONDARY_TARGET_ADOPTED", "needs_adoption_writer"),
        ((event_type == "CONVERGENCE") & (result == "PASS"), "needs_link_writer"),
    )


def status_refused(status: Column, reason: Column, arch: Column) -> Column:
    """Why a status row may not be appended; null: it may."""
    held = status == HELD
    return first_of(
        (F.coalesce(status, F.lit("")) == "", "empty_status"),
        (arch.isNotNull() & ~arch.isin(*ARCHES), "unknown_arch"),
        (held & ~F.coalesce(reason.isin(*HELD_REASONS), F.lit(False)), "invalid_held_reason"),
        (held & reason.isin(*ARCH_HELD) & arch.isNull(), "held_reason_needs_arch"),
    )


def rebaseline_authorized(latest: DataFrame, arch: Column) -> DataFrame:
    """unit, authorized: only the exact hold for missing previous evidence of that arch opens it again. latest: unit, status, reason, arch."""
    ok = (F.col("status") == HELD) & (F.col("reason") == "previous_evidence_missing") & (F.col("arch") == arch)
    return latest.select("unit", F.coalesce(ok, F.lit(False)).alias("authorized"))


def unit_violations(units: DataFrame) -> DataFrame:
    """unit, violation of new units: primary_arch, failed_arches, max_rounds, max_build_invocations and the identity fields."""
    checks = [
        F.when(F.col("primary_arch").isNotNull() & ~F.col("primary_arch").isin(*[f"standard-{a}" for a in ARCHES]), "primary_arch_not_allowed"),
        F.when(F.col("primary_arch").isNotNull() & ~F.array_contains("failed_arches", F.col("primary_arch")), "primary_arch_did_not_fail"),
        F.when(F.size("failed_arches") == 0, "no_failed_arch"),
        F.when(F.col("max_rounds") < 1, "max_rounds"),
        F.when(F.col("max_build_invocations") < 1, "max_build_invocations"),
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", f"identity:{c}") for c in IDENTITY],
    ]
    return units.select("unit", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def rejected_units(units: DataFrame, latest: DataFrame) -> DataFrame:
    """unit, action of units rejected by arch (unit, reason): the terminal status is written with the unit; a retry must agree."""
    old = latest.select("unit", "status", F.col("reason").alias("was"), F.col("arch").alias("at"))
    df = units.select("unit", "reason").join(old, "unit", "left")
    same = (F.col("status") == REJECTED) & F.col("was").eqNullSafe(F.col("reason")) & F.col("at").isNull()
    return df.select("unit", first_of((F.coalesce(F.col("reason"), F.lit("")) == "", "empty_reason"), (F.col("status").isNull(), "insert"), (same, "no_op"), otherwise="conflict").alias("action"))


def requests_to_add(stored: DataFrame, new: DataFrame) -> DataFrame:
    """request, action, seq: the same id and input keeps its seq, another input is a conflict, a new id gets SUBMITTED.
    stored: unit, request, input, seq; new: unit, request, input."""
    df = new.join(stored.select("unit", "request", F.col("input").alias("was"), "seq"), ["unit", "request"], "left")
    return df.select("unit", "request", first_of((F.col("seq").isNull(), "submit"), (F.col("was").eqNullSafe(F.col("input")), "same"), otherwise="conflict").alias("action"), "seq")


def orphan_passes_to_add(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Orphan passes that have no event yet, one for each unit and verification; a repeat keeps the event that is there."""
    return new.dropDuplicates(["unit", "verification_id"]).join(stored.select("unit", "verification_id"), ["unit", "verification_id"], "left_anti")


def linked_passes_complete(links: DataFrame, outcomes: DataFrame, invocations: DataFrame) -> DataFrame:
    """unit, arch, complete: every link (unit, arch, verification_id, round) has just one convergence event of its verification,
    which agrees in round, arch, verdict and result and names an invocation of the same unit, round and arch. No link: no row.

    outcomes: event_id, unit, arch, round, verification_id, verdict, result, invocation; invocations: event_id, unit, arch, round.
    """
    named = outcomes.select("unit", "verification_id", *[F.col(c).alias(f"o_{c}") for c in ("event_id", "arch", "round", "verdict", "result", "invocation")])
    inv = invocations.select(F.col("event_id").alias("o_invocation"), F.col("unit").alias("i_unit"), F.col("arch").alias("i_arch"), F.col("round").alias("i_round"))
    df = links.join(named, ["unit", "verification_id"], "left").join(inv, "o_invocation", "left")
    agrees = (F.col("o_round") == F.col("round")) & (F.col("o_arch") == F.col("arch")) & (F.col("o_verdict") == "n_a") & (F.col("o_result") == "PASS")
    bound = (F.col("i_unit") == F.col("unit")) & (F.col("i_round") == F.col("round")) & (F.col("i_arch") == F.col("arch"))
    per = df.groupBy("unit", "arch", "verification_id", "round").agg(F.count("o_event_id").alias("n"), F.bool_and(F.coalesce(agrees & bound, F.lit(False))).alias("ok"))
    return per.groupBy("unit", "arch").agg(F.bool_and((F.col("n") == 1) & F.col("ok")).alias("complete"))


def units_by_build(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """build, unit, ambiguous: the unit whose request a build was bound to; several units are an error. requests: unit, request."""
    df = requests.join(bindings.select("request", "build").distinct(), "request").select("build", "unit").distinct()
    return df.groupBy("build").agg(F.min("unit").alias("unit"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def rounds_with_pass(rounds: DataFrame, passes: DataFrame) -> DataFrame:
    """Rounds (unit, round, edit) whose edit some pass has."""
    return rounds.join(passes.filter("result = 'PASS'").select("unit", "edit").distinct(), ["unit", "edit"], "left_semi")


def non_substantive(stage: Column, has_evidence: Column) -> Column:
    """The reason under which a failure says nothing about the edit; null: it does."""
    return first_of(
        (stage.isin("apply_failed", "apply_unexpected_paths", "no_effective_changes"), "apply_failed"),
        ((stage == "analyzer_failed") | ((stage == "gbs_build_failed") & ~has_evidence), "analyzer_failed"),
        (stage.isin("build_timeout", "build_mutated_source", "infrastructure_failed", "toolchain_failed"), "toolchain_failed"),
    )


def failure_outcomes(facts: DataFrame) -> DataFrame:
    """result, verdict, reason of failed steps, in the order of handling: a stage that says nothing, evidence missing, previous
    evidence gone since, denied, else the convergence verdict, where a stalled target may be adopted and then advances.

    Needs stage, has_evidence, evidence_bound, previous_bound, repair_allowed, error, verdict, reason, adoptable.
    """
    f, na = F.col, F.lit("n_a")
    stage = non_substantive(f("stage"), f("has_evidence"))
    rungs = lambda a, b, c, d, e: first_of((stage.isNotNull(), a), (~f("evidence_bound"), b), (~f("previous_bound"), c), (~f("repair_allowed").isin("auto", "needs_confirmation"), d), otherwise=e)
    adopted = (f("verdict") == "stalled") & f("adoptable")
    return facts.select(
        "*",
        rungs(na, na, na, F.lit("FAIL"), F.lit("FAIL")).alias("step_result"),
        rungs(na, na, na, F.lit("denied"), F.when(adopted, "advance").otherwise(f("verdict"))).alias("step_verdict"),
        rungs(stage, F.lit("analyzer_failed"), F.lit("previous_evidence_missing"), F.coalesce("error", F.lit("repair denied by failure classifier")), f("reason")).alias("step_reason"),
    )


def verify_outcome() -> Column:
    """Outcome of a verification from its facts, in order. Needs edit_ok, no_changes, apply_error, whitespace_error, changed,
    allowed (arrays of paths), timed_out, mutated, exit_code."""
    f = F.col
    return first_of(
        (~f("edit_ok"), "apply_failed"),
        (f("no_changes"), "no_effective_changes"),
        (f("apply_error"), "apply_failed"),
        (f("whitespace_error"), "apply_failed"),
        (F.size(unexpected_paths(f("changed"), f("allowed"))) > 0, "apply_unexpected_paths"),
        (F.size("changed") == 0, "no_effective_changes"),
        (f("timed_out"), "build_timeout"),
        (f("mutated"), "build_mutated_source"),
        (f("exit_code") != 0, "gbs_build_failed"),
        otherwise="PASS",
    )


def unexpected_paths(changed: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(changed, allowed))


def relink_outcome() -> Column:
    """Whether a pass can be linked anew: identity, marker and tree must be equal, the worktree clean, its paths valid. Needs
    identity_equal, marker_equal, tree_equal, worktree, clean, paths."""
    f = F.col
    bad_path = F.exists("paths", lambda p: p.startswith("/") | F.exists(F.split(p, "/"), lambda x: x.isin(".", "..")))
    return first_of(
        (~f("worktree"), "worktree_damaged"),
        (~f("identity_equal") | ~f("marker_equal") | ~f("tree_equal"), "hash_mismatch"),
        (~f("clean"), "worktree_damaged"),
        (f("paths").isNull() | bad_path, "worktree_damaged"),
        otherwise="relink",
    )


def adoptions(asks: DataFrame, reproduces: DataFrame, adopted: DataFrame) -> DataFrame:
    """unit, arch, decision of stalled targets (unit, arch, expected, fingerprint, errors, truncated): adopted once only, from the
    last reproduction, if that failed otherwise, and both have the same fingerprint and count, neither cut short.

    reproduces: unit, arch, event_id, outcome, fingerprint, errors, truncated; adopted: unit, arch.
    """
    last = reproduces.groupBy("unit", "arch").agg(F.max_by(F.struct("event_id", "outcome", "fingerprint", "errors", "truncated"), "event_id").alias("r"))
    df = asks.join(last, ["unit", "arch"], "left").join(adopted.select("unit", "arch", F.lit(True).alias("before")).distinct(), ["unit", "arch"], "left")
    r = F.col("r")
    why = first_of(
        (F.col("before"), "adopted_before"),
        (r.isNull() | (r["event_id"] != F.col("expected")), "reproduce_changed"),
        (r["outcome"] != "different_failure", "reproduce_matched"),
        (F.col("truncated") | r["truncated"], "truncated"),
        (F.col("fingerprint").isNull() | ~F.col("fingerprint").eqNullSafe(r["fingerprint"]), "other_fingerprint"),
        (F.col("errors") != r["errors"], "other_count"),
        otherwise="adopt",
    )
    return df.select("unit", "arch", why.alias("decision"))


def gate_rows(events: DataFrame) -> DataFrame:
    """The columns that an event's payload gives to its row, and the payload in canonical form: keys in order, no spaces."""
    get = lambda k, kind="string": F.get_json_object("payload", f"$.{k}").try_cast(kind)
    return events.select("event_id", get("round_index", "int").alias("round"), get("arch_norm").alias("arch"), get("verdict").alias("verdict"), get("invocation_event_id", "long").alias("invocation"), canonical_json(F.col("payload")).alias("payload"))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no spaces; null if it is none."""
    return F.to_json(F.try_parse_json(text))
