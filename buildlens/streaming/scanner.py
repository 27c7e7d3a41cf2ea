"""The scanner over a stream of log lines: some facts of state for each log, events as their lines arrive, timers that end it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from buildlens.functions import patterns as P

EVENTS = "log_id string, id string, kind string, severity string, message string, line_no int, phase string, command_id string, file string, line int, parent string"
LINES = "log_id string, line_no int, raw_text string, at timestamp"
_RE = {n: re.compile(getattr(P, n)) for n in ("ANSI", "SECONDS", "PHASE", "EXECUTING", "COMMAND", "CONTINUES", "MARKERS", "COMPILER", "UNKNOWN_OPTION", "WERROR", "UNDEFINED", "MISSING_LIBRARY", "RPM_PHASE", "MAKE", "SOURCE_FILE")}
_PATCH = [re.compile(p) for p, _ in P.PATCH]


def kind_of(text: str) -> tuple[str | None, re.Match | None]:
    """Kind of event of a line, and the compiler's match if the line has a place."""
    low = text.lower()
    if not _RE["MARKERS"].search(low):
        return None, None
    place = _RE["COMPILER"].search(text)
    if "nothing provides" in low:
        return "depsolve", None
    if any(p.search(text) for p in _PATCH):
        return "patch", None
    if "file not found:" in low or "installed (but unpackaged) file(s) found" in low:
        return "install_missing", None
    if "-wunknown-warning-option" in low and _RE["UNKNOWN_OPTION"].search(text):
        return "werror", None
    if place and "-werror" in low:
        return "werror", place
    if "all warnings being treated as errors" in low or _RE["WERROR"].search(text):
        return "werror", None
    for name, kind in (("MISSING_LIBRARY", "linker_missing"), ("UNDEFINED", "linker_undef")):
        if _RE[name].search(text):
            return kind, None
    if place:
        return "compiler", place
    for name, kind in (("RPM_PHASE", "rpm_phase"), ("MAKE", "make_cascade")):
        if _RE[name].search(text):
            return kind, None
    if "spec file" in low and "error" in low:
        return "spec_script", None
    return ("raw_error" if "error:" in low or "fatal:" in low else None), None


def step(state: dict, log_id: str, line_no: int, raw: str) -> tuple | None:
    """One line: changes the state, returns an event or nothing."""
    text = _RE["SECONDS"].sub("", _RE["ANSI"].sub("", raw))
    marker = _RE["PHASE"].match(text) or _RE["EXECUTING"].match(text)
    if marker:
        state.update(phase=marker[1], pending=False)
        return None
    if _RE["COMMAND"].match(text):
        state.update(commands=state["commands"] + 1, pending=bool(_RE["CONTINUES"].search(text)))
        return None
    if state["pending"]:
        state["pending"] = bool(_RE["CONTINUES"].search(text))
        return None
    kind, place = kind_of(text)
    if kind is None:
        return None
    state["seq"] += 1
    event, phase, parent, message, severity = f"E{state['seq']:03d}", state["phase"], None, text, "error"
    if kind == "rpm_phase" and _RE["RPM_PHASE"].search(text)[1] == "%prep":
        parent = state["patches"].get("%prep")
    if kind == "make_cascade":
        target = _RE["MAKE"].search(text)[1]
        found = set()
        for file, e in state["sources"].items():
            base = file.rsplit("/", 1)[-1]
            if target.endswith((f"{base.rsplit('.', 1)[0]}.o", f"{base}.o")):
                found.add(e)
        parent = found.pop() if len(found) == 1 else None
    if kind == "patch":
        low = text.lower()
        if "can't find file to patch" in low:
            message = f"error: patch failed: {text}"
        elif "hunk" in low and "ignored" in low and not low.startswith("hunk"):
            num = next((m[1] for p in _PATCH if (m := p.search(text)) and p.groups), None)
            message = f"Hunk #{num or 1} FAILED: {text}"
        if phase:
            state["patches"][phase] = event
    file = line = None
    if place:
        file, line, message = place[1], int(place[2]), place[5]
        severity = "warning" if place[4].lower() == "warning" else "error"
        if _RE["SOURCE_FILE"].search(file):
            state["sources"][file] = event
    command = f"C{state['commands']:03d}" if state["commands"] else None
    return log_id, event, kind, severity, message, line_no, phase, command, file, line, parent


def fresh() -> dict:
    return {"phase": None, "commands": 0, "pending": False, "seq": 0, "patches": {}, "sources": {}}


def _scanned(held: dict, log_id: str, rows: pd.DataFrame) -> pd.DataFrame:
    """Events of some lines of a log, put in order; changes what is held of it."""
    rows = rows.sort_values("line_no")
    found = [e for n, raw in zip(rows["line_no"], rows["raw_text"]) if raw is not None and (e := step(held, log_id, int(n), raw))]
    return pd.DataFrame(found, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"line": "Int32", "line_no": "int32"})


class LogScanner(StatefulProcessor):
    """One log at a time: what is held of it goes with its end marker, or when no line has come for ``idle_ms`` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.held.get()[0]) if self.held.exists() else fresh()
        lines = pd.concat(list(rows))
        found = _scanned(held, key[0], lines)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if lines["raw_text"].isna().any():
            self.held.clear()
        else:
            last = max(held.get("last", 0), int(lines["at"].max().timestamp() * 1000))
            self.held.update((json.dumps(held | {"last": last}),))
            self.handle.registerTimer(last + self.idle_ms)
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield _scanned(fresh(), key[0], pd.DataFrame({"line_no": [], "raw_text": []}))

    def close(self) -> None:
        pass


def scan_stream(lines: DataFrame, late: str = "10 minutes", idle: int = 6 * 3600) -> DataFrame:
    """Events of a stream of lines (log_id, line_no, raw_text, at). Lines of a log must arrive in order of batches; in a batch they are put in order.

    What is held of a log, its latest event for each source file among it, goes with a line whose text is null, the end of the
    log, or by a timer once the watermark is ``idle`` seconds behind its last line. A line after that begins the log anew, from
    E001 and without phase or command. Lines older than the watermark, ``late`` behind the newest line of all logs, are
    dropped. Needs the RocksDB state store.
    """
    rows = lines.select(F.col("log_id").cast("string").alias("log_id"), "line_no", "raw_text", "at").withWatermark("at", late)
    return rows.groupBy("log_id").transformWithStateInPandas(LogScanner(1000 * idle), EVENTS, "Append", "EventTime")


def replayed(lines: DataFrame) -> DataFrame:
    """The same events of a table of lines (log_id, line_no, raw_text), each log through the same steps."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _scanned(fresh(), key[0], rows)

    return lines.select(F.col("log_id").cast("string").alias("log_id"), "line_no", "raw_text").groupBy("log_id").applyInPandas(run, EVENTS)


#: The setting that the stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def landed(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """Lines from files that land in a folder."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", most_files).json(path)


def new_units(builds: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each (build_id, arch, spec_name) once. The watermark on begin_date bounds what is remembered, and so drops later repeats only of units that old."""
    return builds.withWatermark("begin_date", delay).dropDuplicatesWithinWatermark(["build_id", "arch", "spec_name"])
