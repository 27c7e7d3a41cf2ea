"""Fixed values of the scanner: patterns (Java syntax, numbered groups), word lists and constants."""

ANSI = r"\x1b\[[0-9;]*m"
SECONDS = r"^\[\s*(\d+)s\]\s*"
PHASE = r"^\+\s+(%(?:prep|build|install|check|clean|files|setup)\b\S*)"
EXECUTING = r"^Executing\((%(?:prep|build|install|check))\):"
COMMAND = r"^\+\s+(.+)"
CONTINUES = r"\\\s*$"
MARKERS = r"error|fatal|warning:|undefined reference|cannot find -l|nothing provides|patch|hunk|file not found|unpackaged|werror|make|spec file"
COMPILER = r"(?i)([^\s:][^:]*\.(?:c|cc|cpp|cxx|S|s|cu|h|hh|hpp|hxx)):(\d+)(?::(\d+))?:\s*(fatal error|error|warning):\s*(.*)"
UNKNOWN_OPTION = r"(?i)^(?:[A-Za-z0-9_./+-]+:\s*)?(?:error|warning):\s*unknown warning option ['\"](-W(?:no-)?[^'\"]+)['\"]"
WERROR = r"(?i)^(?:[A-Za-z0-9_./+-]+:\s*)?(?:error|warning):\s*.*\[-Werror(?:,|\])"
UNDEFINED = r"undefined reference to [`'\"](.+?)[`'\"]"
MISSING_LIBRARY = r"cannot find -l([A-Za-z0-9_.+-]+)"
RPM_PHASE = r"error: Bad exit status from .*\((%\w+)\)"
MAKE = r"make(?:\[\d+\])?: \*\*\* (?:\[[^\]]+:)?\s*\[([^\]]+)\] Error \d+"
#: In order; the groups' names follow.
PATCH = [
    (r"(?i)Patch\s*#?(\d+)\s*(?:\(.*\))?\s*failed", ("num",)),
    (r"(?i)Hunk\s*#?(\d+)\s*FAILED", ("num",)),
    (r"(?i)can't find file to patch(?: at input line (\d+))?", ("line",)),
    (r"(?i)(\d+)\s+out of\s+(\d+)\s+hunks?\s+ignored", ("num", "total")),
    (r"(?i)patch:?\s*\*{4}\s*malformed patch at line (\d+)", ("line",)),
    (r"(?i)patch failed:\s*([^\s]+):(\d+)", ("file", "line")),
    (r"(?i)error:\s*patch(?:[\d:]+)?\s*failed", ()),
]
SOURCE_FILE = r"\.(?:c|cc|cpp|cxx|S|s|cu)$"
SOURCE_KINDS = ("compiler", "werror")
RESPONSE_FILE = r"(?:^|\s)(?:-Wl,)?@([^\s]+\.rsp)(?=\s|$)"

#: class, base, base when the context gate holds, cascade probability, default level, patterns; in order.
SEMANTICS = [
    ("syntax_error", 0.90, None, 0.05, "1", ["syntax error", "expected [^\\n]+ before", "expected .+"]),
    ("undeclared_identifier", 0.75, None, 0.30, "2 + grep header", ["use of undeclared identifier", "'[^']+' undeclared", "was not declared in this scope"]),
    ("no_member", 0.80, None, 0.20, "3 (struct/class)", ["no member named", "has no member named", "has no member"]),
    ("type_mismatch", 0.85, None, 0.15, "2 + typedef", ["cannot convert", "invalid conversion", "no matching function for call", "conflicting types"]),
    ("template_instantiation", 0.60, None, 0.50, "3 (template)", ["template instantiation", "instantiated from", "substitution failure"]),
    ("undefined_reference", 0.85, None, 0.20, None, ["undefined reference to"]),
    ("missing_lib", 0.95, None, 0.05, None, ["cannot find -l"]),
    ("generic_error", 0.45, 0.70, 0.40, "2", []),
]
#: What a message alone decides, in order.
BY_MESSAGE = ("syntax_error", "undeclared_identifier", "no_member", "type_mismatch", "template_instantiation")

FIXABLE_OPTIONS = ["-Wdeprecated-declarations", "-Wimplicit-enum-enum-cast", "-Wpointer-bool-conversion", "-Winconsistent-missing-override", "-Wunused-private-field", "-Wunused-field"]
SYSTEM_PREFIXES = ["/usr/include", "/usr/lib", "/opt/toolchain"]
SUSPECT_PARTS = ["generated", "gen", "third_party", "external", "vendor"]
SKIPPED_DIRS = [".git", ".gbs_patch_suggest", ".gbs_workflow", "build", "node_modules"]
TRUNCATED = "too many errors emitted"
