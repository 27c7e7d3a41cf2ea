import difflib
import random

from pyspark.sql import functions as F

from buildlens.operators import spec_edits


def numbered(spark, specs):
    return spark.createDataFrame([(k, i, t) for k, text in specs.items() for i, t in enumerate(text, 1)], "spec string, line_no int, text string")


def test_diffs_equal_the_library(spark):
    r = random.Random(3)
    specs = {f"s{k}": [f"line {i}" for i in range(1, r.randint(2, 40))] for k in range(30)}
    edits, want = [], {}
    for name, old in specs.items():
        new, at = list(old), sorted(r.sample(range(len(old) + 1), min(len(old), r.randint(1, 4))))
        for k in reversed(at):
            new[k:k] = [f"new {k} {i}" for i in range(1 + k % 2)]
            edits += [(name, name, k, i, f"new {k} {i}") for i in range(1 + k % 2)]
        want[name] = "\n".join(x for x in difflib.unified_diff(old, new, lineterm="", n=3) if not x.startswith(("---", "+++")))
    got = spec_edits.unified_diffs(numbered(spark, specs), spark.createDataFrame(edits, "edit string, spec string, after int, place int, text string"))
    assert {x["edit"]: x["diff"] for x in got.collect()} == want


def test_where_requirements_go(spark):
    specs = {
        "block": ["Name: a", "BuildRequires: x", "  y", "BuildRequires: z", "Patch0: p", "BuildRequires: late", "%prep"],
        "none": ["Name: a", "Version: 1", "%description", "text"],
        "bare": ["Name: a"],
        "end": ["Name: a", "BuildRequires: x"],
    }
    points = spec_edits.insertion_points(numbered(spark, specs))
    assert dict(map(tuple, points.collect())) == {"block": 4, "none": 2, "bare": 1, "end": 2}


def test_edits_of_causes(spark):
    lines = numbered(spark, {"s": ["Name: a", "BuildRequires:  PkgConfig( x )", "%prep"]})
    rows = [(1, "s", "depsolve", "nothing provides pkgconfig(x) needed by app"), (2, "s", "depsolve", "Nothing provides zlib;"), (3, "s", "linker_missing", "ld: cannot find -lfoo.so"), (4, "gone", "linker_missing", "cannot find -lx"), (5, "s", "depsolve", "odd"), (6, "s", "compiler", "x")]
    got = spec_edits.spec_diffs(spark.createDataFrame(rows, "log_id int, spec string, kind string, message string"), lines, F.concat("spec", F.lit(".spec")))
    by_log = {r["log_id"]: (r["confidence"], r["requirement"], r["after"], r["diff"]) for r in got.collect()}
    assert {k: v[:3] for k, v in by_log.items()} == {1: ("advisory", "pkgconfig(x)", None), 2: ("medium", "zlib", 2), 3: ("low", "libfoo-devel", 2), 4: ("manual", "libx-devel", None), 5: ("manual", None, None)}
    assert by_log[2][3] == "diff --git a/s.spec b/s.spec\n--- a/s.spec\n+++ b/s.spec\n@@ -1,3 +1,4 @@\n Name: a\n BuildRequires:  PkgConfig( x )\n+BuildRequires:  zlib\n %prep\n" and by_log[1][3] is None
