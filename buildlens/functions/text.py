"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def fingerprint(message: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the text, lower-cased and with single spaces."""
    return F.substring(F.sha1(squeezed(F.lower(message))), 1, 12)


def stable_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def normal_path(path: Column) -> Column:
    """Slashes for backslashes; empty and ``.`` segments out, ``..`` takes the segment before it away."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when((x == "..") & absolute, acc).otherwise(F.array_append(acc, x))
    # element_at of an empty array is never asked for: the size comes first
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) == 0, F.when((x == "..") & absolute, acc).otherwise(F.array_append(acc, x))).otherwise(up(acc, x)))
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(folded, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def normal_message(message: Column) -> Column:
    """Lower case; places ``:12:3`` and whole numbers as #; single spaces."""
    out = F.regexp_replace(F.lower(message), r":\d+(?::\d+)?", ":#")
    return squeezed(F.regexp_replace(out, r"\b\d+\b", "#"))


def redacted(text: Column, workspace: str | None = None, host: str | None = None) -> Column:
    if workspace:
        text = F.replace(text, F.lit(workspace), F.lit("<WORKSPACE>"))
    text = F.regexp_replace(text, r"/home/[^/\s]+/", "<USER>/")
    return F.replace(text, F.lit(host), F.lit("<HOST>")) if host else text


CJK = r"[一-鿿]"
WORDY = r"[A-Za-z0-9_./+-]+"


def token_estimate(text: Column) -> Column:
    """Tokens by rule of thumb: CJK by 1.5, words by 0.75, all other characters by 3; at least one."""
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(text, F.lit(WORDY))
    other = F.length(F.regexp_replace(F.regexp_replace(text, CJK, ""), WORDY, ""))
    return F.greatest(F.lit(1), F.ceil(cjk / F.lit(1.5) + words / F.lit(0.75) + other / F.lit(3.0)).cast("int"))


def truncated(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - len(marker))), F.lit(marker))).otherwise(text)


def slug(text: Column, most: int = 48, gap: str = "-") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", gap), f"^{gap}+|{gap}+$", "")
    return F.regexp_replace(F.substring(out, 1, most), f"{gap}+$", "")


def filled(template: Column, captures: Column) -> Column:
    """``{name}`` from a map; unknown names stay."""
    return F.aggregate(F.map_entries(captures), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def error_code(text: Column) -> tuple[Column, Column]:
    """Code and message of ``CODE: message``, when the code is in upper-case snake; else no code."""
    code = F.nullif(F.regexp_extract(text, r"^([A-Z][A-Z0-9_]+):\s*(.*)$", 1), F.lit(""))
    return code, F.when(code.isNotNull(), F.regexp_extract(text, r"^([A-Z][A-Z0-9_]+):\s*(.*)$", 2)).otherwise(text)


#: Names of one architecture.
ARCHES = {"armv7l": "armv7l", "armv7hl": "armv7l", "arm": "armv7l", "aarch64": "aarch64", "arm64": "aarch64", "x86_64": "x86_64", "amd64": "x86_64"}


def normal_arch(arch: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ARCHES.items() for x in pair])[F.lower(F.trim(arch))]


def devel_package(library: Column) -> Column:
    return F.concat(F.lit("lib"), F.regexp_replace(F.regexp_replace(library, "^lib", ""), r"\.so.*$", ""), F.lit("-devel"))


def url_parts(url: Column) -> dict[str, Column]:
    return {"scheme": F.regexp_extract(url, r"^([a-z]+)://", 1), "host": F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), "path": F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)}
