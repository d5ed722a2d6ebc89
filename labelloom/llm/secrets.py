"""Secret scans that understand assignments.

Base patterns find keyword assignments, cloud access keys and long hexadecimal runs.
Beside them the text is lexed as source code or configuration: names with the literal
or the name assigned to them (``=``, ``:=``, ``:``, ``=>``, quoted keys, subscripts,
tags, command-line options, two-argument setters, joined string pieces). Names that are
assigned to other names are resolved to their literals, so that
``K = "..."; auth_token = K`` judges the literal by ``auth_token``. A literal whose
target name and form score high enough is a finding.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.common import joined_spans, map_texts, query, sha256, table

KINDS = ("assign", "access", "hex", "literal")

#: Base patterns (fixed values) and the fewest characters of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Points of the words of a target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "passcode": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "bearer": 2, "private": 1, "auth": 1, "authorization": 2, "access": 1,
    "signing": 1, "encryption": 1, "session": 1, "client": 0.5, "api": 1, "key": 1.5, "dsn": 2, "pat": 1.5,
}
#: Words that make a target name harmless.
HARMLESS = {
    "public", "count", "length", "len", "size", "max", "min", "limit", "type", "name", "file", "path", "url", "uri",
    "id", "ttl", "expiry", "expires", "timeout", "hint", "label", "title", "field", "column", "header", "regex",
    "pattern", "policy", "reset", "enabled", "required", "index", "prefix", "suffix", "placeholder", "example",
}
#: Values that stand for no secret.
NO_SECRET = re.compile(
    r"(?i)(your|my|some|the)?[_.-]*(password|passwd|secret|token|api[_-]?key|key|change[_-]?me|example|sample|dummy|"
    r"placeholder|todo|test|none|null|nil|true|false|undefined|redacted|insert|here|x+|\*+|\.+|0+|1234567890?)"
    r"([_.-]*(here|value|placeholder|goes|example|string|key|token|secret))*",
    re.A,
)
#: Points from which a literal is a finding, and its fewest characters.
LEAST_SCORE, LEAST_LITERAL = 4.5, 8

_NAME = r"""(?<![A-Za-z0-9_.$-])(?:--?)?[A-Za-z_$][A-Za-z0-9_.-]*+"""
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
_BARE = r"""[A-Za-z0-9+/_.=~!@#$%^&*-]++"""
#: name, optional quote or bracket, optional type, operator, value; ``<name>value<``; ``--name value``; ``("name", "value")``.
PAIR = re.compile(
    rf"""({_NAME})(?:["'`]?\]?)(?:\x20*:\x20*(?:str|String|string|&str|char\*)(?=\x20*=))?[\x20\t]*(?::=|=>|:|=(?!=))[\x20\t]*"""
    rf"""(?:new\x20+String\x20*\(|[bruf]{{1,2}}(?=["']))?({_STRING}(?:[\x20\t]*\+[\x20\t]*{_STRING})*+|{_BARE})""",
    re.A,
)
TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)>([^<>\n]++)</", re.A)
OPTION = re.compile(r"(?<![^\s])--?([A-Za-z][A-Za-z0-9_-]*+)[\x20\t]++([^\s-][^\s]*+)", re.A)
CALL = re.compile(rf"""\([\x20\t]*["']([A-Za-z_][A-Za-z0-9_.-]*+)["'][\x20\t]*,[\x20\t]*({_STRING})""", re.A)
_PIECE = re.compile(_STRING)
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Where the lexer has anything to find at all.
_SIGNS = re.compile(r"[:=<(]|--")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _LONG_HEX in text.encode().translate(_HEX_MASK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


_HEX_MASK = bytes(120 if chr(b) in "0123456789abcdef" else 45 for b in range(256))
_LONG_HEX = b"x" * LEAST_HEX


def pairs(text: str) -> list[tuple[int, str, int, int, str, bool]]:
    """(position, name, literal start, literal end, value, whether it may be a name), by position."""
    found = []
    for pattern, bare in ((PAIR, True), (OPTION, True), (TAG, False), (CALL, False)):
        for m in pattern.finditer(text):
            value, start, end = m.group(2), m.start(2), m.end(2)
            if value[0] in "\"'`":
                pieces = _PIECE.findall(value)
                value = "".join(p[1:-1] for p in pieces)
                start, end, reference = start + 1, end - 1, False
            else:
                reference = bare and _IDENTIFIER.fullmatch(value.rstrip(",;")) is not None
                if bare:
                    value = value.rstrip(",;)")
                    end = start + len(value)
            found.append((m.start(1), m.group(1).lstrip("-"), start, end, value, reference))
    return sorted(found)


def name_score(name: str) -> float:
    """Points of a target name; 0 if a word of it makes it harmless."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS or "public" in parts:
        return 0.0
    joined = "".join(parts)
    return max(sum(SENSITIVE.get(p, 0) for p in parts), 3.0 if joined.endswith("apikey") else 0.0)


def literal_score(value: str) -> float:
    """Points of a literal's form: length, spread of characters, mixed kinds; none for placeholders and prose."""
    n = len(value)
    if n < LEAST_LITERAL or NO_SECRET.fullmatch(value) or re.match(r"\$\{|\{\{|<|%\(|https?://[^@]*$", value):
        return 0.0
    if value.count(" ") > n // 12:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy / 2, 2.0) + 0.5 * (kinds - 1) + 0.5 * (n >= 16)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that score high enough by their best target name."""
    if not _SIGNS.search(text):
        return []
    found = pairs(text)
    places: dict[str, list[int]] = {}
    for k, pair in enumerate(found):
        places.setdefault(pair[1], []).append(k)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for k, (_, name, *_rest) in enumerate(found):
        points = name_score(name)
        if not points:
            continue
        at, seen = k, {k}
        while found[at][5]:  # a name: go to its last assignment before, else to its first after
            known = places.get(found[at][4].rstrip(",;"))
            if not known:
                break
            i = bisect_left(known, at)
            step = known[i - 1] if i else known[0]
            if step in seen:
                break
            seen.add(step)
            at = step
        _, _, start, end, value, _ = found[at]
        if points > best.get((start, end), (0.0, ""))[0]:
            best[start, end] = points, value
    return [
        (start, 3, end)
        for (start, end), (points, value) in best.items()
        if (form := literal_score(value)) and points + form >= LEAST_SCORE
    ]


def scan(text: str) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, base spans, all spans; literals inside a base span add nothing."""
    base = base_spans(text)
    more, end_so_far = [], []
    ordered = sorted(base)
    for start, _, end in ordered:
        end_so_far.append(max(end, end_so_far[-1] if end_so_far else 0))
    starts = [s for s, _, _ in ordered]
    for start, kind, end in literal_spans(text):
        i = bisect_left(starts, start + 1)
        if not i or end_so_far[i - 1] < end:
            more.append((start, kind, end))
    counts = Counter(k for _, k, _ in base)
    return counts[0], counts[1], counts[2], joined_spans(base, KINDS), joined_spans([*base, *more], KINDS)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base counts, base spans and all spans of every whole text.

    Spans count code points, ends are exclusive. A null text counts as empty; repeated
    rows and null keys stay; other columns are left out. An empty table gives no rows.
    """
    fields = "n_assign long, n_access long, n_hex long, base string, spans string"
    return map_texts(df, {key: key}, text, lambda: scan, fields)


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", sha256("base").alias("base_sha256"), "spans"
    )
