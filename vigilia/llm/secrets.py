"""Secret scan: names and literals lexed from source and configuration text.

A text is read as a stream of ``name = literal`` pairs (source assignments, also
with a type or to a subscript, ``key: value`` lines, quoted JSON keys, ``export``
and command-line flags, their value after ``=`` or a space).
Constants are propagated: in ``a = "x9.."`` followed by ``password = a`` the
literal is scored under the name ``password`` too, and ``"ab" + "cd"`` or a
reference to a concatenation counts as one value. A literal is reported when
the sensitivity of its target name and its own randomness score high enough
together. Fixed patterns for assignments, access keys and long hexadecimal
runs are always reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Patterns and least lengths of the base kinds, in report order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
KINDS = ("assign", "access", "hex", "literal")

# Words that make a target name sensitive, and their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3,
    "api_key": 3, "accesskey": 3, "access_key": 3, "privatekey": 3, "private_key": 3,
    "credential": 2, "credentials": 2, "auth": 2, "bearer": 2, "signature": 1, "salt": 1, "key": 1,
}

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_STRING = r""""(?:[^"\\\n]|\\.)++"|'(?:[^'\\\n]|\\.)++'"""
_SPACE = r"[\x20\t]*+"
_VALUE = rf"(?:{_STRING}|[A-Za-z0-9+/_.=\-]+)(?:{_SPACE}\+{_SPACE}(?:{_STRING}|{_NAME}))*"
#: A type between name and value; without spaces around the sign only before a quote.
_PLAIN = r"""[^\[\]"'=:\n]"""
_TYPE = rf"[A-Za-z_][A-Za-z0-9_.]*+(?:\[(?:{_PLAIN}|\[(?:{_PLAIN}|\[{_PLAIN}*+\])*+\])*+\])?+"
_TYPED = rf"""(?:{_SPACE}:{_SPACE}(?P<type>{_TYPE}(?:{_SPACE}\|{_SPACE}{_TYPE})*+)(?={_SPACE}=["']|[\x20\t]++=[\x20\t]))?"""
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])-{{0,2}}["']?(?P<name>{_NAME})(?:["'](?:{_SPACE}\])?)?{_TYPED}{_SPACE}(?::=|=>|=|:){_SPACE}"""
    rf"""(?P<value>{_VALUE})""")
_FLAG = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])--?(?P<type>)(?P<name>{_NAME})[\x20\t]++(?![\-=:])(?P<value>{_STRING}|[A-Za-z0-9+/_.=\-]++)""")
_GAP, _DASHES = re.compile(r"[\x20\t\]]"), re.compile("-*")
_PART = re.compile(rf"(?P<quoted>{_STRING})|(?P<bare>[A-Za-z0-9+/_.=\-]+)")
_SENSITIVE_HINT = re.compile("|".join(sorted({k.replace("_", "_?") for k in SENSITIVE}, key=len, reverse=True)),
                             re.ASCII | re.IGNORECASE)
_LEAST_SCORE = 4.0
_LEAST_VALUE = 8
#: Weight of names under which a quoted value of several words counts, with or without a digit.
_STRONG = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> int:
    parts = re.split(r"[_.\-]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    joined = ["_".join(p) for p in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0) for p in (*parts, *joined)), default=0)


def literal_score(value: str) -> float:
    """0 to 3: Shannon entropy a character, and the kinds of characters mixed."""
    if len(value) < _LEAST_VALUE:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(3.0, entropy / 2 + 0.5 * (kinds - 1))


def _secret(weight: int, value: str, quoted: bool) -> bool:
    words = len(value.split())
    if words > 1 and not (quoted and weight >= _STRONG):
        return False
    return weight + literal_score(value) >= _LEAST_SCORE and (words > 1 or any(c.isdigit() for c in value))


def added_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or by constants.

    A quoted value that is no secret as a whole is read for pairs and flags itself.
    """
    if not _SENSITIVE_HINT.search(text):
        return []
    literals: dict[str, list[tuple[int, int, bool]]] = {}
    found = set()
    todo = [(0, len(text))]
    while todo:
        begin, stop = todo.pop()
        for pattern in (_PAIR, _FLAG):
            at = begin
            while m := pattern.search(text, at, stop):
                at = m.end()
                own: list[tuple[int, int, bool]] = []
                for part in _PART.finditer(text, m.start("value"), m.end("value")):
                    start, end = part.span()
                    if part.group() == "+":
                        continue  # joins two parts
                    if part.group("quoted"):
                        own.append((start + 1, end - 1, True))
                    elif part.group() in literals:
                        own += literals[part.group()]  # a constant named before
                    else:
                        own.append((start, end, False))
                own = list(dict.fromkeys(own))  # a constant used twice is one literal
                if pattern is _PAIR:
                    literals[m.group("name")] = own
                weight = name_score(m.group("name"))
                # One value may be split over several literals; they score together, or else alone.
                if weight and _secret(weight, "".join(text[a:b] for a, b, _ in own), all(q for _, _, q in own)):
                    found.update((a, b) for a, b, _ in own)
                else:
                    found.update((a, b) for a, b, q in own if weight and _secret(weight, text[a:b], q))
                    inside = m.start("value")
                    todo += [(a, b) for a, b, quoted in own if quoted and inside < a and b < m.end("value")
                             and _SENSITIVE_HINT.search(text, a, b)]
                    # What stands after a flag, a space or a subscript may be a name again.
                    if text[inside] not in "\"'" and (text[m.start()] == "-" or _GAP.search(text, m.end("name"), inside)):
                        at = inside + len(_DASHES.match(text, inside).group())
                if weight and m.group("type") and _secret(weight, m.group("type"), False):
                    found.add(m.span("type"))  # a value may look like a type
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of one text as sorted (start, kind, end)."""
    text = text or ""
    base = base_spans(text)
    extra, at = [], 0
    covered = sorted((s, e) for s, _, e in base)
    reach = 0
    for start, end in added_spans(text):
        while at < len(covered) and covered[at][0] <= start:
            reach = max(reach, covered[at][1])
            at += 1
        if end > max(reach, start):  # not inside what is reported anyway
            extra.append((start, 3, end))
    return base, sorted(base + extra)


SCHEMA = "base array<struct<start:int,kind:string,end:int>>, found array<struct<start:int,kind:string,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with ``base`` and ``found``: the spans of each whole text;
    columns of those names are replaced.

    Null and empty texts have no spans; repeated rows are reported each. One
    pass without a shuffle; memory follows the largest batch of texts.
    """
    keep = tuple(c for c in keep if c not in ("base", "found"))
    df = docs.select(*keep, docs[text].alias("_text"))
    fields = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(spans):
            return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]

        for batch in batches:
            both = [scan(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([rows(b) for b, _ in both], _SPAN),
                 pa.array([rows(a) for _, a in both], _SPAN)], [*keep, "base", "found"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(run, f"{kinds}, {SCHEMA}" if kinds else SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by ``[kind]``; overlapping
    spans become one. Returns doc_id, text, lang, source and n_chars, which
    follows the new text; null texts stay null, other columns are left out."""
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, kind, end in scan(text)[1]:
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = end
        return "".join((*out, text[at:])) if at else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) for t in batch.column("text").to_pylist()]
            arrays = {c: batch.column(c) for c in batch.schema.names}
            arrays["text"] = pa.array(texts, pa.string())
            arrays["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return df.mapInArrow(run, "doc_id bigint, text string, lang string, source string, n_chars bigint")
