"""Secret scans by assignment-aware lexing.

Three plain patterns always apply: a value given to a password-like word
(``assign``), access key ids (``access``) and long hexadecimal runs (``hex``).
On top of them the scan reads assignments the way source and configuration files
write them: a name, one of ``= : := =>``, and an expression of quoted strings (also
in threes, with a prefix letter, in parentheses or on the line behind the name),
bare values and other names, joined by ``+`` or as alternatives by ``or``. Strings
joined by ``+`` are scored as one. Strings given to names are
constants; where a name is used in a later value, or inside a string as
``${name}``, its string flows on to the new target. Each literal is scored by the
most sensitive name it reaches, times how much it looks like a credential, and
literals from 0.5 up are ``named`` spans unless a plain pattern has all of them; the
mask covers both. What is called, and words after weakly sensitive names, are no
literals. In a
typed declaration (``name: type =``, ``name type =``) the name is the target; a
type that a plain pattern takes for the value is not masked when the literal is.

Spans are code points, end exclusive. Null text is empty and has no spans; rows
are independent, so repeated rows repeat. Work is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorlog.llm.words import documents, map_texts

KINDS = ("assign", "access", "hex", "named")
MASK = "[REDACTED]"
# The plain patterns, and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: How sensitive a part of a name is.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "passcode": 0.9, "pin": 0.5,
    "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "cred": 0.8, "creds": 0.8, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "key": 0.6,
    "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "access": 0.4, "api": 0.4, "encryption": 0.5,
    "signing": 0.5, "client": 0.2, "webhook": 0.5, "dsn": 0.6, "jwt": 0.8, "otp": 0.6,
}
#: Values that stand for a secret without being one.
DUMMIES = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|changeme|example.*|your[-_ ].*|<.*>|x+|\*+|\.+|test|todo)$")

SEPARATOR = re.compile(r":=|=>|=(?!=)|:(?!:)")
STRING = re.compile(r'''(?:[fFrRbBuU]{1,2}(?=["']))?+(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|''' + r"""'''((?:[^'\\]|\\.|'(?!''))*+)'''|""" + r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)''', re.S)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>+|&]+""")
NAME = re.compile(r"[A-Za-z_$][\w.$-]*+", re.A)
HOLE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)
#: A type between a colon and an equals sign.
TYPED = re.compile(
    r"""[ \t]*+[&*]*+(?:'\w++[ \t]++)?+(?:mut[ \t]++)?+([A-Za-z_][\w.]*+)(?:[\[<][^\n=;:"'`]{0,80}[\]>])?(?:\[\]){0,4}\??"""
    r"""(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+(?:[\[<][^\n=;:"'`|]{0,80}[\]>])?(?:\[\]){0,4}){0,8}[ \t]*+:?=(?![=>])""", re.A)
TYPES = frozenset(
    "str string text char varchar nvarchar wstring cstring ansistring nsstring unicode bytes byte bytearray rune any object unknown "
    "never null undefined none nil optional union final classvar literal annotated readonly partial list array dict map hashmap "
    "record tuple set sequence mapping iterable vec option box cow arc rc int integer long short uint int8 int16 int32 int64 uint8 "
    "uint16 uint32 uint64 u8 u16 u32 u64 i8 i16 i32 i64 usize float float32 float64 double f32 f64 decimal number bool boolean uuid".split())
DECLARES = frozenset(("var", "const"))
KEYWORDS = DECLARES | frozenset(("let", "val", "static", "final", "public", "private", "protected", "readonly", "export", "mut"))
#: Plain words, which only strongly sensitive names make a secret of.
WORDY = re.compile(r"[A-Za-z]?[a-z]+\d{0,2}(?:[-_.][A-Za-z]?[a-z]+\d{0,2})*")
#: A value on the lines behind its name: a string, or a block of lines.
BEHIND = re.compile(r"[ \t(]*+(?:\r?\n[ \t(]*+){1,3}(?=[fFrRbBuU]{0,2}[\"'`])|[ \t]*+[|>][+-]?[ \t]*+\r?\n[ \t]++")
JOINT = re.compile(r"[ \t]*+\)?[ \t]*+(\+|\bor\b|\|\||\?\?)[ \t]*+(?:\r?\n[ \t]*+)?")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.$-")

Span = tuple[int, int]


def name_score(name: str) -> float:
    """Sensitivity of a target name: its most sensitive part, more if several parts are."""
    parts = [p.lower() for p in PARTS.findall(name)]
    found = sorted((WEIGHTS.get(p, 0.0) for p in parts), reverse=True)
    joined = WEIGHTS.get("".join(parts[-2:]), 0.0)
    return min(1.0, max(joined, (found[0] + 0.5 * sum(found[1:])) if found else 0.0))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential rather than a word, a path or a dummy."""
    if len(value) < 6 or DUMMIES.match(value) or re.search(r"\s", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 + entropy / 6 + 0.15 * (classes - 1))


def name_before(text: str, end: int) -> str:
    """The name that ends, perhaps quoted, before a separator."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    return text[start:end].lstrip("-.")


def is_type(word: str) -> bool:
    return word.rpartition(".")[2].lower() in TYPES


def targets(text: str, at: int, sign: str) -> list[str]:
    """The names that a separator at ``at`` gives its value to; in ``name type =`` the name, and the type's too if it may be one."""
    word = name_before(text, at)
    if sign != "=" or not word:
        return [word] if word else []
    end = at
    while text[end - 1] in " \t":
        end -= 1
    if text[end - 1] in "\"'`":
        return [word]
    before = end - len(word)
    while before and text[before - 1] in "*[]":
        before -= 1
    if not before or text[before - 1] not in " \t":
        return [word]
    name = name_before(text, before)
    if not name or name in KEYWORDS:
        return [word]
    if is_type(word):
        return [name]
    start = text.rfind(name, 0, before)
    return [name, word] if name_before(text, start) in DECLARES and text[start - 1] in " \t" else [word]


def operands(text: str, at: int) -> tuple[list[tuple[str, int, int]], list[int], int]:
    """Strings, bare values and names of an expression from ``at``, and its end.

    The second list says for each operand after the first whether ``+`` joins it to
    the one before. What is called with parentheses is no operand.
    """
    out: list[tuple[str, int, int]] = []
    plus: list[int] = []
    if m := BEHIND.match(text, at):
        at = m.end()
    sign = 0
    while True:
        while at < len(text) and text[at] in " \t(":
            at += 1
        if m := STRING.match(text, at):
            k = m.lastindex or 1
            found = ("string", m.start(k), m.end(k))
        elif m := BARE.match(text, at):
            found = ("name" if NAME.fullmatch(text, m.start(), m.end()) else "bare", m.start(), m.end())
            if found[0] == "name" and m[0] in ("or", "not"):
                return out, plus, at
        else:
            return out, plus, at
        at = m.end()
        if found[0] == "string" or text[at : at + 1] != "(":
            if out:
                plus.append(sign)
            out.append(found)
        joint = JOINT.match(text, at)
        if joint is None:
            return out, plus, at
        sign, at = int(joint[1] == "+"), joint.end()


def declared_literals(text: str, limit: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Literals that reach a sensitive name, in order; and the types that stand before such literals of typed declarations."""
    constants: dict[str, int] = {}  # the last assignment of each name
    weights: list[float] = []  # of each assignment
    parts_of: list[dict[tuple[Span, ...] | int, None]] = []  # its literals, those joined together, and the assignments it takes other values from
    bare: set[Span] = set()
    types: list[tuple[Span, list[Span]]] = []
    at = 0
    while m := SEPARATOR.search(text, at):
        begin, kind_of = m.end(), None
        names = targets(text, m.start(), m[0])
        if m[0] == ":" and (typed := TYPED.match(text, m.end())):
            name = name_before(text, m.start() - (text[m.start() - 1 : m.start()] in ("?", "!")))
            if name and operands(text, typed.end())[0]:
                begin, kind_of = typed.end(), typed.span(1)
                names = [name] if is_type(typed[1]) else [name, typed[1]]
        parts, plus, at = operands(text, begin) if names else ([], [], begin)
        at = max(at, begin)
        values: dict[tuple[Span, ...] | int, None] = {}
        run: list[Span] = []  # strings joined by plus signs
        for n, (kind, start, end) in enumerate(parts):
            if n and not plus[n - 1] or kind != "string":
                if len(run) > 1:
                    values[tuple(run)] = None
                run = []
            if kind == "string":
                run.append((start, end))
            else:
                bare.add((start, end))
            known = constants.get(text[start:end]) if kind == "name" else None
            values[((start, end),) if known is None else known] = None
            if kind != "name":
                for hole in HOLE.finditer(text, start, end):
                    if hole[1] in constants:
                        values[constants[hole[1]]] = None
        if len(run) > 1:
            values[tuple(run)] = None
        if len(parts) == 1 and parts[0][0] == "bare" and text[m.start()] == ":" and "//" in text[m.start() : m.start() + 3]:
            continue  # an address, not an assignment
        if names and values:
            if kind_of and is_type(text[slice(*kind_of)]):
                types.append((kind_of, [(a, b) for _, a, b in parts]))
            elif kind_of and any(c.isdigit() for c in text[slice(*kind_of)]):
                values[(kind_of,)] = None  # rather a value than a type
            for name in names:
                constants[name] = len(weights)
            weights.append(max(map(name_score, names)))
            parts_of.append(values)
            if parts[-1][0] != "string":  # a bare value may itself be name=value
                at = max(begin, parts[-1][1])
                if SEPARATOR.search(text, at, parts[-1][2]) is None:
                    at = max(at, parts[-1][2])
    best: dict[tuple[Span, ...], float] = {}
    for i in range(len(weights) - 1, -1, -1):  # an assignment's values are older than itself
        for value in parts_of[i]:
            if isinstance(value, int):
                weights[value] = max(weights[value], weights[i])
            else:
                best[value] = max(best.get(value, 0.0), weights[i])
    found: set[Span] = set()
    for pieces, weight in best.items():
        value = "".join(text[a:b] for a, b in pieces)
        wordy = weight < 0.8 and pieces[0] in bare and WORDY.fullmatch(value)
        if weight and not wordy and weight * literal_score(value) >= limit:
            found.update(pieces)
    return sorted(found), [t for t, own in types if any(s in found for s in own)]


def named_literals(text: str, limit: float = 0.5) -> list[Span]:
    """Literals that reach a sensitive name, in order."""
    return declared_literals(text, limit)[0]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[Span]]:
    """All spans by start, then kind; and the parts of the text to mask, in order and apart."""
    spans: list[tuple[str, int, int]] = []
    secret: list[Span] = []
    separated = ":" in text or "=" in text
    if separated:
        low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
        if any(h in low for h in HINTS):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 6:
                    spans.append(("assign", m.start(), m.end()))
                    secret.append(m.span(2))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    secret += [(a, b) for kind, a, b in spans if kind != "assign"]
    if separated:
        base = sorted((a, b) for _, a, b in spans)
        named, types = declared_literals(text)
        beginnings = {a: b for a, b in types}
        secret = [(a, b) for a, b in secret if a not in beginnings or text[a:b].rstrip("=") != text[a : beginnings[a]]]
        reach = at = 0  # both lists are in order: how far the base spans go that begin no later than the literal
        for a, b in named:
            while at < len(base) and base[at][0] <= a:
                reach = max(reach, base[at][1])
                at += 1
            if b > reach:
                spans.append(("named", a, b))
                secret.append((a, b))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    merged: list[Span] = []
    for a, b in sorted(secret):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return spans, merged


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def masked(text: str) -> str:
    """The text with every secret replaced by ``[REDACTED]``."""
    _, secret = scan(text)
    out, at = [], 0
    for a, b in secret:
        out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:] if secret else text


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(df: DataFrame) -> DataFrame:
    """Counts and spans of each document; one row per input row."""

    def fn(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        found = [scan(t)[0] for t in texts]
        count = lambda kind: [sum(s[0] == kind for s in spans) for spans in found]
        yield {
            "doc_id": batch.column(batch.schema.get_field_index("doc_id")),
            **{f"n_{k}": count(k) for k in KINDS},
            "base_sha256": [hashlib.sha256(joined([s for s in x if s[0] != "named"]).encode()).hexdigest() for x in found],
            "spans": [joined(x) for x in found],
        }

    return map_texts(
        documents(df), fn, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_named bigint, base_sha256 string, spans string")


def mask_secrets(df: DataFrame) -> DataFrame:
    """The same rows and columns with secrets masked in ``text``; ``n_chars`` follows the text. Null text stays null."""
    schema, at = df.schema, df.columns.index("text")

    def run(batches):
        for batch in batches:
            column = pa.array([t if t is None else masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    out = df.mapInArrow(run, schema)
    if "n_chars" not in df.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
