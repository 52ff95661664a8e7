"""Secret scans by assignment-aware lexing.

Three base patterns find secrets by their own looks.  Beside them, a tokenizer (words, strings with escapes, prefixes
and three quotes, signs, lines) and a small parser read source and configuration syntax into pairs of names and
literals: types and modifiers about a name, subscripts, keys, tags, values on the next line, joined literals, calls that
look something up with a default.  Names that are given other names hand their weight on to them, in any order of
definition; a literal is scored by the most sensitive name that it reaches and by how random it looks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import parts_of

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal either way: the shorter ones are what is dropped
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_RUNS = bytes(49 if chr(k) in "0123456789abcdef" else 48 for k in range(256))

#: A literal counts from this score on.
SCORE = 0.6
# Parts of names that make a target sensitive, and how much.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "key": 0.5, "auth": 0.6, "credential": 0.9, "private": 0.6, "access": 0.4, "signing": 0.5, "bearer": 0.8, "salt": 0.5, "cert": 0.3}
_DUMMY = re.compile(rb"(?i)^(?:x+|\*+|\.+|0+|changeme|example|none|null|true|false|your.*|<.*>|\$\{.*\}|placeholder|default)$")
# Tokens of source and configuration files.  Runs are possessive, so the scan stays linear.
_TOKEN = re.compile(
    rb"""(?P<line>\r?\n|\r)|(?P<blank>[\x20\t\f]++|//|/\*|\*/|\#|\\\r?\n)"""
    rb"""|(?P<string>[A-Za-z]{0,2}?(?:\"\"\"(?P<s3>(?:[^"\\]|\\[\s\S]|"(?!""))*+)\"\"\"|\'\'\'(?P<t3>(?:[^'\\]|\\[\s\S]|'(?!''))*+)\'\'\'|"(?P<s1>(?:[^"\\\r\n]|\\[^\r\n])*+)"|'(?P<t1>(?:[^'\\\r\n]|\\[^\r\n])*+)'|`(?P<u1>[^`\r\n]*+)`))"""
    rb"""|(?P<word>[A-Za-z_$@][A-Za-z0-9_.$-]*+)|(?P<op>:=|=>|==|!=|<=|>=|::|->|[=:+,;()\[\]{}<>|&?!])|(?P<other>[^\s])"""
)
_TAGGED = re.compile(rb"""<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>\r\n]*+)?>\s*+([^<>\s]++)\s*+</""")
#: An unquoted value.
_BARE = re.compile(rb"[A-Za-z0-9+/_.=$@%^*!~-]++")
_IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_.]*+")
# Words that stand before or behind a declared name and are none.
_MODIFIERS = frozenset(b"var let const val final static public private protected readonly export set local declare def define auto extern mut pub my our global".split())
_TYPES = frozenset(b"string str text char byte bytes any object".split())
_ASSIGNS = frozenset((b"=", b":=", b"=>", b":"))
#: Calls whose first argument names what they look up; other literal arguments stand for it.
_LOOKUPS = re.compile(rb"(?i)(?:^|[._])(?:get|getenv|env|environ|fetch|lookup|config|setting|getproperty|getstring|get_env|getattr|setdefault|pop)$")


def _at(data: bytes, spans: list[tuple[str, int, int]], ascii_: bool) -> list[tuple[str, int, int]]:
    """Byte places as code points."""
    if ascii_ or not spans:
        return spans
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(heads[s]), int(heads[e])) for k, s, e in spans]


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    out = []
    low = data.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in data:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    if b"1" * 32 in data.translate(_RUNS):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(data)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _entropy(value: bytes) -> float:
    n = np.bincount(np.frombuffer(value, np.uint8))
    p = n[n > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def sensitivity(name: bytes) -> float:
    """How much a name promises a secret: the strongest of its parts, and a little for each other one."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.decode("ascii")).lower()
    joined = re.sub(r"[^a-z0-9]", "", parts)
    found = sorted((w for k, w in _SENSITIVE.items() if k in re.split(r"[^a-z0-9]+", parts) or len(k) > 4 and k in joined), reverse=True)
    return found[0] + 0.2 * sum(found[1:]) if found else 0.0


_PARTS = tuple(k.encode() for k in _SENSITIVE)


def _name_weight(name: bytes) -> float:
    return sensitivity(name) if name.isascii() and len(name) <= 256 else 0.0


def literal_score(name_weight: float, value: bytes) -> float:
    """Sensitivity of the names a literal reaches, times its looks: length, mixed classes, entropy."""
    if len(value) < 8 or b" " in value or _DUMMY.match(value):
        return 0.0
    classes = sum(bool(re.search(c, value)) for c in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return name_weight * (0.25 * min(classes, 3) + 0.25 * min(_entropy(value) / 3.0, 2.0) + 0.1 * min(math.log2(len(value) / 8), 2))


class _Tokens:
    """A text's tokens: kind, bytes, and the place of what they hold (of a string: inside its quotes)."""

    def __init__(self, data: bytes):
        self.data = data
        self.kind, self.text, self.start, self.end, self.begin = [], [], [], [], []
        for m in _TOKEN.finditer(data):
            kind = m.lastgroup
            if kind == "blank":
                continue
            s, e = m.span()
            self.begin.append(s)
            if kind not in ("line", "word", "op", "other"):
                kind, (s, e) = "string", next(m.span(g) for g in ("s3", "t3", "s1", "t1", "u1") if m.start(g) >= 0)
            self.kind.append(kind)
            self.text.append(data[s:e])
            self.start.append(s)
            self.end.append(e)

    def is_op(self, k: int, *ops: bytes) -> bool:
        return 0 <= k < len(self.kind) and self.kind[k] == "op" and self.text[k] in ops


def _target(t: _Tokens, at: int, statement: int) -> bytes | None:
    """The name that is given a value by the sign at `at`: before it, before its type, after `var`, or a subscript."""
    k = at - 1
    if k < statement:
        return None
    if t.is_op(k, b"]"):  # config["name"] = ...
        k -= 1
        return t.text[k] if k > statement and t.kind[k] in ("string", "word") and t.is_op(k - 1, b"[") else None
    if t.kind[k] == "string":  # "name": ...
        return t.text[k] if t.text[at] != b"=" or t.is_op(k - 1, b"[") else None
    first = statement
    while first < at and t.kind[first] == "word" and t.text[first].lower() in _MODIFIERS:
        first += 1
    if first > statement and first < k and t.kind[first] == "word" and t.text[k].lower() in _TYPES:  # var name type = ...
        return t.text[first]
    if t.text[at] != b":":  # name: type = ..., a type of one word or with brackets
        colon = next((j for j in range(at - 1, max(statement, at - 12), -1) if t.is_op(j, b":")), None)
        if colon is not None and colon > statement and t.kind[colon - 1] in ("word", "string"):
            return t.text[colon - 1]
    return t.text[k] if t.kind[k] == "word" else None


def _value(t: _Tokens, at: int) -> tuple[list[tuple[int, int, bytes]], list[bytes]]:
    """Literals and names of the expression after the sign at `at`."""
    k, n = at + 1, len(t.kind)
    if k < n and t.kind[k] == "line" and t.text[at] == b":":  # on the next line, if that assigns nothing itself
        k += 1
        if k + 1 < n and (t.is_op(k + 1, *_ASSIGNS) or t.is_op(k, b"{", b"[", b"-")):
            return [], []
    elif k + 1 < n and t.text[at] == b":" and t.is_op(k, b"|", b">") and t.kind[k + 1] == "line":  # a block
        k += 2
    literals: list[tuple[int, int, bytes]] = []
    names: list[bytes] = []
    while k < n:
        if t.kind[k] == "string":
            literals.append((t.start[k], t.end[k], t.text[k]))
            k += 1
        elif t.kind[k] == "word" and t.is_op(k + 1, b"("):
            depth, argument, j = 1, 0, k + 2
            while j < n and depth and j < k + 64:
                if t.is_op(j, b"(", b"[", b"{"):
                    depth += 1
                elif t.is_op(j, b")", b"]", b"}"):
                    depth -= 1
                elif t.is_op(j, b",") and depth == 1:
                    argument += 1
                elif t.kind[j] == "string" and (argument or not _LOOKUPS.search(t.text[k])):
                    literals.append((t.start[j], t.end[j], t.text[j]))
                j += 1
            k = j
        elif t.kind[k] in ("word", "other") and not literals and not names or t.kind[k] == "word" and (t.is_op(k - 1, b"+", b"|", b"?") or t.text[k - 1] in (b".", b"or", b"else")):
            m = _BARE.match(t.data, t.begin[k])
            if m is None:
                break
            if _IDENTIFIER.fullmatch(m[0]):
                names.append(m[0])
            if k == at + 1 or t.kind[k - 1] == "line":
                literals.append((m.start(), m.end(), m[0]))
            while k < n and t.begin[k] < m.end():
                k += 1
        else:
            break
        # Parts are joined by a plus or a dot, or stand side by side, or one stands in for another.
        if k < n and t.kind[k] == "word" and t.text[k] in (b"or", b"else"):
            k += 1
            continue
        if t.is_op(k, b"|", b"?") and t.is_op(k + 1, t.text[k]):
            k += 2
            continue
        if t.is_op(k, b"+") or k < n and t.kind[k] == "other" and t.text[k] in (b".", b"~"):
            k += 1
            while k < n and t.kind[k] == "line":
                k += 1
        elif not (k < n and t.kind[k] == "string" and literals):
            break
    return literals, names


def lexed_spans(data: bytes) -> list[tuple[str, int, int]]:
    """Literals that sensitive names are given, directly or by way of other names, wherever those are defined."""
    low = data.lower()
    if not any(k in low for k in _PARTS) or b"=" not in data and b":" not in data and b"</" not in data:
        return []
    given: dict[bytes, list[tuple[list[tuple[int, int, bytes]], list[bytes]]]] = {}
    t, statement = _Tokens(data), 0
    for k, kind in enumerate(t.kind):
        if kind == "op" and t.text[k] in _ASSIGNS:
            if name := _target(t, k, statement):
                given.setdefault(name, []).append(_value(t, k))
        elif kind == "line" or kind == "op" and t.text[k] in (b";", b",", b"{", b"}", b"("):
            statement = k + 1
    for m in _TAGGED.finditer(data):
        given.setdefault(m[1], []).append(([(m.start(2), m.end(2), m[2])], []))
    # Weights go from names to what they are made of: the heaviest names first, so each name is passed once.
    weights = {name: w for name in given if (w := _name_weight(name)) > 0}
    heaviest = sorted(weights, key=weights.get)
    done: set[bytes] = set()
    best: dict[tuple[int, int], tuple[float, bytes]] = {}
    while heaviest:
        stack, weight = [heaviest[-1]], weights[heaviest.pop()]
        while stack:
            name = stack.pop()
            if name in done:
                continue
            done.add(name)
            for literals, names in given[name]:
                joined_ = b"".join(v for _, _, v in literals)
                known = [x for x in names if x in given and x != name]
                for s, e, v in literals:
                    if v not in known and best.get((s, e), (0.0, b""))[0] < weight:
                        best[s, e] = (weight, joined_)
                stack += known
    score = cache(literal_score)  # all parts of a joined literal share one
    out: list[tuple[str, int, int]] = []
    for (s, e), (w, whole) in sorted(best.items()):
        if score(w, whole) >= SCORE and (not out or out[-1][2] <= s):
            out.append(("literal", s, e))
    return out


def spans(text: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of UTF-8 bytes in code points; an added span overlaps no base span or other."""
    base = base_spans(text)
    # Literals never overlap each other; a base span that begins before one ends must have ended by its start.
    starts, ends = [s for _, s, _ in base], [0, *accumulate((e for _, _, e in base), max)]
    added = [(k, s, e) for k, s, e in lexed_spans(text) if ends[bisect_left(starts, e)] <= s]
    ascii_ = text.isascii()
    return _at(text, base, ascii_), _at(text, added, ascii_)


def joined(found: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], kinds.index(x[0]))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base array<struct<kind,start,end>>, added the same) for every row of docs(doc_id, text, ...).

    Places are code points, ends exclusive.  Null and empty texts hold nothing; a null doc_id is carried
    along; rows that repeat come back as often; other columns are not read.  Empty table: no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in parts_of(batches):
            found = [spans(t) if t else ([], []) for t in batch.column(1).to_pylist()]
            sides = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in f[k]] for f in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def digest(found: DataFrame, kinds: tuple[str, ...], counted: dict[str, str]) -> DataFrame:
    """Counts of base spans by kind, the hash of the joined base spans, and all spans joined."""
    place = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    order = F.create_map(*[F.lit(v) for k, name in enumerate(kinds) for v in (name, k)])
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("k"), x["kind"].alias("kind"), x["end"].alias("end")))), place), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(c) for c, k in counted.items()]
    return found.select("doc_id", *counts, F.sha2(in_order(F.col("base")), 256).alias("base_sha256"), in_order(F.concat("base", "added")).alias("spans"))
