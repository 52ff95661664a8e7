"""Personal data by a linear-chain conditional random field over word-shape features.

Four base patterns find mail addresses, IP addresses, card and phone numbers.  The field finds what the
patterns miss (numbers written without a country code, addresses spelt out): it is trained on a small
labelled table that is part of this module, and decoded by Viterbi in numpy, many regions at once.

A region is a run of white-space separated chunks that hold a digit or an @, with connectors (brackets,
"at", "dot") between them and a word such as "phone" before them.  Every other chunk is outside by definition, both in training and in decoding,
so cutting the chain at those changes no decoding; and no base match can reach beyond a region, so all work
after one pass over the bytes is on regions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .staging import parts_of
from .worker import enter

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]")
_CONNECTOR = re.compile(rb"(?i)[().\[\]<>{}/|:;,_-]+|[(\[{<]?(?:at|dot)[)\]}>]?")
#: A word that says that a telephone number follows.
_CUE = re.compile(rb"(?i)(?:call|dial|phone|telephone|tel|mobile|cell|ring|fax|fon|telefon|anruf|mobil|handy|t\xc3\xa9l\xc3\xa9phone|t\xc3\xa9l|appelez|tel\xc3\xa9fono|m\xc3\xb3vil|llame)[.:]?")
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]")
_LIVE = np.zeros(256, dtype=bool)
_LIVE[[*range(48, 58), 64]] = True
#: Tokens of a region decoded at once; a longer region is decoded block by block, scores and back pointers carried on.
_MOST_TOKENS = 512
#: So many tokens to each side are features of one.
_REACH = 3

# The labelled table: [kind:text] marks a span.
_EXAMPLES = """
write to [email:jo.field@mail.example.org] today
mail [email:a_b+c@x.co] , [email:info@firm.example]
reach me [email:sam at example dot com] please
contact [email:lee (at) firm (dot) org] now
contact [email:kim [at] site [dot] net] now
it is [email:r.poe AT mail DOT example DOT com] ok
sent by [email:x99@mail3.example.com] on 3 May
call [phone:+1 (555) 010-2030] now
call [phone:+44 20 7946 0958] or [phone:+49 30 901820]
call [phone:(555) 010-2030] now
call [phone:555-010-2030] or [phone:555.010.2030]
tel [phone:(212) 555-0175] ext 12
ring [phone:1-800-555-0199] today
fon [phone:030 901820] heute
from [ip:192.168.0.1] to [ip:10.0.0.254] ok
call [phone:5550102030] now
phone: [phone:2125550175] or later
tel [phone:0301234567] bitte
Tel. [phone:0401234567] abends
Phone. [phone:3125550187] or write
isbn 978-0-14-044913-6 and 0-14-044913-9 too
mobile : [phone:07700900123] after 6
fax [phone:08912345678] or [phone:020 7946 0018]
call me at [phone:3125550142] ok
host [ip:8.8.8.8] : 53 up
SSN 123-45-6789 on file
ssn: 078-05-1120 was shown
number 219-09-9999 is taken
in 1999 of 5550102030 and 2125550175 rows
nos 0301234567 and 07700900123 sold
the card [card:4111 1111 1111 1111] expires 12/27
card [card:4111111111111111] and [card:5500-0000-0000-0004] ok
pay [card:3782 822463 10005] now
paid 1200.50 on 2024-01-31 at 10:30
version 1.2.3 and 2.0.14 came out
order 20240131 with 12345678901 items
see section 4.2.1 and page 12 , 13
id 79927398713 and serial 04-1234-99
between 1998 and 2004 about 35,000 people
token = " 0123456789abcdef0123456789abcdef "
on 12/05/2021 at 18:45:10 in room 101
price $ 19.99 ( 20 % off ) for 3 units
isbn 978-3-16-148410-0 was lent 7 times
@home with user @dave and 2 others
a score of 3-2 and 10-7 in 1990
ratio 0.75 at 100 dpi dot 5
look at 5 dot plots at 3 places
item 123-45 or 12-345 in lot 7
coordinates 52.520008 13.404954 north
build 10.0.19045 of 2023.11.02
9404 1000200030004000 48 and 12
tables 3 4 5 6 and 7 at last
""".strip().splitlines()


_MARK = re.compile(r"\[(email|ip|card|phone):((?:[^\[\]]|\[(?:at|dot)\])+)\]")


def _shape(token: bytes) -> str:
    if token.isdigit():
        return f"d{min(len(token), 9)}" if len(token) < 13 else ("dcard" if len(token) in (14, 15, 16, 19) else "dlong")
    if token.lower() in (b"at", b"dot"):
        return token.lower().decode()
    if _CUE.fullmatch(token):
        return "cue"
    if token[0] in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or token[0] >= 128:
        return "word"
    return token.decode("ascii")


def _features(tokens: list[bytes], gaps: list[bool]) -> list[list[str]]:
    """Of each token: its shape, what stands beside it and whether space lies between."""
    shapes = [_shape(t) for t in tokens]
    n = len(tokens)
    get = lambda k: shapes[k] if 0 <= k < n else "end"
    gap = lambda k: "_" if k <= 0 or k >= n or gaps[k] else ""
    out = []
    for k in range(n):
        l1, r1 = get(k - 1) + gap(k), gap(k + 1) + get(k + 1)
        out.append([
            "s=" + shapes[k], "l=" + l1, "r=" + r1, f"ls={l1}|{shapes[k]}", f"sr={shapes[k]}|{r1}", f"lr={l1}|{r1}",
            f"ll={get(k - 2)}{gap(k - 1)}{l1}|{shapes[k]}", f"rr={shapes[k]}|{r1}{gap(k + 2)}{get(k + 2)}",
            f"r3={r1}{gap(k + 2)}{get(k + 2)}{gap(k + 3)}{get(k + 3)}|{shapes[k]}", f"l3={get(k - 3)}{gap(k - 2)}{get(k - 2)}{gap(k - 1)}{l1}|{shapes[k]}", "bias",
        ])
    return out


#: Outside, and begin and inside of each kind.
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def _regions(data: bytes, starts: np.ndarray, ends: np.ndarray, live: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a text's runs of live chunks with connectors between them and beside them."""
    out: list[tuple[int, int]] = []
    n, done = len(starts), -1
    connects = lambda k: 0 <= k < n and _CONNECTOR.fullmatch(data, starts[k], ends[k])
    for k in np.flatnonzero(live):
        if k <= done:
            continue
        first = last = int(k)
        while first - 1 > done and connects(first - 1):
            first -= 1
        while last + 1 < n and (live[last + 1] or connects(last + 1)):
            last += 1
        if first - 1 > done and _CUE.fullmatch(data, starts[first - 1], ends[first - 1]):
            first -= 1
        done = last
        out.append((int(starts[first]), int(ends[last])))
    return out


def _spelt_regions(data: bytes) -> list[tuple[int, int]]:
    """Ranges of addresses that are spelt out: word, at, word, dot, word."""
    return [m.span() for m in _SPELT.finditer(data)]


# Parts of any length and number: each run is possessive and begins where it can, so the scan stays linear.
_SPELT = re.compile(rb"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s{1,2}[(\[{<]?at[)\]}>]?\s{1,2}[A-Za-z0-9-]++(?:\s{1,2}[(\[{<]?dot[)\]}>]?\s{1,2}[A-Za-z0-9-]++)++")
_DOT = re.compile(rb"(?i)\s[(\[{<]?dot[)\]}>]?\s")


class Field:
    """The trained field: feature index, emission weights (features x tags) and transitions."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.stack([self.emit[[k for f in fs if (k := get(f)) is not None]].sum(0) for fs in features])

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of many sequences of emissions, by Viterbi, all of a batch in step."""
        order = sorted(range(len(batch)), key=lambda k: -len(batch[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
        for g in range(0, len(order), 256):
            rows = order[g : g + 256]
            lengths = np.array([len(batch[k]) for k in rows])
            longest, tags = int(lengths[0]), len(TAGS)
            scores = np.zeros((len(rows), longest, tags))
            for r, k in enumerate(rows):
                scores[r, : lengths[r]] = batch[k]
            back = np.zeros((longest, len(rows), tags), np.int8)
            best = scores[:, 0] + _FIRST
            finals = best.copy()
            for t in range(1, longest):
                live = int((lengths > t).sum())
                through = best[:live, :, None] + self.move[None]
                back[t, :live] = through.argmax(1)
                best[:live] = through.max(1) + scores[:live, t]
                finals[:live] = best[:live]
            for r, k in enumerate(rows):
                path = np.empty(lengths[r], np.int64)
                path[-1] = int(finals[r].argmax())
                for t in range(lengths[r] - 1, 0, -1):
                    path[t - 1] = back[t, r, path[t]]
                out[k] = path
        return out

    def follow(self, blocks) -> np.ndarray:
        """Best tags of one sequence whose emissions come block by block; only back pointers are kept of all of it."""
        best, back = None, []
        for scores in blocks:
            came = np.zeros(scores.shape, np.int8)
            for t, own in enumerate(scores):
                if best is None:
                    best = own + _FIRST
                    continue
                through = best[:, None] + self.move
                came[t] = through.argmax(0)
                best = through.max(0) + own
            back.append(came)
        back = np.concatenate(back)
        path = np.empty(len(back), np.int64)
        path[-1] = int(best.argmax())
        for t in range(len(back) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


# Inside may follow only begin or inside of its kind.
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
_FIRST = np.array([-1e4 if t.startswith("I") else 0.0 for t in TAGS])


def _labelled(line: str) -> list[tuple[list[bytes], list[bool], list[int]]]:
    """Tokens, gaps before them and tags of each region of one labelled line."""
    text, marks, at = "", [], 0
    for m in re.finditer(_MARK, line):
        text += line[at : m.start()]
        marks.append((len(text), len(text) + len(m[2]), m[1]))
        text, at = text + m[2], m.end()
    data = (text + line[at:]).encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends = tb._words_of(raw)
    live = np.array([bool(_LIVE[raw[a:b]].any()) for a, b in zip(starts, ends)], dtype=bool)
    out = []
    for first, last in [*_regions(data, starts, ends, live), *_spelt_regions(data)]:
        tokens, gaps, tags = [], [], []
        for m in _TOKEN.finditer(data, first, last):
            inside = [(s, k) for s, e, k in marks if s <= m.start() < e]
            tokens.append(m[0])
            gaps.append(m.start() == first or data[m.start() - 1 : m.start()].isspace())
            tags.append(TAGS.index(("B-" if m.start() == inside[0][0] else "I-") + inside[0][1]) if inside else 0)
        out.append((tokens, gaps, tags))
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 160, l2: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps (Adam) on the regions of the labelled table; the same on every machine."""
    lines = list(_EXAMPLES)
    for line in _EXAMPLES:  # each span also before a comma, before a full stop, and beside the next example's
        lines += [re.sub(_MARK, lambda m, p=p: m[0] + p, line) for p in (",", ".") if re.search(_MARK, line)]
    spans = [m[0] for line in _EXAMPLES for m in re.finditer(_MARK, line)]
    lines += [f"{a}, {b}" for a, b in zip(spans, spans[1:])] + [f"{a} {b}" for a, b in zip(spans, spans[2:])]
    sequences = [x for line in lines for x in _labelled(line)]
    features = [_features(t, g) for t, g, _ in sequences]
    index: dict[str, int] = {}
    for fs in features:
        for f in fs:
            for x in f:
                index.setdefault(x, len(index))
    longest, tags = max(map(len, features)), len(TAGS)
    width = len(features[0][0])
    ids = np.full((len(features), longest, width), len(index), np.int64)
    gold = np.full((len(features), longest), -1)
    for r, (fs, (_, _, y)) in enumerate(zip(features, sequences)):
        for t, f in enumerate(fs):
            ids[r, t] = [index[x] for x in f]
        gold[r, : len(y)] = y
    live = gold >= 0
    emit, move = np.zeros((len(index) + 1, tags)), np.zeros((tags, tags))
    barred = np.where(_ALLOWED, 0.0, -1e4)
    target_e, target_m = np.zeros_like(emit), np.zeros_like(move)
    for r in range(len(features)):
        for t in range(longest):
            if live[r, t]:
                target_e[ids[r, t], gold[r, t]] += 1
                if t and live[r, t - 1]:
                    target_m[gold[r, t - 1], gold[r, t]] += 1
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        score = emit[ids].sum(2)
        full = move + barred
        alpha, beta = np.zeros((longest, len(features), tags)), np.zeros((longest, len(features), tags))
        alpha[0] = score[:, 0] + _FIRST
        for t in range(1, longest):
            alpha[t] = np.where(live[:, t, None], lse(alpha[t - 1][:, :, None] + full[None], 1) + score[:, t], alpha[t - 1])
        z = lse(alpha[-1], 1)
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(live[:, t + 1, None], lse(full[None] + (score[:, t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        node = np.exp(alpha + beta - z[None, :, None]) * live.T[:, :, None]
        grad_e, grad_m = np.zeros_like(emit), np.zeros_like(move)
        for k in range(width):
            np.add.at(grad_e, ids[:, :, k].T.ravel(), node.reshape(-1, tags))
        for t in range(1, longest):
            pair = alpha[t - 1][:, :, None] + full[None] + (score[:, t] + beta[t])[:, None, :] - z[:, None, None]
            grad_m += (np.exp(np.minimum(pair, 0)) * live[:, t, None, None]).sum(0)
        for x, g, m1, m2 in ((emit, target_e - grad_e - l2 * emit, *moments[:2]), (move, target_m - grad_m - l2 * move, *moments[2:])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        emit[-1] = 0
    return Field(index, np.round(emit, 6), np.where(_ALLOWED, np.round(move, 6), -1e4))


def _luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    out = []
    if b"@" in data:
        # Mail addresses hold no white space and one may only start where the run before its @ does.
        at = 0
        while (k := data.find(b"@", at)) >= 0:
            s = k
            while s > 0 and data[s - 1 : s].isalnum() | (data[s - 1] in b"._%+-") and data[s - 1] < 128:
                s -= 1
            m = _EMAIL.match(data, max(s, at)) if max(s, at) < k else None
            if m:
                out.append(("email", m.start(), m.end()))
            at = m.end() if m else k + 1
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(data) if all(int(x[-6:]) <= 255 and not x[:-6].strip(b"0") for x in m[0].split(b"."))]
    for m in _CARD.finditer(data):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if b"+" in data:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(data) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _valid(kind: str, value: bytes) -> bool:
    """What a decoded span must look like at the least."""
    digits = len(_DIGITS.findall(value))
    if kind == "email":
        return bool(re.fullmatch(rb"(?is)[A-Za-z0-9._%+-]+(?:@|\s*[(\[{<]?\bat\b[)\]}>]?\s*)[A-Za-z0-9-]+(?:(?:\.|\s*[(\[{<]?\bdot\b[)\]}>]?\s*)[A-Za-z0-9-]+)+", value))
    if kind == "ip":
        return bool(re.fullmatch(rb"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", value)) and all(int(x) <= 255 for x in value.split(b"."))
    if kind == "card":
        return 14 <= digits <= 19 and _luhn(bytes(c for c in value if 48 <= c <= 57))
    return 7 <= digits <= 15


def _pieces(data: bytes, cut: np.ndarray, first: int, last: int) -> tuple[list[bytes], list[bool]]:
    """Tokens from first to last and whether a gap is before each; before a region's first there is one."""
    gaps = [k == 0 or cut[k - 1, 1] < cut[k, 0] for k in range(first, last)]
    return [data[x:y] for x, y in cut[first:last].tolist()], gaps


def _blocks(field: Field, data: bytes, cut: np.ndarray):
    """Emissions of a long region block by block, each from features that see beyond the block."""
    for c in range(0, len(cut), _MOST_TOKENS):
        first, last = max(0, c - _REACH), min(len(cut), c + _MOST_TOKENS + _REACH)
        yield field.emissions(_features(*_pieces(data, cut, first, last))[c - first : c - first + _MOST_TOKENS])


def find(texts: pa.Array, field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base, added) spans in code points of each text of an Arrow array."""
    at, raw, valid = tb.buffers(texts)
    out: list[tuple[list, list]] = [([], []) for _ in range(len(texts))]
    jobs: list[tuple] = []
    emissions: list[np.ndarray] = []
    memory: dict[tuple, np.ndarray] = {}
    # Base spans by their starts, and how far those up to each reach: what overlaps one is found by bisection.
    ends_of = lambda base: ([s for _, s, _ in base], [0, *accumulate((e for _, _, e in base), max)])

    def settle(r: int, base: tuple[list[int], list[int]], cut: np.ndarray, data: bytes, place, path: np.ndarray) -> None:
        k = 0
        while k < len(cut):
            if path[k] == 0:
                k += 1
                continue
            kind, e = TAGS[path[k]][2:], k + 1
            while e < len(cut) and path[e] and TAGS[path[e]] == "I-" + kind:
                e += 1
            s, t = int(cut[k, 0]), int(cut[e - 1, 1])
            if _valid(kind, data[s:t]) and base[1][bisect_left(base[0], t)] <= s:
                out[r][1].append((kind, place(s), place(t)))
            k = e

    for first, last in tb.chunks(at):
        part = raw[at[first] : at[last]]
        hot = np.concatenate([[0], np.cumsum(_LIVE[part], dtype=np.int64)])
        blob = part.tobytes()
        spelt_near = _DOT.search(blob) is not None
        for r in range(first, last):
            if not valid[r]:
                continue
            a, b = int(at[r] - at[first]), int(at[r + 1] - at[first])
            live_text = hot[b] > hot[a]
            if not live_text and not spelt_near:
                continue
            data = blob[a:b]
            regions: list[tuple[int, int]] = []
            if live_text:
                starts, ends = tb._words_of(part[a:b])
                live = hot[a + ends] > hot[a + starts]
                regions = _regions(data, starts, ends, live)
            base: list[tuple[str, int, int]] = []
            for s, e in regions:
                base += [(k, s + x, s + y) for k, x, y in base_spans(data[s:e])]
            base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            if spelt_near and _DOT.search(data):
                regions = sorted({*regions, *_spelt_regions(data)})
            heads = None
            if not data.isascii() and regions:
                heads = np.concatenate([[0], np.cumsum((part[a:b] & 0xC0) != 0x80)])
            place = (lambda x, h=heads: x) if heads is None else (lambda x, h=heads: int(h[x]))
            out[r][0].extend((k, place(s), place(e)) for k, s, e in base)
            known = ends_of(base)
            for s, e in regions:
                cut = np.fromiter((x for m in _TOKEN.finditer(data, s, e) for x in m.span()), np.int64).reshape(-1, 2)
                if len(cut) > _MOST_TOKENS:
                    settle(r, known, cut, data, place, field.follow(_blocks(field, data, cut)))
                elif len(cut):
                    words, gaps = _pieces(data, cut, 0, len(cut))
                    key = tuple(_shape(w) for w in words), tuple(gaps)
                    if key not in memory:
                        memory[key] = field.emissions(_features(words, gaps))
                    emissions.append(memory[key])
                    jobs.append((r, known, cut, data, place))
    for job, path in zip(jobs, field.decode(emissions) if emissions else []):
        settle(*job, path)
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, base array<struct<kind,start,end>>, added the same) for every row of docs(doc_id, text, ...).

    Places are code points, ends exclusive; an added span overlaps no base span.  Null and empty texts hold
    nothing; a null doc_id is carried along; rows that repeat come back as often; other columns are not
    read.  Empty table: no rows.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(rows.sparkSession.sparkContext.broadcast(field or trained())), f"doc_id long, base {kind}, added {kind}")


def _scanner(field):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        enter("pii")
        for batch in parts_of(batches):
            found = find(batch.column(1), field.value)
            sides = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in f[k]] for f in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["doc_id", "base", "added"])

    return run


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span in `text` replaced by its kind in angle brackets; texts without spans are untouched.

    Null texts stay null; all other columns are carried along as they are.
    """
    names = docs.columns
    inner = docs.select(F.col("text").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != "text"])
    held = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        enter("pii")
        for batch in parts_of(batches):
            texts = batch.column(0).to_pylist()
            for r, (base, added) in enumerate(find(batch.column(0), held.value)):
                spans = sorted(base + added, key=lambda x: (x[1], -x[2]))
                if spans:
                    text, parts, at = texts[r], [], 0
                    for kind, s, e in spans:
                        if s >= at:
                            parts += [text[at:s], f"<{kind}>"]
                        at = max(at, e)
                    texts[r] = "".join([*parts, text[at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *(batch.column(k) for k in range(1, batch.num_columns))], names=batch.schema.names)

    out = inner.mapInArrow(run, inner.schema)
    return out.select(*[(F.col("t") if c == "text" else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])
