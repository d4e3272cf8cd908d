"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

Patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone
numbers, leftmost and without overlap in each kind; matches whose numbers fail are dropped.
Candidates are found from '@', '.', digits and '+', so that no text costs more than linear time.

The field labels tokens (cut at white space and at '=') as names, contacts (local phone numbers,
spelled-out addresses), identifiers, secrets or nothing. A name is one that an address, a title, a
label or a closing introduces; the field has no list of names and does not look for others. Its
features are word shapes (letter case, digits, length, hyphens, end), of the token and both
neighbours, and groups of cue words, up to two tokens away. It is trained on a small labelled
table (`_invented`, made by a rule, with a part held out for tests) by gradient ascent on the
regularised likelihood. Decoding is Viterbi's algorithm over numpy batches: a token whose best
label would stay `nothing` whatever its neighbours are is settled at once, which is exact; runs of
the other tokens of a line are decoded together. Spans of the field that overlap a pattern's span
are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._invented import lines

BASE_KINDS = ["email", "ip", "card", "phone"]
FIELD_KINDS = ["name", "contact", "id", "secret"]
KINDS = [*BASE_KINDS, *FIELD_KINDS]

# --- patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in own):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all pattern matches, in order."""
    finders = (_emails, _ips, _cards, _phones)
    return sorted((a, kind, b) for kind, find in enumerate(finders) for a, b in find(text))


# --- cues

#: Groups of words that hint at what stands near them, lower case, without
#: punctuation at the end.
CUES = {
    "greeting": "dear hello hi hallo liebe lieber bonjour cher chère hola querido querida estimado estimada geehrte geehrter geehrtes",
    "title": "mr mrs ms miss dr prof frau herr herrn señor señora sr sra don doña madame monsieur mme",
    "label": "name nombre nom contact kontakt contacto ansprechpartner signed author autor auteur patient applicant",
    "intro": "is bin ist soy suis heiße llamo m'appelle called named",
    "field": "age address city town place subject date alter adresse stadt ort betreff datum ville lieu objet edad ciudad dirección asunto fecha",
    "closing": "regards wishes sincerely yours grüße grüßen cordialement saludos atentamente",
    "phone": "call phone tel telephone mobile handy fax telefon teléfono téléphone appelez llame rufen reach ring",
    "mail": "mail email e-mail write correo courriel écrivez schreiben",
    "spelled": "at dot arroba punto punkt point [at] [dot]",
    "identifier": "ssn social security passport iban tax id dni nie reisepass ausweis pasaporte passeport steuernummer",
    "number": "number no nr num nummer numéro número",
    "secret": "token password passwd passwort kennwort contraseña secret api_key apikey api-key secret_key client_secret access_key key pwd bearer passe",
    "digest": "commit revision sha1 sha256 sha512 md5 checksum digest hash build isbn",
    "role": "customer service support team sir madam damen herren all everyone office department sales client cliente kunde kollegen equipo todos unknown",
    "function": "a an and the of in to on was were had must have has how what der die das und ein eine im le la les de du des et est el los las y en una un que",
}

# --- features -------------------------------------------------------------------------------

_SHAPES, _DIGITS, _LENGTHS, _HYPHENS, _ENDS = 10, 8, 6, 4, 4
_RADIX = (_SHAPES, _DIGITS, _LENGTHS, _HYPHENS, _ENDS, 2, 2)
N_CODES = int(np.prod(_RADIX))
_OFFSETS = np.concatenate([[0], np.cumsum(_RADIX)])
_PAIR_AT = int(_OFFSETS[-1])
N_FEATURES = _PAIR_AT + _SHAPES * _DIGITS + _SHAPES * _LENGTHS
N_CUES = len(CUES) + 1
#: Tokens on each side whose cues are features.
REACH = 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
# counts of a byte, twelve bits each: capitals, small letters, digits, hyphens, signs
_CAPITAL, _SMALL, _DIGIT, _HYPHEN, _SIGN = (1 << 12 * i for i in range(5))
_COUNTS = np.zeros(256, np.int64)
_COUNTS[0x41:0x5B] = _CAPITAL
_COUNTS[0x61:0x7B] = _COUNTS[0xC0:] = _SMALL
_COUNTS[0x30:0x3A] = _DIGIT
_COUNTS[[0x2D, 0x2F]] = _HYPHEN
_COUNTS[[0x40, 0x5B, 0x5D, 0x28]] = _SIGN
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14), 0x3D]] = True
_END = np.zeros(256, np.int64)
_END[[ord(c) for c in ",;"]] = 1
_END[ord(":")] = 2
_END[[ord(c) for c in ".!?"]] = 3
_DIGIT_BUCKET = np.array([0, 1, 1, 2, 3, 4, 4, 4, 4, 5, 6, 6, 6, 6, 7])
_LENGTH_BUCKET = np.array([0, 0, 1, 1, 2, 2, 2, 2, 2, *[3] * 7, *[4] * 16, 5])


def _counted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of every token: capitals, small letters, digits, hyphens and signs, up to 4,095 each.
    Capitals are ASCII and Latin-1."""
    each = _COUNTS[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    each[capital] = _CAPITAL
    long = np.flatnonzero(ends - starts > 4095)
    rest = {i: each[starts[i] : ends[i]].copy() for i in long.tolist()}
    for i in rest:
        each[starts[i] : ends[i]] = 0
    sums = np.add.reduceat(each, starts)
    out = [sums >> 12 * i & 4095 for i in range(5)]
    for place, own in rest.items():
        for i in range(5):
            out[i][place] = min(4095, int((own == 1 << 12 * i).sum()))
    return out


class Tokens:
    """Tokens of the rows of a flat buffer: places, shape codes, cue groups and lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends = starts, ends = _text.spans_of(~_SPACE[data], offsets)
        self.rows = np.searchsorted(offsets, starts, "right") - 1
        if not len(starts):
            self.code = self.cue = self.line = np.zeros(0, np.int64)
            return
        upper, lower, digit, hyphen, sign = _counted(data, starts, ends)
        size = ends - starts
        letters = upper + lower
        head = data[starts]
        first = ((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (data[np.minimum(starts + 1, len(data) - 1)] <= 0x9E))
        shape = np.select(
            [sign > 0, (digit > 0) & (letters == 0), (digit > 0) & (upper > 0) & (lower == 0), digit > 0, letters == 0, first & (upper == 1), (lower == 0), upper == 0],
            [1, 2, 3, 4, 5, 6, 7, 8], 9,
        )
        quote = (head == 0x22) | (head == 0x27)
        under = np.add.reduceat(data == 0x5F, starts) > 0
        parts = (shape, _DIGIT_BUCKET[np.minimum(digit, 14)], _LENGTH_BUCKET[np.minimum(size, 32)], np.minimum(hyphen, 3), _END[data[ends - 1]], quote, under)
        code = np.zeros(len(starts), np.int64)
        for part, radix in zip(parts, _RADIX, strict=True):
            code = code * radix + part
        self.code = code
        bare = ends.copy()
        for _ in range(2):
            bare -= (bare - starts > 1) & (_END[data[np.maximum(bare - 1, 0)]] > 0)
        cue = _cue_ids(_text.span_hashes(_FOLD[data], starts, bare))
        self.cue = np.where((_END[data[ends - 1]] == 3) & ~_ABBREVIATED[cue], 0, cue)
        breaks = np.flatnonzero(data == 0x0A)
        self.line = np.searchsorted(breaks, starts) + self.rows


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    groups = [(word.encode(), i + 1) for i, words in enumerate(CUES.values()) for word in words.split()]
    data = np.frombuffer(b"".join(x for x, _ in groups), np.uint8)
    ends = np.cumsum([len(x) for x, _ in groups])
    keys = _text.span_hashes(data, ends - [len(x) for x, _ in groups], ends)
    order = np.argsort(keys)
    return keys[order], np.array([i for _, i in groups])[order]


_CUE_KEYS, _CUE_GROUPS = _cue_table()
#: Groups whose words are abbreviated; a word of another group that ends a sentence is no cue.
_ABBREVIATED = np.array([False, *(name in ("title", "phone", "number", "identifier") for name in CUES)])


def _cue_ids(keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_CUE_KEYS, keys), len(_CUE_KEYS) - 1)
    return np.where(_CUE_KEYS[at] == keys, _CUE_GROUPS[at], 0)


def _code_features() -> np.ndarray:
    """Features of every shape code: one for each part, and two pairs of parts."""
    rest, parts = np.arange(N_CODES), []
    for radix in reversed(_RADIX):
        rest, part = np.divmod(rest, radix)
        parts.insert(0, part)
    own = [p + o for p, o in zip(parts, _OFFSETS[:-1], strict=True)]
    pairs = [_PAIR_AT + parts[0] * _DIGITS + parts[1], _PAIR_AT + _SHAPES * _DIGITS + parts[0] * _LENGTHS + parts[2]]
    return np.stack([*own, *pairs], axis=1)


_CODE_FEATURES = _code_features()


class Field:
    """A trained field, labels being nothing and FIELD_KINDS. Weights: shapes [before, own,
    after][feature, label]; cues [-REACH to REACH][group, label]; moves [label, label]. Borders of
    lines count as nothing."""

    def __init__(self, shapes: np.ndarray, cues: np.ndarray, moves: np.ndarray) -> None:
        self.shapes, self.cues, self.moves = shapes, cues, moves
        self.by_code = shapes[:, _CODE_FEATURES].sum(axis=2)

    def emissions(self, tokens: Tokens) -> np.ndarray:
        total = self.by_code[1][tokens.code] + self.cues[REACH][tokens.cue]
        cued = np.flatnonzero(tokens.cue)
        for step in range(1, REACH + 1):
            same = tokens.line[step:] == tokens.line[:-step]
            if step == 1:
                total[1:] += self.by_code[0][tokens.code[:-1]] * same[:, None]
                total[:-1] += self.by_code[2][tokens.code[1:]] * same[:, None]
            after, before = cued[cued + step < len(total)], cued[cued >= step]
            after, before = after[same[after]], before[same[before - step]]
            total[after + step] += self.cues[REACH - step][tokens.cue[after]]
            total[before - step] += self.cues[REACH + step][tokens.cue[before]]
        return total

    def labels(self, tokens: Tokens) -> np.ndarray:
        """The best labels of all tokens."""
        n = len(tokens.starts)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        scores = self.emissions(tokens)
        # what a label can gain over `nothing` by moves, whatever stands before and after
        gain = (self.moves - self.moves[:, :1]).max(axis=0) + (self.moves - self.moves[0]).max(axis=1)
        open_ = np.flatnonzero((scores[:, 1:] + gain[1:]).max(axis=1) >= scores[:, 0])
        if not len(open_):
            return out
        first = np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (tokens.line[open_[1:]] != tokens.line[open_[:-1]])])
        begins = np.flatnonzero(first)
        out[open_] = self._viterbi(scores[open_], begins, np.diff(np.append(begins, len(open_))))
        return out

    def _viterbi(self, scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end, each between labels `nothing`. All are
        stepped together, the longest first, so that those still running are a prefix."""
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
        back = np.zeros(scores.shape, np.int8)
        best = self.moves[0] + scores[begins]
        for i in range(1, len(running)):
            k = running[i]
            step = best[:k, :, None] + self.moves
            at = begins[:k] + i
            back[at] = step.argmax(axis=1)
            best[:k] = step.max(axis=1) + scores[at]
        path = np.zeros(len(scores), np.int8)
        path[begins + sizes - 1] = (best + self.moves[:, 0]).argmax(axis=1)
        for i in range(len(running) - 1, 0, -1):
            at = begins[: running[i]] + i
            path[at - 1] = back[at, path[at]]
        return path


def labelled(table: list[list[tuple[str, str | None]]]) -> tuple[Tokens, np.ndarray]:
    """The tokens of a labelled table (see `_invented.lines`) and their labels."""
    texts, edges, kinds = [], [], []
    for parts in table:
        texts.append("".join(x for x, _ in parts).encode())
        edges.append(np.cumsum([len(x.encode()) for x, _ in parts]))
        kinds.append(np.array([FIELD_KINDS.index(k) + 1 if k else 0 for _, k in parts]))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    tokens = Tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    place = tokens.starts - offsets[tokens.rows]
    # a quote or bracket before a span belongs to its token
    inside = (place + tokens.ends - offsets[tokens.rows]) // 2
    return tokens, np.array([kinds[r][np.searchsorted(edges[r], i, "right")] for r, i in zip(tokens.rows.tolist(), inside.tolist(), strict=True)])


@cache
def trained() -> Field:
    return train(lines("train"))


def train(table: list[list[tuple[str, str | None]]], rounds: int = 200, penalty: float = 0.1) -> Field:
    """Fits the field to a labelled table by Adam on the regularised likelihood."""
    tokens, gold = labelled(table)
    k, n = len(FIELD_KINDS) + 1, len(table)
    first = np.searchsorted(tokens.rows, np.arange(n + 1))
    place = np.arange(len(gold)) - first[tokens.rows]
    width = int(np.diff(first).max())
    there = np.zeros((n, width), bool)
    there[tokens.rows, place] = True
    shapes, cues, moves = np.zeros((3, N_FEATURES, k)), np.zeros((2 * REACH + 1, N_CUES, k)), np.zeros((k, k))
    weights = (shapes, cues, moves)
    states = [np.zeros((2, *x.shape)) for x in weights]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    features = _CODE_FEATURES[tokens.code]
    heads = np.flatnonzero(place == 0)
    tails, inner = np.append(heads[1:], len(place)) - 1, np.flatnonzero(place > 0)

    def sums(at: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, part[:, j], size) for j in range(k)], axis=1)

    for t in range(1, rounds + 1):
        scores = np.zeros((n, width, k))
        scores[tokens.rows, place] = Field(*weights).emissions(tokens)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = moves[0] + scores[:, 0]
        for i in range(1, width):
            new = soft(alpha[:, i - 1, :, None] + moves, 1) + scores[:, i]
            alpha[:, i] = np.where(there[:, i, None], new, alpha[:, i - 1])
        beta[:, -1] = moves[:, 0]
        for i in range(width - 2, -1, -1):
            new = soft(moves + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(there[:, i + 1, None], new, moves[:, 0])
        norm = soft(alpha[:, 0] + beta[:, 0], 1)
        node = np.exp(alpha + beta - norm[:, None, None])[tokens.rows, place]
        diff = -node
        diff[np.arange(len(gold)), gold] += 1
        grads = [np.zeros_like(x) for x in weights]
        for step in range(-REACH, REACH + 1):
            # of each token, what the one `step` places after it is given by it
            own = np.arange(max(0, -step), min(len(gold), len(gold) - step))
            own = own[tokens.rows[own] == tokens.rows[own + step]]
            if abs(step) <= 1:
                grads[0][1 - step] = sums(features[own].ravel(), np.repeat(diff[own + step], features.shape[1], axis=0), N_FEATURES)
            some = own[tokens.cue[own] > 0]
            grads[1][REACH - step] = sums(tokens.cue[some], diff[some + step], N_CUES)
        pair = np.exp(alpha[:, :-1, :, None] + moves + (scores + beta)[:, 1:, None, :] - norm[:, None, None, None]) * there[:, 1:, None, None]
        grads[2] -= pair.sum(axis=(0, 1))
        grads[2][0] -= node[heads].sum(axis=0)
        grads[2][:, 0] -= node[tails].sum(axis=0)
        np.add.at(grads[2], (gold[inner - 1], gold[inner]), 1)
        np.add.at(grads[2], (0, gold[heads]), 1)
        np.add.at(grads[2], (gold[tails], 0), 1)
        for x, g, state in zip(weights, grads, states, strict=True):
            g = g - penalty * x
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.99 * state[1] + 0.01 * g * g
            x += 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
    return Field(*weights)


# --- the operator ---------------------------------------------------------------------------

_TRIM = b"\"'()[]<>,.;:!?#$%&*=|"


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, kind's place in KINDS, end) in code points of the field's spans."""
    tokens = Tokens(data, offsets)
    labels = field.labels(tokens)
    hit = np.flatnonzero(labels)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(hit):
        return out
    joined = (hit[1:] == hit[:-1] + 1) & (tokens.line[hit[1:]] == tokens.line[hit[:-1]]) & (labels[hit[1:]] == labels[hit[:-1]])
    begins = np.flatnonzero(np.concatenate([[True], ~joined]))
    ends = np.append(begins[1:], len(hit)) - 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    for b, e in zip(hit[begins].tolist(), hit[ends].tolist(), strict=True):
        row, start, end = int(tokens.rows[b]), int(tokens.starts[b]), int(tokens.ends[e])
        raw = data[start:end].tobytes()
        start, end = start + len(raw) - len(raw.lstrip(_TRIM)), end - len(raw) + len(raw.rstrip(_TRIM))
        if start < end:
            base = int(points[offsets[row]])
            out.setdefault(row, []).append((int(points[start]) - base, len(BASE_KINDS) + int(labels[b]) - 1, int(points[end]) - base))
    return out


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of sorted spans without overlap, those that overlap no span of the sorted `base`. Both
    are passed once."""
    out, place, reach = [], 0, 0
    for span in spans:
        while place < len(base) and base[place][0] < span[2]:
            reach = max(reach, base[place][2])
            place += 1
        if reach <= span[0]:
            out.append(span)
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


_FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the patterns' matches, the digest of kind:start:end of these, all spans
    written likewise, by start, then kind in the order of KINDS, and their number; offsets are
    code points and ends are exclusive.

    A null or empty text has no spans. Texts are read whole, in time linear in their length. Rows
    that repeat a doc_id or a text, or have no doc_id, are rows like others. Spans that start
    together are written in the order of their kinds. An empty table gives an empty result; other
    columns are ignored.
    """
    field = field or trained()
    sent = docs.sparkSession.sparkContext.broadcast((field.shapes, field.cues, field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for rows, data, at in _text.slices(batches, "text"):
            marks = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data == 0x40) | _IS_DIGIT[data], out=marks[1:])
            likely = np.flatnonzero(np.diff(marks[at])).tolist()
            more = field_spans(own, data, at)
            n = rows.num_rows
            base: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            for i in likely:
                base[i] = base_spans(data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
            every = list(base)
            for i, spans in more.items():
                every[i] = sorted([*base[i], *apart(spans, base[i])])
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE_KINDS))]
            digests = [hashlib.sha256(_digest(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([_text.column(rows, "doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_digest(x) for x in every], pa.string()), pa.array([len(x) for x in every], pa.int64())], names=_FOUND.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)
