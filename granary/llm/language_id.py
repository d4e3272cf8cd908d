"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A word, its start
marked, has the probability of all its segmentations together, by the forward algorithm; a text
has the product over its words. No segmentation is chosen, in training or in scoring: training
is expectation maximisation with forward-backward counts, from equal probabilities, over the
word counts of each language.

Words are runs of letters, lower-cased; all else is dropped. Words are never cut and no piece is
too long; those of over LONG_WORD letters are summed in logarithms, as their probabilities may be
too small for a float. A character that no piece has costs a fixed factor. The vocabulary's ids, scores and order are not used, only its pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._store import written

MARK = "▁"
#: Longer words are summed in logarithms. At UNKNOWN a letter, shorter ones do not underflow.
LONG_WORD = 24
#: At most about so many labelled documents are learned from.
SAMPLE_DOCS = 20_000
ROUNDS = 3
FLOOR = 1e-7
UNKNOWN = 1e-9
UNDETERMINED = "und"


def pieces_of(file: str) -> list[str]:
    """The lower-case pieces of letters of a SentencePiece vocabulary, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in found if (p[1:] if p[0] == MARK else p).isalpha())


class Lattice:
    """All segmentations of many words of one length, as ids of pieces by end and length.

    Pieces are a trie whose steps, (state, character) to state, lie in an open hash table; all
    places of all words step through it together."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.none = len(pieces)
        states = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        self.piece = np.full(len(states), self.none, np.int32)
        self.piece[[states[p] for p in pieces]] = np.arange(len(pieces))
        steps = [(states[x[:-1]] << 21 | ord(x[-1]), i) for x, i in states.items() if x]
        keys, to = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free, first = np.unique(slots[left], return_index=True)
            first = first[self.keys[free] < 0]
            placed = left[first]
            self.keys[slots[placed]], self.to[slots[placed]] = keys[placed], to[placed]
            left = np.delete(left, first)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which steps there are, and where they lead."""
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[slots[left]]
            left = left[(held != keys[left]) & (held >= 0)]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        there = np.flatnonzero(self.keys[slots] == keys)
        return there, self.to[slots[there]]

    def ids(self, words: list[str]) -> np.ndarray:
        """[word, end, length - 1]: the piece that ends there, or `none`. Words have one length."""
        n, width = len(words), len(words[0]) + 1
        chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.int64)
        out = np.full((n, width + 1, self.longest), self.none, np.int32)
        word, start = (x.ravel() for x in np.divmod(np.arange(n * width), width))
        state = np.zeros(n * width, np.int64)
        for size in range(1, min(self.longest, width) + 1):
            inside = np.flatnonzero(start + size <= width)
            word, start, state = word[inside], start[inside], state[inside]
            there, state = self._next(state << 21 | chars[word, start + size - 1])
            word, start = word[there], start[there]
            out[word, start + size, size - 1] = self.piece[state]
        return out


def _held(ids: np.ndarray, none: int) -> list[list[int]]:
    """By end, the sizes of pieces that some word has there."""
    return [(np.flatnonzero(x) + 1).tolist() for x in (ids != none).any(axis=0)]


def _with_none(probabilities: np.ndarray) -> np.ndarray:
    return np.concatenate([probabilities, np.zeros((1, probabilities.shape[1]))])


def forward(ids: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """[word, place, language]: the summed probability of all segmentations up to each place.
    One unknown character may always be passed, at the price of UNKNOWN."""
    n, places, _ = ids.shape
    table, held = _with_none(probabilities), _held(ids, len(probabilities))
    alpha = np.zeros((n, places, table.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, places):
        total = UNKNOWN * alpha[:, end - 1]
        for size in held[end]:
            total = total + table[ids[:, end, size - 1]] * alpha[:, end - size]
        alpha[:, end] = total
    return alpha


def log_forward(ids: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """The logarithms of `forward`, for words of any length."""
    n, places, _ = ids.shape
    with np.errstate(divide="ignore"):
        table, held = np.log(_with_none(probabilities)), _held(ids, len(probabilities))
    alpha = np.zeros((n, places, table.shape[1]))
    for end in range(1, places):
        total = np.log(UNKNOWN) + alpha[:, end - 1]
        for size in held[end]:
            total = np.logaddexp(total, table[ids[:, end, size - 1]] + alpha[:, end - size])
        alpha[:, end] = total
    return alpha


def expected(ids: np.ndarray, probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of words with weights [word, language]."""
    n, places, _ = ids.shape
    if places > LONG_WORD + 2:
        return _log_expected(ids, probabilities, weights)
    table, held = _with_none(probabilities), _held(ids, len(probabilities))
    alpha = forward(ids, probabilities)
    beta = np.zeros_like(alpha)
    beta[:, -1] = 1
    for at in range(places - 1, 0, -1):
        beta[:, at - 1] += UNKNOWN * beta[:, at]
        for size in held[at]:
            beta[:, at - size] += table[ids[:, at, size - 1]] * beta[:, at]
    scale = weights / np.maximum(alpha[:, -1], 1e-300)
    out = np.zeros(table.shape)
    for end in range(1, places):
        for size in held[end]:
            own = ids[:, end, size - 1]
            some = np.flatnonzero(own < len(probabilities))
            np.add.at(out, own[some], alpha[some, end - size] * table[own[some]] * beta[some, end] * scale[some])
    return out[:-1]


def _log_expected(ids: np.ndarray, probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """`expected` in logarithms."""
    n, places, _ = ids.shape
    with np.errstate(divide="ignore"):
        table, held = np.log(_with_none(probabilities)), _held(ids, len(probabilities))
    alpha = log_forward(ids, probabilities)
    beta = np.full_like(alpha, -np.inf)
    beta[:, -1] = 0
    out = np.zeros(table.shape)
    for at in range(places - 1, 0, -1):
        beta[:, at - 1] = np.logaddexp(beta[:, at - 1], np.log(UNKNOWN) + beta[:, at])
        for size in held[at]:
            own = ids[:, at, size - 1]
            through = table[own] + beta[:, at]
            beta[:, at - size] = np.logaddexp(beta[:, at - size], through)
            np.add.at(out, own, np.exp(alpha[:, at - size] + through - alpha[:, -1]) * weights)
    return out[:-1]


def _by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        step = 2048 if length <= LONG_WORD else max(1, 2048 * LONG_WORD // length)
        for k in range(0, len(at), step):
            yield at[k : k + step], [words[i] for i in at[k : k + step]]


_RUN = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # numbers that are no decimal digits, as one half, are no letters
    return [own for run in found for own in "".join(c if c.isalpha() else " " for c in run).split()]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Languages, pieces and their probabilities [piece, language]."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray) -> None:
        self.languages, self.pieces, self.probabilities = languages, pieces, probabilities


def _cutoffs(sizes: list[int], sample: int) -> list[int]:
    """The greatest 64-bit hash to keep of each language, so that about `sample` documents are
    kept, as many of each language as of others, or all that it has."""
    out, left = [0] * len(sizes), sample
    for k, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        quota = min(sizes[i], left / (len(sizes) - k))
        left -= quota
        out[i] = 2**63 - 1 if quota == sizes[i] else int((2 * quota / sizes[i] - 1) * (2**63 - 1))
    return out


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of (doc_id, text, lang), dealt evenly over the languages, of which each
    has at least one, chosen by a hash of doc_id and text. So rows without a doc_id are chosen like
    others; only rows that repeat both are chosen together."""
    key = F.xxhash64(F.lit(5), "doc_id", "text")
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(key).alias("least")).collect()
    if sum(r["n"] for r in found) <= sample:
        return labelled
    rows = [(r["lang"], max(r["least"], most)) for r, most in zip(found, _cutoffs([r["n"] for r in found], sample), strict=True)]
    cutoffs = labelled.sparkSession.createDataFrame(rows, "lang string, most long")
    return labelled.join(F.broadcast(cutoffs), "lang").where(key <= F.col("most"))


def train(docs: DataFrame, file: str, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Learns from text and lang of labelled documents that are not held out, `sampled`. Words are counted in Spark; each round's expected
    counts are summed there, and |pieces| * |languages| numbers reach the driver."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    picked = sampled(labelled, sample)
    counted = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(_text.column(batch, "text"), _text.column(batch, "lang").to_pylist(), strict=True):
                for word in letters_of(text.as_py()):
                    counts[lang, word] += 1
                if len(counts) > 300_000:
                    yield flush()
        if counts:
            yield flush()

    words = written(picked.select("text", "lang").mapInArrow(count, counted).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().toLocalIterator())
    pieces = pieces_of(file)
    probabilities = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("lang", T.IntegerType()), T.StructField("n", T.DoubleType())])
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((languages, pieces, probabilities))

        def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            languages, pieces, probabilities = sent.value
            lattice, number = Lattice(pieces), {x: i for i, x in enumerate(languages)}
            out = np.zeros(probabilities.shape)
            for batch in batches:
                own = batch["word"].tolist()
                columns = batch["lang"].map(number).to_numpy()
                n = batch["n"].to_numpy(float)
                for at, words in _by_length(own):
                    weights = np.zeros((len(words), len(languages)))
                    weights[np.arange(len(words)), columns[at]] = n[at]
                    out += expected(lattice.ids(words), probabilities, weights)
            piece, lang = np.nonzero(out)
            yield pd.DataFrame({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": out[piece, lang]})

        sums = words.mapInPandas(collect, schema).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(probabilities.shape)
        counts[sums["piece"], sums["lang"]] = sums["n"]
        probabilities = np.maximum(counts / np.maximum(counts.sum(axis=0), 1e-300), FLOOR)
        probabilities = probabilities / probabilities.sum(axis=0)
    return Model(languages, pieces, probabilities)


class Scorer:
    """Log-probabilities of words under every language, kept for words seen before."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most = model, most
        self.lattice = Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
            self.scores = self.scores[:0]
        new = np.zeros((len(words), len(self.model.languages)))
        for at, some in _by_length(words):
            ids = self.lattice.ids(some)
            if len(some[0]) <= LONG_WORD:
                new[at] = np.log(np.maximum(forward(ids, self.model.probabilities)[:, -1], 1e-300))
            else:
                new[at] = log_forward(ids, self.model.probabilities)[:, -1]
        first = len(self.scores)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, new])

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [letters_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for own in words for w in own if w not in self.known))
        if len(self.known) + len(new) > self.most:
            new = list(dict.fromkeys(w for own in words for w in own))
        if new:
            self._learn(new)
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        some = [i for i, own in enumerate(words) if own] if self.model.languages else []
        if some:
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
            sizes = np.array([len(words[i]) for i in some])
            total = np.add.reduceat(self.scores[at], np.cumsum(sizes) - sizes, axis=0)
            best = total.argmax(axis=1)
            scores[some] = 1 / np.exp(total - total[np.arange(len(some)), best][:, None]).sum(axis=1)
            for i, k in zip(some, best.tolist(), strict=True):
                langs[i] = self.model.languages[k]
        return langs, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the posterior for equal priors, of every row. A
    text that is null or has no letter is `und` with score 0; ties go to the first language in
    order. Texts are scored whole, however long; rows that repeat a doc_id or a text are scored
    each by its text, and a null doc_id is not held out. With no labelled documents at all, every
    text is `und`; an empty table gives an empty result. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probabilities))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for rows, _, _ in _text.slices(batches, "text"):
            langs, scores = scorer.texts(_text.column(rows, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([_text.column(rows, "doc_id"), _text.column(rows, "held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, schema)
