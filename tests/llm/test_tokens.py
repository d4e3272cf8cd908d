"""Ops 3 and 8: exact equality with the libraries, round trips, files."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import _text, sentence_pieces, token_output
from tests.llm.helpers import N_ODD, ODD, documents, odd_documents

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def odd_strings(n, alphabet, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 60))) for _ in range(n)]


def flat(texts):
    return _text.utf8(pa.array(texts, pa.string()))


def test_word_encoder_equals_library():
    encoder = token_output.WordEncoder(WORDS)
    texts = [t or "" for t in ODD] + odd_strings(1500, "aAbé ÉßÀ×÷1 29.,!?'s|<>\n\t中\x1f́½İ-")
    texts += ["<|endoftext|>x <|startoftext|>", "don't I'LL it's", "á ö", " x y\u0085z", "ΑΣ ΑΣΑ"]
    ids, counts = encoder.encode(*flat(texts))
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_word_encoder_with_a_small_store():
    encoder = token_output.WordEncoder(WORDS, most_words=5)
    for text in ("one two three", "four five six seven eight", "one nine"):
        ids, _ = encoder.encode(*flat([text]))
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_elias_fano():
    pick = np.random.default_rng(2)
    for values in ([], [0], [0, 0, 0], [5], [0, 1, 2, 3], np.sort(pick.integers(0, 10**7, 3000)), np.repeat([7, 9_000_000], 700)):
        made = token_output.EliasFano.of(np.array(values, np.int64))
        assert made.selected(0, len(values)).tolist() == list(values)
        for first in range(0, len(values), 500):
            assert made.selected(first, min(len(values), first + 37)).tolist() == list(values[first : first + 37])
        assert all(made.select(i) == values[i] for i in range(0, len(values), 13))
        with pytest.raises(IndexError):
            made.select(len(values))
    n, last = 3000, 10**7
    assert token_output.EliasFano.of(np.linspace(0, last, n).astype(int)).bits() <= n * (2 + np.ceil(np.log2(last / n))) + 64


def test_segment():
    ids = np.arange(10, dtype="<u2")
    one = token_output.Segment(token_output.pack_segment(np.array([3, 4, 9]), np.array([4, 0, 6]), ids))
    assert one.doc_ids(0, 3).tolist() == [3, 4, 9] and one.doc_ids(1, 2).tolist() == [4]
    least = token_output.NULL_ID
    odd = token_output.Segment(token_output.pack_segment(np.array([least, least, -5, 0, 2**63 - 1]), np.array([1, 2, 3, 4, 0]), ids))
    assert [odd.doc_ids(i, j).tolist() for i, j in ((0, 5), (1, 4), (0, 1), (3, 5))] == [[least, least, -5, 0, 2**63 - 1], [least, -5, 0], [least], [0, 2**63 - 1]]
    assert odd.document(2).tolist() == [3, 4, 5]
    none = token_output.Segment(token_output.pack_segment(np.array([least]), np.array([10]), ids))
    assert none.doc_ids(0, 1).tolist() == [least]
    assert [one.document(i).tolist() for i in range(3)] == [[0, 1, 2, 3], [], [4, 5, 6, 7, 8, 9]]
    with pytest.raises(ValueError):
        token_output.Segment(b"other")


def test_written_files(spark):
    docs = documents(spark, [t for t in ODD if t is None or len(t) < 60_000] * 3).repartition(5)
    where, manifest = token_output.write(docs, WORDS, end_id=2, segment_ids=30)
    got = token_output.read(where, manifest).orderBy("doc_id").collect()
    library, start = token_output.WordEncoder(WORDS).library, 0
    for row, want in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(want["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (want["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert manifest.count() > 5


def test_rows_of_one_doc_id_are_dealt_over_parts(spark, monkeypatch):
    """A third of the rows has no doc_id and a fourth has one; all stay, in order."""
    monkeypatch.setattr(token_output, "PART_BYTES", 400)
    rows = [(None, f"nobody {i}") for i in range(200)] + [(7, f"seven {i}") for i in range(150)] + [(i, f"own {i}") for i in range(-100, 150)] + [(2**63 - 1, "last"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    where, manifest = token_output.write(docs, WORDS, end_id=2)
    got = token_output.read(where, manifest).orderBy("start").collect()
    library = token_output.WordEncoder(WORDS).library
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    want = [(i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order) and [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    most = manifest.agg({"n_docs": "max"}).first()[0]
    assert most < 100  # so 200 rows without a doc_id lie in more than two segments, of a part each


def test_output_of_odd_and_empty_tables(spark):
    assert token_output.read(*token_output.write(odd_documents(spark), WORDS, 2)).count() == N_ODD
    assert token_output.read(*token_output.write(documents(spark, ["x"]).limit(0), WORDS, 2)).count() == 0
    assert sentence_pieces.digests(odd_documents(spark), PIECES).count() == N_ODD
    assert sentence_pieces.encode(documents(spark, ["x"]).limit(0), PIECES).count() == 0


def test_pieces_equal_library_and_spans_cover():
    codec = sentence_pieces.Codec(PIECES, add_bos=True)
    texts = [t or "" for t in ODD] + odd_strings(1500, "ab  é▁\n中1,\t😀") + ["▁", " ▁a▁ b", "a  b   c"]
    ids, ends, counts = codec.encode(*flat(texts))
    parts, spans = (np.split(x, np.cumsum(counts)[:-1]) for x in (ids, ends))
    decoded, decimals = codec.decode(ids, counts), codec.decimals(ids, counts)
    for text, own, span, back, shown in zip(texts, parts, spans, decoded, decimals, strict=True):
        want = [1, *codec.library.encode(text), 2]
        assert own.tolist() == want
        assert back.decode() == codec.library.decode(want)
        assert shown.decode() == " ".join(map(str, want))
        assert span[-1] == len(text.encode()) and (np.diff(span) >= 0).all() and span[0] == 0
        pieces = [codec.library.id_to_piece(i) for i in want[1:-1]]
        size = lambda p: 1 if p.startswith("<0x") else len(p.replace("▁", " ").encode())
        if text and "▁" not in text:  # all spaces are one byte, and the first mark has none
            assert span[1:-1].tolist() == (np.cumsum([size(p) for p in pieces]) - 1).tolist()


def slowly_normalised(codec, data):
    """(bytes, alignment) of one text by the library's rules, character by character."""
    mark = "▁".encode() if codec.escape else b" "
    steps, at = [], 0
    while at < len(data):
        new, size = codec.map.longest(data, at) or (None, len(data[at:].decode()[0].encode()))
        steps.append((data[at : at + size], range(at, at + size)) if new is None else (new, [at] * len(new)))
        at += size
    flat = [(c, i) for new, places in steps for c, i in zip(new, places, strict=True)]
    end = len(data)
    if codec.tidy:
        flat = [x for n, x in enumerate(flat) if x[0] != 32 or n and flat[n - 1][0] != 32]
        if flat and flat[-1][0] == 32:
            end = flat.pop()[1]
    if codec.dummy and (flat or data and not codec.tidy):
        flat = [*flat, (32, end)] if codec.suffix else [(32, flat[0][1] if codec.tidy else 0), *flat]
    out = [(byte, i) for c, i in flat for byte in (mark if c == 32 else [c])]
    return bytes(c for c, _ in out), [i for _, i in out], end


@pytest.mark.parametrize("tidy,suffix,mapped,dummy", [(False, False, False, True), (True, False, True, True), (False, True, True, True), (True, True, True, False), (False, False, True, False)])
def test_buffers_are_normalised_as_texts_are(tidy, suffix, mapped, dummy):
    codec = sentence_pieces.Codec(PIECES)
    codec.tidy, codec.suffix, codec.dummy = tidy, suffix, dummy
    if mapped:
        codec.map = some_map()
    texts = [t or "" for t in ODD if not t or len(t) < 60_000] + odd_strings(800, "abcﬁＡ　­  é▁\n中😀")
    data, offsets = flat(texts)
    made, bounds, align, ends = codec.normalised(data, offsets)
    for i, text in enumerate(texts):
        want, places, end = slowly_normalised(codec, text.encode())
        assert made[bounds[i] : bounds[i + 1]].tobytes() == want
        assert align[bounds[i] : bounds[i + 1]].tolist() == places and ends[i] == end


def test_bytes_that_are_no_text():
    codec = sentence_pieces.Codec(PIECES)
    data = np.frombuffer("é a".encode() + b"\xff\xc3b" + "中".encode(), np.uint8)
    made, bounds, align, ends = codec.normalised(data, np.array([0, 4, len(data)]))
    assert made.tobytes().decode() == "▁é▁a▁��b中" and bounds.tolist() == [0, 9, 22] and ends.tolist() == [4, 6]
    assert align[9:].tolist() == [0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 3, 3, 3]


@pytest.mark.parametrize("module", ["pieces", "words"])
def test_colliding_hashes_change_no_id(monkeypatch, module):
    real = _text.span_hashes
    pick = random.Random(3)
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [x[:n] for n in (1024, 2048, 4096) for x in (thue, other)]
    texts += [" ".join(pick.choice(["one", "two", "three", "fourteen", "internationally", "x" * 40, "Zoë", "中文", "don't"]) for _ in range(30)) for _ in range(40)]
    for bits in (64, 3, 0):
        monkeypatch.setattr(_text, "span_hashes", lambda *a, bits=bits: real(*a) & np.uint64((1 << bits) - 1))
        for most in (1_500_000, 3):
            codec = sentence_pieces.Codec(PIECES, add_eos=False, most_chunks=most) if module == "pieces" else token_output.WordEncoder(WORDS, most)
            want = codec.library.encode(texts) if module == "pieces" else [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
            one = codec.encode(*flat(texts))
            assert [x.tolist() for x in np.split(one[0], np.cumsum(one[-1])[:-1])] == want
            for text, ids in zip(texts, want, strict=True):  # one batch after the other
                assert codec.encode(*flat([text]))[0].tolist() == ids


def trie(words):
    """A double array (see CharacterMap) of byte strings with values, built slowly."""
    units, used = [0] * 4096, {0}

    def place(node, items, depth):
        kinds = sorted({w[depth] if len(w) > depth else 0 for w, _ in items})
        base = next(b for b in range(1, 2048) if all((b ^ k) not in used for k in kinds))
        for k in kinds:
            used.add(base ^ k)
        units[node] |= (base ^ node) << 10
        for k in kinds:
            below = [(w, v) for w, v in items if (w[depth] if len(w) > depth else 0) == k]
            if k == 0:
                units[node] |= 1 << 8
                units[base] = below[0][1] | 1 << 31
            else:
                units[base ^ k] |= k
                place(base ^ k, below, depth + 1)

    place(0, words, 0)
    return np.array(units, "<u4").tobytes()


def some_map():
    new = [("ﬁ", "fi"), ("Ａ", "A"), ("ab", "X"), ("abc", "Y"), ("　", " "), ("­", "")]
    texts = b"".join(v.encode() + b"\0" for _, v in new)
    at = np.cumsum([0] + [len(v.encode()) + 1 for _, v in new])
    raw = trie([(k.encode(), int(a)) for (k, _), a in zip(new, at, strict=False)])
    return sentence_pieces.CharacterMap(len(raw).to_bytes(4, "little") + raw + texts)


def test_character_map_takes_the_longest_prefix():
    found = some_map()
    assert [found.longest(k.encode(), 0) for k in ("ﬁx", "abd", "abcd", "a", "z", "­")] == [(b"fi", 3), (b"X", 2), (b"Y", 3), None, None, (b"", 2)]
    codec = sentence_pieces.Codec(PIECES)
    codec.map, codec.tidy, codec.simple = found, True, False
    text, _, align, ends = codec.normalised(*flat(["  ﬁ　　abc "]))
    assert text.tobytes().decode() == "▁fi▁Y"
    assert align.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 11] and ends.tolist() == [14]
    ids, ends, _ = codec.encode(*flat(["ﬁsh abc"]))
    assert ends[-1] == len("ﬁsh abc".encode()) and ids.tolist()[:-1] == codec.library.encode("fish Y")


def test_digests(spark):
    got = sentence_pieces.digests(documents(spark, ["Hello  world", None]), PIECES, with_ids=True).orderBy("doc_id").collect()
    library = sentence_pieces.Codec(PIECES).library
    for row, text in zip(got, ("Hello  world", ""), strict=True):
        ids = [*library.encode(text), 2]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
