"""Op 5 on long pieces, long words and rare languages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import language_id

P = pytest.importorskip("public_tokenizers")
PIECES = P.path("piece_bpe_32k.model")


def test_no_piece_of_letters_is_left_out():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    assert {*language_id.pieces_of(PIECES)} == {p for p in found if p.removeprefix("▁").isalpha()}
    assert max(map(len, language_id.pieces_of(PIECES))) > 8


def log_total(word, pieces, p, column):
    marked, sums = "▁" + word, [0.0]
    for end in range(1, len(word) + 2):
        terms = [math.log(language_id.UNKNOWN) + sums[end - 1]]
        terms += [math.log(p[i, column]) + sums[end - len(x)] for i, x in enumerate(pieces) if marked[:end].endswith(x)]
        most = max(terms)
        sums.append(most + math.log(sum(math.exp(t - most) for t in terms)))
    return sums[-1]


def test_lattice_holds_every_piece():
    pick = np.random.default_rng(16)
    pieces = sorted({"".join(pick.choice(list("▁abcß中𝄞"), pick.integers(1, 6))) for _ in range(300)})
    lattice = language_id.Lattice(pieces)
    number = {p: i for i, p in enumerate(pieces)}
    for length in (1, 2, 7, 30):
        words = ["".join(pick.choice(list("abcß中𝄞x"), length)) for _ in range(20)]
        ids = lattice.ids(words)
        assert ids.shape == (20, length + 2, lattice.longest)
        for i, word in enumerate(words):
            marked = "▁" + word
            for end in range(length + 2):
                for size in range(1, lattice.longest + 1):
                    part = marked[end - size : end] if end >= size else None
                    assert ids[i, end, size - 1] == number.get(part, lattice.none)
    assert language_id.Lattice([]).ids(["ab"]).tolist() == [[[0]] * 4]


def test_letters():
    texts = ["Don't x2y a_b", "½ab²c Ⅷ", "İSTANBUL ǅ", "中文，字 é\u0301", "", "1 _ ²"]
    for text in texts:
        want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert language_id.letters_of(text) == want


def test_a_text_without_spaces_and_a_word_of_sixty_letters():
    pieces = ["▁", "a", "ab", "b", "中", "中文", "文字"]
    p = np.random.default_rng(17).random((len(pieces), 2))
    texts = ["ab" * 30, "中文字" * 400, "ab " + "b" * 25]
    langs, scores = language_id.Scorer(language_id.Model(["x", "y"], pieces, p)).texts([*texts, None, "12"])
    for i, text in enumerate(texts):
        total = [sum(log_total(w, pieces, p, c) for w in text.split()) for c in range(2)]
        assert langs[i] == "xy"[int(total[1] > total[0])] and abs(scores[i] - 1 / (1 + math.exp(-abs(total[0] - total[1])))) < 1e-6
    assert langs[3:] == ["und", "und"] and scores[3:].tolist() == [0, 0]


def test_odd_and_empty_tables(spark):
    from tests.llm.helpers import N_ODD, documents, odd_documents

    model = language_id.train(odd_documents(spark).withColumn("lang", F.lit("en")), PIECES, rounds=1)
    rows = language_id.identify(odd_documents(spark).unionByName(odd_documents(spark)), model).collect()
    assert len(rows) == 2 * N_ODD
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert {i: got[i] for i in (0, 1, 2, 3, 4, 7, 8, 11, None)} == {i: ("en", 1.0) if i in (4, 8, None) else ("und", 0.0) for i in (0, 1, 2, 3, 4, 7, 8, 11, None)}
    assert language_id.identify(documents(spark, ["x"]).limit(0), model).count() == 0


def test_long_words_are_summed_whole():
    pieces = ["▁", "▁a", "a", "ab", "b", "donaudampfschiff", "fahrt", "ababababababab"]
    p = np.random.default_rng(14).random((len(pieces), 2))
    scorer = language_id.Scorer(language_id.Model(["x", "y"], pieces, p))
    words = ["ab" * 6, "ab" * 12, "ab" * 13, "donaudampfschifffahrt" * 3, "z" * 24, "z" * 300, "abz" * 400]
    scorer._learn(words)
    for word in words:
        got = scorer.scores[scorer.known[word]]
        assert np.allclose(got, [log_total(word, pieces, p, c) for c in range(2)], rtol=1e-9)


def test_counts_of_long_words_are_slopes():
    pieces = ["▁", "▁a", "a", "ab", "b", "babababababab"]
    p = np.random.default_rng(15).random((len(pieces), 2))
    word = "ab" * 40 + "z" * 60
    counts = language_id.expected(language_id.Lattice(pieces).ids([word]), p, np.array([[2.0, 0.0]]))
    for i in range(len(pieces)):
        up = p.copy()
        up[i] *= 1 + 1e-6
        slope = (log_total(word, pieces, up, 0) - log_total(word, pieces, p, 0)) / 1e-6
        assert abs(2 * slope - counts[i, 0]) < 1e-3 and counts[i, 1] == 0


def test_no_language_is_lost_in_the_sample(spark):
    texts = [("the mill by the river", "en")] * 3000 + [("mylly joen varrella", "fi")] * 4 + [("moulin au bord", "fr")] * 400
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    for sample in (60, 1):
        model = language_id.train(docs, PIECES, sample=sample, rounds=1)
        assert model.languages == ["en", "fi", "fr"]
    got = language_id.identify(docs, model).join(docs, "doc_id").where(F.col("lang") != F.col("lang_pred")).count()
    assert got == 0


def test_samples_are_dealt_evenly():
    share = lambda cutoff: (cutoff / (2**63 - 1) + 1) / 2
    sizes = [6_000_000, 10, 40_000, 100]
    kept = [share(c) * n for c, n in zip(language_id._cutoffs(sizes, 20_000), sizes, strict=True)]
    assert np.allclose(kept, [9945, 10, 9945, 100], atol=1e-3)


def test_rows_without_a_doc_id_are_sampled_like_others(spark):
    rows = [(None, f"text {i}", "en") for i in range(4000)] + [(i, "one text", "en") for i in range(4000)] + [(1, "un texte", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language_id.sampled(docs, 401).groupBy("lang", F.col("doc_id").isNull().alias("unnamed")).count().collect()
    counts = {(r["lang"], r["unnamed"]): r["count"] for r in kept}
    assert counts["fr", False] == 1 and all(140 < counts["en", x] < 260 for x in (True, False))
    assert language_id.sampled(docs, 8001).count() == 8001
