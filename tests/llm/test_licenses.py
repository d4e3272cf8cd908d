"""Op 1 on whole license texts."""

from granary.llm import license_scan

MIT = """The MIT License (MIT)

Copyright (c) 2019 Jane Doe <jane@example.org>

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_NOTICE = """Copyright 2021 Example Corp and contributors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
PROSE = "the river ran past the old mill and the miller counted his sacks of grain in the evening "


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, path string, text string")
    return [(r["file_license"], r["license"], r["license_from"]) for r in license_scan.licenses(docs).orderBy("doc_id").collect()]


def test_whole_texts_license_their_directories(spark):
    rows = [
        ("LICENSE", MIT), ("top.c", PROSE), ("lib/x/y/z.c", PROSE),
        ("vendor/a/NOTICE", APACHE_NOTICE), ("vendor/a/b/c/d.c", PROSE), ("vendor/e.c", PROSE),
    ]
    assert scanned(spark, rows) == [
        ("MIT", "MIT", "file"), (None, "MIT", ""), (None, "MIT", ""),
        ("Apache-2.0", "Apache-2.0", "file"), (None, "Apache-2.0", "vendor/a"), (None, "MIT", ""),
    ]


def test_every_full_text_is_found_at_its_depth(spark):
    names = [name for name, _ in license_scan.full_texts()]
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0"} <= {*names}
    rows, expected = [], []
    for i, (name, text) in enumerate(license_scan.full_texts()):
        folder = "/".join(["p", str(i), *"abcd"[: i % 5]])
        # of one owner, on one line, and with words of the project's own before it
        changed = "Copyright (c) 2020 Ada and Bob. " + " ".join(text.split())
        rows += [(f"{folder}/COPYING", changed), (f"{folder}/src/deep/er/file.c", PROSE), (f"p/{i}x/file.c", PROSE)]
        expected += [(name, name, "file"), (None, name, folder), (None, None, None)]
    assert scanned(spark, rows) == expected


def header(spark, texts):
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return [(r["header_license"], r["n_headers"]) for r in license_scan.scan(docs).orderBy("doc_id").limit(len(NOTICES)).collect()]


NOTICES = [
    ("Copyright (c) 2019 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
    ("Copyright 2024 Example Corp. Released under the MIT License.", "MIT", 1),
    (PROSE * 9 + "This work is licensed under the GNU General Public License, version 3. " + PROSE * 9, "GPL-3.0", 1),
    (PROSE * 50 + "Licensed under CC BY-NC 4.0. " + PROSE, "CC-BY-NC-4.0", 1),
    # across lines; the words of PROSE weigh little, so the second line alone is close enough
    (PROSE + "\n" + PROSE + "Released under\nthe MIT License. " + PROSE, "MIT", 1),
    ("Released under the MIT License. " + PROSE + "\n" + PROSE + " Released under the MIT License.", "MIT", 2),
    ("Released under the MIT License.\n" * 3, "MIT", 3),
    (PROSE * 20 + "a license to sell grain, and the general public came to the mill " + PROSE * 20, None, 0),
    ("license license " + PROSE, None, 0),
]


def test_notices_among_other_words_are_headers(spark):
    # frequencies as in a table of which few documents name a license
    others = [f"{PROSE}under the {i}th version of the license at work" if i % 20 == 0 else PROSE for i in range(400)]
    assert header(spark, [t for t, _, _ in NOTICES] + others) == [(name, n) for _, name, n in NOTICES]


def test_windows_miss_nothing():
    import numpy as np

    pick = np.random.default_rng(13)
    keys = np.sort(license_scan.Vocabulary(license_scan.TEMPLATES).hashes())
    weights = license_scan.Weights(1000, keys, pick.integers(0, 900, len(keys)), 3)
    scorer = license_scan.Scorer(license_scan.TEMPLATES, weights)
    size = len(scorer.vocabulary.words)
    number = {w: i for i, w in enumerate(scorer.vocabulary.words)}
    words = []
    for _ in range(40):
        words += pick.integers(-30, size, pick.integers(0, 6)).clip(-1).tolist()
        words += [number[w] if pick.random() < 0.8 else -1 for w in license_scan.template_words(license_scan.TEMPLATES[pick.integers(0, len(license_scan.TEMPLATES))][1])]
    words = np.array(words)
    row = np.arange(len(words)) // 97
    hashes = np.where(words >= 0, scorer.vocabulary.hashes()[words], np.arange(len(words)).astype(np.uint64) % np.uint64(50))
    bag = license_scan.Bag(words, hashes, weights.of(hashes))
    found = set(zip(*(x.tolist() for x in license_scan.windows(scorer, row, bag)), strict=True))
    close = 0
    for t, length in enumerate(scorer.lengths):
        for reach in (length, length + length // 2):
            for i in range(len(words)):
                last = min(i + reach, int(np.searchsorted(row, row[i], "right")))
                own = words[i:last]
                counts, others = bag.take(slice(i, last)).grouped(np.zeros(last - i, np.int64), 1, size)
                own_weights = counts[0] * scorer.idf
                cosine = own_weights @ scorer.templates[t] / np.sqrt(own_weights @ own_weights + others[0] + 1e-300)
                if words[i] >= 0 and scorer.templates[t, words[i]] and scorer.vocabulary.telling[own[own >= 0]].sum() >= 2 and cosine >= license_scan.HEADER_COSINE:
                    close += 1
                    assert (i, last) in found
    assert close > 100


def test_the_query_inherits_from_directories_above(spark, tmp_path):
    from granary.llm import queries

    rows = [(10_000, MIT), (10_100, PROSE), (10_101, PROSE), (10_200, APACHE_NOTICE), (10_201, PROSE), (20_001, PROSE), (None, PROSE)]
    spark.createDataFrame([(i, t, "web") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["path"], r["license"], r["license_from"]) for r in queries.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got[10_000] == ("web/10000.txt", "MIT", "file")
    assert got[10_200] == ("web/1/10200.txt", "Apache-2.0", "file")
    assert got[10_100] == ("web/1/10100.txt", "Apache-2.0", "web/1")
    assert got[10_101] == ("web/1/101/10101.txt", "Apache-2.0", "web/1")
    assert got[10_201] == ("web/1/102/10201.txt", "Apache-2.0", "web/1")
    assert got[20_001] == ("web/2/200/20001.txt", "MIT", "web")
    assert len(got) == len(rows)
