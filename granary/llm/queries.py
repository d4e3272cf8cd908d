"""One query for each operator, over its whole table; names, columns and parameters are fixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.quality_rules import CUTOFFS, DELTA, RISK


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import personal_data

    return personal_data.find(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import token_output

    return token_output.read(*token_output.write(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path, so one is made: source, then directories of 10,000 and 100 ids. The
    first document of each 100 lies one directory higher and the first of each 10,000 two, so that
    licenses are inherited through several directories."""
    from granary.llm import license_scan

    docs = _table(spark, sf_dir, "documents")
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    below = lambda n: F.when(F.col("doc_id") % n != 0, folder(n))
    path = F.concat_ws("/", "source", below(10_000), below(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.licenses(docs.select("doc_id", path.alias("path"), "text"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import ngram_jaccard

    return ngram_jaccard.near_duplicates(_table(spark, sf_dir, "documents")).drop("class_key")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import sentence_pieces

    return sentence_pieces.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import language_id

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.train(docs, _tokenizer("piece_bpe_32k.model")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import decontamination

    found = decontamination.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import quality_rules

    judged = quality_rules.assess(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import line_dedup

    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_token_output": op8_token_output,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
              FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM docs WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b, 5 * c = 5 * x.n AND x.n = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 5 * c >= 4 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT doc_id, min(reach.b) AS class_id,
               least(doc_id, coalesce((SELECT min(l.b) FROM links l WHERE l.a = doc_id AND l.same), doc_id)) AS copy_of,
               (SELECT count(*) FROM links l WHERE l.a = doc_id) AS n_links
        FROM docs JOIN reach ON reach.a = doc_id GROUP BY doc_id
    """,
    "op6_decontamination": rf"""
        WITH items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
        docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
                  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
        hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op9_quality_rules": rf"""
        WITH cuts(rule, i, cutoff) AS (VALUES {", ".join(f"('{r}', {i}, {c:f}::double)" for r, cs in CUTOFFS.items() for i, c in enumerate(cs))}),
        docs AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
                  FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2))),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
        counts AS (SELECT doc_id, stratum, t, cast(len(w) AS bigint) AS n_words, length(array_to_string(w, '')) AS word_chars,
                cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS bigint) AS n_symbols, coalesce(repeated.n, 0) AS n_repeat_words,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM docs LEFT JOIN repeated USING (doc_id)),
        m AS (SELECT *, cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
                CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END AS dup_line_share,
                CASE WHEN word_chars > 0 THEN len(regexp_extract_all(t, '\p{{Lu}}')) / word_chars ELSE 0 END AS upper_share,
                CASE WHEN n_words > 0 THEN (length(t) - length(replace(t, '!', ''))) / n_words ELSE 0 END AS exclaim_share FROM counts),
        scores AS (UNPIVOT (SELECT doc_id, stratum, base_failed, {", ".join(f"{r}::double AS {r}" for r in CUTOFFS)} FROM m) ON {", ".join(CUTOFFS)} INTO NAME rule VALUE score),
        good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
        cells AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k
                  FROM scores SEMI JOIN good USING (doc_id) JOIN cuts USING (rule) WHERE NOT base_failed GROUP BY ALL),
        tested AS (SELECT *, k < n * {RISK / len(CUTOFFS)} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                + j * ln({RISK / len(CUTOFFS)}) + (n - j) * ln({1 - RISK / len(CUTOFFS)})))) <= {DELTA} / ({len(CUTOFFS)} * (SELECT count(DISTINCT stratum) FROM cells)) AS valid FROM cells),
        chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(valid) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM tested) WHERE ok GROUP BY ALL),
        rejected AS (SELECT DISTINCT doc_id FROM scores JOIN chosen USING (stratum, rule) WHERE score > cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM m
    """,
    "op10_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
    """,
}
