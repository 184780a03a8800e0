"""Quality rules, lines first: every line is judged, failing lines go, and a document that loses too much text goes too."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed, slices, windows, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a document's word characters that may go with its failing lines.
MAX_LOST_PERCENT = 50
#: A line of at least so many words has to hold the end of a sentence; shorter ones may be headings or items.
SENTENCE_WORDS = 8
SYMBOLS = "#*$%&|<>"
#: Characters that, by themselves, make words no words; see line_fails.
JUNK = "#*$%&{}"
SENTENCE_END = re.compile("[.!?…。！？।؟۔]")
#: Two words of these alone make a line a menu or a row of a table.
SEPARATORS = "|>»•·/"
#: Lower case, in the languages of the tables.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "use cookies",
    "enable javascript",
    "javascript is disabled",
    "javascript is required",
    "lorem ipsum",
    "subscribe to our",
    "sign up for our",
    "click here to",
    "skip to content",
    "skip to main content",
    "powered by",
    "copyright ©",
    "follow us on",
    "share on facebook",
    "share on twitter",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "accepter les cookies",
    "activer javascript",
    "abonnez-vous à notre",
    "cliquez ici pour",
    "aller au contenu",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "javascript aktivieren",
    "abonnieren sie unseren",
    "klicken sie hier",
    "zum inhalt springen",
    "todos los derechos reservados",
    "política de privacidad",
    "condiciones de uso",
    "aviso legal",
    "aceptar las cookies",
    "habilite javascript",
    "suscríbase a nuestro",
    "haga clic aquí",
    "saltar al contenido",
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))


def line_fails(line: str) -> bool:
    """Whether a line with a word is cut: a menu or table row, a line of symbols, boilerplate, or long without a sentence's end."""
    words = line.encode().split()  # bytes split at ASCII white space alone
    n = len(words)
    if sum(not w.decode().strip(SEPARATORS) for w in words) >= 2 or 3 * sum(map(line.count, JUNK)) > n:
        return True
    if n >= SENTENCE_WORDS and not SENTENCE_END.search(line):
        return True
    lower = line.lower()
    return any(x in lower for x in BOILERPLATE)


def lines_of(text: str) -> tuple[int, int, str]:
    """(lines with a word that are equal to an earlier line, characters of words lost with failing lines, the lines left)."""
    lower = text.lower()
    odd = any(x in text for x in JUNK + SEPARATORS) or any(x in lower for x in BOILERPLATE)
    seen, dups, lost, kept = set(), 0, 0, []
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        if odd or len(line) < 2 * SENTENCE_WORDS or not SENTENCE_END.search(line):  # others can't fail
            if not (chars := word_chars(line)):
                kept.append(line)
                continue
            seen.add(line)
            if line_fails(line):
                lost += chars
                continue
        seen.add(line)
        kept.append(line)
    return dups, lost, "\n".join(kept)


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its words, and those covered by three-word windows that it has twice or more."""
    words = words_of(texts)
    counts = np.diff(words.first)
    hashes, text = windows(words, 3)
    inside = text == np.repeat(np.arange(len(texts)), counts)[2:]
    keys = mixed(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys[inside])
    place, run = np.flatnonzero(inside)[order], keys[inside][order]
    same = run[1:] == run[:-1]
    twice = place[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(run) else place
    covered = np.zeros(len(words.hashes), np.int64)
    for k in range(3):
        covered[twice + k] = 1
    sums = np.concatenate([[0], np.cumsum(covered)])
    return counts, sums[words.first[1:]] - sums[words.first[:-1]]


def reports(texts: list[str | None]) -> tuple[list[list[int]], list[str]]:
    """(COUNTS, each over the texts, and their cleaned texts)."""
    own = [t or "" for t in texts]
    n_words, repeats = repeated_words([t.encode() for t in own])
    dups, lost, cleaned = zip(*map(lines_of, own), strict=True) if own else ((), (), ())
    return [n_words.tolist(), list(map(word_chars, own)), [sum(map(t.count, SYMBOLS)) for t in own], list(dups), repeats.tolist(), list(lost)], list(cleaned)


def judge(docs: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, keep: list[str] | None = None, cleaned: bool = True) -> DataFrame:
    """The columns keep (by default all but the text) as struct doc, with the fields of a report, base_failed and kept, and (cleaned) the text that is left; one row per input row.

    A null text counts as empty: it has no words, so base_failed. Blank lines are neither judged nor counted. Repeated
    rows are judged alike; columns stay inside doc, whatever their names.
    """
    keep = keep or [c for c in docs.columns if c != text_col] or [text_col]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs[text_col].alias("text"))
    names = ["doc", *COUNTS, *["cleaned"] * cleaned]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts, left = reports(batch.column(1).to_pylist())
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *[pa.array(left, pa.string())] * cleaned]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(judged, f"doc {rows.schema['doc'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}{', cleaned string' * cleaned}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **kwargs) -> DataFrame:
    """The kept rows of docs with their failing lines cut; chars_col, where docs has it, counts the new text."""
    new = {text_col: F.col("cleaned")} | ({chars_col: F.length("cleaned")} if chars_col in docs.columns else {})
    kept = judge(docs, text_col, **kwargs).where("kept")
    return kept.select(*[(new[c] if c in new else F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=["doc_id"], cleaned=False).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


# The chained CASE and the patterns say what line_fails says.
ORACLE_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), j AS (
  SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l
), f AS (
  SELECT doc_id, again, length(array_to_string(lw, '')) AS chars,
    len(list_filter(lw, lambda x: regexp_full_match(x, '[|>»•·/]+'))) >= 2 OR 3 * (length(line) - length(translate(line, '#*$%&{}', ''))) > len(lw)
    OR (len(lw) >= 8 AND NOT regexp_matches(line, '[.!?…。！？।؟۔]')) OR regexp_matches(lower(line), '"""
    + "|".join(BOILERPLATE).replace("'", "''")
    + r"""') AS fails
  FROM j WHERE len(lw) > 0
), s AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars FROM f GROUP BY doc_id
), t AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS g FROM d WHERE len(w) > 2
), m AS (
  SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM m, range(3) r(k) GROUP BY doc_id
), a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM b
"""
)
QUERIES = {"op2_quality_rules": (op2_quality_rules, ORACLE_SQL)}
