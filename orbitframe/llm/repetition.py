"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Each text is judged by itself, in one pass over the scan without any exchange.  Words get small
numbers per text, numbers get random 64-bit values, and the hashes of all windows of n words follow
from those of n - 1 words by one multiply-add over the array; equal windows are neighbours once
sorted.  Covered characters are then the code points of words inside a window that occurs twice or
more, and of lines that occur twice or more, the first occurrence included in both.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, map_rows, mix64, table, texts, tune

#: Rules of the base contract.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
#: Share of a text's word characters that may lie inside repeated n-grams of so many words.
LIMITS = {5: 0.32, 6: 0.30, 8: 0.28, 10: 0.26}
#: Share of word characters in lines that occur again.
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
_MULT = np.uint64(0xD1342543DE82EF95)
_COUNT = str.maketrans("", "", SYMBOLS)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which windows have an equal one elsewhere."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of so many words lie in a window of n that begins at a marked place."""
    edge = np.zeros(length + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, lengths: tuple[int, ...] = tuple(LIMITS)) -> dict:
    """Counts and covered characters of one text."""
    words = WORD.findall(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = int(sizes.sum())
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    value = mix64(ids)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(text) - len(text.translate(_COUNT)), "n_repeat_words": 0}
    wanted, hashes = {*lengths, BASE_WINDOW}, value
    for n in range(2, max(wanted) + 1):
        if len(hashes) < 2:
            hashes = hashes[:0]
        else:
            hashes = hashes[:-1] * _MULT + value[n - 1 :]
        if n in wanted:
            marked = repeated(hashes)
            cover = covered(marked, n, len(words)) if marked.any() else np.zeros(len(words), bool)
            if n in lengths:
                out[f"chars_{n}"] = int(sizes[cover].sum())
            if n == BASE_WINDOW:
                out["n_repeat_words"] = int(cover.sum())
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else [text] * bool(words)
    times = Counter(lines)
    out["n_dup_lines"] = len(lines) - len(times)
    out["chars_lines"] = sum(c * sum(map(len, WORD.findall(x))) for x, c in times.items() if c > 1)
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"]
    chars = m["word_chars"]
    good = all(m[f"chars_{n}"] <= share * chars for n, share in LIMITS.items()) and m["chars_lines"] <= LINE_LIMIT * chars
    return failed, good and not failed


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in LIMITS), "chars_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in LONGS) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: counts, covered characters by n-gram length and by lines, base_failed and kept.

    A null or empty text has no words and fails the base.  Repeated rows give repeated rows, a null id
    stays null, other columns are left out.  Windows are compared by 64-bit hashes within one text.
    """

    def run(part: pa.RecordBatch) -> dict:
        found = [measure(t) for t in texts(part.column(1))]
        pairs = [verdict(m) for m in found]
        return {k: [m[k] for m in found] for k in LONGS} | {"base_failed": [p[0] for p in pairs], "kept": [p[1] for p in pairs]}

    out = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_rows(out, ["doc_id", "text"], run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts, joins = [], []
    for n in sorted({*LIMITS, BASE_WINDOW}):
        parts.append(f"""
g{n} AS (SELECT rid, i, size, CASE WHEN i + {n - 1} <= n THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS gram FROM words),
d{n} AS (SELECT rid, i, size, coalesce(gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1, false) AS dup FROM g{n}),
c{n} AS (SELECT rid, size, max(dup::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS cov FROM d{n}),
s{n} AS (SELECT rid, sum(size * cov)::BIGINT AS chars, sum(cov)::BIGINT AS n FROM c{n} GROUP BY rid)""")
        joins.append(f"LEFT JOIN s{n} USING (rid)")
    chars = ", ".join(f"coalesce(s{n}.chars, 0) AS chars_{n}" for n in LIMITS)
    good = " AND ".join(f"chars_{n} <= {share}::DOUBLE * word_chars" for n, share in LIMITS.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM docs),
words AS (SELECT rid, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, length(unnest(ws)) AS size FROM split),
lines AS (
  SELECT rid, line, count(*) AS c, any_value(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS size
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL
),
l AS (SELECT rid, sum(c - 1)::BIGINT AS n_dup_lines, coalesce(sum(c * size) FILTER (c > 1), 0)::BIGINT AS chars_lines FROM lines GROUP BY rid),
{','.join(parts)},
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(s{BASE_WINDOW}.n, 0) AS n_repeat_words, {chars}, coalesce(chars_lines, 0) AS chars_lines
  FROM split LEFT JOIN l USING (rid) {' '.join(joins)}
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words) AND {good} AND chars_lines <= {LINE_LIMIT}::DOUBLE * word_chars AS kept
FROM m
"""


SQL = _sql()
