"""Quality rules on lines that many documents of a host share, with DataFrame functions only.

Normalised lines are hashed; for each host the distinct texts with a line are counted. A line in more than ``max_share``
of its host's texts (and in at least ``min_docs``) is page furniture: it is removed everywhere but in the document with
the smallest id that has it, and a document left with less than ``min_left`` of its characters is rejected. Equal texts
count once, so a group of exact copies doesn't make its own lines frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, read, written

#: Hosts, frequent lines, and frequent lines of one host up to these numbers are broadcast as one list a host (a few MB);
#: beyond, each text meets only the frequent lines that it has, in shuffled joins.
BROADCAST_HOSTS = 50_000
BROADCAST_LINES = 200_000
HOST_LINES = 256

MAX_SHARE = 0.1
MIN_DOCS = 20
MIN_LEFT = 0.5

_WORD_CHAR = r"[^ \\t-\\r]"
_SPACES = r"[ \\t-\\r]+"
_TRIM_SQL = "' \\t\\n\\u000B\\u000C\\r'"


def _lines(text: str) -> str:
    """Lines with a word."""
    return f"filter(split({text}, '\\n', -1), l -> l rlike '{_WORD_CHAR}')"


def _line_hash(line: str) -> str:
    return f"xxhash64(regexp_replace(lower(trim(BOTH {_TRIM_SQL} FROM {line})), '{_SPACES}', ' '))"


def _hashed(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Each row's host, id, text's hash, and the hashes of its distinct lines with a null for the document itself."""
    lines = f"transform({_lines(f'coalesce(`{text_col}`, "")')}, l -> {_line_hash('l')})"
    return df.select(
        F.coalesce(F.col(host_col), F.lit("")).alias("_host"),
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
        F.expr(f"array_append(array_distinct({lines}), cast(null as bigint))").alias("_hs"),
    )


def frequent_lines(hashed: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per host and frequent line: its hash, the first document's id and the number of texts with it."""
    # the null line stands for the document itself: its count is the host's number of texts
    counts = (
        hashed.select("_host", "_id", "_text", F.explode("_hs").alias("_h"))
        .groupBy("_host", "_h", "_text")
        .agg(F.min("_id").alias("_first"))
        .groupBy("_host", "_h")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
        .where(F.col("_h").isNull() | (F.col("_n") >= min_docs))
    )
    counts = written(counts, "line-counts")
    hosts = counts.where("_h IS NULL").select("_host", F.col("_n").alias("_texts"))
    lines = lookup(counts.where("_h IS NOT NULL"), hosts, "_host", "_texts", F.col("_h"), keep_weight=True)
    lines = lines.where(F.col("_n") > F.col("_texts") * F.lit(max_share))
    return written(lines.select("_host", "_h", "_first", "_n"), "frequent-lines")


def _lines_of_texts(hashed: DataFrame, lines: DataFrame) -> DataFrame:
    """For each host and text with a frequent line: ``freq``, those it has, and the number of rows with that text.

    Keyed on hashes: where two texts share one, each gets the other's frequent lines too, which it doesn't have.
    """
    key = F.concat_ws(":", F.col("_h").cast("string"), "_host").alias("_key")
    pairs = hashed.select("_host", "_text", F.explode("_hs").alias("_h")).where("_h IS NOT NULL")
    pairs = pairs.groupBy("_host", "_text", "_h").agg(F.count(F.lit(1)).alias("_rows")).select("*", key)
    known = lines.select(key, "_first", "_n", F.lit(True).alias("_hit"))
    found = lookup(pairs, known, "_key", "_n", F.col("_text")).where("_hit")
    texts = found.groupBy("_host", "_text").agg(
        F.collect_list(F.struct(F.col("_h").alias("h"), F.col("_first").alias("first"))).alias("freq"),
        F.max("_rows").alias("_rows"),
    )
    text_key = F.concat_ws(":", F.col("_text").cast("string"), "_host").alias("_key")
    return written(texts.select(text_key, "freq", "_rows"), "lines-of-texts")


def line_frequency_verdict(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Add ``_kept_text`` (the text without removed lines) and ``_depleted`` to all rows of ``df``.

    A null text counts as empty, a null host as the host with the empty name, a null id as no first document. Empty
    texts have nothing to lose and aren't depleted. Rows that share the smallest id all keep the line.
    """
    hashed = _hashed(df, id_col, text_col, host_col)
    lines = frequent_lines(hashed, max_share, min_docs)
    per_host = lines.groupBy("_host").agg(F.count(F.lit(1)).alias("n"))
    hosts, total, longest = per_host.agg(F.count(F.lit(1)), *[F.coalesce(f("n"), F.lit(0)) for f in (F.sum, F.max)]).first()
    text = f"coalesce(`{text_col}`, '')"
    host = F.coalesce(F.col(host_col), F.lit(""))
    if hosts <= BROADCAST_HOSTS and total <= BROADCAST_LINES and longest <= HOST_LINES:
        freq = lines.groupBy("_host").agg(F.collect_list(F.struct(F.col("_h").alias("h"), F.col("_first").alias("first"))).alias("freq"))
        rows = df.withColumn("_host", host).join(F.broadcast(freq), "_host", "left").drop("_host")
    else:
        keyed = df.withColumn("_key", F.concat_ws(":", F.xxhash64(F.expr(text)).cast("string"), host))
        rows = lookup(keyed, _lines_of_texts(hashed, lines), "_key", "_rows", F.xxhash64(F.col(id_col), F.col(text_col))).drop("_key")
    # the one-element array binds the hash, so it is computed once a line
    removed = f"transform(array({_line_hash('l')}), h -> exists(freq, f -> f.h = h AND NOT (f.first <=> `{id_col}`)))[0]"
    kept = f"array_join(filter(split({text}, '\\n', -1), l -> NOT (l rlike '{_WORD_CHAR}' AND {removed})), '\\n')"
    rows = rows.withColumn("_kept_text", F.expr(f"CASE WHEN freq IS NULL THEN {text} ELSE {kept} END"))
    return rows.withColumn("_depleted", F.length("_kept_text") < F.lit(min_left) * F.length(F.expr(text))).drop("freq")


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text counts as empty.

    Repeated 3-word windows are found by 64-bit hashes: only texts with a repeated window sort their windows.
    """
    text = f"coalesce(`{text_col}`, '')"
    spaces = " + ".join(f"(octet_length(_t) - octet_length(replace(_t, '{c}', '')))" for c in (" ", "\\t", "\\n", "\\u000B", "\\u000C", "\\r"))
    a = df.withColumn("_t", F.expr(text)).withColumn("_trimmed", F.expr(f"trim(BOTH {_TRIM_SQL} FROM _t)"))
    b = a.withColumn("_ws", F.expr(f"CASE WHEN _trimmed = '' THEN array() ELSE split(_trimmed, '{_SPACES}') END"))
    c = b.withColumn("n_words", F.size("_ws").cast("long")).withColumn("_hw", F.expr("transform(_ws, w -> xxhash64(w))"))
    d = c.withColumn(
        "_win",
        F.expr(
            "CASE WHEN size(_hw) < 3 THEN array() ELSE"
            " transform(sequence(0, size(_hw) - 3), i -> xxhash64(_hw[i], _hw[i + 1], _hw[i + 2])) END"
        ),
    )
    e = d.withColumn(
        "_sorted",
        F.expr("CASE WHEN size(array_distinct(_win)) < size(_win) THEN sort_array(transform(_win, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    f = e.withColumn(
        "_twice",
        F.expr(
            "filter(_sorted, (s, j) -> (j > 0 AND _sorted[greatest(j - 1, 0)].h = s.h)"
            " OR (j < size(_sorted) - 1 AND _sorted[least(j + 1, size(_sorted) - 1)].h = s.h))"
        ),
    )
    lines = f.withColumn("_lines", F.expr(_lines("_t")))
    out = (
        lines.withColumn("word_chars", F.expr(f"cast(length(_t) - ({spaces}) as bigint)"))
        .withColumn("n_symbols", F.expr("cast(regexp_count(_t, '[#*$%&|<>]') as bigint)"))
        .withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"))
        .withColumn(
            "n_repeat_words",
            F.expr(
                "CASE WHEN _twice IS NULL THEN 0L ELSE"
                " cast(size(array_distinct(flatten(transform(_twice, s -> array(s.i, s.i + 1, s.i + 2))))) as bigint) END"
            ),
        )
    )
    out = out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return out.drop("_t", "_trimmed", "_ws", "_hw", "_win", "_sorted", "_twice", "_lines")


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float
) -> DataFrame:
    """One row per row of ``df``: the row itself as the struct ``_row``, its base features, ``base_failed``, ``kept``
    and ``_kept_text``; names in ``df`` can't clash. ``limits``: max_share, min_docs, min_left."""
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.col(host_col).alias("_from"),
    )
    judged = base_features(line_frequency_verdict(rows, "_id", "_text", "_from", **limits), "_text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_kept_text"]
    kept = (~F.col("base_failed") & ~F.col("_depleted")).alias("kept")
    # a generator: filters on its output aren't pushed below, where each would be unfolded into all it is made of
    return judged.select("_row", F.inline(F.array(F.struct(*names, kept))))


def clean_documents(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", **names) -> DataFrame:
    """Rows of ``df`` that the rules keep, without removed lines; ``size_col``, if there, counts the text's characters."""
    out = quality_rules(df, text_col=text_col, **names).where("kept").select("_row.*", "_kept_text")
    changed = F.col("_kept_text") != F.coalesce(F.col(text_col), F.lit(""))
    new = {text_col: F.when(changed, F.col("_kept_text")).otherwise(F.col(text_col))}
    if size_col in df.columns:
        kind = df.schema[size_col].dataType
        new[size_col] = F.when(changed, F.length("_kept_text").cast(kind)).otherwise(F.col(size_col))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def op5_line_frequency(spark, sf_dir: str) -> DataFrame:
    """Quality rules on all documents, hosts being their sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
f AS (
  SELECT *, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM w
),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM f, unnest(range(1, n_words - 1)) r(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM rep, unnest(range(3)) r(k) GROUP BY rid),
ln AS (
  SELECT rid, doc_id, host, md5(t) AS tx, length(l) AS n, regexp_matches(l, '[^\x20\x09-\x0D]') AS worded,
    regexp_replace(lower(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g') AS l
  FROM (SELECT rid, doc_id, host, t, unnest(ls) AS l FROM f)
),
hosts AS (SELECT host, count(DISTINCT md5(t)) AS texts FROM d GROUP BY 1),
fr AS (
  SELECT host, l, min(doc_id) AS first FROM ln JOIN hosts USING (host) WHERE worded
  GROUP BY host, l, texts HAVING count(DISTINCT tx) >= 20 AND count(DISTINCT tx) > texts * 0.1
),
lost AS (
  SELECT rid, sum(n)::BIGINT AS n, count(*)::BIGINT AS k, count(*) FILTER (NOT gone) AS stay,
    coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS left_chars
  FROM (SELECT ln.rid, ln.n, (fr.l IS NOT NULL AND fr.first IS DISTINCT FROM ln.doc_id) AS gone
        FROM ln LEFT JOIN fr ON ln.worded AND ln.host = fr.host AND ln.l = fr.l) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words)
    AND NOT (left_chars + greatest(stay - 1, 0) < 0.5 * length(t)) AS kept
FROM f LEFT JOIN cov USING (rid) JOIN lost USING (rid)
"""
