"""Registered queries of the library's own operators, and the DuckDB SQL that gives the same rows.

The dictionary is the vocabulary of all documents and part names. Misspelt inputs are made from every distinct word of
the part names by a fixed rule: by the word's length, a letter left out, two letters swapped, or a letter doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import deletes, nfkc, osa, tokens, transfer_case
from .operators.compound import lookup_compound
from .operators.dictionary import Dictionary, bigrams_from_corpus, build_index, from_corpus, merge, stats
from .operators.lookup import lookup, unknown
from .operators.segment import word_segmentation
from .plans.config import Config, Verbosity
from .sources.dictionary_files import dictionary_lines, parse_bigrams, parse_terms, sum_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, parts = _read(spark, sf_dir, "documents").select("text"), _read(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    return from_corpus(docs.union(parts))


def _dictionary(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Dictionary:
    return Dictionary.build(_words(spark, sf_dir), config or Config(1))


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "part").select("p_partkey", F.explode(tokens(F.col("p_name"))).alias("w"))
    return words.groupBy("w").agg(F.min("p_partkey").alias("id"))


TYPO = (
    "CASE length(w) % 3 WHEN 0 THEN concat(substr(w, 1, 2), substr(w, 4))"
    " WHEN 1 THEN concat(substr(w, 1, 1), substr(w, 3, 1), substr(w, 2, 1), substr(w, 4))"
    " ELSE concat(substr(w, 1, 2), substr(w, 2)) END"
)


def _inputs(spark: SparkSession, sf_dir: str, upper: bool = False) -> DataFrame:
    typo = F.expr(f"upper({TYPO})" if upper else TYPO)
    return _part_words(spark, sf_dir).select("id", typo.alias("input"))


_DOC_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_''’]+')"
_WORDS = f"""words AS (
  SELECT term, count(*) AS count FROM (
    SELECT unnest({_DOC_TOKENS}) AS term FROM (SELECT text FROM documents UNION ALL SELECT p_name AS text FROM part)
  ) GROUP BY term
)"""
_INPUTS = f"""inputs AS (
  SELECT id, w, {TYPO} AS input FROM (
    SELECT w, min(p_partkey) AS id FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}_''’]+')) AS w FROM part)
    GROUP BY w
  )
)"""


def osa_sql(a: str, b: str) -> str:
    """Optimal string alignment distance in DuckDB."""
    swap = f"x.i > 1 AND y[1] > 1 AND substr({a}, x.i, 1) = substr({b}, y[1] - 1, 1) AND substr({a}, x.i - 1, 1) = substr({b}, y[1], 1)"
    return f"""CASE WHEN {a} = {b} THEN 0 WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE
  list_reduce(list_concat([{{'i': 0, 'p2': range(0, length({b}) + 1), 'p1': range(0, length({b}) + 1)}}],
    list_transform(range(1, length({a}) + 1), lambda i: {{'i': i, 'p2': CAST([] AS BIGINT[]), 'p1': CAST([] AS BIGINT[])}})),
    lambda s, x: {{'i': x.i, 'p2': s.p1, 'p1': list_reduce(list_concat([[x.i]], list_transform(range(1, length({b}) + 1), lambda j: [j])),
      lambda r, y: list_append(r, least(r[y[1]] + 1, s.p1[y[1] + 1] + 1,
        s.p1[y[1]] + CASE WHEN substr({a}, x.i, 1) = substr({b}, y[1], 1) THEN 0 ELSE 1 END,
        CASE WHEN {swap} THEN s.p2[y[1] - 1] + 1 ELSE 2147483647 END)))}}).p1[length({b}) + 1] END"""


def _brute(k: str, max_k: int, floor: str = "", strange: bool = False) -> str:
    """Matches of every input with every term; bytes bound characters from above, two bytes a letter at most here."""
    near = f"abs(length(i.q) - length(w.term)) <= i.k AND damerau_levenshtein(i.q, w.term) <= 2 * {max_k}"
    return f"""{_WORDS}, {_INPUTS},
asked AS (SELECT id, input FROM inputs{" UNION ALL SELECT id, 'zqx' || w || 'xqz' FROM inputs" if strange else ""}),
keyed AS (SELECT id, input, lower(input) AS q, {k} AS k FROM asked),
close AS (SELECT i.id, i.input, i.q, i.k, w.term, w.count FROM keyed i JOIN words w ON {near}),
far AS (SELECT *, ({osa_sql('q', 'term')})::INT AS distance FROM close),
found AS (
  SELECT id, input, term, distance, count, (row_number() OVER (PARTITION BY id, input ORDER BY distance, count DESC, term))::INT AS rank,
    min(distance) OVER (PARTITION BY id, input) AS least
  FROM far WHERE distance <= k AND (distance = 0 OR true{floor})
)"""


_K1 = _brute("1", 1)
_OUT = "SELECT id, input, term, distance, count, rank FROM found"


def q_tokens(spark, sf_dir):
    t = tokens(F.col("text"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def q_tokens_compat(spark, sf_dir):
    lines = _read(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.concat_ws(" ", "role", F.lit("'s _said"), "text"), compat=True).alias("t"))
    return lines.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def q_dictionary_build(spark, sf_dir):
    return _words(spark, sf_dir)


def q_dictionary_threshold(spark, sf_dir):
    return _words(spark, sf_dir).where("count >= 3")


def q_dictionary_merge(spark, sf_dir):
    return merge(*[from_corpus(_read(spark, sf_dir, t)) for t in ("documents", "conversations", "benchmark")])


def q_dictionary_stats(spark, sf_dir):
    return stats(_words(spark, sf_dir), Config(1, count_threshold=2))


def q_bigram_build(spark, sf_dir):
    return bigrams_from_corpus(_read(spark, sf_dir, "benchmark"))


def q_dictionary_save(spark, sf_dir):
    return dictionary_lines(_words(spark, sf_dir))


def q_load_lines(spark, sf_dir):
    lines = _read(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_mktsegment", F.abs(F.col("c_custkey")).cast("string")).alias("value"))
    bad = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value"))
    return sum_counts(parse_terms(lines.union(bad)))


def q_load_bigrams(spark, sf_dir):
    lines = _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("value"))
    return parse_bigrams(lines, order="p_partkey")


def q_deletes_k1(spark, sf_dir):
    return _words(spark, sf_dir).select("term", F.size(deletes("term", 1, 7)).cast("long").alias("n"), F.md5(F.array_join(F.sort_array(deletes("term", 1, 7)), " ").cast("binary")).alias("digest"))


def q_deletes_k2(spark, sf_dir):
    words = from_corpus(_read(spark, sf_dir, "benchmark"))
    return words.select("term", F.explode(deletes("term", 2, 7)).alias("del"))


def q_index_stats(spark, sf_dir):
    terms = build_index(_words(spark, sf_dir), Config(1)).groupBy("del").agg(F.count(F.lit(1)).alias("terms"))
    return terms.groupBy("terms").agg(F.count(F.lit(1)).alias("dels"))


def q_osa_pairs(spark, sf_dir):
    a = _part_words(spark, sf_dir).select(F.col("w").alias("a"))
    b = _read(spark, sf_dir, "nation").select(F.lower("n_name").alias("b"))
    pairs = a.unionByName(b.withColumnRenamed("b", "a")).crossJoin(F.broadcast(b))  # 25 nations
    return pairs.select("a", "b", osa("a", "b").alias("distance"), osa("a", "b", 2).alias("within_2"))


def q_lookup_exact(spark, sf_dir):
    words = _part_words(spark, sf_dir).select("id", F.col("w").alias("input"))
    return lookup(words.unionByName(_inputs(spark, sf_dir)), _dictionary(spark, sf_dir), Verbosity.ALL, 0)


def q_lookup_unknown(spark, sf_dir):
    strange = _part_words(spark, sf_dir).select("id", F.concat(F.lit("zqx"), "w", F.lit("xqz")).alias("input"))
    return unknown(_inputs(spark, sf_dir).unionByName(strange), _dictionary(spark, sf_dir), 1)


def q_lookup_all_k1(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir), _dictionary(spark, sf_dir), Verbosity.ALL, 1)


def q_lookup_all_k2(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir), _dictionary(spark, sf_dir, Config(2)), Verbosity.ALL, 2)


def q_lookup_closest(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir), _dictionary(spark, sf_dir, Config(2)), Verbosity.CLOSEST, 2)


def q_lookup_top(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir), _dictionary(spark, sf_dir, Config(2)), Verbosity.TOP, 2)


def q_lookup_max_results(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir), _dictionary(spark, sf_dir), Verbosity.ALL, 1, max_results=3)


def q_lookup_thresholds(spark, sf_dir):
    d = _dictionary(spark, sf_dir, Config(1, thresholds=(2, 6)))
    return lookup(_inputs(spark, sf_dir), d, Verbosity.ALL, 1, thresholds=(4, 6))


def q_lookup_preserve_case(spark, sf_dir):
    return lookup(_inputs(spark, sf_dir, upper=True), _dictionary(spark, sf_dir), Verbosity.TOP, 1, preserve_case=True)


def q_transfer_case(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select(F.initcap("p_name").alias("source"), F.lower("p_brand").alias("target")).distinct()
    return parts.select("source", "target", transfer_case("source", "target").alias("result"))


def q_nfkc(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", nfkc(F.concat(F.col("text"), F.lit(" ﬁ"))).alias("text")).select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def q_lookup_compound(spark, sf_dir):
    names = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    joined = names.select("id", F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" "), F.expr("substr(p_name, 2)")).alias("input"))
    parts = _read(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    d = Dictionary.build(_words(spark, sf_dir), Config(1), bigrams_from_corpus(parts))
    return lookup_compound(joined, d, 1)


def _unspaced(spark, sf_dir):
    names = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return names.select("id", F.replace("p_name", F.lit(" "), F.lit("")).alias("input"))


def q_segment_exact(spark, sf_dir):
    return word_segmentation(_unspaced(spark, sf_dir), _dictionary(spark, sf_dir), 0)


def q_segment_k1(spark, sf_dir):
    return word_segmentation(_unspaced(spark, sf_dir), _dictionary(spark, sf_dir), 1)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_LEVEL = "list_distinct(flatten(list_transform({x}, lambda w: CASE WHEN length(w) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)) END)))"
_D0 = "[substr(term, 1, 7)]"
_D1 = _LEVEL.format(x=_D0)
_SHORT = "CASE WHEN length(term) <= {k} THEN [''] ELSE CAST([] AS VARCHAR[]) END"
_ALL1 = f"list_distinct(list_concat({_D0}, {_D1}, {_SHORT.format(k=1)}))"
_ALL2 = f"list_distinct(list_concat({_D0}, {_D1}, {_LEVEL.format(x=_D1)}, {_SHORT.format(k=2)}))"


def _corpus(table: str) -> str:
    return f"SELECT unnest({_DOC_TOKENS}) AS term FROM {table}"


_CASED = """list_reduce(list_concat([{'i': 0, 'out': '', 'up': false}], list_transform(range(1, length(target) + 1), lambda i: {'i': i, 'out': '', 'up': false})),
  lambda a, x: CASE
    WHEN x.i > length(source) THEN {'i': x.i, 'out': a.out || CASE WHEN a.up THEN upper(substr(target, x.i, 1)) ELSE substr(target, x.i, 1) END, 'up': a.up}
    WHEN regexp_matches(substr(source, x.i, 1), '^\\p{Lu}$') THEN {'i': x.i, 'out': a.out || upper(substr(target, x.i, 1)), 'up': x.i > 1}
    WHEN a.up AND regexp_matches(substr(source, x.i, 1), '^\\s$') AND NOT regexp_matches(substr(target, x.i, 1), '^\\s$')
      THEN {'i': x.i, 'out': a.out || upper(substr(target, x.i, 1)), 'up': true}
    ELSE {'i': x.i, 'out': a.out || substr(target, x.i, 1), 'up': false} END).out"""

ORACLE_SQL = {
    "q_tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents)",
    "q_dictionary_build": f"WITH {_WORDS} SELECT * FROM words",
    "q_dictionary_threshold": f"WITH {_WORDS} SELECT * FROM words WHERE count >= 3",
    "q_dictionary_merge": f"SELECT term, count(*) AS count FROM ({_corpus('documents')} UNION ALL {_corpus('conversations')} UNION ALL {_corpus('benchmark')}) GROUP BY term",
    "q_dictionary_stats": f"WITH {_WORDS} SELECT count(*) AS size, sum(count)::BIGINT AS total, coalesce(max(length(term)) FILTER (count >= 2), 0)::INT AS max_term_length FROM words",
    "q_bigram_build": f"SELECT bigram, count(*) AS count FROM (SELECT t[i] || ' ' || t[i + 1] AS bigram FROM (SELECT {_DOC_TOKENS} AS t FROM benchmark), unnest(range(1, len(t))) r(i)) GROUP BY bigram",
    "q_dictionary_save": f"WITH {_WORDS} SELECT term || ' ' || count AS value FROM words",
    "q_load_lines": "SELECT c_mktsegment AS term, sum(c_custkey)::BIGINT AS count FROM customer GROUP BY 1",
    "q_load_bigrams": "SELECT p_name AS bigram, arg_max(p_size, p_partkey)::BIGINT AS count, min(p_size)::BIGINT AS low FROM part GROUP BY 1",
    "q_deletes_k1": f"WITH {_WORDS} SELECT term, len({_ALL1})::BIGINT AS n, md5(array_to_string(list_sort({_ALL1}), ' ')) AS digest FROM words",
    "q_deletes_k2": f"SELECT term, unnest({_ALL2}) AS del FROM (SELECT DISTINCT term FROM ({_corpus('benchmark')}))",
    "q_index_stats": f"WITH {_WORDS}, d AS (SELECT unnest({_ALL1}) AS del FROM words), n AS (SELECT del, count(*) AS terms FROM d GROUP BY del) SELECT terms, count(*) AS dels FROM n GROUP BY terms",
    "q_osa_pairs": f"""WITH {_INPUTS}, a AS (SELECT w AS a FROM inputs UNION ALL SELECT lower(n_name) FROM nation),
p AS (SELECT a, lower(n_name) AS b FROM a, nation), d AS (SELECT a, b, ({osa_sql('a', 'b')})::INT AS distance FROM p)
SELECT a, b, distance, CASE WHEN distance <= 2 THEN distance END AS within_2 FROM d""",
    "q_lookup_exact": f"WITH {_WORDS}, {_INPUTS}, i AS (SELECT id, w AS input FROM inputs UNION ALL SELECT id, input FROM inputs) SELECT id, input, term, 0 AS distance, count, 1 AS rank FROM i JOIN words ON lower(input) = term",
    "q_lookup_unknown": f"WITH {_brute('1', 1, strange=True)} SELECT id, input FROM asked ANTI JOIN found USING (id, input)",
    "q_lookup_all_k1": f"WITH {_K1} {_OUT}",
    "q_lookup_all_k2": f"WITH {_brute('2', 2)} {_OUT}",
    "q_lookup_closest": f"WITH {_brute('2', 2)} {_OUT} WHERE distance = least",
    "q_lookup_top": f"WITH {_brute('2', 2)} {_OUT} WHERE rank = 1",
    "q_lookup_max_results": f"WITH {_K1} {_OUT} WHERE rank <= 3",
    "q_lookup_thresholds": "WITH "
    + _brute("CASE WHEN length(input) >= 6 THEN 2 WHEN length(input) >= 4 THEN 1 ELSE 0 END", 2).replace("OR true", "OR length(term) >= 2")
    + f" {_OUT}",
    "q_transfer_case": f"""SELECT source, target, CASE WHEN lower(source) = lower(target) THEN source ELSE {_CASED} END AS result FROM (
  SELECT DISTINCT array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS source,
    lower(p_brand) AS target FROM part)""",
    "q_lookup_preserve_case": f"WITH {_K1} SELECT id, upper(input) AS input, upper(term) AS term, distance, count, rank FROM found WHERE rank = 1",
}
