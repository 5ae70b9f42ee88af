"""Frequency dictionaries: built from a corpus, merged, with what lookups need of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deletes, tokens
from ..plans.config import Config
from ..sources.dictionary_files import MAX_COUNT, sum_counts


def from_corpus(docs: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    """(term, count) of the tokens of a text column."""
    return docs.select(F.explode(tokens(F.col(text_col), compat)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def bigrams_from_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bigram, count) of adjacent tokens; pairs are formed inside the row, without a join."""
    rows = docs.select(tokens(F.col(text_col)).alias("t")).where(F.size("t") >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))
    return rows.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("count"))


def merge(*dictionaries: DataFrame) -> DataFrame:
    """Counts of the same term add up."""
    out = dictionaries[0].select("term", "count")
    for d in dictionaries[1:]:
        out = out.unionByName(d.select("term", "count"))
    return sum_counts(out)


def indexed_terms(words: DataFrame, config: Config) -> DataFrame:
    """Terms that lookups find at a distance: frequent and long enough. Others match exactly only."""
    out = words.where(F.col("count") >= config.count_threshold)
    return out.where(F.length("term") >= config.thresholds[0]) if config.thresholds else out


def build_index(words: DataFrame, config: Config) -> DataFrame:
    """(del, term, count): each indexed term under each string that deletions leave of its prefix.

    All terms are indexed to the greatest distance of any, so that lookups with thresholds miss nothing.
    """
    rows = indexed_terms(words, config)
    return rows.select(F.explode(deletes("term", config.depth, config.prefix_length)).alias("del"), "term", "count")


def keyed(index: DataFrame, prefix_length: int) -> DataFrame:
    """(h, n, term, count): the index by a 64-bit hash of ``del``, with the number of deletions that gave it.

    Lookups take the distance of every pair that meets, so terms that meet by a collision do no harm.
    """
    if "h" in index.columns:
        return index
    n = F.least(F.length("term"), F.lit(prefix_length)) - F.length("del")
    return index.select(F.xxhash64("del").alias("h"), n.alias("n"), "term", "count")


def stats(words: DataFrame, config: Config) -> DataFrame:
    """One row: size, total count, longest indexed term."""
    ok = F.col("count") >= config.count_threshold
    if config.thresholds:
        ok &= F.length("term") >= config.thresholds[0]
    return words.agg(
        F.count(F.lit(1)).alias("size"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.coalesce(F.max(F.when(ok, F.length("term"))), F.lit(0)).alias("max_term_length"),
    )


@dataclass
class Dictionary:
    """Words (term, count), the delete index, optional bigrams (bigram, count) and the numbers drawn from them."""

    words: DataFrame
    config: Config
    index: DataFrame
    max_term_length: int
    bigrams: DataFrame | None = None
    bigram_min_count: int = MAX_COUNT

    @classmethod
    def build(cls, words: DataFrame, config: Config | None = None, bigrams: DataFrame | None = None) -> Dictionary:
        """``bigrams`` may carry ``low``, the smallest count of its source lines; else the smallest count is taken."""
        config = config or Config()
        longest = stats(words, config).first()["max_term_length"]
        low = MAX_COUNT
        if bigrams is not None:
            found = bigrams.agg(F.min("low" if "low" in bigrams.columns else "count")).first()[0]
            low = MAX_COUNT if found is None else found
        return cls(words, config, build_index(words, config), longest, bigrams, low)

    def persist(self) -> Dictionary:
        """The same dictionary with its tables kept on the executors, placed by the keys that lookups join on, so that
        only the looked-up strings are shuffled. ``release`` lets go of them."""
        words = self.words.repartition("term").persist()
        index = keyed(self.index, self.config.prefix_length).repartition("h").persist()
        return replace(self, words=words, index=index)

    def release(self) -> None:
        self.words.unpersist()
        self.index.unpersist()

    def size(self) -> int:
        """Terms, those below the count threshold too."""
        return self.words.count()

    def save(self, path: str) -> None:
        """Tables as Parquet, the index sorted by its key, and the settings."""
        spark = self.words.sparkSession
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.index.repartition("del").sortWithinPartitions("del").write.mode("overwrite").parquet(f"{path}/index")
        if self.bigrams is not None:
            self.bigrams.write.mode("overwrite").parquet(f"{path}/bigrams")
        row = [(self.config.to_json(), self.max_term_length, self.bigram_min_count, self.bigrams is not None)]
        schema = "config string, max_term_length int, bigram_min_count long, has_bigrams boolean"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        schema = "config string, max_term_length int, bigram_min_count long, has_bigrams boolean"
        row = spark.read.schema(schema).json(f"{path}/settings").first()
        bigrams = spark.read.parquet(f"{path}/bigrams") if row.has_bigrams else None
        words, index = (spark.read.parquet(f"{path}/{t}") for t in ("words", "index"))
        return cls(words, Config.from_json(row.config), index, row.max_term_length, bigrams, row.bigram_min_count)
