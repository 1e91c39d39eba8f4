"""Dictionaries of words with counts, suggestions, corrections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablefin.functions import strings
from sablefin.functions.text import ENGLISH_STOP_WORDS

# Words of the minimal dictionary.
MINIMAL_WORDS = """
hello world search query text word spell correct suggestion dictionary language english computer program software system data information
process result value number string character
""".split()


@dataclass
class Dictionary:
    """A table word, freq."""

    words: DataFrame

    @staticmethod
    def of_words(spark: SparkSession, words, freq: int = 1) -> Dictionary:
        return Dictionary(spark.createDataFrame([(w, freq) for w in words], "word string, freq long"))

    @staticmethod
    def minimal(spark: SparkSession) -> Dictionary:
        return Dictionary.of_words(spark, MINIMAL_WORDS, 100)

    @staticmethod
    def from_corpus(docs: DataFrame, column: str) -> Dictionary:
        words = docs.select(F.explode(strings.acronym_words(F.col(column))).alias("word"))
        return Dictionary(words.groupBy("word").agg(F.count("*").alias("freq")))

    @staticmethod
    def from_terms(term_stats: DataFrame, name: str) -> Dictionary:
        """Learned from an index."""
        return Dictionary(term_stats.filter(F.col("field") == name).select(F.col("term").alias("word"), F.col("ctf").alias("freq")))

    def merged(self, other: Dictionary) -> Dictionary:
        return Dictionary(self.words.unionByName(other.words).groupBy("word").agg(F.sum("freq").alias("freq")))

    def pruned(self, min_freq: int) -> Dictionary:
        return Dictionary(self.words.filter(F.col("freq") >= min_freq))

    def with_prefix(self, prefix: str) -> DataFrame:
        return self.words.filter(F.col("word").startswith(prefix))

    def top(self, n: int) -> DataFrame:
        return self.words.orderBy(F.desc("freq"), "word").limit(n)

    def totals(self) -> DataFrame:
        return self.words.agg(F.sum("freq").alias("total"))

    def probabilities(self) -> DataFrame:
        return self.words.crossJoin(F.broadcast(self.totals())).withColumn("p", F.col("freq") / F.col("total"))


def suggestion_score(word: Column, candidate: Column, edits: Column, freq: Column, total: Column, keyboard: bool = True) -> Column:
    near = 0.6 / (1 + edits) + 0.4 * F.when(freq > 0, F.log(freq) / F.log(total)).otherwise(F.lit(0.0))
    length = F.when(F.octet_length(word) == F.octet_length(candidate), 1.0).otherwise(0.9)
    prefix = 1 + 0.2 * strings.common_prefix(word, candidate) / F.greatest(F.length(word), F.length(candidate))
    keys = F.when(strings.keyboard(word, candidate) < edits, 1.1).otherwise(1.0) if keyboard else F.lit(1.0)
    return F.least(F.lit(1.0), near * length * prefix * keys)


def shortened(word: Column, edits: int) -> Column:
    """The word and what up to so many deletions leave of it; two words within that many edits share one."""
    out = last = F.array(word)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: i <= F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))
        out = F.array_union(out, last)
    return out


def suggestions(dictionary: Dictionary, words: DataFrame, max_edits: int = 2, min_freq: int = 1, keyboard: bool = True, many: bool = False) -> DataFrame:
    """(query_word, word, edits, freq, score) for a table with column query_word; a known word suggests itself alone with score 1.

    A few words (a query's) go to one scan of the dictionary, by a join on length (each with the lengths it may
    meet). Where the words are many, as a vocabulary is, both sides are keyed by what deletions leave of them, so
    that only near words meet. Levenshtein with a threshold decides.
    """
    known = dictionary.words.filter(F.col("freq") >= min_freq)
    if many:
        known = known.select("word", "freq", F.explode(shortened(F.col("word"), max_edits)).alias("n"))
        asked = words.select("query_word").distinct().select("query_word", F.explode(shortened(F.col("query_word"), max_edits)).alias("n"))
        met = known.join(asked, "n").select("query_word", "word", "freq").distinct()
    else:
        lengths = F.sequence(F.greatest(F.lit(1), F.length("query_word") - max_edits), F.length("query_word") + max_edits)
        met = known.withColumn("n", F.length("word")).join(words.select("query_word").distinct().select("query_word", F.explode(lengths).alias("n")), "n")
    pairs = met.withColumn("edits", F.levenshtein(F.col("query_word"), F.col("word"), max_edits)).filter(F.col("edits") >= 0)
    exact = Window.partitionBy("query_word")
    pairs = pairs.withColumn("is_known", F.min("edits").over(exact) == 0).filter(~F.col("is_known") | (F.col("edits") == 0))
    pairs = pairs.crossJoin(F.broadcast(dictionary.totals()))
    score = F.when(F.col("edits") == 0, F.lit(1.0)).otherwise(suggestion_score(F.col("query_word"), F.col("word"), F.col("edits"), F.col("freq"), F.col("total"), keyboard))
    return pairs.select("query_word", "word", "edits", "freq", score.alias("score"))


def best_suggestions(found: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("query_word").orderBy(F.desc("score"), F.desc("freq"), "word")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


@dataclass
class Correction:
    query: str
    corrected: str
    confidence: float
    auto_corrected: bool
    words: dict[str, list[tuple[str, float]]] = field(default_factory=dict)

    @property
    def did_you_mean(self) -> str | None:
        """Words replaced by their best suggestion where it scores over 0.5; only for unsure queries that were not corrected."""
        if self.auto_corrected or self.confidence >= 0.7 or not any(self.words.values()):
            return None
        out = " ".join(found[0][0] if (found := self.words.get(w)) and found[0][1] > 0.5 else w for w in self.query.split())
        return out if out != self.query else None

    @property
    def should_retry(self) -> bool:
        return self.auto_corrected or self.confidence > 0.7


@dataclass
class Corrector:
    dictionary: Dictionary
    max_edits: int = 2
    auto_threshold: float = 0.8
    min_length: int = 2
    stop_words: frozenset = frozenset(ENGLISH_STOP_WORDS)
    history: list[str] = field(default_factory=list)

    def correct(self, query: str) -> Correction:
        """One job for all words of a query."""
        words = query.split()
        asked = [w.lower() for w in dict.fromkeys(words) if len(w) >= self.min_length and w.lower() not in self.stop_words]
        spark = self.dictionary.words.sparkSession
        found: dict[str, list] = {}
        if asked:
            top = best_suggestions(suggestions(self.dictionary, spark.createDataFrame([(w,) for w in asked], "query_word string"), self.max_edits))
            for r in top.orderBy("query_word", "rank").collect():  # five rows a query word
                found.setdefault(r["query_word"], []).append((r["word"], r["score"]))
        sure, out, changed = [], [], False
        for w in words:
            own = found.get(w.lower(), [])
            known = w.lower() not in asked or (own and own[0][0] == w.lower())
            sure.append(1.0 if known else own[0][1] if own else 0.5)
            if not known and own and own[0][1] >= self.auto_threshold:
                out.append(own[0][0])
                changed = True
            else:
                out.append(w)
        self.history.append(query)
        mean = sum(sure) / len(sure) if sure else 1.0
        return Correction(query, " ".join(out), mean, changed, {w: [x for x in found.get(w.lower(), []) if x[0] != w.lower()] for w in words})

    def learn(self, terms) -> None:
        self.dictionary = self.dictionary.merged(Dictionary.of_words(self.dictionary.words.sparkSession, terms))


def corrected_search(search, corrector: Corrector, query: str):
    """search(text) -> hits; a second search with the corrected text where the first finds under two and the correction is sure."""
    first = search(query)
    fix = corrector.correct(query)
    if fix.corrected != query and (fix.auto_corrected or (fix.confidence > 0.7 and len(first.take(2)) < 2)):
        return search(fix.corrected), fix
    return first, fix


def extract_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def might_be_misspelled(word: Column) -> Column:
    """Odd looks: a letter three times over, letters and digits mixed, or no vowel in a longer word."""
    return word.rlike(r"(?i)([a-z])\1\1") | (word.rlike("[a-zA-Z]") & word.rlike("[0-9]")) | (word.rlike("^[a-zA-Z]{4,}$") & ~word.rlike("(?i)[aeiouy]"))


def correctness(docs: DataFrame, column: str, dictionary: Dictionary, key: str = "doc_id") -> DataFrame:
    """Share of a text's words that are in the dictionary; 1 without words."""
    words = docs.select(key, F.explode_outer(extract_words(F.col(column))).alias("word"))
    per = words.groupBy(key, "word").agg(F.count("*").alias("c"))
    known = per.join(dictionary.words.select("word", F.lit(1).alias("known")), "word", "left")
    total = F.sum(F.when(F.col("word").isNotNull(), F.col("c")).otherwise(0))
    return known.groupBy(key).agg(F.when(total > 0, F.sum(F.when(F.col("known").isNotNull(), F.col("c")).otherwise(0)) / total).otherwise(F.lit(1.0)).alias("correctness"))


def build_corrected_query(query: str, replacements: dict[str, str]) -> str:
    return " ".join(replacements.get(w.lower(), w) for w in query.split())
