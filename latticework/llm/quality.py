"""Quality rules: how far a document's histograms are from its language's.

Two histograms are taken of every whole text: of character classes, and of the
languages' common words (with one bin for all other words). A language's
reference is the sum of its documents' histograms over the whole corpus. A
document whose Jensen-Shannon distance to its reference is too large in either
is not kept; short texts, whose histograms say little, are passed by a guard on
their length. Base rules on repetition come first. JVM expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small

#: Common words of the languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "are", "be", "this", "by"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "pas", "sur"),
    "de": ("der", "die", "und", "das", "in", "den", "von", "zu", "mit", "ist", "im", "nicht", "ein", "eine", "auf", "als", "auch", "es"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"),
}
#: Character classes, as Java regular expressions; lower-case letters are what is left.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[.,;:?'\"()\-]", r"[^\p{Ll}\p{Lu}\p{Nd}\x20\x09-\x0D.,;:?'\"()\-]")
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Largest distances kept; least characters and least words for a histogram to be judged.
CLASS_DISTANCE, WORD_DISTANCE, LEAST_CHARS, LEAST_WORDS = 0.25, 0.65, 40, 50


def _repeated(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows that the text has twice or more.

    Windows are sorted by hash, equal neighbours give their places, and each
    place covers as many new words as lie between it and the next one.
    """
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    docs = docs.withColumn("_hashes", F.when(n > WINDOW, hashes))
    # most texts have no window twice: only the others are sorted
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    docs = docs.withColumn("_windows", F.when(some, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda j: F.get("_windows", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_windows") - 1), lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False)))
    docs = docs.withColumn("_twice", F.when(F.size("_windows") > 1, F.sort_array(F.transform(twice, lambda j: F.get("_windows", j)["i"]))))
    gaps = F.zip_with(F.slice("_twice", 2, F.size("_twice")), F.slice("_twice", F.lit(1), F.size("_twice") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    return docs.withColumn("n_repeat_words", F.when(F.size("_twice") > 0, covered).otherwise(0).cast("long")).drop("_hashes", "_windows", "_twice")


def _common(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Add _common_counts: counts of the common words and, last, of all others."""
    plain = F.filter(F.split(F.lower("_text"), r"\P{L}+"), lambda w: F.length(w) > 0)
    docs = docs.withColumn("_plain", plain)
    docs = docs.withColumn("_known", F.sort_array(F.filter("_plain", lambda w: w.isin(vocabulary))))
    first = F.filter(F.sequence(F.lit(0), F.size("_known") - 1), lambda j: (j == 0) | (F.get("_known", j) != F.get("_known", j - 1)))
    docs = docs.withColumn("_first", F.when(F.size("_known") > 0, first).otherwise(F.array().cast("array<int>")))
    runs = F.zip_with("_first", F.concat(F.slice("_first", 2, F.greatest(F.size("_first"), F.lit(1))), F.array(F.size("_known"))), lambda a, b: (b - a).cast("double"))
    # without words the second array is one longer: cut to the first's length
    docs = docs.withColumn("_by_word", F.map_from_arrays(F.transform("_first", lambda j: F.get("_known", j)), F.slice(runs, F.lit(1), F.size("_first"))))
    counts = F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.coalesce(F.try_element_at("_by_word", v), F.lit(0.0)))
    return docs.withColumn("_common_counts", F.concat(counts, F.array((F.size("_plain") - F.size("_known")).cast("double")))).drop("_plain", "_known", "_first", "_by_word")


def distance(p: Column, q: Column, p_sum: Column, q_sum: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays with their sums; null if either is empty."""

    def part(a: Column, b: Column) -> Column:
        half = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return (half(a) + half(b)) / 2

    terms = F.zip_with(p, q, lambda a, b: part(a / p_sum, b / q_sum))
    return F.when((p_sum > 0) & (q_sum > 0), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))))


def measure(docs: DataFrame, lists: dict[str, tuple[str, ...]] = COMMON_WORDS) -> DataFrame:
    """Base counts and both histograms of every row of ``docs`` (doc_id, text, lang)."""
    vocabulary = sorted({w for own in lists.values() for w in own})
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("_lang"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    found = found.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)).withColumn("_lines", lines)
    for k, c in enumerate(CLASSES):
        found = found.withColumn(f"_c{k}", F.regexp_count("_text", F.lit(c)))
    chars, classes = F.length("_text"), [F.col(f"_c{k}") for k in range(len(CLASSES))]
    counts = [chars - sum(classes[1:], classes[0]), *classes]
    found = found.select(
        "doc_id", "_lang", "_text", "_words",
        F.size("_words").cast("long").alias("n_words"),
        (chars - F.col("_c2")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[c.cast("double") for c in counts]).alias("_class_counts"),
    )
    return _common(_repeated(found).drop("_words"), vocabulary).drop("_text")


def judge(docs: DataFrame, lists: dict[str, tuple[str, ...]] = COMMON_WORDS, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """Base rules and distances of every row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept. Null texts count as empty
    and fail the base rules. Documents without a lang are compared with the sum
    of all languages. A distance is null where its guard lets a short text pass.
    Equal rows get equal verdicts; an empty table gives an empty result.
    """
    found = cut(measure(docs, lists), "quality")
    sizes = {"_class_counts": len(CLASSES) + 1, "_common_counts": len({w for own in lists.values() for w in own}) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    own = found.where("_lang <> ''").groupBy("_lang").agg(*sums)
    whole = found.agg(*sums).select(F.lit("").alias("_lang"), "*")
    refs = own.unionByName(whole).select("_lang", *[F.array(*[f"{c}{i}" for i in range(n)]).alias(f"_ref{c}") for c, n in sizes.items()])
    refs = cut(refs, "references")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    joined = found.join(small(refs, refs.count()), "_lang", "left")
    for c in sizes:
        joined = joined.withColumn(f"_sum{c}", total(c)).withColumn(f"_sum_ref{c}", total(f"_ref{c}"))
    far = [distance(F.col(c), F.col(f"_ref{c}"), F.col(f"_sum{c}"), F.col(f"_sum_ref{c}")) for c in sizes]
    joined = joined.withColumn("class_distance", F.when(F.col("_sum_class_counts") >= LEAST_CHARS, far[0]))
    joined = joined.withColumn("word_distance", F.when(F.col("_sum_common_counts") >= LEAST_WORDS, far[1]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    close = F.coalesce(F.col("class_distance") <= class_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= word_distance, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "class_distance", "word_distance", (~failed & close).alias("kept"))
