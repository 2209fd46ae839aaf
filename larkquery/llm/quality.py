"""Quality rules: base counts and a distribution-divergence verdict, DataFrame functions only.

A document's character classes and common words are two histograms.  References for each language are the same
histograms summed over the whole corpus (documents that pass the base rules).  The verdict compares a document
with its closest reference by Jensen-Shannon distance (base 2, so 0 to 1), separately for both histograms, and
only where the document has enough words for its histogram to mean something.

The work is one pass over the texts; per document it leaves a few counts, which are written to the shared folder.
The references are one row per language of ``COMMON_WORDS``, however large the corpus, and go back as literals.

Defined cases: null text has no words and fails the base rules (fewer than ``min_words``); a null or unknown
language still gets a verdict, as references do not depend on the document's own label; an empty table gives an
empty result; repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

# Frequent words of each reference language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SPACE = r"[\x20\x09-\x0D]+"
# Classes that are cut out of a text one after another; what is left is the class "other".
CLASSES = [("ascii_letter", "[A-Za-z]+"), ("space", SPACE), ("letter", r"\p{L}+"), ("digit", "[0-9]+"), ("punctuation", r"""[.,;:!?'"()\-]+""")]


def _histograms(df: DataFrame) -> DataFrame:
    """Adds char_hist (CLASSES and other, in characters), word_hist (WORDS and other, in words) and word_chars."""
    df = df.withColumn("left0", F.col("text"))
    for i, (name, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", pattern, ""))
        df = df.withColumn(name, (F.length(f"left{i}") - F.length(f"left{i + 1}")).cast("long"))
    last = f"left{len(CLASSES)}"
    df = df.withColumn("char_hist", F.array(*[F.col(n) for n, _ in CLASSES], F.length(last).cast("long")))
    df = df.withColumn("n_symbols", (F.length(last) - F.length(F.regexp_replace(last, r"[#*$%&|<>]", ""))).cast("long"))
    df = df.withColumn("word_chars", F.length("text").cast("long") - F.col("space"))
    df = df.withColumn("common", F.filter("words", lambda w: w.isin(WORDS)))
    one = lambda w: F.size(F.filter("common", lambda x: x == F.lit(w))).cast("long")
    return df.withColumn("word_hist", F.array(*[one(w) for w in WORDS], F.col("n_words") - F.size("common")))


def _repeats(df: DataFrame, width: int = 8) -> DataFrame:
    """Adds n_repeat_words: words inside windows of ``width`` words that the text holds twice or more.

    Windows are 64-bit hashes inside one document.  Only documents that repeat one sort them; all steps are linear
    or a sort, so a text of one repeated word stays cheap.
    """
    df = df.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    some = F.col("n_words") >= width
    starts = F.sequence(F.lit(1), F.greatest(F.size("word_hashes") - (width - 1), F.lit(1)))
    df = df.withColumn("windows", F.when(some, F.transform(starts, lambda i: F.xxhash64(F.slice("word_hashes", i, width)))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(F.col("repeats"), ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    at = lambda i: F.get("ordered", i)["h"]
    twice = F.filter("ordered", lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
    inside = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        inside,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda s, i: F.struct((i + width).alias("end"), (s["total"] + i + width - F.greatest(i, s["end"])).alias("total")),
        lambda s: s["total"],
    )
    return df.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long"))


def js_distance(hist: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram with this total from a distribution; null where it is empty."""
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def part(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    both = F.zip_with(hist, ref, part)
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 20,
    guard_words: int = 60,
    most_char_distance: float = 0.25,
    most_word_distance: float = 0.275,
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance (null: no reference, or fewer than ``guard_words`` words, and then not judged)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE, -1), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = _repeats(_histograms(df))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = write_shared(df.select(*base, "lang", F.length("text").cast("long").alias("n_chars"), "char_hist", "word_hist"), "quality-counts")

    chars, words = len(CLASSES) + 1, len(WORDS) + 1
    sums = [F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(chars)] + [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(words)]
    refs = counted.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums).collect()

    def nearest(hist: str, total_col: str, prefix: str, n: int) -> Column:
        found = []
        for r in sorted(refs, key=lambda r: r["lang"]):
            counts = [r[f"{prefix}{i}"] or 0 for i in range(n)]
            if total := sum(counts):
                found.append(js_distance(F.col(hist), F.col(total_col), [c / total for c in counts]))
        none = F.lit(None).cast("double")
        return F.when(F.col("n_words") >= guard_words, F.array_min(F.array(none, *found)))

    out = counted.withColumns({"char_distance": nearest("char_hist", "n_chars", "c", chars), "word_distance": nearest("word_hist", "n_words", "w", words)})
    far = F.coalesce(F.col("char_distance") > most_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > most_word_distance, F.lit(False))
    return out.select(*base, (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
