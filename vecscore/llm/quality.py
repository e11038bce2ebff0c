"""Quality rules, line first: each line is held against punctuation, navigation and boilerplate rules, the lines that
fail are removed, and a document that loses too much of its text is rejected. Everything is an expression on one row:
the plan is a single scan without an exchange, so neither hot sources nor copies matter.

Defined cases: null and empty texts have no words and fail the base rules (fewer than MIN_WORDS words). Windows of five
words are told apart by a 64-bit hash of their words' 64-bit hashes. Blank lines are neither kept nor lost text.
A text no line of which fails stays as it is. Repeated rows are judged alike, extra columns pass through quality_stage untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import SPACE, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A document goes if its failed lines hold more than this share of its word characters.
MAX_LOSS_PERCENT = 40
#: A line is navigation with so many separators between its items.
SEPARATORS = r"[|»›•·]"
MIN_SEPARATORS = 2
#: A line fails the punctuation rule with so many runs of marks that prose does not have, or with this share of marks.
MARK_RUNS = r"!!+|\?\?+|[#*$%&<>=~^_]{2,}"
MIN_MARK_RUNS = 3
MARKS = r"[^\p{L}\p{M}\p{N}\s]"
MAX_MARKS_PERCENT = 25
#: Words of page furniture. A line with any of these and no more than BOILERPLATE_CHARS characters is boilerplate.
BOILERPLATE = r"(?i)\b(?:cookies?|javascript|privacy policy|terms of (?:use|service)|all rights reserved|sign (?:in|up)|log ?in|subscribe|click here|read more|share this|copyright|skip to content)\b"
BOILERPLATE_CHARS = 160


def line_verdict(line: Column) -> Column:
    """The rule that line fails, or null. All lines are held against the rules on marks, only short ones against boilerplate."""
    marks = F.regexp_count(line, F.lit(MARKS))
    bad_marks = (F.regexp_count(line, F.lit(MARK_RUNS)) >= MIN_MARK_RUNS) | (marks * 100 > F.length(line) * MAX_MARKS_PERCENT)
    by_marks = F.when(F.regexp_count(line, F.lit(SEPARATORS)) >= MIN_SEPARATORS, F.lit("navigation")).when(bad_marks, F.lit("punctuation"))
    short = F.length(line) <= BOILERPLATE_CHARS
    return F.coalesce(by_marks, F.when(short & line.rlike(BOILERPLATE), F.lit("boilerplate")))


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, "")).cast("long")


def repeated_words(df: DataFrame, word_col: str, out: str) -> DataFrame:
    """df with the number of words that lie in a window of WINDOW words found twice or more in the same row."""
    names = [f"__{out}_{k}" for k in ("hash", "two", "four", "window", "sorted", "at")]
    h, two, four, w, s, at = (F.col(n) for n in names)
    n = F.size(h)
    mix = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn(names[0], F.transform(word_col, lambda x: F.xxhash64(x)))
    df = df.withColumn(names[1], F.when(n > WINDOW, F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), mix)))
    df = df.withColumn(names[2], F.zip_with(F.slice(two, F.lit(1), n - 3), F.slice(two, F.lit(3), n - 3), mix))
    # a window found twice holds four words found twice; most texts have none, and only the others go on
    df = df.withColumn(names[3], F.when(F.size(F.array_distinct(four)) < F.size(four), F.zip_with(F.slice(four, F.lit(1), n - 4), F.slice(h, F.lit(5), n - 4), mix)))
    order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(names[4], F.when(F.size(F.array_distinct(w)) < F.size(w), order))
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    df = df.withColumn(names[5], F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))
    return df.withColumn(out, F.coalesce(covered["n"], F.lit(0)).cast("long")).drop(*names)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, cleaned_text, lost_chars and kept. The new names must not be among the columns of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__words", words(text)).withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = repeated_words(df, "__words", "n_repeat_words")
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", word_chars(F.col("__words"))).withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    # a blank line fails no rule, so it stays where it is
    df = df.withColumn("__all", F.split(text, "\n")).withColumn("__good", F.filter("__all", lambda x: line_verdict(x).isNull()))
    df = df.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_failed_lines", (F.size("__all") - F.size("__good")).cast("long"))
    df = df.withColumn("cleaned_text", F.when(F.col("n_failed_lines") > 0, F.array_join("__good", "\n")).otherwise(F.col(text_col)))
    left = word_chars(words(F.col("cleaned_text")))
    df = df.withColumn("lost_chars", F.when(F.col("n_failed_lines") > 0, F.col("word_chars") - left).otherwise(0).cast("long"))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOSS_PERCENT)
    return df.withColumn("kept", kept).drop("__words", "__lines", "__all", "__good")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept and what line cleaning found."""
    found = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failed lines; n_chars, where docs has it, is the length of what is left."""
    found = judge(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("text")))
    new = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text")}
    own = [new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("__row")[f.name].alias(f.name) for f in docs.schema.fields]
    # a filter on kept would be pushed below all of judge()'s steps, each copied into the next; none is pushed below a generator
    kept = F.explode_outer(F.when(F.col("kept"), F.array(F.struct(*own)))).alias("__row")
    return found.select(kept).filter("__row is not null").select("__row.*")
