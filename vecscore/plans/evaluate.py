"""Evaluation of decisions: confusion counts, latency, and the scores made of them; and metric formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEST_MS, CUT_MS, CUT_RATE = 1.0, 2000.0, 0.15


def confusion(rows: DataFrame) -> DataFrame:
    """rows: expected_approved, approved, status, ms. One row: tp, tn, fp, fn, err, p99."""
    ok, e, a = F.col("status") == 200, F.col("expected_approved"), F.col("approved")
    return rows.agg(
        F.count_if(ok & ~e & ~a).alias("tp"), F.count_if(ok & e & a).alias("tn"), F.count_if(ok & e & ~a).alias("fp"), F.count_if(ok & ~e & a).alias("fn"), F.count_if(~ok).alias("err"), F.percentile("ms", 0.99).alias("p99")
    )


def errors(counts: DataFrame) -> DataFrame:
    """counts with n, weighted (errors by cost), failure_rate and error_rate."""
    df = counts.withColumn("n", F.expr("tp + tn + fp + fn + err")).withColumn("weighted", F.expr("fp + 3 * fn + 5 * err"))
    over = lambda x: F.when(F.col("n") > 0, x / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    return df.withColumn("failure_rate", over(F.expr("fp + fn + err"))).withColumn("error_rate", over(F.col("weighted")))


def p99_score(p99: Column) -> Column:
    return F.when(p99 <= 0, 0.0).when(p99 > CUT_MS, -3000.0).otherwise(F.log10(1000.0 / F.greatest(p99, F.lit(BEST_MS))) * 1000)


def detection_score(rate: Column, error_rate: Column, weighted: Column) -> Column:
    return F.when(rate > CUT_RATE, -3000.0).otherwise(F.log10(1.0 / F.greatest(error_rate, F.lit(0.001))) * 1000 - F.log10(weighted + 1.0) * 300)


def final_score(rows: DataFrame) -> DataFrame:
    df = errors(confusion(rows))
    p, d = p99_score(F.col("p99")), detection_score(F.col("failure_rate"), F.col("error_rate"), F.col("weighted"))
    shown = F.when(F.col("failure_rate") <= CUT_RATE, F.round(d, 6))
    return df.select(
        "tp", "tn", "fp", "fn", "err", F.round("failure_rate", 6).alias("failure_rate"), F.round("p99", 6).alias("p99"), F.when(F.col("p99") <= CUT_MS, F.round(p, 6)).alias("p99_score"), shown.alias("detection_score"), F.round(p + d, 6).alias("final_score")
    )


def check_percent(passes: Column, fails: Column) -> Column:
    return F.floor(passes * 100 / F.when(passes + fails > 0, passes + fails))


def plain(x: Column, digits: int) -> Column:
    """x rounded to digits decimals, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def trimmed(x: Column, digits: int) -> Column:
    """x (not negative) cut to digits decimals, without zeros at the end."""
    return plain(F.floor(x * 10**digits) / 10**digits, digits)


#: Byte units in steps of 1000, and time units with their share of a millisecond.
BYTE_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
TIME_UNITS = {"s": ("s", 0.001), "ms": ("ms", 1.0), "us": ("µs", 1000.0)}


def humanize_bytes(n: Column) -> Column:
    """Bytes in steps of 1000, at one decimal below ten; under ten bytes as they are. From 1e27 on no unit is left, and the result is null."""
    step = F.when(n < 10, 0).otherwise(F.floor(F.log(n.cast("double")) / F.log(F.lit(1000.0))))
    value = F.floor(n / F.pow(F.lit(1000.0), step) * 10 + 0.5) / 10
    unit = F.get(F.array(*map(F.lit, BYTE_UNITS)), step.cast("int"))
    return F.when(n < 10, F.concat(plain(n.cast("double"), 6), F.lit(" B"))).otherwise(F.concat(F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%d", F.floor(value + 0.5))), F.lit(" "), unit))


def humanize_duration(ms: Column, unit: str = "") -> Column:
    """Milliseconds, in the unit named (two decimals) or else in the largest fitting ones, decimals cut."""
    if unit in TIME_UNITS:
        name, share = TIME_UNITS[unit]
        return F.concat(F.format_string("%.2f", F.round(ms * share, 2)), F.lit(name))
    minutes = F.floor(ms / 60_000)
    rest = (ms % 60_000) / 1000
    sec = F.concat(F.when(ms > 60_000, trimmed(rest, 0)).otherwise(trimmed(rest, 2)), F.lit("s"))
    minute = F.concat((minutes % 60).cast("string"), F.lit("m"), sec)
    return (
        F.when(ms == 0, F.lit("0s")).when(ms < 0.001, F.concat(trimmed(ms * 1_000_000, 0), F.lit("ns"))).when(ms < 1, F.concat(trimmed(ms * 1000, 2), F.lit("µs")))
        .when(ms < 1000, F.concat(trimmed(ms, 2), F.lit("ms"))).when(minutes < 1, sec).when(minutes < 60, minute).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), minute))
    )


def humanize_value(x: Column, kind: Column, contains: Column, unit: str = "") -> Column:
    """A metric's value: rates as percents cut to two decimals, else by what the metric contains."""
    rate = F.concat(F.format_string("%.2f", F.floor(x * 100 * 100) / 100), F.lit("%"))
    return F.when(kind == "rate", rate).when(contains == "data", humanize_bytes(x)).when(contains == "time", humanize_duration(x, unit)).otherwise(plain(x, 6))


def display_name(name: Column) -> Column:
    """A sub-metric, name{tags}, is shown as its tags."""
    at = F.instr(name, "{")
    return F.when(at > 0, F.concat(F.lit("{ "), F.substring(name, at + 1, F.length(name) - at - 1), F.lit(" }"))).otherwise(name)


def indent(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("{")), F.lit("  ")).otherwise(F.lit(""))


def escape_html(text: Column) -> Column:
    for mark, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def junit_case(metric: Column, threshold: Column, ok: Column) -> Column:
    """The line of a JUnit report for one threshold of a metric."""
    head = F.concat(F.lit('<testcase name="'), escape_html(metric), F.lit(" - "), escape_html(threshold), F.lit('"'))
    return F.concat(head, F.when(ok, F.lit(" />")).otherwise(F.lit('><failure message="failed" /></testcase>')))
