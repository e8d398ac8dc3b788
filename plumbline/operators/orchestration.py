"""Security analyses of many snapshots: what was taken in, which rules were evaluated, and why others were not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Limits of an analysis, states of a rule, codes.
MAX_SOURCE_FILES, MAX_SOURCE_BYTES = 64, 8 << 20
EVALUATED, FAILED, UNSUPPORTED, REFUSED = "SUPPORTED_PARTIAL_V2_SCOPE", "FAILED", "CONTRACT_ONLY", "REFUSED"
ALWAYS = "PARTIAL_ANALYSIS"


def intake(files: DataFrame, languages: DataFrame, max_files: int = MAX_SOURCE_FILES, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """(snapshot, units, refused, codes) of each snapshot of languages (snapshot, language). files: (snapshot, seq from 0, path,
    language, size, problem); a problem is the code of a source that could not be read, or null.

    Sources are taken in order until one goes over max_files or max_bytes; what comes after is not looked at. One of another language
    or with a problem is no unit and fails its own snapshot only; a repeated path refuses the snapshot. As seq cuts first, the
    window over a snapshot has at most max_files rows, whatever it holds."""
    total = F.sum("size").over(W.partitionBy("snapshot").orderBy("seq"))
    taken = files.filter(F.col("seq") < max_files).withColumn("_in", total <= max_bytes)
    taken = taken.select("snapshot", "path", "language", "problem", "_in").join(languages.select("snapshot", F.col("language").alias("_own")), "snapshot")
    code = F.when(F.col("language").eqNullSafe(F.col("_own")), F.col("problem")).otherwise("UNSUPPORTED_LANGUAGE")
    code = F.when(F.col("_in"), code).otherwise("SOURCE_INTAKE_LIMIT")
    # paths first, so that repeats need no distinct count
    paths = taken.groupBy("snapshot", "path").agg(
        F.count_if("_in").alias("times"), F.count_if(code.isNull()).alias("units"), F.collect_set(code).alias("codes")
    )
    per = paths.groupBy("snapshot").agg(
        F.sum("units").alias("units"), F.max(F.col("times") > 1).alias("refused"), F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes")
    )
    over = files.filter(F.col("seq") >= max_files).select("snapshot").distinct().withColumn("_over", F.lit(True))
    out = languages.select("snapshot").distinct().join(per, "snapshot", "left").join(over, "snapshot", "left")
    none = F.coalesce("units", F.lit(0)) == 0
    extra = F.array_compact(F.array(F.when(F.col("_over"), "SOURCE_INTAKE_LIMIT"), F.when(none, "SOURCE_UNAVAILABLE")))
    codes = F.array_union(F.coalesce("codes", F.array().cast("array<string>")), extra)
    return out.select("snapshot", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("refused", F.lit(False)).alias("refused"), codes.alias("codes"))


def coverage(
    requests: DataFrame, supported: DataFrame, files: DataFrame, findings: DataFrame, failures: DataFrame, max_files: int = MAX_SOURCE_FILES, max_bytes: int = MAX_SOURCE_BYTES
) -> DataFrame:
    """(snapshot, rule, supported, evaluated, status, units, findings, diagnostics): one row a requested rule.

    requests: (snapshot, language, rule); supported: (language, rule); files as in intake(); findings: (snapshot, rule, finding), of
    which equal ones count once; failures: (snapshot, rule), the detectors that broke. A snapshot whose intake failed has no rule
    evaluated; a detector that broke fails its own rule. Findings of rules that were not evaluated do not count. diagnostics are the
    codes of the snapshot, in order, joined by commas."""
    asked = requests.select("snapshot", "language", "rule").distinct()
    state = intake(files, asked.select("snapshot", "language").distinct(), max_files, max_bytes)
    told = findings.select("snapshot", "rule", "finding").distinct().groupBy("snapshot", "rule").agg(F.count(F.lit(1)).alias("_found"))
    broke = failures.select("snapshot", "rule").distinct().withColumn("_broke", F.lit(True))
    known = supported.select("language", "rule").distinct().withColumn("_known", F.lit(True))
    rows = asked.join(known, ["language", "rule"], "left").join(told, ["snapshot", "rule"], "left").join(broke, ["snapshot", "rule"], "left").join(state, "snapshot")
    failed = F.size("codes") > 0
    known_, broke_ = F.coalesce("_known", F.lit(False)), F.coalesce("_broke", F.lit(False))
    status = F.when(F.col("refused"), REFUSED).when(~known_, UNSUPPORTED).when(failed | broke_, FAILED).otherwise(EVALUATED)
    rows = rows.select("snapshot", "rule", known_.alias("supported"), status.alias("status"), "units", "refused", "codes", F.coalesce("_found", F.lit(0)).alias("_found"), (known_ & broke_ & ~failed).alias("_error"))
    rows = rows.withColumn("evaluated", F.col("status") == EVALUATED)
    # a snapshot has as many rows as rules, which are few
    whole = W.partitionBy("snapshot")
    own = F.array_compact(F.array(F.when(F.max("_error").over(whole), "DETECTOR_ERROR"), F.when(~F.min("supported").over(whole), "UNSUPPORTED_RULE"), F.lit(ALWAYS)))
    text = F.when(F.col("refused"), "DUPLICATE_SOURCE").otherwise(F.array_join(F.array_sort(F.array_union("codes", own)), ","))
    found = F.when(F.col("evaluated"), F.col("_found")).otherwise(0)
    return rows.select("snapshot", "rule", "supported", "evaluated", "status", "units", found.alias("findings"), text.alias("diagnostics"))


def results(covered: DataFrame) -> DataFrame:
    """(snapshot, requested_rules, analyzed_rules, applicable_rules, unsupported_rules, findings, diagnostics) of coverage(): the rules in
    order, joined by commas. A rule that was asked but not evaluated is unsupported."""
    rules = lambda name, which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("rule")))), ",").alias(name)
    return covered.groupBy("snapshot").agg(
        rules("requested_rules", F.lit(True)), rules("analyzed_rules", F.col("evaluated")), rules("applicable_rules", F.col("findings") > 0),
        rules("unsupported_rules", ~F.col("evaluated")), F.sum("findings").alias("findings"), F.max("diagnostics").alias("diagnostics"),
    )


def observed(covered: DataFrame) -> tuple[DataFrame, Observation]:
    """coverage() with counts of rules by status, to be had from the observation once an action has read the rows."""
    seen = Observation()
    by = [F.count_if(F.col("status") == s).alias(s) for s in (EVALUATED, FAILED, UNSUPPORTED, REFUSED)]
    return covered.observe(seen, F.count(F.lit(1)).alias("rules"), *by, F.sum("findings").alias("findings")), seen
