"""Security: secret and purpose predicates, API tables, flow lattice, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules.
RULES = {
    "SEC001": "hard-coded secret",
    "SEC002": "SQL injection",
    "SEC003": "command injection",
    "SEC004": "path traversal",
    "SEC005": "unsafe deserialisation",
    "SEC006": "server-side request forgery",
    "SEC007": "cross-site scripting",
    "SEC008": "weak cryptography",
    "SEC009": "insecure randomness",
    "SEC010": "dynamic code evaluation",
}
#: Sinks by rule and language.
SINKS = {
    ("SEC002", "JAVA"): ("java.sql.Statement.execute", "java.sql.Statement.executeQuery", "java.sql.Statement.executeUpdate"),
    ("SEC002", "TYPESCRIPT"): ("pg.Client.query", "pg.Pool.query"),
    ("SEC003", "JAVA"): ("java.lang.Runtime.exec", "java.lang.ProcessBuilder.start"),
    ("SEC003", "TYPESCRIPT"): ("child_process.exec", "child_process.execSync", "child_process.spawn", "child_process.spawnSync"),
    ("SEC004", "JAVA"): ("java.nio.file.Files.readAllBytes", "java.nio.file.Files.readString", "java.nio.file.Files.newInputStream"),
    ("SEC004", "TYPESCRIPT"): ("fs.readFile", "fs.readFileSync", "fs.createReadStream"),
    ("SEC005", "JAVA"): ("java.io.ObjectInputStream.readObject", "java.io.ObjectInputStream.readUnshared"),
    ("SEC006", "JAVA"): ("java.net.URL.openConnection", "java.net.URL.openStream"),
    ("SEC006", "TYPESCRIPT"): ("http.get", "http.request", "https.get", "https.request"),
    ("SEC007", "JAVA"): ("javax.servlet.jsp.JspWriter.write", "javax.servlet.jsp.JspWriter.print"),
    ("SEC007", "TYPESCRIPT"): ("innerHTML", "outerHTML"),
    ("SEC008", "JAVA"): ("java.security.MessageDigest.getInstance", "javax.crypto.Cipher.getInstance"),
    ("SEC008", "TYPESCRIPT"): ("crypto.createHash", "crypto.createCipheriv"),
    ("SEC009", "JAVA"): ("java.util.Random.nextInt", "java.util.Random.nextLong", "java.util.Random.nextDouble", "java.lang.Math.random"),
    ("SEC009", "TYPESCRIPT"): ("Math.random",),
    ("SEC010", "JAVA"): ("javax.script.ScriptEngine.eval",),
    ("SEC010", "TYPESCRIPT"): ("eval", "Function"),
}
#: Algorithms that are weak, in lower case without hyphens.
WEAK = ("md5", "sha1", "des", "des/ecb/pkcs5padding", "rc4", "descbc")
#: Words that tell a purpose, and names and values that are no secrets.
SENSITIVE = ("password", "secret", "session", "nonce", "csrf", "auth", "reset", "token", "key")
NOT_SECURITY = "(?i)checksum|cache|fingerprint|simulation|shuffle|sample|parser|label|game"
PLACEHOLDER = r"(?i)placeholder|example|changeme|your[_ -]|<|\$\{|process\.env"
#: Shapes of whole values that are secrets.
KNOWN = r"^(?:(?:sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{30,}|AKIA[A-Z0-9]{16})$|-----BEGIN (?:RSA )?PRIVATE KEY-----)"


def sensitive_name(name: Column, words: Sequence[str] = SENSITIVE) -> Column:
    """True if a word of the name is one of `words`; words end at a capital after a small letter and at what is no letter."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), "[^a-z]+")
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))


def secret_parts(name: Column, value: Column) -> dict[str, Column]:
    """The parts of the secret predicate: excused (a placeholder, or a name of another purpose); a known shape; or a telling name
    with 28 or more characters, 12 or more of them distinct, of three or more classes (small, capital, digit, neither letter,
    digit nor underscore), and not all hexadecimal digits and hyphens."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    classes = sum((value.rlike(p).cast("int") for p in ("[A-Z]", "[0-9]", r"(?U)[^\w]")), value.rlike("[a-z]").cast("int"))
    return {
        "excused": value.rlike(PLACEHOLDER) | name.rlike(NOT_SECURITY),
        "known": value.rlike(KNOWN),
        "telling_name": sensitive_name(name),
        "long": F.length(value) >= 28,
        "varied": F.size(F.array_distinct(chars)) >= 12,
        "mixed": classes >= 3,
        "hex": value.rlike("^[0-9a-fA-F-]+$"),
    }


def is_secret(name: Column, value: Column) -> Column:
    p = secret_parts(name, value)
    return ~p["excused"] & (p["known"] | (p["telling_name"] & p["long"] & p["varied"] & p["mixed"] & ~p["hex"]))


def sinks(calls: DataFrame) -> DataFrame:
    """calls (language, api) with the rule whose sink they reach; others drop out. A constant map, no join."""
    table = {f"{lang}:{api}": rule for (rule, lang), apis in SINKS.items() for api in apis}
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    rule = F.try_element_at(F.create_map(*pairs), F.concat_ws(":", "language", "api"))
    return calls.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())


def weak_algorithm(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "-", "").isin(*WEAK)


def randomness_state(tags: Column, explicit: Column, rule: Column) -> Column:
    """CONFIRMED, POTENTIAL, or null for a finding that is dropped, by purpose tags (SECURITY, NONSECURITY)."""
    secure, only_not = F.array_contains(tags, "SECURITY"), F.array_contains(tags, "NONSECURITY") & ~F.array_contains(tags, "SECURITY")
    return (
        F.when((rule == "SEC009") & ~secure, F.lit(None).cast("string"))
        .when((rule == "SEC008") & only_not & ~explicit, F.lit(None).cast("string"))
        .when(explicit | secure, "CONFIRMED")
        .otherwise("POTENTIAL")
    )


def merge_flows(values: DataFrame, key: Sequence[str], max_paths: int = 32) -> DataFrame:
    """values (key, state, sanitized array of rules, paths) joined in the lattice: anything UNKNOWN, or over max_paths paths,
    is UNKNOWN; a TAINTED one makes TAINTED; sanitized ones stay SANITIZED if they share a rule, else TAINTED; none is
    UNTAINTED. Partial aggregation keeps one row a key and task: counts of rules, not lists of values."""
    rows = values.groupBy(*key).agg(
        F.max(F.col("state") == "UNKNOWN").alias("u"),
        F.max(F.col("state") == "TAINTED").alias("t"),
        F.count_if(F.col("state") == "SANITIZED").alias("n"),
        F.sum("paths").alias("paths"),
    )
    each = values.filter("state = 'SANITIZED'").withColumn("rule", F.explode(F.array_distinct("sanitized"))).groupBy(*key, "rule").agg(F.count(F.lit(1)).alias("c"))
    each = each.groupBy(*key).agg(F.collect_list(F.struct("rule", "c")).alias("all"))
    out = rows.join(each, list(key), "left")
    common = F.array_sort(F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<rule:string,c:bigint>>")), lambda x: x["c"] == F.col("n")), lambda x: x["rule"]))
    state = (
        F.when(F.col("u") | (F.col("paths") > max_paths), "UNKNOWN")
        .when(F.col("t"), "TAINTED")
        .when((F.col("n") > 0) & (F.size(common) > 0), "SANITIZED")
        .when(F.col("n") > 0, "TAINTED")
        .otherwise("UNTAINTED")
    )
    return out.select(*key, state.alias("state"), F.when(state == "SANITIZED", F.array_join(common, ",")).otherwise("").alias("sanitized_for"))


def emit(rule: Column, sanitized: Column, has_source: Column, state: Column) -> Column:
    """What a sink reports: nothing if sanitized for the rule or without a source, else POTENTIAL or SUPPORTED."""
    return F.when(F.array_contains(sanitized, rule) | ~has_source, F.lit(None).cast("string")).when(state == "UNKNOWN", "POTENTIAL").otherwise("SUPPORTED")


def distinct_findings(found: DataFrame, key: str = "finding_id", columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(findings once each, conflicting ids): an id may come twice, but only with equal content."""
    columns = list(columns) or [c for c in found.columns if c != key]
    per = found.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("n"), F.min(F.struct(*columns)).alias("s"))
    return per.filter("n = 1").select(key, "s.*"), per.filter("n > 1").select(key)
