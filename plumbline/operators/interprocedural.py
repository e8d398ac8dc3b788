"""Security across functions: bounded call summaries, values that meet, guards that prove, refinements, completeness.

Facts come as tables or columns; nothing here reads source text but the completeness certificate, whose scope is two statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: How deep calls are followed, and how many a root may take.
MAX_CALL_DEPTH, MAX_EXPANSIONS = 4, 256
#: States from the one that says least to the one that decides.
STATES = ("UNTAINTED", "SANITIZED", "TAINTED", "UNKNOWN")
#: Fixed value: the form of a host name that a list may allow.
HOST = r"^[a-zA-Z0-9.-]+\.[a-zA-Z0-9-]+$"
#: What a guard of a kind proves, and for which rule.
PROOFS = {"SQL_PARAMETERIZATION": "SEC002", "COMMAND_ARGUMENT_BOUNDARY": "SEC003", "PATH_CONFINEMENT": "SEC004", "SSRF_ALLOWLIST": "SEC006", "XSS_SANITIZATION": "SEC007"}
#: Types of java.lang that are named without an import, and algorithms of the closed scope.
LANG_TYPES = ("String", "Double", "Long", "Integer", "Boolean")
HASHES, CIPHERS = ("sha256", "sha384", "sha512", "sha3-256", "sha3-512"), ("aes-128-gcm", "aes-192-gcm", "aes-256-gcm")


def call_summaries(calls: DataFrame, states: DataFrame, max_depth: int = MAX_CALL_DEPTH, max_expansions: int = MAX_EXPANSIONS) -> DataFrame:
    """(root, expansions, depth_limit, recursion, expansion_limit, state) of each function of states (function, state). calls: (caller,
    callee), one row a call site. A root's calls are followed with the functions on the way: one that is on the way already is
    RECURSION, one beyond max_depth is DEPTH, and a root that takes more than max_expansions is given up. Any of these, or an
    unknown function, makes the state UNKNOWN; else it is the strongest state of what is reached (as max_expansions counts each call,
    expansions is null for a root that was given up). Roots over the limit drop out before a level is expanded, and a caller with more
    calls than any root may take is not expanded at all, so a hub costs a row and not its calls."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.coalesce("state", F.lit("UNKNOWN")))
    known = checkpointed(states.select(F.col("function").alias("f"), rank.alias("s")))
    calls = checkpointed(calls.select("caller", "callee"))
    hubs = calls.groupBy("caller").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_expansions + max_depth).select(F.col("caller").alias("at"))
    hubs = checkpointed(hubs)
    front = known.select(F.col("f").alias("root"), F.col("f").alias("at"), F.array("f").alias("path"))
    facts = None
    spent = front.select("root", F.lit(1).cast("long").alias("spent"))
    over = spent.limit(0).select("root")
    for level in range(max_depth):
        hit = front.join(hubs, "at", "left_semi").select("root").distinct()
        over = checkpointed(over.union(hit).distinct())
        front = front.join(over, "root", "left_anti")
        own = front.join(known, F.col("at") == F.col("f"), "left").groupBy("root").agg(F.max(F.coalesce("s", F.lit(len(STATES)))).alias("s"))
        own = own.select("root", "s", F.lit(False).alias("recursion"), F.lit(False).alias("depth_limit"))
        step = checkpointed(front.join(calls, F.col("at") == F.col("caller")).select("root", "callee", "path", F.array_contains("path", F.col("callee")).alias("again")))
        ends = step.filter(F.col("again") | F.lit(level + 1 >= max_depth)).groupBy("root").agg(F.lit(0).cast("long").alias("s"), F.max("again").alias("recursion"), F.max(~F.col("again")).alias("depth_limit"))
        facts = own.union(ends) if facts is None else facts.union(own).union(ends)
        facts = checkpointed(facts.groupBy("root").agg(F.max("s").alias("s"), F.max("recursion").alias("recursion"), F.max("depth_limit").alias("depth_limit")))
        if level + 1 >= max_depth:
            break
        front = step.filter(~F.col("again")).select("root", F.col("callee").alias("at"), F.concat("path", F.array("callee")).alias("path"))
        more = front.groupBy("root").agg(F.count(F.lit(1)).alias("more"))
        spent = checkpointed(spent.join(more, "root", "left").select("root", (F.col("spent") + F.coalesce("more", F.lit(0))).alias("spent")))
        over = checkpointed(over.union(spent.filter(F.col("spent") > max_expansions).select("root")).distinct())
        front = checkpointed(front.join(over, "root", "left_anti"))
    out = spent.join(facts, "root", "left").join(over.withColumn("expansion_limit", F.lit(True)), "root", "left")
    out = out.na.fill(False, ["recursion", "depth_limit", "expansion_limit"])
    lost = F.col("expansion_limit")
    flagged = lost | F.col("recursion") | F.col("depth_limit")
    state = F.when(flagged, "UNKNOWN").otherwise(F.element_at(F.array(*[F.lit(s) for s in STATES]), F.greatest(F.col("s"), F.lit(1)).cast("int")))
    none = lambda c: F.when(~lost, F.col(c)).alias(c)
    return out.select("root", none("spent").alias("expansions"), none("depth_limit"), none("recursion"), "expansion_limit", state.alias("state"))


def joined_values(values: DataFrame, key: str, facts: tuple[str, ...] = ("object_id", "path_fact", "url_id", "url_part")) -> DataFrame:
    """One row a key: what all values that meet there agree on (a null among others is no agreement; a url and its part only
    together), and whether any is unknown."""
    same = lambda c: (F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c))
    null = lambda c: F.count(c) == 0
    agreed = {c: same(c) for c in facts}
    url = (agreed["url_id"] | null("url_id")) & (agreed["url_part"] | null("url_part"))
    columns = [F.when(agreed[c] & (url if c.startswith("url") else F.lit(True)), F.min(c)).alias(c) for c in facts]
    return values.groupBy(key).agg(*columns, F.bool_or(F.col("state") == "UNKNOWN").alias("unknown"))


def guard_proof(language: Column, call: Column, normalized: Column, target_root: Column, prefix_is_root: Column, prefix_root: Column, prefix: Column, url_part: Column, allowed: Column) -> Column:
    """What a condition proves when it holds: PATH_CONFINEMENT, SSRF_ALLOWLIST, or null. startsWith proves a normalized path inside its
    root: in Java if the prefix is that root as a path, elsewhere if it is its text and one slash. equals, includes, == and !=
    (which proves where it fails) prove the host of a url if all they allow are whole host names."""
    inside = normalized & F.when(language == "JAVA", prefix_is_root & (prefix_root == target_root)).otherwise(prefix == F.concat(F.rtrim(target_root, F.lit("/")), F.lit("/")))
    hosts = (url_part == "host") & (F.size(allowed) > 0) & F.forall(allowed, lambda h: F.coalesce(h.rlike(HOST), F.lit(False)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when((call == "startsWith") & yes(inside), "PATH_CONFINEMENT").when(call.isin("equals", "includes", "===", "!==", "==", "!=") & yes(hosts), "SSRF_ALLOWLIST")


def guard_doubt(call: Column, proof: Column, has_url: Column) -> Column:
    """What a guard that proves nothing leaves open."""
    return F.when(proof.isNull() & (call == "startsWith"), "CONFINEMENT_UNPROVEN").when(proof.isNull() & call.isin("equals", "includes") & has_url, "ALLOWLIST_UNPROVEN")


def proven_branch(call: Column, negated: Column, proof: Column) -> Column:
    """The branch that a proof holds in: THEN or ELSE."""
    return F.when(proof.isNotNull(), F.when(negated != call.isin("!=", "!=="), "ELSE").otherwise("THEN"))


def proof_rule(proof: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROOFS.items() for x in kv]), proof)


def qualified_java(name: Column, bound: Column, imported: Column) -> Column:
    """The full name of a Java type that is written without an import: the common types of java.lang unless the name is bound or
    imported, and full names of the platform unless their first word is bound; else null. bound: an array of local names."""
    root = F.element_at(F.split(name, r"\."), 1)
    free = lambda n: ~F.array_contains(bound, n)
    return F.when(name.isin(*LANG_TYPES) & free(name) & ~imported, F.concat(F.lit("java.lang."), name)).when(name.rlike(r"^(?:java|javax|jakarta)(?:\.[A-Za-z_$][\w$]*)+$") & free(root), name)


_STRING = r"""(?:"[^"\\\n]*"|'[^'\\\n]*')"""
_CLOSED = (
    r"""^\s*import\s+([A-Za-z_$][\w$]*)\s+from\s+(?:"(?:node:)?crypto"|'(?:node:)?crypto')\s*;?\s+"""
    rf"""([A-Za-z_$][\w$]*)\.(createHash|createCipheriv)\(\s*({_STRING}(?:\s*,\s*{_STRING})*)\s*\)\s*;?\s*$"""
)


def certificate(language: Column, rule: Column, units: Column, text: Column, blocked: Column, failed: Column) -> Column:
    """COMPLETE if a report of nothing is proof of nothing, else NOT_PROVEN: only for weak cryptography (SEC008) in one TypeScript unit of
    two statements, a default import of crypto and one call of it with literals that choose a secure algorithm, without diagnostics
    and failures."""
    part = lambda i: F.regexp_extract(text, _CLOSED, i)
    given = F.regexp_extract_all(part(4), F.lit(f"({_STRING})"), F.lit(1))
    algorithm = F.lower(F.btrim(F.get(given, 0), F.lit("\"'")))
    hashed = (part(3) == "createHash") & (F.size(given) == 1) & algorithm.isin(*HASHES)
    sealed = (part(3) == "createCipheriv") & (F.size(given) == 3) & algorithm.isin(*CIPHERS)
    closed = text.rlike(_CLOSED) & (part(1) == part(2)) & (hashed | sealed)
    done = (language == "TYPESCRIPT") & (rule == "SEC008") & (units == 1) & closed & (F.size(blocked) == 0) & ~failed
    return F.when(F.coalesce(done, F.lit(False)), "COMPLETE").otherwise("NOT_PROVEN")


def certificate_reasons(status: Column, blocked: Column) -> Column:
    return F.when(status == "COMPLETE", F.array(F.lit("CLOSED_LITERAL_CRYPTO_SCOPE"))).when(F.size(blocked) > 0, F.array_sort(blocked)).otherwise(F.array(F.lit("COMPLETENESS_NOT_PROVEN")))
