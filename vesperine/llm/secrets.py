"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. A ledger holds
the findings of each (blob, rule version) pair that was ever scanned; a run
scans only pairs it has not seen, one representative row per blob, and joins
findings back to every path that holds the blob. All work is done by DataFrame
expressions.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperine.llm.common import joined_to_groups, write_shared


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # whose length is checked; 0 is the whole match
    least: int


# The base rules, in their listed order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Rules the method adds; public credential formats.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
)
RULES = BASE_RULES + MORE_RULES
FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _long_enough(rule: Rule) -> str:
    """A pattern that some kept match must meet: what ends a rule's pattern is
    its repeated class, so the least length is put in place of the plus."""
    if rule.group or not rule.pattern.endswith("]+"):
        return rule.pattern
    fixed = rule.pattern[: rule.pattern.rindex("[")]
    if any(c in fixed for c in "+*?.("):
        return rule.pattern
    length = len(re.sub(r"\[[^]]*\]", "x", fixed))  # a class is one character
    return f"{rule.pattern[:-1]}{{{rule.least - length},}}"


def version_of(rules: tuple[Rule, ...], label: str = "") -> str:
    """The rules' version in a ledger: a label and a hash of all they say, so
    that changed rules never reuse findings."""
    return f"{label}{hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]}"


def find(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: leftmost non-overlapping matches, those too short
    dropped afterwards. Offsets count code points; ``end`` is exclusive."""
    nothing = F.array().cast(FINDING)
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length).alias("all"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("part"),
    )
    state = "struct<pos:int,out:" + FINDING + ">"

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(x["all"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        out = F.when(x["part"] >= rule.least, F.concat(acc["out"], one.cast(FINDING))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), out.alias("out")).cast(state)

    zero = F.struct(F.lit(0).alias("pos"), nothing.alias("out")).cast(state)
    spans = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(_long_enough(rule)), spans).otherwise(nothing)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans by start, then the rules' order."""
    return F.array_sort(F.concat(*[find(text, rule, k) for k, rule in enumerate(rules)]))


def scan(
    versions: DataFrame,
    path_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    label: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(paths with findings, the ledger with this run's blobs added).

    The first holds one row per input row: ``path, blob, findings``. The second
    holds ``blob, rule_version, findings``, one row per pair, and is stored in
    the shared folder, so that the next run can take it. A rule version is
    ``label`` and a hash of the rules. A null text is the empty blob; a null
    path is a path; repeated rows each get their findings; an empty table gives
    no rows and leaves the ledger as it is. Paths may be of any orderable type.
    """
    rule_version = version_of(rules, label)
    rows = versions.select(F.col(path_col).alias("__path"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn(
        "blob", F.sha2(F.col("__text").cast("binary"), 256)
    )
    paths = write_shared(rows.select("__path", "blob"), "secret-paths")
    counted = paths.groupBy("blob").agg(F.min("__path").alias("__rep"), F.count(F.lit(1)).alias("__n"))
    blobs = counted.select("blob", "__rep")
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = rows.join(
        blobs.withColumnRenamed("blob", "__blob"), (F.col("blob") == F.col("__blob")) & F.col("__path").eqNullSafe(F.col("__rep"))
    )
    scanned = unseen.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("__text"), rules).alias("findings"))
    # A path that repeats a version is scanned twice but recorded once.
    scanned = scanned.groupBy("blob", "rule_version").agg(F.first("findings").alias("findings"))
    new = write_shared(scanned, "secret-ledger")
    whole = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    hits = whole.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    hits = write_shared(hits.join(counted.select("blob", "__n"), "blob"), "secret-hits")
    out = joined_to_groups(paths, hits, "blob", "__n", "__path")
    return (
        out.select(F.col("__path").alias(path_col), "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings")),
        whole,
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
