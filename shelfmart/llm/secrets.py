"""Secret scan with an incremental ledger of blobs.

A text is a blob, named by its SHA-256. The ledger holds which (blob, rule version) pairs have been scanned and what was
found. A run scans the blobs the ledger lacks under the rules' version, once each however many paths hold them, adds
them to the ledger and joins the findings back to every path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.llm.common import table, written
from shelfmart.llm.spans import SPAN, count_of, joined, spans


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    keep: Callable[[Column], Column]
    judged_by: str  # what `keep` asks for, in words; part of the rules' version
    needs: tuple[str, ...]  # a text with a match contains one of these


# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = [
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, "12 characters of value", (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]++", lambda m: F.length(m) >= 18, "18 characters", ("AKIA",)),
    # runs of at least 16 only: a shorter run fails as a whole and begins or ends no other match
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", lambda m: F.lit(True), "16 characters", ()),
]
MORE_RULES = [
    # the whole block; its first line alone where the last one is missing
    Rule(
        "pem",
        r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----"
        r"(?:(?:(?!-----)[\s\S])*+-----END (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----)?",
        lambda m: F.lit(True), "any", ("PRIVATE KEY-----",),
    ),
    Rule("forge", r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}+", lambda m: F.lit(True), "36 characters", ("gh",)),
]
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: list[Rule] = RULES) -> str:
    """Changes whenever a rule does, so that all blobs are scanned again under it."""
    text = "\n".join(f"{r.name}\t{r.pattern}\t{r.judged_by}" for r in rules)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def findings(text: Column, rules: list[Rule] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules."""

    def possible(rule: Rule) -> Column | None:
        return reduce(or_, [F.contains(text, F.lit(part)) for part in rule.needs]) if rule.needs else None

    found = F.concat(*[spans(text, kind, r.pattern, r.keep, possible(r)) for kind, r in enumerate(rules)])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])))
    return F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).cast(SPAN)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, version string, found {SPAN}")


def scan_unseen(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the blobs of `docs` that `ledger` lacks under the version of `rules`. Each blob is shuffled once
    per task that holds it and scanned once."""
    version = rules_version(rules)
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    seen = ledger.where(F.col("version") == version).select("blob")
    unseen = blobs.dropDuplicates(["blob"]).join(seen, "blob", "left_anti")
    return unseen.select("blob", F.lit(version).alias("version"), findings(F.col("body"), rules).alias("found"))


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Scan `docs`; return (its rows with `blob` and `found`, the ledger with the new rows).

    Null text counts as empty. Repeated rows stay and get the same findings. An empty table gives no rows and leaves the
    ledger as it is. Columns of `docs` named `blob` or `found` are replaced; all others are kept.
    """
    spark = docs.sparkSession
    old = empty_ledger(spark) if ledger is None else ledger
    new = written(scan_unseen(docs, old, rules, text), "ledger")
    whole = old.unionByName(new)
    version = rules_version(rules)
    hits = whole.where((F.col("version") == version) & (F.size("found") > 0)).select("blob", "found")
    paths = docs.drop("blob", "found").withColumn("blob", blob_id(F.col(text)))
    out = paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))
    return out, whole


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < len(BASE_RULES))
    names = [rule.name for rule in RULES]
    return paths.select(
        "doc_id",
        *[count_of(found, kind).alias(f"n_{rule.name}") for kind, rule in enumerate(BASE_RULES)],
        F.sha2(joined(base, names).cast("binary"), 256).alias("base_sha256"),
        joined(found, names).alias("spans"),
    )
