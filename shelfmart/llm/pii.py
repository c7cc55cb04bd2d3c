"""Personal data: base patterns, and contexts learned from what they find.

The base patterns give seed entities. The two words before an entity are its lexical pattern. Patterns and the
identifier-like tokens behind them form a graph that is scored in rounds: a pattern scores the share of its instances
that are trusted entities of one kind; a pattern with enough support and a high share makes the untrusted tokens behind
it trusted, which may raise further patterns in the next round. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.llm.common import table, written
from shelfmart.llm.spans import SPAN, count_of, joined, spans

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the kinds. Runs are taken whole (possessive), and a match starts at a run's start or
# where the match before ended; neither changes the matches, both keep the time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A whole token with a digit or an at sign, of any length from LEAST_CANDIDATE on.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LEAST_CANDIDATE = 4  # characters; shorter tokens are counts, days and list numbers
CANDIDATE_KIND = len(KINDS)
CONTEXT_WORDS, CONTEXT_CHARS = 2, 48
MASKS = [f"<{kind}>" for kind in KINDS]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a digit string: every second digit from the right doubled, digit sums added."""
    backward = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(backward, place, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def is_email(value: Column) -> Column:
    return F.lit(True)


def is_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and start."""
    digit = F.rlike(text, F.lit("[0-9]"))
    rules = [
        (EMAIL, is_email, F.contains(text, F.lit("@"))),
        (IP, is_ip, digit),
        (CARD, is_card, digit),
        (PHONE, is_phone, F.contains(text, F.lit("+"))),
    ]
    return F.concat(*[spans(text, kind, *rule) for kind, rule in enumerate(rules)])


def _before(text: Column, start: Column, chars: int) -> Column:
    begin = F.greatest(start - chars, F.lit(0))
    return F.substr(text, begin + 1, start - begin)


def token_spans(text: Column) -> Column:
    """Whole tokens with a digit or an at sign."""
    long_enough = lambda m: F.length(m) >= LEAST_CANDIDATE
    return spans(text, CANDIDATE_KIND, CANDIDATE, long_enough, F.rlike(text, F.lit("[0-9@]")))


def _with_context(text: Column, found: Column) -> Column:
    """Spans with the two words before them, lower case and without digits. Both words have to lie within CONTEXT_CHARS
    characters before the span: a longer one, such as a key or a link, is no lexical context, and the span has none."""

    def context(s: Column) -> Column:
        before = F.lower(_before(text, s["start"], CONTEXT_CHARS))
        # the word at the cut may be the end of a longer one, so a character before it has to be seen
        whole = s["start"] <= CONTEXT_CHARS
        words = F.when(whole, F.regexp_extract(before, r"(?<!\S)(\S+\s+\S+)\s*$", 1)).otherwise(
            F.regexp_extract(before, r"\s(\S+\s+\S+)\s*$", 1)
        )
        return F.nullif(F.regexp_replace(F.regexp_replace(words, "[0-9]+", "0"), r"\s+", " "), F.lit(""))

    return F.transform(
        found,
        lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], context(s).alias("context")),
    )


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Row ids, the kept columns, base spans and the identifier-like tokens outside them, each with its context."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("*", body.alias("_body")).select("*", base_spans(F.col("_body")).alias("_base"))
    tokens = token_spans(F.col("_body"))
    outside = F.filter(
        tokens, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
    )
    return rows.select("*", outside.alias("_tokens")).select(
        *[c for c in rows.columns if c not in ("_body", "_base", text)],
        F.monotonically_increasing_id().alias("_row"),
        _with_context(F.col("_body"), F.col("_base")).alias("_base"),
        _with_context(F.col("_body"), F.col("_tokens")).alias("_tokens"),
    )


def learned_patterns(edges: DataFrame, min_support: int, min_share: float) -> DataFrame:
    """(context, kind) pairs that earn trust. `edges`: context, instance, kind (null: untrusted token), n.

    In each round an instance is trusted with the kind it was found as, or with that of a trusted pattern before it.
    A pattern needs `min_support` different trusted instances of one kind and `min_share` of all its occurrences. A
    pattern that is trusted stays so, and the rounds end when one finds no further pattern.
    """
    patterns = None
    while True:
        scored = edges
        if patterns is not None:
            promoted = (
                edges.where(F.col("kind").isNull())
                .join(patterns.withColumnRenamed("kind", "learned"), "context")
                .groupBy("instance")
                .agg(F.min("learned").alias("learned"))
            )
            scored = edges.join(promoted, "instance", "left").withColumn("kind", F.coalesce("kind", "learned"))
        by_kind = scored.groupBy("context", "kind").agg(
            F.count_distinct("instance").alias("support"), F.sum("n").alias("n")
        )
        best = by_kind.groupBy("context").agg(
            F.sum("n").alias("total"),
            F.max(
                F.when(F.col("kind").isNotNull(), F.struct("n", "support", -F.col("kind")))
            ).alias("top"),
        )
        trusted = best.where(
            (F.col("top.support") >= min_support) & (F.col("top.n") >= F.lit(min_share) * F.col("total"))
        ).select("context", (-F.col("top.col3")).alias("kind"))
        if patterns is not None:
            trusted = trusted.join(patterns, "context", "left_anti")
        fresh = written(trusted, "pii-patterns")
        if fresh.isEmpty():
            return fresh if patterns is None else patterns
        patterns = fresh if patterns is None else written(patterns.unionByName(fresh), "pii-patterns")


def find(
    docs: DataFrame, text: str = "text", min_support: int = 5, min_share: float = 0.9
) -> DataFrame:
    """`docs` without its text, with `base` (spans of the base patterns) and `found` (these and the learned ones), both
    arrays of (kind, start, end, value) by kind and start.

    Null and empty texts have no spans. Repeated rows stay, each with the same spans. Columns of `docs` named like the
    results are replaced; names that begin with an underscore are reserved for the operator. An empty table gives no
    rows.
    """
    rows = written(extracted(docs.drop("base", "found"), text), "pii-spans")
    seeds = rows.select(F.explode(F.concat("_base", "_tokens")).alias("s")).select("s.*")
    edges = written(
        seeds.where(F.col("context").isNotNull())
        .select(
            "context",
            F.lower("value").alias("instance"),
            F.when(F.col("kind") < CANDIDATE_KIND, F.col("kind")).alias("kind"),
        )
        .groupBy("context", "instance", "kind")
        .agg(F.count("*").alias("n")),
        "pii-edges",
    )
    patterns = learned_patterns(edges, min_support, min_share)
    learned = (
        rows.select("_row", F.explode("_tokens").alias("s"))
        .where(F.col("s.context").isNotNull())
        .select("_row", "s.start", "s.end", "s.value", "s.context")
        .join(patterns, "context")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("_learned"))
    )
    base = F.transform("_base", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).cast(SPAN)
    every = F.array_sort(F.concat(base, F.coalesce("_learned", F.array().cast(SPAN))))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.join(learned, "_row", "left").select(*kept, base.alias("base"), every.alias("found"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind's mask. Spans that overlap are replaced as one, by the first's."""
    places = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    label = F.array(*[F.lit(m) for m in MASKS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.get(label, s["kind"]))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(places, start, step, finish)).otherwise(text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *[count_of(F.col("base"), kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found"), KINDS).alias("spans"),
    )
