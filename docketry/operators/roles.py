"""Keys of matters, and roles of amounts, by rules that come as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import stable_id
from docketry.functions.text import folded, spans
from docketry.operators.linkage import first_match


def party(value: Column) -> Column:
    """A party's name without case, stops and spacing, an ampersand read as ``and``."""
    words = F.regexp_extract_all(F.regexp_replace(F.replace(F.lower(value), F.lit("&"), F.lit(" and ")), r"\.", ""), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(words, " ")


def number(value: Column) -> Column:
    """The digits of a value as a number without leading zeros; empty where it has none."""
    return F.coalesce(F.regexp_replace(value, r"\D", "").try_cast("decimal(38,0)").cast("string"), F.lit(""))


#: How a component is normalised (fixed values).
NORMAL = {"number": number, "party": party, "text": folded}


@dataclass(frozen=True)
class Component:
    """A part of a key: group ``group`` of the identity's regex, normalised as ``kind``."""

    role: str
    group: int
    kind: str = "text"


@dataclass(frozen=True)
class Identity:
    """One kind of transaction: where its regex matches exactly once, its components tell which one it is."""

    name: str
    role: str
    regex: str
    components: tuple[Component, ...] = ()


@dataclass(frozen=True)
class KeyPolicy:
    """Segments of ``rule_name`` are keyed by their only project number and their only transaction."""

    name: str
    rule_name: str
    project: str
    identities: tuple[Identity, ...] = field(default=())
    project_kind: str = "number"


def matter_keys(segments: DataFrame, policy: KeyPolicy) -> DataFrame:
    """``segments`` (rule_name, raw_text and others) with status, reasons, resolver, matter_key and components.

    Out of the policy's scope is insufficient. Several projects, or several transactions, are ambiguous; none of
    either, or a component that is missing, is insufficient; all others are resolved. The same project named
    again is a reason but no obstacle. ``components`` has role, raw, normal, char_start and char_end within the
    segment. Null texts state nothing; an empty input gives no row. All rows are handled where they lie.
    """
    text = F.coalesce("raw_text", F.lit(""))
    norm = NORMAL[policy.project_kind]
    named = lambda regex, group, m: F.regexp_extract(m["raw"], regex, group)
    rows = segments.withColumn("_projects", spans(text, policy.project))
    rows = rows.withColumn("_ids", F.filter(F.array_distinct(F.transform("_projects", lambda m: norm(named(policy.project, 1, m)))), lambda x: x != ""))
    for i, one in enumerate(policy.identities):
        rows = rows.withColumn(f"_m{i}", spans(text, one.regex))
    count = reduce(lambda a, b: a + b, (F.size(f"_m{i}") for i in range(len(policy.identities))), F.lit(0))
    rows = rows.withColumn("_n", count)

    def part(role: str, m: Column, raw: Column, normal: Column) -> Column:
        at = m["char_start"] + F.greatest(F.instr(m["raw"], raw) - 1, F.lit(0))
        return F.struct(F.lit(role).alias("role"), raw.alias("raw"), normal.alias("normal"), at.alias("char_start"), (at + F.length(raw)).alias("char_end"))

    first = F.get("_projects", F.lit(0))
    project = part("project_id", first, named(policy.project, 1, first), F.get("_ids", F.lit(0)))
    found, resolver = F.when(F.lit(False), F.array(project)), F.when(F.lit(False), "")
    for i, one in enumerate(policy.identities):
        m = F.get(f"_m{i}", F.lit(0))
        parts = [F.struct(F.lit("transaction_role").alias("role"), m["raw"].alias("raw"), F.lit(one.role).alias("normal"), m["char_start"].alias("char_start"), m["char_end"].alias("char_end"))]
        parts += [part(c.role, m, named(one.regex, c.group, m), NORMAL[c.kind](named(one.regex, c.group, m))) for c in one.components]
        only = (F.col("_n") == 1) & (F.size(f"_m{i}") == 1)
        found, resolver = found.when(only, F.array(project, *parts)), resolver.when(F.size(f"_m{i}") > 0, one.name)
    rows = rows.withColumn("_parts", found).withColumn("_in", F.coalesce(F.col("rule_name") == policy.rule_name, F.lit(False)))
    missing = F.transform(F.filter("_parts", lambda c: F.coalesce(c["normal"], F.lit("")) == ""), lambda c: F.concat(F.lit("missing_"), c["role"]))
    clear = (F.size("_ids") == 1) & (F.col("_n") == 1)
    why = F.array_compact(
        F.array(
            F.when(F.size("_ids") == 0, "missing_project_id").when(F.size("_ids") > 1, "multiple_project_ids").when(F.size("_projects") > 1, "repeated_same_project_id"),
            F.when(F.col("_n") == 0, "unrecognized_transaction_identity").when(F.col("_n") > 1, "multiple_transaction_identity_matches"),
        )
    )
    rows = rows.withColumn("_missing", F.when(clear, missing).otherwise(F.array().cast("array<string>")))
    reasons = F.when(~F.col("_in"), F.array(F.lit("segment_rule_not_in_policy_scope"))).otherwise(F.concat(why, F.col("_missing")))
    status = (
        F.when(~F.col("_in"), "insufficient_identity").when((F.size("_ids") > 1) | (F.col("_n") > 1), "ambiguous")
        .when((F.size("_ids") == 0) | (F.col("_n") == 0) | (F.size("_missing") > 0), "insufficient_identity").otherwise("resolved")
    )
    keyed = F.array_join(F.transform("_parts", lambda c: F.concat(c["role"], F.lit("="), c["normal"])), "\x1f")
    key = stable_id("matter-key", F.lit(policy.name), resolver, keyed)
    keep = segments.columns
    out = rows.withColumn("status", status).withColumn("reasons", reasons).withColumn("resolver", F.when(F.col("_in") & (F.col("status") != "ambiguous"), resolver))
    return out.select(*keep, "status", "reasons", "resolver", F.when(F.col("status") == "resolved", key).alias("matter_key"), F.when(F.col("_in"), F.col("_parts")).alias("components"))


def key_groups(keyed: DataFrame) -> DataFrame:
    """(matter_key, occurrences, units, artifacts) of keys that two segments or more resolve to."""
    groups = keyed.where("status = 'resolved'").groupBy("matter_key").agg(F.count_distinct("segment_id").alias("occurrences"), F.count_distinct("evidence_id").alias("units"), F.count_distinct("artifact_id").alias("artifacts"))
    return groups.where("occurrences >= 2")


def amount_roles(keyed: DataFrame, facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Amounts within resolved segments with status, role and the names of the rules that match their exact span.

    A rule is (name, role, regex); the first group of the regex is the amount. No match is unknown, one
    match assigned, more are ambiguous, even of one role. ``facts``: fact_id, evidence_id, normalized_text,
    char_start, char_end; joined on the unit, spans compared exactly. Repeated facts count once.
    """
    text = F.coalesce("raw_text", F.lit(""))

    def hits(name: str, role: str, regex: str) -> Column:
        def hit(m: Column) -> Column:
            raw = F.regexp_extract(m["raw"], regex, 1)
            # the group ends the match in rules of this kind; else its first place in it counts
            at = F.when(m["raw"].endswith(raw), F.length(m["raw"]) - F.length(raw)).otherwise(F.instr(m["raw"], raw) - 1) + m["char_start"] + F.col("segment_start")
            return F.struct(F.lit(name).alias("rule"), F.lit(role).alias("role"), at.alias("at"), (at + F.length(raw)).alias("end"))

        return F.transform(spans(text, regex), hit)

    inside = keyed.where("status = 'resolved'").select("segment_id", "evidence_id", "artifact_id", "matter_key", "raw_text", F.col("char_start").alias("segment_start"), F.col("char_end").alias("segment_end"))
    inside = inside.withColumn("hits", F.flatten(F.array(*(hits(*r) for r in rules)))).drop("raw_text")
    f = facts.where("char_start is not null and char_end is not null").select("fact_id", "evidence_id", "normalized_text", F.col("char_start").alias("fs"), F.col("char_end").alias("fe")).distinct()
    both = inside.join(f, "evidence_id").where("fs >= segment_start and fe <= segment_end")
    matched = F.filter("hits", lambda h: (h["at"] == F.col("fs")) & (h["end"] == F.col("fe")))
    rows = both.withColumn("m", matched)
    status = F.when(F.size("m") == 0, "unknown").when(F.size("m") == 1, "assigned").otherwise("ambiguous")
    return rows.select("segment_id", "evidence_id", "artifact_id", "matter_key", "fact_id", "normalized_text", status.alias("status"), F.when(F.size("m") == 1, F.get("m", F.lit(0))["role"]).alias("role"), F.transform("m", lambda h: h["rule"]).alias("rules"))


def role_populations(assigned: DataFrame) -> DataFrame:
    """(matter_key, role, occurrences, units, artifacts, values, conflict): amounts of one matter and role, two or more.

    ``values`` are the distinct values in order; two or more are a conflict.
    """
    groups = assigned.where("status = 'assigned'").groupBy("matter_key", "role").agg(
        F.count("*").alias("occurrences"), F.count_distinct("evidence_id").alias("units"), F.count_distinct("artifact_id").alias("artifacts"), F.array_sort(F.collect_set("normalized_text")).alias("values")
    )
    return groups.where("occurrences >= 2").withColumn("conflict", F.size("values") >= 2)


@dataclass(frozen=True)
class ContextRule:
    """A value for an amount whose surroundings hold all of ``all``, one of ``any`` and none of ``none``.

    The text before the amount must match ``left`` and the text after it ``right``, where given; the amount
    must be one of ``numbers``, and stand before or after the page's first match of ``before`` or ``after``.
    ``kinds`` are the values of the first axis that a rule of the second holds for.
    """

    value: str
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    left: str = ""
    right: str = ""
    before: str = ""
    after: str = ""
    kinds: tuple[str, ...] = ()

    def holds(self, near: Column, left: Column, right: Column, number: Column, start: Column, page: Column, kind: Column | None = None) -> Column:
        has = lambda t: near.contains(" ".join(t.lower().split()))
        parts = [has(t) for t in self.all] + [~has(t) for t in self.none]
        if self.any:
            parts.append(reduce(lambda a, b: a | b, map(has, self.any)))
        if self.numbers:
            parts.append(number.isin(*self.numbers))
        if self.left:
            parts.append(left.rlike(self.left))
        if self.right:
            parts.append(right.rlike(self.right))
        if self.before:
            parts.append(start < F.get(spans(page, self.before), F.lit(0))["char_start"])
        if self.after:
            parts.append(start > F.get(spans(page, self.after), F.lit(0))["char_end"])
        if kind is not None:
            parts.append(kind.isin(*self.kinds))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def in_context(amounts: DataFrame, rules: list[ContextRule], default: str, radius: int, side: int, kind: str | None = None) -> Column:
    """The value of the first rule that holds for each amount (text, char_start, char_end, normalized_text)."""
    text, start, end = F.col("text"), F.col("char_start"), F.col("char_end")
    piece = lambda a, b: folded(F.substring(text, a + 1, b - a))
    zero = F.lit(0)
    near = piece(F.greatest(start - radius, zero), F.least(end + radius, F.length(text)))
    left, right = piece(F.greatest(start - side, zero), start), piece(end, F.least(end + side, F.length(text)))
    of = None if kind is None else F.col(kind)
    return first_match([(r.value, r.holds(near, left, right, F.col("normalized_text"), start, text, of)) for r in rules], default)
