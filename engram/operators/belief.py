"""Belief projection: what the claims on record say about a proposition.

Claims of the same actor or on the same evidence are one voice, transitively;
a voice counts with its most confident claim, voices combine as 1 - prod(1 - c).
Voices are found as connected components over the claims' keys, so a proposition
that a third of all claims are about is never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.components import connected_components


@dataclass(frozen=True)
class Policy:
    """accept and material are the thresholds of a score that decides and of one that matters."""

    id: str = "policy:baseline"
    accept: float = 0.7
    material: float = 0.3
    modes: tuple[str, ...] = ("observed", "stated", "inferred", "imported")

    def custom(self, accept: float | None = None, material: float | None = None, modes: tuple[str, ...] | None = None) -> Policy:
        new = replace(self, id=self.id.removesuffix("+custom") + "+custom", accept=self.accept if accept is None else accept, material=self.material if material is None else material, modes=self.modes if modes is None else tuple(modes))
        if not 0 <= new.material <= new.accept <= 1:
            raise ValueError("0 <= material <= accept <= 1")
        return new


BASELINE = Policy()
FORECAST = Policy("policy:forecast", modes=("predicted", "inferred"))
POLICIES = {"baseline": BASELINE, "forecast": FORECAST}


def eligibility(claims: DataFrame, policy: Policy = BASELINE, at: Column | None = None) -> DataFrame:
    """Add confidence (0.5 where none is stated) and excluded (the first reason, or null)."""
    at = F.current_timestamp() if at is None else at
    mode = F.coalesce("mode", F.lit(""))
    reason = (
        F.when(F.coalesce("state", F.lit("")) != "active", "not_visible")
        .when(F.col("status").isin("retracted", "superseded", "expired"), F.col("status"))
        .when(~F.coalesce(F.col("status") == "active", F.lit(False)), "not_visible")
        .when((F.col("valid_from") > at) | (F.col("valid_until") <= at), "outside_valid_time")
        .when((mode == "hypothetical") & ~F.lit("hypothetical" in policy.modes), "hypothetical_not_requested")
        .when((mode == "predicted") & ~F.lit("predicted" in policy.modes), "prediction_not_requested")
        .when(~mode.isin(*policy.modes), "policy_excluded")
    )
    stated = F.when(F.coalesce("confidence", F.lit(-1.0)) < 0, 0.5).otherwise(F.col("confidence"))
    return claims.withColumn("confidence", F.least(F.greatest(stated, F.lit(0.0)), F.lit(1.0))).withColumn("excluded", reason)


def voices(sides: DataFrame) -> DataFrame:
    """(target, side, voice, confidence) from rows target, side, claim, actor, evidence (array), confidence."""
    scope = F.concat_ws("|", "target", "side")
    tag = lambda kind, c: F.concat_ws("|", scope, F.lit(kind), c)
    actor = F.when(F.length("actor") > 0, tag("a", F.col("actor")))
    rows = sides.select("target", "side", "claim", "confidence", F.array_compact(F.concat(F.array(actor), F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: tag("e", e)))).alias("keys"))
    named = rows.withColumn("first", F.try_element_at("keys", F.lit(1)))
    links = named.filter("first is not null").select(F.col("first").alias("a"), F.explode("keys").alias("b")).distinct()
    groups = connected_components(links)
    joined = named.join(groups.select(F.col("node").alias("first"), "component"), "first", "left")
    voice = F.coalesce("component", tag("c", F.col("claim")))
    return joined.groupBy("target", "side", voice.alias("voice")).agg(F.max("confidence").alias("confidence"))


def combined(c: Column) -> Column:
    """1 - prod(1 - c) over a group."""
    sure = F.max(c) >= 1.0
    return F.when(sure, 1.0).otherwise(1.0 - F.exp(F.sum(F.log1p(-F.when(c < 1.0, c)))))


def classify(support: Column, opposition: Column, policy: Policy = BASELINE, engaged: Column | None = None) -> Column:
    """``engaged``: somebody spoke, for, against or uncertain; without it a score above 0 tells."""
    a, m = policy.accept, policy.material
    engaged = (support > 0) | (opposition > 0) if engaged is None else engaged
    return (
        F.when(~engaged, "insufficient")
        .when((support >= a) & (opposition < m), "accepted")
        .when((opposition >= a) & (support < m), "rejected")
        .when((support >= m) & (opposition >= m), "contested")
        .otherwise("uncertain")
    )


#: stages that a projection leaves out, to be told with its results
MISSING_STAGES = ("trust", "evidence_quality")


def uncertainty(beliefs: DataFrame, policy: Policy = BASELINE) -> DataFrame:
    """(id, level, reasons): how uncertain each answer of ``project`` is and why.

    Level total (nobody spoke), high (contested or undecided), medium (opposition that
    matters) or low. Reasons: no_eligible_claim, both_sides, single_voice,
    uncertain_claims, excluded_claims.
    """
    level = F.when(F.col("status") == "insufficient", "total").when(F.col("status").isin("contested", "uncertain"), "high").when(F.col("opposition") >= policy.material, "medium").otherwise("low")
    s, o = F.col("support_voices"), F.col("opposition_voices")
    reasons = [((s == 0) & (o == 0), "no_eligible_claim"), ((s > 0) & (o > 0), "both_sides"), ((s == 1) & (o == 0), "single_voice"), (F.col("uncertain_claims") > 0, "uncertain_claims"), (F.col("excluded_claims") > 0, "excluded_claims")]
    return beliefs.select("id", level.alias("level"), F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])).alias("reasons"))


def project(propositions: DataFrame, claims: DataFrame, *, policy: Policy = BASELINE, functional: tuple[str, ...] = (), at: Column | None = None) -> DataFrame:
    """(id, support, opposition, support_voices, opposition_voices, uncertain_claims, excluded_claims, status, policy) of every proposition.

    :param propositions: id, subject, predicate (local name), object: the live ones.
    :param claims: id, target, actor, stance, mode, confidence, status, state,
        valid_from, valid_until, evidence (array). Claims on unknown propositions and
        repeated rows count for nothing.
    :param functional: predicates with one value: support for another object of the
        same subject counts as opposition.
    """
    judged = eligibility(claims.dropDuplicates(["id"]), policy, at)
    usable = judged.filter("excluded is null")
    direct = usable.filter(F.col("stance").isin("support", "reject")).select("target", F.when(F.col("stance") == "support", "s").otherwise("o").alias("side"), F.col("id").alias("claim"), "actor", "evidence", "confidence")
    sides = direct
    if functional:
        slots = propositions.filter(F.col("predicate").isin(*functional)).select(F.col("id").alias("target"), "subject", "predicate", "object")
        backing = direct.filter("side = 's'").join(slots, "target").select(F.col("target").alias("rival"), "subject", "predicate", F.col("object").alias("other"), "claim", "actor", "evidence", "confidence")
        against = backing.join(slots, ["subject", "predicate"]).filter(F.col("object") != F.col("other"))
        sides = direct.unionByName(against.select("target", F.lit("o").alias("side"), "claim", "actor", "evidence", "confidence"))
    sides = sides.join(propositions.select(F.col("id").alias("target")), "target", "left_semi")
    by_side = voices(sides).groupBy("target", "side").agg(combined(F.col("confidence")).alias("score"), F.count("*").alias("n"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    scores = by_side.groupBy(F.col("target").alias("id")).agg(pick("s", "score").alias("s"), pick("o", "score").alias("o"), pick("s", "n").alias("sn"), pick("o", "n").alias("on"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    # claims that take no side, and those left out, counted once for each proposition
    unsure = F.col("excluded").isNull() & F.coalesce(F.col("stance") == "uncertain", F.lit(False))
    others = judged.groupBy(F.col("target").alias("id")).agg(F.sum(unsure.cast("long")).alias("u"), F.sum(F.col("excluded").isNotNull().cast("long")).alias("x"))
    out = propositions.select("id").join(scores, "id", "left").join(others, "id", "left")
    count = lambda c, name: zero(c, 0).cast("long").alias(name)
    out = out.select("id", zero("s", 0.0).alias("support"), zero("o", 0.0).alias("opposition"), count("sn", "support_voices"), count("on", "opposition_voices"), count("u", "uncertain_claims"), count("x", "excluded_claims"))
    engaged = (F.col("support_voices") > 0) | (F.col("opposition_voices") > 0) | (F.col("uncertain_claims") > 0)
    return out.withColumn("status", classify(F.col("support"), F.col("opposition"), policy, engaged)).withColumn("policy", F.lit(policy.id))


def slots(propositions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(subject, predicate, accepted_values, accepted, leading, contested) of every slot.

    ``accepted_values`` lists the accepted propositions in order, ``accepted`` counts
    them; two are a contradiction to be seen, not settled here. ``leading`` is the best
    supported proposition that isn't insufficient, of equal ones the last.
    """
    rows = propositions.select("id", "subject", "predicate").join(beliefs, "id")
    accepted = F.col("status") == "accepted"
    number = F.split("id", "-")[1].cast("long")
    known = F.when(F.col("status") != "insufficient", F.struct("support", number.alias("n"), "id"))
    out = rows.groupBy("subject", "predicate").agg(
        F.transform(F.array_sort(F.collect_list(F.when(accepted, F.struct(number.alias("n"), "id")))), lambda x: x["id"]).alias("accepted_values"),
        F.max(known).getField("id").alias("leading"),
        F.sum((F.col("status") == "contested").cast("long")).alias("_contested"),
    )
    n = F.size("accepted_values").cast("long")
    return out.select("subject", "predicate", "accepted_values", n.alias("accepted"), "leading", ((n > 1) | (F.col("_contested") > 0)).alias("contested"))
