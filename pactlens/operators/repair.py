"""Second calls that mend a finding: a quote that its paragraph does not hold, and citations of which none is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.findings import MAX_REFERENCES, json_object, reference_policy, valid_references
from pactlens.functions.text import let, match_key, strip, text_of
from pactlens.operators.classifiers import Classifier, Policy, call_rows, needs_object

#: A repaired quote is at least and at most so many times as long as the one that was asked for.
SHORTEST, LONGEST = 0.5, 2.0


def holds(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text, case and spacing aside. An empty quote stands in every text."""
    return match_key(text).contains(match_key(quote))


def accepts_repair(text: Column, quote: Column, repaired: Column) -> Column:
    """Whether a repaired quote may take a quote's place: it is not empty, the text holds it, and its length is within the bounds."""
    size, asked = F.length(text_of(repaired)), F.length(text_of(quote))
    kept = let(match_key(repaired), lambda k: (k != "") & match_key(text).contains(k))
    return kept & (size <= asked * LONGEST) & (size >= asked * SHORTEST)


def repair_quotes(found: DataFrame, repairer: Classifier, *, quote: str = "quote", text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """found with the quotes mended, and repair: null where the text holds the quote or one of both is empty, else a struct of
    original, repaired, matched, error.

    Only the rows to be mended are called: `repairer` is given the row and answers {"quote": "..."}. An answer that is not accepted,
    an empty one and a failed call leave the quote as it was. Columns raw, attempts, error of found must not exist.
    """
    to_mend = (text_of(F.col(quote)) != "") & (text_of(F.col(text)) != "") & ~holds(F.col(text), F.col(quote))
    marked = found.withColumn("__mend", to_mend)
    called = call_rows(marked, repairer, check=needs_object, policy=policy, only="__mend")
    answer = strip(F.from_json(json_object(F.col("raw")), "struct<quote:string>")["quote"])
    asked = called.withColumn("__new", answer).withColumn("__ok", F.coalesce(accepts_repair(F.col(text), F.col(quote), F.col("__new")), F.lit(False)))
    unfit = F.when((F.col("__new") != "") & ~F.col("__ok"), F.lit("not in the text, or of another length"))
    repair = F.struct(F.col(quote).alias("original"), F.col("__new").alias("repaired"), F.col("__ok").alias("matched"), F.coalesce("error", unfit).alias("error"))
    columns = [F.col(f"`{c}`") for c in found.columns if c != quote]
    mended = asked.select(*columns, F.when(F.col("__mend") & F.col("__ok"), F.col("__new")).otherwise(F.col(quote)).alias(quote), F.when(F.col("__mend"), repair).alias("repair"))
    return mended.select(*[F.col(f"`{c}`") for c in found.columns], "repair")


def regenerate_references(found: DataFrame, asker: Classifier, *, refs: str = "refs", skip_if_none: bool = False, policy: Policy = Policy(attempts=2)) -> DataFrame:
    """found with the valid ones of its references, six at most, and ref_action: keep, regenerated or none_valid.

    A finding of whose references none is valid leaves with skip_if_none, else it is called again, and alone: `asker` is given the row
    and answers {"legal_references": [...]}, of which the valid ones are taken. Where there are none, or the call fails, the finding
    stays without references. A finding without references is not asked for any.
    """
    judged = found.withColumn("__policy", reference_policy(F.col(refs), skip_if_none)).filter("__policy.action <> 'skip'")
    others = [F.col(f"`{c}`") for c in found.columns if c != refs]
    again = call_rows(judged.filter("__policy.action = 'regenerate'").drop("__policy"), asker, check=needs_object, policy=policy)
    answer = F.from_json(json_object(F.col("raw")), "struct<legal_references:array<string>>")["legal_references"]
    told = again.select(*others, F.slice(valid_references(answer), 1, MAX_REFERENCES).alias(refs))
    told = told.withColumn("ref_action", F.when(F.size(refs) > 0, "regenerated").otherwise("none_valid"))
    kept = judged.filter("__policy.action = 'keep'").select(*others, F.col("__policy.references").alias(refs), F.lit("keep").alias("ref_action"))
    return kept.unionByName(told).select(*[F.col(f"`{c}`") for c in found.columns], "ref_action")
