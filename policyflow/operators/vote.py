"""Vote between two response sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, numbers, text as tx
from .ordered import last_per_key

FIELDS = ["inferred_code", "confidence", "source", "ref_page", "ref_sentence"]


def vote(primary: Column, secondary: Column) -> dict[str, Column]:
    """Expressions of the decision for two response structs (null fields count as absent).

    Equal codes: mean score plus 0.15, at most 1. Different codes: the higher score wins, the primary on a tie, times 0.7.
    The label is taken from the unrounded score.
    """
    code = [tx.strip(tx.text_or_empty(r["inferred_code"])) for r in (primary, secondary)]
    score = [numbers.label_score(F.coalesce(r["confidence"], F.lit("low"))) for r in (primary, secondary)]
    agree = codes.same_code(code[0], code[1])
    lead = agree | (score[0] >= score[1])
    raw = F.when(agree, F.least(score[0] * 0.5 + score[1] * 0.5 + 0.15, F.lit(1.0))).otherwise(
        F.greatest(score[0], score[1]) * 0.7
    )

    def evidence(field):
        return F.when(lead, tx.text_or_empty(primary[field])).otherwise(tx.text_or_empty(secondary[field]))

    own_source = F.when(agree, F.coalesce(primary["source"], secondary["source"], F.lit(""))).otherwise(evidence("source"))
    return {
        "final_code": F.when(agree, tx.first_filled(code[0], code[1])).when(lead, code[0]).otherwise(code[1]),
        "score": F.round(raw, 3),
        "label": numbers.score_label(raw),
        "agreement": agree,
        "source": own_source,
        "ref_page": evidence("ref_page"),
        "ref_sentence": evidence("ref_sentence"),
        "provider": F.lit("ensemble"),
    }


def with_secondary(primary: DataFrame, secondary: DataFrame, keys: list[str], pos: str, fields: list[str]) -> DataFrame:
    """Primary rows with the last secondary row of their trimmed key as the struct ``__s``, null where there is none."""
    probe = primary.withColumns({f"__{k}": tx.strip(tx.text_or_empty(F.col(k))) for k in keys})
    probe_keys = [f"__{k}" for k in keys]
    other = secondary.select(
        *[tx.strip(tx.text_or_empty(F.col(k))).alias(f"__{k}") for k in keys], F.col(pos).alias("__pos"), F.struct(*fields).alias("__s")
    )
    return probe.join(last_per_key(other, probe_keys, "__pos").drop("__pos"), probe_keys, "left").drop(*probe_keys)


def vote_batch(
    primary: DataFrame, secondary: DataFrame, keys: list[str], pos: str, fields: list[str] = FIELDS
) -> DataFrame:
    """One decision per primary row; the last secondary row of a key takes part, a missing one counts as empty."""
    joined = with_secondary(primary.withColumn("__p", F.struct(*fields)), secondary, keys, pos, fields)
    decided = vote(F.col("__p"), F.col("__s"))
    keep = [c for c in primary.columns if c not in fields]
    return joined.select(*keep, *[e.alias(n) for n, e in decided.items()])
