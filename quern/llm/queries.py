"""The queries of the ten problems, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import capping, components, handwritten, leaks, mixing, overlap, packing, stuffing, terms, tokens
from quern.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _terms_found(s: SparkSession, d: str) -> DataFrame:
    return terms.label_term_marks(table(s, d, "generated_label")).where("mark <> 'useful'").select("field", "term", "mark")


def _packed(s: SparkSession, d: str) -> DataFrame:
    names = ("sequence_metadata", "sequence_run", "generated_label", "source_manifest")
    return packing.pack(packing.sequence_records(*(table(s, d, n) for n in names)))


def _plan(s: SparkSession, d: str, *more: str) -> tuple[DataFrame, ...]:
    return tuple(table(s, d, n) for n in ("split_plan", "repo_alias", *more))


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": _terms_found,
        "p1_terms": lambda s, d: terms.label_term_marks(t(s, d, "generated_label")),
        "p2_found": lambda s, d: handwritten.found(*(t(s, d, n) for n in ("generated_label", "source_manifest", "repo_alias"))),
        "p2_report": lambda s, d: handwritten.report(*(t(s, d, n) for n in ("generated_label", "source_manifest", "repo_alias"))),
        "p2_recurring": lambda s, d: handwritten.recurrence_report(t(s, d, "generated_label"), t(s, d, "repo_alias")),
        "p3_found": lambda s, d: overlap.found(t(s, d, "generated_label")),
        "p3_report": lambda s, d: overlap.report(t(s, d, "generated_label")),
        "p4_found": lambda s, d: components.torn_windows(*_plan(s, d)),
        "p4_splits": lambda s, d: components.plan_splits(*_plan(s, d, "split_target")),
        "p4_report": lambda s, d: components.plan_report(*_plan(s, d, "split_target")),
        "p5_budget": lambda s, d: tokens.budget(*(t(s, d, n) for n in ("documents", "sequence_metadata", "generated_label", "source_manifest"))),
        "p5_loss_tokens": lambda s, d: tokens.loss_tokens(*(t(s, d, n) for n in ("sequence_metadata", "generated_label", "source_manifest"))),
        "p5_document_tokens": lambda s, d: tokens.document_tokens(t(s, d, "documents")),
        "p6_found": lambda s, d: capping.labels_beyond_cap(t(s, d, "generated_label")).select("label_id"),
        "p6_report": lambda s, d: capping.report(t(s, d, "generated_label")),
        "p7_found": lambda s, d: packing.divided(_packed(s, d)),
        "p7_packing": _packed,
        "p7_report": lambda s, d: packing.report(_packed(s, d)),
        "p7_mixture": lambda s, d: packing.mixture(_packed(s, d)),
        "p8_found": lambda s, d: leaks.found(t(s, d, "documents"), t(s, d, "eval_item")),
        "p8_report": lambda s, d: leaks.report(t(s, d, "documents"), t(s, d, "eval_item")),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_target")),
        "p9_shares": lambda s, d: mixing.shares(mixing.mix(t(s, d, "documents"), t(s, d, "mix_target")), t(s, d, "mix_target")),
        "p10_found": lambda s, d: stuffing.found(t(s, d, "documents")),
        "p10_scores": lambda s, d: stuffing.scores(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from quern.llm.oracle import SQL

    return SQL
