"""Verdicts over measured criteria, on the driver.

A criterion is True, False or None (not measured).
"""

from __future__ import annotations

from collections.abc import Mapping


def verdict(criteria: Mapping[str, bool | None]) -> str:
    """FAIL if any measured criterion fails, else INCOMPLETE if one is not measured."""
    if any(v is False for v in criteria.values()):
        return "FAIL"
    return "INCOMPLETE" if any(v is None for v in criteria.values()) else "PASS"


def strict_verdict(criteria: Mapping[str, bool | None]) -> str:
    """INCOMPLETE if any criterion is not measured, even when another fails."""
    if any(v is None for v in criteria.values()):
        return "INCOMPLETE"
    return "PASS" if all(criteria.values()) else "FAIL"


def prevalence_gate(seasonality_lo: float | None, beyond_keyword: float | None, parse_fail: float | None, agreement: float | None, ratio_min: float = 1.2, beyond_min: float = 0.02, fail_max: float = 0.02, agreement_min: float = 0.6) -> str:
    """Seasonality shows, labels go beyond the lexicon, answers parse, raters agree."""
    return verdict(
        {
            "seasonality": None if seasonality_lo is None else seasonality_lo >= ratio_min,
            "beyond_keyword": None if beyond_keyword is None else beyond_keyword >= beyond_min,
            "schema_health": None if parse_fail is None else parse_fail <= fail_max,
            "agreement": None if agreement is None else agreement >= agreement_min,
        }
    )


def experiment_gate(hashes: set[str], universe_ok: bool | None, placebo_lo: float | None, seed_cv: float | None) -> str:
    """One test set, no rows from outside, a placebo that does no good, stable seeds."""
    return verdict({"same_test": len(hashes) == 1 if hashes else None, "universe": universe_ok, "placebo": None if placebo_lo is None else placebo_lo <= 0, "seeds": None if seed_cv is None else seed_cv < 0.10})


def agreement_gate(kappa: float | None, raters: int) -> str:
    """Kappa of 0.60 or more; a single rater never passes."""
    if raters < 2:
        return "INCOMPLETE"
    return verdict({"kappa": None if kappa is None else kappa >= 0.60})


def fidelity_gate(narrow_f1: float | None, broad_f1: float | None, human_drop: float | None) -> str:
    return strict_verdict({"narrow": None if narrow_f1 is None else narrow_f1 >= 0.85, "broad": None if broad_f1 is None else broad_f1 >= 0.85, "human": None if human_drop is None else human_drop <= 0.05})


def reproduced(a, b, key: str = "user_id") -> dict[str, int]:
    """Rows of either table that the other lacks, by all common columns: both 0 if
    a run was reproduced. Runs jobs."""
    cols = [c for c in a.columns if c in b.columns]
    return {"only_first": a.select(*cols).exceptAll(b.select(*cols)).count(), "only_second": b.select(*cols).exceptAll(a.select(*cols)).count()}
