"""Queries over the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from clearfold.checks.base import Check


def all_checks() -> dict[str, Check]:
    from clearfold.checks import corpus, definitions, evaluation, extraction, modelling, sampling

    out: dict[str, Check] = {}
    for module in (corpus, sampling, definitions, extraction, evaluation, modelling):
        for check in module.CHECKS:
            if check.name in out:
                raise ValueError(f"two checks named {check.name}")
            out[check.name] = check
    return out
