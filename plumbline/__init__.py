"""Plumbline: data-quality checks, entity resolution and audited cleansing as Spark jobs."""

import sys

from pyspark import cloudpickle

from plumbline.model import (
    Action,
    Category,
    DatasetMeta,
    DomainRule,
    Findings,
    Severity,
    SignalConfig,
    Status,
)
from plumbline.plans.checks import CheckConfig, run_quality_checks
from plumbline.plans.cleanse import execute_approved
from plumbline.plans.resolve import resolve_entities

# Task code travels by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Action",
    "Category",
    "CheckConfig",
    "DatasetMeta",
    "DomainRule",
    "Findings",
    "Severity",
    "SignalConfig",
    "Status",
    "execute_approved",
    "resolve_entities",
    "run_quality_checks",
]
