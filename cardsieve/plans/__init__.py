"""Whole jobs, put together from the operators."""

from cardsieve.plans.pipeline import PipelineResult, run_cached, run_to_table
from cardsieve.plans.report import RiskReport, risk_report

__all__ = ["PipelineResult", "RiskReport", "risk_report", "run_cached", "run_to_table"]
