"""Run-status vocabulary and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names and their descriptions.
STATUS_DESCRIPTIONS = {
    "PENDING": "Simulation task created but not yet processed",
    "CONFIG_ERROR": "Configuration error (e.g., missing paths, invalid parameters)",
    "SETUP_ERROR": "Error during input file generation",
    "READY_TO_RUN": "Input files generated successfully, ready for execution",
    "RUNNING": "Simulation is currently executing",
    "SUCCESS": "Simulation completed successfully",
    "RUN_ERROR": "Error during simulation execution",
    "TIMEOUT": "Simulation exceeded time limit",
    "MISSING_FILES": "Required input/output files not found",
    "OUTPUT_PARSED": "Model outputs successfully parsed and standardized",
    "OUTPUT_ERROR": "Error during output parsing",
    "SKIPPED": "Simulation skipped (e.g., due to dependencies or filters)",
    "UNKNOWN_ERROR": "Unspecified error occurred",
}

# The sets of status names.
FINAL = [
    "SUCCESS",
    "CONFIG_ERROR",
    "SETUP_ERROR",
    "RUN_ERROR",
    "TIMEOUT",
    "MISSING_FILES",
    "OUTPUT_PARSED",
    "OUTPUT_ERROR",
    "SKIPPED",
    "UNKNOWN_ERROR",
]
SUCCESSFUL = ["SUCCESS", "OUTPUT_PARSED"]
RUNNABLE = ["READY_TO_RUN"]
COMPLETED = ["SUCCESS", "COMPLETE"]
ERRORS = [name for name in STATUS_DESCRIPTIONS if "ERROR" in name or "TIMEOUT" in name]


def is_error(status: Column) -> Column:
    return status.contains("ERROR") | status.contains("TIMEOUT")


def is_final(status: Column) -> Column:
    return status.isin(FINAL)


def is_success(status: Column) -> Column:
    return status.isin(SUCCESSFUL)


def is_runnable(status: Column) -> Column:
    return status.isin(RUNNABLE)


def is_completed(status: Column) -> Column:
    return status.isin(COMPLETED)


def is_known(status: Column) -> Column:
    return status.isin(list(STATUS_DESCRIPTIONS))


def description(status: Column) -> Column:
    pairs = [F.lit(x) for item in STATUS_DESCRIPTIONS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), status)
