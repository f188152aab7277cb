"""Planning statuses: raw wording to canonical states."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wordings of each canonical state.
WORDINGS = {
    "pre_validation": ["pre validation", "pre reg", "unregistered application", "validation"],
    "registered": ["new application", "new application set up", "registered application", "application registered", "registration", "valid"],
    "under_assessment": ["officer allocation", "referral", "assessment period", "35 day assessment", "45 day assessment", "49 day assessment", "planner assignment", "planners report", "recommendation review", "recommended decision", "recommended decision entered", "managers order", "publication required", "provisional recommendation", "application under review"],
    "further_information_requested": ["further information", "additional information", "additional information requested", "ai requested", "decision request a.i.", "request ai approval", "ai request approved", "significant ai requested", "clarification of ai requested", "cai requested", "additional information approval required", "additional information consultees", "ai referral", "cai consultees", "sai referral", "sai consultees"],
    "further_information_received": ["further information received", "additional information received", "ai received", "cai received", "ai not significant"],
    "decision_made": ["decision", "decision made", "decision notice issued", "decision issued", "decision following a.i.", "decision review"],
    "final_grant": ["final grant", "final grant review"],
    "appealed": ["appealed", "appeal lodged", "application appealed", "application under appeal", "appealed financial", "decision appealed", "leave to appeal", "planner rpt to abp", "planners report to acp", "appeal report sent to abp", "appeal comments due", "file to acp"],
    "appeal_decided": ["appeal decided"],
    "withdrawn": ["withdrawn", "application withdrawn", "planning application withdrawn", "deemed withdrawn", "withdrawal of application on appeal"],
    "invalid": ["invalid", "invalid application", "invalid details sent to applicant", "invalid site notice", "invalid due to site notice", "incompleted", "incompleted application"],
    "finalised": ["application closed", "application finalised", "pac report & file closed", "pac meeting & file closed", "application archived"],
}
#: What each state is called.
LABELS = {
    "pre_validation": "Pre-validation",
    "registered": "Application registered",
    "under_assessment": "Under assessment",
    "further_information_requested": "Further information requested",
    "further_information_received": "Further information received",
    "decision_made": "Decision made",
    "final_grant": "Final grant",
    "appealed": "Under appeal",
    "appeal_decided": "Appeal decided",
    "withdrawn": "Withdrawn",
    "invalid": "Invalid or incomplete",
    "finalised": "Application finalised",
    "unknown": "Status not classified",
}
#: States after which nothing follows.
TERMINAL = ("final_grant", "appeal_decided", "withdrawn", "invalid", "finalised")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), key)


def status_key(raw: Column) -> Column:
    """Lower case, hyphens and underscores as blanks, blanks collapsed."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(raw)), r"[\s_-]+", " "))


def canonical(raw: Column) -> Column:
    """One of the states; `unknown` for null, blank and unseen wordings."""
    known = {wording: state for state, wordings in WORDINGS.items() for wording in wordings}
    return F.coalesce(_lookup(known, status_key(raw)), F.lit("unknown"))


def label(state: Column) -> Column:
    return F.coalesce(_lookup(LABELS, state), F.lit(LABELS["unknown"]))


def is_terminal(state: Column) -> Column:
    return F.coalesce(state.isin(*TERMINAL), F.lit(False))
