"""Status structs: every result carries how it was obtained, so "not checked" never reads as "not found"."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_TYPE = "struct<state:string,reason:string>"


def _text(reason) -> Column:
    if isinstance(reason, Column):
        return reason
    return F.lit(reason).cast("string")


def status(state: str, reason=None) -> Column:
    return F.struct(F.lit(state).alias("state"), _text(reason).alias("reason")).cast(STATUS_TYPE)


def assessed(note=None) -> Column:
    return status("assessed", note)


def not_assessed(reason) -> Column:
    return status("not assessed", reason)


def gated(reason) -> Column:
    return status("gated", reason)


def skipped(reason) -> Column:
    return status("skipped", reason)


def status_text(st: Column) -> Column:
    """The one-line form: ``state`` or ``state: reason``."""
    return F.when(st["reason"].isNull(), st["state"]).otherwise(F.concat_ws(": ", st["state"], st["reason"]))


def parse_status(text: Column) -> Column:
    """A one-line status back into a struct; text in an unknown form counts as not assessed, with itself as reason."""
    head = F.trim(F.element_at(F.split(text, ":", 2), 1))
    tail = F.when(F.contains(text, F.lit(":")), F.trim(F.element_at(F.split(text, ":", 2), 2)))
    state = (F.when(head.isin("assessed", "gated"), head).when(head.startswith("skipped"), F.lit("skipped"))
             .otherwise(F.lit("not assessed")))
    reason = F.when(head.isin("assessed", "gated"), tail).otherwise(F.coalesce(tail, text, F.lit("no result")))
    return F.struct(F.coalesce(state, F.lit("not assessed")).alias("state"), reason.alias("reason"))
