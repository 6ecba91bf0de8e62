"""Exit codes, job ids and run status text."""

from __future__ import annotations

import signal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what is said of the kill that is nearly always the OOM killer.
OOM_NOTE = (
    "SIGKILL -- killed by the OS, most often an out-of-memory kill; "
    "check the step's declared resources against what it actually used"
)


def explain_returncode(code: Column) -> Column:
    """The code as text, with the signal named where it is one."""
    names = {s.value: OOM_NOTE if s.name == "SIGKILL" else s.name for s in signal.Signals}
    table = F.create_map(*[F.lit(x) for k, v in sorted(names.items()) for x in (k, v)])
    name = F.try_element_at(table, (-code).cast("int"))
    text = code.cast("string")
    return F.when((code < 0) & name.isNotNull(), F.concat(text, F.lit(" ("), name, F.lit(")"))).otherwise(text)


def run_status(reply: Column) -> Column:
    """A probe's reply as a status: an exit code, RUNNING, or anything else."""
    text = F.trim(reply)
    finished = text.rlike("^[0-9]+$")
    return (
        F.when(text == "RUNNING", F.lit("RUNNING"))
        .when(finished & text.rlike("^0+$"), F.lit("FINISHED (success)"))
        .when(finished, F.concat(F.lit("FINISHED (exit "), F.regexp_replace(text, "^0+", ""), F.lit(")")))
        .otherwise(F.lit("UNKNOWN"))
    )


def job_id(reply: Column) -> Column:
    """The id in a submit reply of the form `id` or `id;cluster`."""
    return F.substring_index(F.trim(reply), ";", 1)
