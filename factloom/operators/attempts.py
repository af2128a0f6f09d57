"""Attempts with one fallback, as a table of transitions folded over a module's attempts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The statuses of an attempt, and those after which the fallback is tried.
STATUSES = (
    "ok", "empty_content", "schema_rejected", "structured_output_invalid", "parse_failure", "provider_response_mismatch", "api_error", "auth_error", "network_error", "skipped",
)
RETRYABLE = ("empty_content", "schema_rejected", "structured_output_invalid", "parse_failure", "provider_response_mismatch")
#: (state, may be retried) -> state; an attempt counts if the state before it isn't done.
TRANSITIONS = {("first", True): "fallback", ("first", False): "done", ("fallback", True): "done", ("fallback", False): "done", ("done", True): "done", ("done", False): "done"}


def attempt_status(said: Column) -> Column:
    """A known status, trimmed; api_error for anything else."""
    text = F.trim(said)
    return F.when(text.isin(*STATUSES), text).otherwise("api_error")


def status_of(parse_status: Column, errors: Column, provider_error: Column) -> Column:
    """The status of one attempt: the provider's error, else what parsing said, else whether the payload holds against its schema."""
    return F.when(provider_error.isNotNull(), provider_error).when(parse_status != "ok", parse_status).when(F.size(errors) > 0, "structured_output_invalid").otherwise("ok")


def provider_status(attempts: DataFrame, key: str, order: str, status: str, transitions: dict[tuple[str, bool], str] = TRANSITIONS, most: int = 2) -> DataFrame:
    """(key, attempts, first_attempt_status, second_attempt_status, retry_used, retry_reason, final_status) of every key.

    Attempts are read in order, at most ``most`` of them, until the table says
    done; later ones weren't due and don't count. No more than these are gathered for
    a key, however many there are.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = attempts.select(key, F.col(order).alias("_o"), attempt_status(F.col(status)).alias("_s"), place.alias("_n")).filter(F.col("_n") <= most)
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_s"))), lambda x: x["_s"]).alias("_l"))
    table = F.create_map(*[F.lit(x) for (state, again), to in transitions.items() for x in (f"{state} {str(again).lower()}", to)])
    state = lambda at, used: F.struct(at.cast("string").alias("at"), used.cast("array<string>").alias("used"))

    def step(a: Column, s: Column) -> Column:
        to = F.element_at(table, F.concat_ws(" ", a["at"], s.isin(*RETRYABLE).cast("string")))
        return F.when(a["at"] == "done", a).otherwise(state(to, F.concat(a["used"], F.array(s))))

    used = F.aggregate("_l", state(F.lit("first"), F.array()), step, lambda a: a["used"])
    rows = listed.select(key, used.alias("_u"))
    retried = F.size("_u") > 1
    return rows.select(
        key, F.size("_u").alias("attempts"), F.get("_u", F.lit(0)).alias("first_attempt_status"), F.get("_u", F.lit(1)).alias("second_attempt_status"), retried.alias("retry_used"),
        F.when(retried, F.get("_u", F.lit(0))).alias("retry_reason"), F.element_at("_u", -1).alias("final_status"),
    )
