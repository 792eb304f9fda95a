"""Outbox tables: what would be mailed, paged or put on the event bus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alert_subject
from ..operators.events import to_event_map


def mail_outbox(
    mails: DataFrame, notify_format: str = "%s", recipients: tuple[str, ...] = (), quiet: bool = False
) -> DataFrame:
    """Mails (subject, body) with their final subject; a quiet outbox withholds them."""
    return mails.withColumns(
        {
            "subject": F.format_string(notify_format, F.col("subject")),
            "recipients": F.lit(",".join(recipients)),
            "delivery": F.lit("withheld" if quiet else "send"),
        }
    )


def pager_payload() -> Column:
    """JSON body of a page; description and details only on trigger."""
    trigger = F.col("action") == "trigger"
    return F.to_json(
        F.struct(
            F.col("pager_key").alias("service_key"),
            "incident_key",
            F.col("action").alias("event_type"),
            F.when(trigger, F.col("description")).alias("description"),
            F.when(trigger, F.col("details")).alias("details"),
        )
    )


def pager_outbox(actions: DataFrame, quiet: bool = False, mail_only: bool = False) -> DataFrame:
    """Actions with their payload and route: withheld, mail or post."""
    route = "withheld" if quiet else "mail" if mail_only else "post"
    return actions.withColumns({"payload": pager_payload(), "route": F.lit(route)})


def pager_mails(outbox: DataFrame, service: str) -> DataFrame:
    """Mail rows of pages: those routed to mail, and posts that did not get a 2xx answer.
    `post_status` is the answer of a post, null while it has not been made."""
    asked = F.col("route") == "mail"
    failed = (F.col("route") == "post") & ~F.col("post_status").between(200, 299)
    subject = F.when(asked, alert_subject(F.lit("DEFAULT"), F.lit(service), F.lit("PagerDuty event")))
    subject = subject.otherwise(
        alert_subject(F.lit("SERVICE_FAILURE"), F.lit(service), F.lit("Failed to post PagerDuty event"))
    )
    return outbox.filter(asked | failed).select(
        subject.alias("subject"), F.col("payload").alias("body")
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch in a folder of its own, replacing what an earlier attempt of it may have left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_metrics(metrics: DataFrame, path: str, batch_id: int) -> None:
    write_batch(metrics.withColumn("day", F.to_date("created")), path, batch_id)


def write_events(df: DataFrame, feed: str, path: str, batch_id: int) -> None:
    write_batch(to_event_map(df, feed), f"{path}/feed={feed}", batch_id)
