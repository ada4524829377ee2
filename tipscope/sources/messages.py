"""Landed chat traffic as validated message rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where messages may come from, commands that are not tips, the longest text.
SOURCES = ("telegram", "youtube", "x", "whatsapp", "manual")
COMMANDS = ("/start", "/help")
MAX_TEXT = 4000


def recent_messages(landed: DataFrame, *, now: datetime | Column, days: int = 90) -> DataFrame:
    """Messages with text, posted within ``days`` of ``now``, in table columns and types."""
    end = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    posted = F.col("posted_at").cast("timestamp")
    return (
        landed.where((posted >= end - F.expr(f"INTERVAL {int(days)} DAYS"))
                     & (F.col("text") != "") & F.col("source").isin(*SOURCES))
        .select("source", F.col("channel_id").cast("string").alias("channel_id"),
                F.col("message_id").cast("string").alias("message_id"), "text",
                posted.alias("posted_at"))
    )


def parse_updates(raw: DataFrame, column: str = "update") -> DataFrame:
    """(chat_id, text) of chat updates in JSON; a new message wins over an edited one.

    Updates without a chat id or text give no row.
    """
    def part(path: str) -> Column:
        found = F.get_json_object(F.col(column), path)
        return F.when(~found.isin("{}", "", "[]", "false", "0", "null"), found)

    body = F.coalesce(part("$.message"), part("$.edited_message"))
    return (
        raw.select(
            F.get_json_object(body, "$.chat.id").try_cast("bigint").alias("chat_id"),
            F.get_json_object(body, "$.text").alias("text"))
        .where(F.col("chat_id").isNotNull() & (F.col("text") != ""))
    )


def request_is_valid() -> Column:
    return F.coalesce(
        F.length("text").between(1, MAX_TEXT) & F.col("source").isin(*SOURCES), F.lit(False))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) scoring requests."""
    return requests.where(request_is_valid()), requests.where(~request_is_valid())


def drop_commands(messages: DataFrame) -> DataFrame:
    return messages.where(~F.lower(F.trim("text")).isin(*COMMANDS))
