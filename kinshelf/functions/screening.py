"""Row tests on access logs and host samples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinshelf.params import CPU_ALERT, DISK_ALERT, MEMORY_ALERT

# User agents that mark a robot, and the form of an API key.
BOT_AGENT = "bot|crawler|spider|scraper"
API_KEY = r"^[a-zA-Z0-9\-_]+$"
API_KEY_LENGTH = (20, 100)


def is_bot(user_agent: Column) -> Column:
    """A missing header passes."""
    return F.lower(F.coalesce(user_agent, F.lit(""))).rlike(BOT_AGENT)


def valid_key_format(api_key: Column) -> Column:
    fits = F.length(api_key).between(*API_KEY_LENGTH) & api_key.rlike(API_KEY)
    return F.coalesce(fits, F.lit(False))


def health_issues(cpu: Column, memory: Column, disk: Column) -> Column:
    return F.array_compact(F.array(
        F.when(cpu > CPU_ALERT, "high_cpu"),
        F.when(memory > MEMORY_ALERT, "high_memory"),
        F.when(disk > DISK_ALERT, "high_disk"),
    ))


def health_status(issues: Column) -> Column:
    return F.when(F.size(issues) > 0, "unhealthy").otherwise("healthy")
