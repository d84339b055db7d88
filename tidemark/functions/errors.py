"""Error classification and retry decisions over tables of failed calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DELAY_CAP_MS = 64_000
RATE_REASONS = ("rateLimitExceeded", "userRateLimitExceeded", "dailyLimitExceeded")


def retry_after_seconds(header: Column, now_ms: Column) -> Column:
    """Seconds, or an HTTP date; never negative, null if neither."""
    number = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(number, F.ceil((F.unix_millis(date) - now_ms) / 1000).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def error_info(response: Column, now_ms: Column) -> Column:
    """struct(status, retry_after) of struct(status, headers map): the header by either spelling; nulls where there is nothing."""
    headers = response["headers"]
    header = F.coalesce(headers["retry-after"], headers["Retry-After"])
    return F.struct(response["status"].alias("status"), F.when(header != "", retry_after_seconds(header, now_ms)).alias("retry_after"))


def classify_http(status: Column) -> Column:
    return F.when(status == 401, "auth").when(status == 403, "permission").when(status == 404, "notFound").when(status == 429, "rateLimit").otherwise("transient")


def classify(provider: Column, status: Column, reason: Column) -> Column:
    """With what providers do differently."""
    drive = (provider == "googledrive") & (status == 403) & F.coalesce(reason.isin(*RATE_REASONS), F.lit(False))
    full = (provider == "dropbox") & (F.coalesce(F.contains(reason, F.lit("insufficient_space")) | F.contains(reason, F.lit("no_write_permission")), F.lit(False)) | (status == 507))
    one = provider == "onedrive"
    return F.when(drive, "rateLimit").when(full, "storageFull").when(one & (status == 507), "permission").when(one & status.isin(423, 503, 509), "transient").otherwise(classify_http(status))


def decide_retry(kind: Column, attempt: Column, most: Column, retry_after_ms: Column, rng: Column) -> Column:
    """struct(action, kind, delay_ms)."""
    abort = F.when(kind == "auth", "auth").when(kind.isin("permission", "storageFull"), "permission")
    action = F.when(abort.isNotNull(), "abort").when(kind == "notFound", "stop").when(attempt >= most, "exhausted").otherwise("retry")
    backoff = F.pow(F.lit(2.0), attempt - 1) * 1000 * (F.lit(0.5) + rng)
    delay = F.least(F.coalesce(retry_after_ms.cast("double"), backoff), F.lit(float(DELAY_CAP_MS)))
    return F.struct(action.alias("action"), abort.alias("kind"), F.when(action == "retry", delay).alias("delay_ms"))


def cursor_expired(status: Column, summary: Column) -> Column:
    return (status == 410) | F.coalesce(F.startswith(summary, F.lit("reset")), F.lit(False))


def delta_token(link: Column) -> Column:
    """The ``token`` parameter of a delta link; a link without one is an error."""
    token = F.parse_url(link, F.lit("QUERY"), F.lit("token"))
    return F.when(token.isNotNull(), token).otherwise(F.raise_error(F.concat(F.lit("no token in "), link)))
