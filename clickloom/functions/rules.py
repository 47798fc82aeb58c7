"""Validation rules as one array column naming every rule a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the data model.
MAX_SALT = 11
MAX_USER_LENGTH = 128
MAX_NAME_LENGTH = 200
MAX_CONTENT_LENGTH = 2000
TEXT_KEYS = ("click_id", "user_id", "clicked_at", "receiver")
NUMBER_KEYS = ("ad_id", "advertiser_id", "salt")
EVENT_KEYS = TEXT_KEYS + NUMBER_KEYS
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_TIME_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)
HTTP_URL_PATTERN = (
    r"^(?i:https?)://([^/?#\[\]]+|[^/?#\[\]]*\[[0-9A-Fa-f:.]+\][^/?#\[\]]*)([/?#].*)?$"
)
SCHEME_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*:"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a null verdict counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    )


def length_between(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def attempt_rules(ad_id: Column, user_id: Column) -> Column:
    return broken({"ad_id": ad_id >= 1, "user_id": length_between(user_id, 1, MAX_USER_LENGTH)})


def _number(fields: Column, key: str) -> Column:
    """A JSON number, null for any other type."""
    found = fields[key]
    kind = F.schema_of_variant(found)
    is_number = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    return F.when(is_number, F.try_variant_get(found, "$", "decimal(38,18)"))


def _text(fields: Column, key: str) -> Column:
    """A JSON string, null for any other type."""
    found = fields[key]
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def event_fields(value: Column) -> Column:
    """One parse of a JSON object into its fields; null for anything else."""
    return F.from_json(value, "map<string,variant>")


def typed_event(fields: Column) -> Column:
    """The fields of an event as text or number; null where the JSON type is another."""
    return F.struct(
        *[_text(fields, key).alias(key) for key in TEXT_KEYS],
        *[_number(fields, key).alias(key) for key in NUMBER_KEYS],
        F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(key) for key in EVENT_KEYS]))).alias(
            "unknown"
        ),
        fields.isNull().alias("no_object"),
    )


def event_rules(event: Column) -> Column:
    """Strict check of one :func:`typed_event`: presence, bounds, formats and no unknown keys."""
    def whole(key: str) -> Column:
        return event[key] == F.floor(event[key])

    checks = {
        "click_id": event["click_id"].rlike(UUID_PATTERN),
        "ad_id": whole("ad_id") & (event["ad_id"] >= 1),
        "advertiser_id": whole("advertiser_id") & (event["advertiser_id"] >= 1),
        "salt": whole("salt") & event["salt"].between(0, MAX_SALT),
        "user_id": length_between(event["user_id"], 1, MAX_USER_LENGTH),
        "clicked_at": event["clicked_at"].rlike(DATE_TIME_PATTERN)
        & event["clicked_at"].try_cast("timestamp").isNotNull(),
        "receiver": event["receiver"].isNotNull(),
        "unknown_keys": event["unknown"] == 0,
    }
    return F.when(event["no_object"], F.array(F.lit("not_an_object"))).otherwise(broken(checks))


def http_url(url: Column) -> Column:
    """An absolute http(s) address with a host."""
    return url.rlike(HTTP_URL_PATTERN)


def absolute_uri(uri: Column) -> Column:
    """Null is allowed; anything else needs a scheme."""
    return uri.isNull() | uri.rlike(SCHEME_PATTERN)


def ad_rules(content: Column, img_url: Column, redirect_url: Column) -> dict[str, Column]:
    return {
        "content": length_between(content, 1, MAX_CONTENT_LENGTH),
        "img_url": absolute_uri(img_url),
        "redirect_url": http_url(redirect_url),
    }


def advertiser_rules(name: Column) -> Column:
    return broken({"name": length_between(name, 1, MAX_NAME_LENGTH)})
