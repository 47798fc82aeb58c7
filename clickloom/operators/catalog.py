"""The ads catalogue: reads, validation, and batches of changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.rules import ad_rules, advertiser_rules, broken
from clickloom.operators.filtering import as_of_column
from clickloom.operators.skew import splittable_lookup
from clickloom.schemas import ADS

# Fixed value.
MAX_PAGE = 200


def active_ads(ads: DataFrame) -> DataFrame:
    return ads.where("active")


def click_url(prefix: str, ad_id: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), ad_id.cast("string"))


def enrich_clicks(attempts: DataFrame, ads: DataFrame) -> DataFrame:
    """Attempts on active ads, with owner and redirect target.

    Catalyst broadcasts the catalogue while it is below the size it allows, else it sorts and
    merges, splitting a hot ad's rows at run time.
    """
    lookup = active_ads(ads).select(F.col("id").alias("ad_id"), "advertiser_id", "redirect_url")
    return attempts.join(lookup, "ad_id")


def unknown_ad_clicks(attempts: DataFrame, ads: DataFrame) -> DataFrame:
    """Attempts on ads that do not exist or are inactive."""
    return attempts.join(active_ads(ads).select(F.col("id").alias("ad_id")), "ad_id", "left_anti")


def active_ads_page(ads: DataFrame, after_id: int = 0, limit: int = 20, prefix: str = "/click") -> DataFrame:
    """One page of the active feed. ``next_after_id`` is null on the last page, even a full one."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must lie between 1 and {MAX_PAGE}")
    found = active_ads(ads).where(F.col("id") > after_id).orderBy("id").limit(limit + 1)
    # At most limit + 1 rows: one nested row costs nothing and yields the cursor in the same job.
    ids = F.sort_array(F.collect_list("row"))
    row = F.struct("id", *[name for name in ADS.names if name != "id"])
    page = found.select(row.alias("row")).agg(ids.alias("rows"))
    cursor = F.when(F.size("rows") > limit, F.element_at(F.col("rows.id"), limit))
    return (
        page.select(cursor.alias("next_after_id"), F.explode(F.slice("rows", 1, limit)).alias("row"))
        .select("row.*", "next_after_id")
        .withColumn("click_url", click_url(prefix, F.col("id")))
    )


def newest_active_ads(ads: DataFrame, limit: int) -> DataFrame:
    return active_ads(ads).orderBy(F.desc("id")).limit(limit)


def advertiser_ads(ads: DataFrame, advertiser_id: int, include_inactive: bool = False) -> DataFrame:
    mine = ads.where(F.col("advertiser_id") == advertiser_id)
    return (mine if include_inactive else active_ads(mine)).orderBy("id")


def active_ad(ads: DataFrame, ad_id: int) -> DataFrame:
    return active_ads(ads).where(F.col("id") == ad_id)


def advertiser(advertisers: DataFrame, advertiser_id: int) -> DataFrame:
    return advertisers.where(F.col("id") == advertiser_id)


def _rules(rows: DataFrame) -> dict[str, Column]:
    return ad_rules(F.col("content"), F.col("img_url"), F.col("redirect_url"))


def validate_ads(ads: DataFrame, advertisers: DataFrame) -> DataFrame:
    """Add ``broken_rules``, including an owner that does not exist."""
    owners = advertisers.select(F.col("id").alias("advertiser_id"), F.lit(True).alias("_owner")).distinct()
    known = ads.join(owners, "advertiser_id", "left")
    rules = {**_rules(ads), "advertiser_id": F.col("_owner").isNotNull()}
    return known.select(*ads.columns, broken(rules).alias("broken_rules"))


def validate_advertisers(advertisers: DataFrame) -> DataFrame:
    return advertisers.withColumn("broken_rules", advertiser_rules(F.col("name")))


def create_advertisers(advertisers: DataFrame, new: DataFrame) -> DataFrame:
    """Append valid advertisers."""
    valid = validate_advertisers(new).where(F.size("broken_rules") == 0).drop("broken_rules")
    return advertisers.unionByName(valid)


def new_ads(proposals: DataFrame, advertisers: DataFrame, now: datetime | Column | None) -> DataFrame:
    """Valid proposals whose advertiser exists, as active ads stamped with ``now``."""
    valid = proposals.where(F.size(broken(_rules(proposals))) == 0)
    owned = valid.join(advertisers.select(F.col("id").alias("advertiser_id")), "advertiser_id", "left_semi")
    stamp = as_of_column(now)
    return owned.select(
        "id",
        "advertiser_id",
        "content",
        "img_url",
        "redirect_url",
        F.lit(True).alias("active"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def rejected_ads(proposals: DataFrame, advertisers: DataFrame) -> DataFrame:
    """Proposals :func:`new_ads` leaves out."""
    return validate_ads(proposals, advertisers).where(F.size("broken_rules") > 0)


def create_ads(
    ads: DataFrame, proposals: DataFrame, advertisers: DataFrame, now: datetime | Column | None
) -> DataFrame:
    return ads.unionByName(new_ads(proposals, advertisers, now))


def update_ads(ads: DataFrame, changes: DataFrame, now: datetime | Column | None) -> DataFrame:
    """Replace the editable fields of owned ads.

    A change by anybody but the owner matches nothing. Of several valid changes of one ad the one
    with the highest ``seq`` holds, or the greatest by its fields where changes have no ``seq``.
    """
    valid = changes.where(F.size(broken(_rules(changes))) == 0)
    fields = F.struct("content", "img_url", "redirect_url", "active")
    order = F.col("seq") if "seq" in changes.columns else fields
    change = valid.groupBy("id", "advertiser_id").agg(F.max_by(fields, order).alias("change"))
    changed = F.col("change").isNotNull()
    fields = ("content", "img_url", "redirect_url", "active")
    return (
        ads.join(change, ["id", "advertiser_id"], "left")
        .withColumn("updated_at", F.when(changed, as_of_column(now)).otherwise(F.col("updated_at")))
        .withColumns({name: F.when(changed, F.col(f"change.{name}")).otherwise(F.col(name)) for name in fields})
        .select(*ADS.names)
    )


def soft_delete_ads(ads: DataFrame, deletes: DataFrame, now: datetime | Column | None) -> DataFrame:
    """Deactivate owned ads; deleting again leaves ``updated_at`` alone."""
    gone = deletes.select("id", "advertiser_id").distinct().withColumn("gone", F.lit(True))
    hit = F.col("gone").isNotNull()
    return (
        ads.join(gone, ["id", "advertiser_id"], "left")
        .withColumn(
            "updated_at",
            F.when(hit & F.col("active"), as_of_column(now)).otherwise(F.col("updated_at")),
        )
        .withColumn("active", F.when(hit, False).otherwise(F.col("active")))
        .select(*ADS.names)
    )


def _outcomes(changes: DataFrame, births: DataFrame) -> DataFrame:
    """What a feed comes to for each (id, advertiser_id): the last edit with its ``seq``, and when the
    first delete after it (and after the ad was made) came.

    The feed is reduced to a row for each ad before it meets the catalogue; the deletes of one ad
    are split between tasks at run time.
    """
    key = ["id", "advertiser_id"]
    edit = F.struct("content", "img_url", "redirect_url", "active", "changed_at")
    updates = (
        changes.where((F.col("op") == "update") & (F.size(broken(_rules(changes))) == 0))
        .groupBy(*key)
        .agg(F.max_by(edit, F.col("seq")).alias("edit"), F.max("seq").alias("edited"))
    )
    deletes = changes.where("op = 'delete'").select(*key, "seq", "changed_at")
    after = splittable_lookup(deletes, updates.select(*key, "edited"), key, "id").join(
        births, "id", "left"
    )
    since = F.greatest("edited", "born")
    gone = (
        after.where(since.isNull() | (F.col("seq") > since))
        .groupBy(*key)
        .agg(F.min_by("changed_at", "seq").alias("deleted_at"))
    )
    return updates.join(gone, key, "full")


def apply_ad_changes(ads: DataFrame, changes: DataFrame, advertisers: DataFrame) -> DataFrame:
    """Apply an ordered feed of create, update and delete; ``seq`` is unique and gives the order.

    The outcome per ad follows from its last update and, after that, its first delete: later
    deletes change nothing, and an update that leaves the ad inactive makes them void too. The
    catalogue is read once and joined once, to one row for each ad that the feed names: while those
    are small they are broadcast and the catalogue stays where it is.
    """
    made = changes.where("op = 'create'")
    births = made.select("id", F.col("seq").alias("born"))
    created = new_ads(made, advertisers, F.col("changed_at")).join(births, "id")
    base = ads.withColumn("born", F.lit(None).cast("long")).unionByName(created)
    edited = F.col("edit").isNotNull() & (F.col("born").isNull() | (F.col("edited") > F.col("born")))
    live = F.when(edited, F.col("edit.active")).otherwise(F.col("active"))
    stamped = F.when(edited, F.col("edit.changed_at")).otherwise(F.col("updated_at"))
    deleted = F.col("deleted_at").isNotNull()
    return base.join(_outcomes(changes, births), ["id", "advertiser_id"], "left").select(
        "id",
        "advertiser_id",
        *[
            F.when(edited, F.col(f"edit.{name}")).otherwise(F.col(name)).alias(name)
            for name in ("content", "img_url", "redirect_url")
        ],
        (live & ~deleted).alias("active"),
        "created_at",
        F.when(deleted & live, F.col("deleted_at")).otherwise(stamped).alias("updated_at"),
    )
