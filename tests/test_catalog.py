import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import catalog, skew
from clickloom.schemas import AD_CHANGES, ADS, ADVERTISERS
from helpers import naive, plan_of, utc

BORN, NOW = utc(2026, 1, 1), utc(2026, 2, 1)


def ad(number, owner=7, active=True, content="text"):
    return (number, owner, content, None, f"https://l.example/{number}", active, BORN, BORN)


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([ad(1), ad(2), ad(3, active=False), ad(4, 8), ad(5)], ADS)


@pytest.fixture(scope="module")
def advertisers(spark):
    return spark.createDataFrame([(7, "seven", BORN), (8, "eight", BORN)], ADVERTISERS)


def test_pages_follow_the_key(ads):
    first = catalog.active_ads_page(ads, limit=2).collect()
    assert [(r.id, r.next_after_id) for r in first] == [(1, 2), (2, 2)]
    # full, but the last
    second = catalog.active_ads_page(ads, after_id=2, limit=2).collect()
    assert [(r.id, r.next_after_id) for r in second] == [(4, None), (5, None)]
    assert [r.id for r in catalog.active_ads_page(ads, limit=4).collect()] == [1, 2, 4, 5]
    assert catalog.active_ads_page(ads, after_id=5).collect() == []
    with pytest.raises(ValueError):
        catalog.active_ads_page(ads, limit=201)


def test_click_url_has_one_slash(ads):
    for prefix in ("https://go.example/click", "https://go.example/click/"):
        assert catalog.active_ads_page(ads, limit=1, prefix=prefix).first().click_url == "https://go.example/click/1"


def test_unknown_and_inactive_ads(spark, ads):
    attempts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 999)], "click_id string, ad_id long")
    assert [r.click_id for r in catalog.enrich_clicks(attempts, ads).collect()] == ["a"]
    assert sorted(r.click_id for r in catalog.unknown_ad_clicks(attempts, ads).collect()) == ["b", "c"]


def test_reads(ads, advertisers):
    assert [r.id for r in catalog.newest_active_ads(ads, 2).collect()] == [5, 4]
    assert [r.id for r in catalog.advertiser_ads(ads, 7).collect()] == [1, 2, 5]
    assert [r.id for r in catalog.advertiser_ads(ads, 7, include_inactive=True).collect()] == [1, 2, 3, 5]
    assert catalog.active_ad(ads, 3).count() == 0
    assert catalog.advertiser(advertisers, 8).first().name == "eight"


def test_addresses(spark, advertisers):
    cases = [
        ("https://a.example/x?q=1#f", None, []),
        ("HTTP://a.example", "data:image/png;base64,x", []),
        ("http://under_score/a b", None, []),
        ("ftp://a.example", None, ["redirect_url"]),
        ("https:///path", None, ["redirect_url"]),
        ("/relative", None, ["redirect_url"]),
        ("https://a", "relative.png", ["img_url"]),
    ]
    rows = [(n, 7, "c", img, url, True, BORN, BORN) for n, (url, img, _) in enumerate(cases)]
    checked = catalog.validate_ads(spark.createDataFrame(rows, ADS), advertisers).orderBy("id").collect()
    assert [r.broken_rules for r in checked] == [rules for _, _, rules in cases]


def test_create_needs_an_advertiser(spark, ads, advertisers):
    proposals = spark.createDataFrame([ad(10), ad(11, 99), ad(12, content="")], ADS)
    made = catalog.create_ads(ads, proposals, advertisers, NOW)
    assert sorted(r.id for r in made.collect()) == [1, 2, 3, 4, 5, 10]
    new = made.where("id = 10").first()
    assert new.active and naive(new.created_at) == naive(new.updated_at) == NOW.replace(tzinfo=None)
    assert sorted(r.id for r in catalog.rejected_ads(proposals, advertisers).collect()) == [11, 12]


def test_update_by_the_owner_only(spark, ads):
    changes = spark.createDataFrame([ad(1, 7, False, "new"), ad(4, 7, True, "stolen")], ADS)
    got = {r.id: r for r in catalog.update_ads(ads, changes, NOW).collect()}
    assert len(got) == 5
    assert (got[1].content, got[1].active) == ("new", False)
    assert naive(got[1].updated_at) == NOW.replace(tzinfo=None)
    assert got[4].content == "text" and naive(got[4].updated_at) == BORN.replace(tzinfo=None)


def test_second_delete_leaves_the_time_alone(spark, ads):
    gone = spark.createDataFrame([(1, 7), (1, 7), (3, 7), (4, 7)], "id long, advertiser_id long")
    once = catalog.soft_delete_ads(ads, gone, NOW)
    twice = catalog.soft_delete_ads(once, gone, utc(2026, 3, 1))
    got = {r.id: (r.active, naive(r.updated_at)) for r in twice.collect()}
    assert got[1] == (False, NOW.replace(tzinfo=None))
    assert got[3] == (False, BORN.replace(tzinfo=None))
    assert got[4] == (True, BORN.replace(tzinfo=None))


def _apply_one_by_one(ads, changes, owners):
    state = {a[0]: list(a) for a in ads}
    for seq, op, number, owner, content, img, url, active, at in sorted(changes):
        if op == "create":
            if owner in owners and number not in state:
                state[number] = [number, owner, content, img, url, True, at, at]
        elif number in state and state[number][1] == owner:
            row = state[number]
            if op == "update":
                row[2:6], row[7] = [content, img, url, active], at
            else:
                row[7] = at if row[5] else row[7]
                row[5] = False
    return sorted(tuple(row) for row in state.values())


@pytest.mark.parametrize("seed", range(4))
def test_a_feed_equals_its_changes_one_by_one(spark, advertisers, seed):
    pick = random.Random(seed)
    ads = [ad(n, pick.choice([7, 8]), pick.random() < 0.7) for n in range(1, 15)]
    born = {n: 7 + n % 3 for n in range(20, 30)}
    changes, created = [], set()
    for seq in range(1, 200):
        if pick.random() < 0.1 and len(created) < len(born):
            number, op = 20 + len(created), "create"
            created.add(number)
        else:
            # a third of all changes hit one ad
            number = 1 if pick.random() < 0.33 else pick.choice(list(range(1, 15)) + list(born))
            op = pick.choice(["update", "delete", "delete"])
        owner = born.get(number) or next(a[1] for a in ads if a[0] == number)
        if op != "create" and pick.random() < 0.2:
            owner += 1
        at = utc(2026, 3, 1, seq // 60, seq % 60)
        changes.append((seq, op, number, owner, f"c{seq}", None, f"https://n.example/{seq}", pick.random() < 0.6, at))
    got = catalog.apply_ad_changes(
        spark.createDataFrame(ads, ADS), spark.createDataFrame(changes, AD_CHANGES), advertisers
    )
    found = sorted((*tuple(r)[:6], naive(r.created_at), naive(r.updated_at)) for r in got.select(*ADS.names).collect())
    wanted = [
        (*row[:6], row[6].replace(tzinfo=None), row[7].replace(tzinfo=None))
        for row in _apply_one_by_one(ads, changes, {7, 8})
    ]
    assert found == wanted


def test_create_advertisers(spark, advertisers):
    new = spark.createDataFrame([(9, "n" * 200, NOW), (10, "", NOW), (11, "n" * 201, NOW)], ADVERTISERS)
    assert sorted(r.id for r in catalog.create_advertisers(advertisers, new).collect()) == [7, 8, 9]


def test_salted_lookup_keeps_every_row(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    joined = skew.salted_lookup(facts, lookup, ["k"], F.col("id"), "left")
    assert joined.count() == 1000 and joined.where("name is null").count() == 333


def test_several_changes_of_one_ad_give_one_row(spark, ads):
    rows = [
        (seq, 1, 7, f"text {seq}", None, "https://l.example/new", True) for seq in (3, 9, 5)
    ]
    schema = "seq long, id long, advertiser_id long, content string, img_url string, redirect_url string, active boolean"
    changed = catalog.update_ads(ads, spark.createDataFrame(rows, schema), NOW)
    assert [r.content for r in changed.where("id = 1").collect()] == ["text 9"]
    assert changed.count() == ads.count()
    unordered = catalog.update_ads(ads, spark.createDataFrame(rows, schema).drop("seq"), NOW)
    assert [r.content for r in unordered.where("id = 1").collect()] == ["text 9"]


def test_an_advertiser_given_twice_doubles_nothing(ads, advertisers):
    assert catalog.validate_ads(ads, advertisers.union(advertisers)).count() == ads.count()


def test_hosts_in_brackets(spark):
    from clickloom.functions.rules import http_url

    urls = {
        "http://[abc": False,
        "http://abc]/x": False,
        "https://[::1]:80/x": True,
        "HTTP://h_1/[x]": True,
        "http://?x": False,
        "ftp://h": False,
    }
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.ok for r in frame.select("u", http_url(F.col("u")).alias("ok")).collect()} == urls


def test_the_catalogue_is_read_once_and_never_copied(spark, tmp_path, advertisers):
    from clickloom.schemas import AD_CHANGES, ADS

    spark.createDataFrame([], ADS).write.parquet(str(tmp_path / "catalogue"))
    spark.createDataFrame([], AD_CHANGES).write.parquet(str(tmp_path / "feed"))
    stored_ads = spark.read.schema(ADS).parquet(str(tmp_path / "catalogue"))
    feed = spark.read.schema(AD_CHANGES).parquet(str(tmp_path / "feed"))
    plan = plan_of(catalog.apply_ad_changes(stored_ads, feed, advertisers))
    scans = [line for line in plan.splitlines() if line.startswith("Location") and "/catalogue]" in line]
    assert len(scans) == 1
    assert "_salt" not in plan
