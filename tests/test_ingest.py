import json
import os

from clickloom.streaming import ingest
from clickloom.streaming.log import VersionedLog
from test_events import EVENT


def test_every_record_ends_in_one_place_over_a_replay(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "ck"))
    log = VersionedLog(spark, path)

    def arrive(rows):
        frame = spark.createDataFrame(rows, "n long, value string")
        frame.coalesce(1).write.mode("append").parquet(source)
        run()

    def run():
        stream = spark.readStream.schema("n long, value string").parquet(source)
        ingest.start_ingest(stream, path, checkpoint, available_now=True).awaitTermination()

    good = json.dumps(EVENT)
    arrive([(1, good), (2, "{"), (3, json.dumps({**EVENT, "ad_id": 0})), (4, None)])
    arrive([(5, good), (6, json.dumps({**EVENT, "more": 1}))])
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in os.listdir(commits):
        if name in (str(last), f".{last}.crc"):
            os.remove(os.path.join(commits, name))
    run()
    events = log.read(ingest.EVENTS, "n long, ad_id long, user_id string").collect()
    assert sorted(map(tuple, events)) == [(n, EVENT["ad_id"], EVENT["user_id"]) for n in (1, 5)]
    rejects = log.read(ingest.REJECTS, "n long, value string, broken_rules array<string>").collect()
    found = {r.n: r.broken_rules for r in rejects}
    assert found[3] == ["ad_id"] and found[6] == ["unknown_keys"] and found[2] == ["not_an_object"]
    assert set(found) == {2, 3, 4, 6} and all(found.values()) and len(rejects) == 4
