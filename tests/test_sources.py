import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.scalars import hmac_sha256, ulid
from tidewatch.operators import canonical as C
from tidewatch.operators import detect, features, graph, history
from tidewatch.operators.quality import validate_canonical
from tidewatch.operators.canonical import to_canonical
from tidewatch.sources import files, tables, topics
from tests.brute import START

KEY = "k"


def write(folder, name, text):
    import pathlib

    path = pathlib.Path(folder) / name
    path.write_text(text)
    return str(path)


def accepted(df, n):
    valid, report = validate_canonical(df)
    assert [r.asDict() for r in report.collect()] == [] and valid.count() == n


def test_ieee_cis(spark, folder):
    tx = write(folder, "tx.csv", "TransactionID,TransactionDT,TransactionAmt,ProductCD,card1,card2,addr1,P_emaildomain,isFraud,V1\n"
               "1,86400,68.505,W,13926,404.0,315.0,gmail.com,0,9\n2,86401,10.0,,2755,,,,1,9\n3,86402,0.125,C,2755,,,,,9\n")
    ids = write(folder, "id.csv", "TransactionID,DeviceInfo,id_31\n1,Windows,chrome 62\n")
    raw, identity = files.read_raw(spark, "ieee_cis", tx), files.read_raw(spark, "ieee_cis_identity", ids)
    out = C.canonicalize_ieee_cis(raw, identity, KEY)
    accepted(out, 3)
    rows = out.orderBy("ts_ms").collect()
    assert [r["ts_ms"] for r in rows] == [(C.IEEE_CIS_EPOCH + 86400 + i) * 1000 for i in range(3)]
    assert [r["amount_minor"] for r in rows] == [round(68.505 * 100), 1000, 12]
    assert [r["card_bin"] for r in rows] == ["404", None, None] and [r["mcc"] for r in rows] == ["W", "", "C"]
    assert [r["label"] for r in rows] == [0, 1, 0] and rows[0]["attributes"] == {"addr1_zip_prefix": "315"}
    assert rows[0]["email_domain_hash"] and rows[1]["email_domain_hash"] is None
    assert rows[1]["device_fp"] == rows[2]["device_fp"] != rows[0]["device_fp"] and rows[1]["user_id"] == rows[2]["user_id"]
    without = C.canonicalize_ieee_cis(raw, None, KEY)
    accepted(without, 3)
    assert without.select("device_fp").distinct().count() == 1


def test_ulb_rows_are_numbered_over_all_files(spark, folder):
    header = ",".join(["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"])
    line = lambda n: ",".join([str(float(n)), *["0.5"] * 28, f"{n}.25", str(n % 2)])
    write(folder, "a.csv", "\n".join([header, *[line(n) for n in range(7)]]))
    write(folder, "b.csv", "\n".join([header, *[line(n) for n in range(7, 12)]]))
    raw = files.read_raw(spark, "ulb", folder, row_index=True)
    assert [r["row_index"] for r in raw.orderBy("Time").collect()] == list(range(12))
    out = C.canonicalize_ulb(raw, KEY, START // 1000)
    accepted(out, 12)
    rows = out.orderBy("ts_ms").collect()
    assert len({r["user_id"] for r in rows}) == 12 and [r["card_bin"] for r in rows[:3]] == ["100000", "200037", "300074"]
    assert rows[0]["currency"] == "EUR" and len(rows[0]["attributes"]) == 30
    assert files.read_raw(spark, "ulb", folder, first_only=True).count() == 7
    assert [r["Time"] for r in files.first_rows(raw, 2, ["Time"]).collect()] == [0.0, 1.0]
    with pytest.raises(ValueError):
        files.read_raw(spark, "sparkov", folder)


def test_a_file_of_many_blocks_is_numbered_in_order(spark, folder):
    path = write(folder, "long.csv", "n\n" + "\n".join(str(i) for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = files.with_row_index(spark.read.option("header", True).csv(path))
        assert numbered.rdd.getNumPartitions() > 1
        assert numbered.filter("n <> row_index").count() == 0 and numbered.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sparkov(spark, folder):
    path = write(folder, "s.csv", "trans_date_trans_time,cc_num,merchant,category,amt,first,last,lat,long,is_fraud,city\n"
                 "2019-01-01 00:00:18,2703186189652095,fraud_Rippin,misc_net,4.97,Jennifer,Banks,36.0788,-81.1781,0,Moravian\n"
                 "2019-01-01 00:00:44,630423337322,fraud_Heller,,107.23,Ann,Gill,x,-118.2105,1,Orient\n")
    out = C.canonicalize_sparkov(files.read_raw(spark, "sparkov", path), KEY)
    accepted(out, 2)
    a, b = out.orderBy("ts_ms").collect()
    assert a["ts_ms"] == 1546300818000 and a["amount_minor"] == 497 and a["card_bin"] == "270318" and (a["lat"], b["lat"]) == (36.0788, None)
    assert b["mcc"] == "" and b["label"] == 1 and a["attributes"]["city"] == "Moravian"
    assert not {"cc_num", "first", "last"} & set(a["attributes"])


def test_paysim(spark, folder):
    path = write(folder, "p.csv", "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
                 "1,PAYMENT,9839.64,C1,170136.0,160296.36,M1,0.0,0.0,0,0\n2,GIFT,-5,C1,x,1,M2,,,1,1\n")
    out = C.canonicalize_paysim(files.read_raw(spark, "paysim", path), KEY)
    accepted(out, 2)
    a, b = out.orderBy("ts_ms").collect()
    assert a["ts_ms"] == (C.PAYSIM_EPOCH + 3600) * 1000 and (a["channel"], b["channel"]) == ("transfer", "other")
    assert (a["amount_minor"], b["amount_minor"]) == (983964, 0) and b["attributes"]["balance_delta"] is None
    assert float(a["attributes"]["balance_delta"]) == pytest.approx(-9839.64) and a["attributes"]["dest_hash"] == a["merchant_id"]
    assert b["attributes"]["isFlaggedFraud"] == "1"


def given_rows(spark):
    """The smallest events table as canonical transactions."""
    tx = tables.events_as_tx(spark, "/root/testdata/sf0.001")
    hashed = hmac_sha256(F.col("user_id"), "k")
    columns = {c: F.col(c) for c in ("ts_ms", "amount_minor", "currency", "channel", "merchant_id", "mcc", "country", "lat", "lon", "label")}
    return to_canonical(tx, "synthetic", {"tx_id": ulid(F.col("ts_ms"), F.col("tx_id")), "user_id": hashed, **columns})


def test_the_given_events_are_valid_transactions(spark):
    df = given_rows(spark)
    accepted(df, df.count())
    users = features.offline_features(df)
    assert users.count() == df.select("user_id").distinct().count()
    assert users.filter("fraud_rate_user > 1 OR pct_mobile < 0 OR amt_std_30d < 0").count() == 0


def test_detectors_find_what_they_are_for(spark):
    schema = "tx_id string, user_id string, ts_ms long, amount_minor long, device_fp string, lat double, lon double"

    def table(rows):
        return spark.createDataFrame([(f"t{k}", *r) for k, r in enumerate(rows)], schema)

    quick = table([("fast", START + k * 1500, 700 + k, "d", 0.0, 0.0) for k in range(31)] + [("slow", START + k * 600_000, 9, "d", 0.0, 0.0) for k in range(40)])
    assert {r["user_id"] for r in detect.velocity_attack(quick).filter("velocity_attack").collect()} == {"fast"}
    flown = detect.impossible_travel(table([("a", START, 1, "d", 52.5, 13.4), ("a", START + 900_000, 1, "d", 41.9, 12.5), ("b", START, 1, "d", 52.5, 13.4)]))
    far = flown.filter("impossible_travel").collect()
    assert len(far) == 1 and 1_150 < far[0]["distance_from_last_km"] < 1_220
    shared = table([(f"u{k}", START, 1, "one" if k % 2 else f"own{k}", 0.0, 0.0) for k in range(104)])
    assert [(r["device_fp"], r["users"]) for r in detect.device_spray(shared).collect()] == [("one", 52)]
    slips = detect.fat_finger(table([("a", START + k, amount, "d", 0.0, 0.0) for k, amount in enumerate([300, 400, 4000, 39_999])]))
    assert [r["amount_minor"] for r in slips.filter("fat_finger").collect()] == [4000]
    hops = spark.createDataFrame([("p", "q", START, 90), ("q", "r", START + 100_000, 80), ("r", "s", START + 250_000, 70)], "src string, dst string, ts_ms long, amount_minor long")
    chains = graph.payment_chains(hops).collect()
    assert len(chains) == 1 and (chains[0]["chain_start_ms"], chains[0]["ts_ms"]) == (START, START + 250_000)


def test_chains_equal_a_search_over_all_of_them(spark):
    import random

    rng = random.Random(11)
    rows = [(rng.randrange(12), rng.randrange(12), START + rng.randrange(200) * 30_000, i) for i in range(300)]
    got = {r["amount_minor"]: r["chain_start_ms"] for r in graph.payment_chains(
        spark.createDataFrame(rows, "src long, dst long, ts_ms long, amount_minor long"), cell_ms=600_000).collect()}
    want = {}
    moves = [r for r in rows if r[0] != r[1]]
    for c in moves:
        starts = [a[2] for b in moves if b[1] == c[0] and b[2] < c[2] for a in moves if a[1] == b[0] and a[2] < b[2] and c[2] - a[2] <= 600_000]
        if starts:
            want[c[3]] = max(starts)
    assert want and got == want


def test_pagerank_converges_to_the_power_iteration(spark):
    import numpy as np

    pairs = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (2, 4)]
    got = {r["account"]: r["pagerank"] for r in graph.pagerank(spark.createDataFrame(pairs, "src long, dst long"), 30).collect()}
    m = np.zeros((5, 5))
    for s, d in pairs:
        m[d, s] = 1 / sum(x == s for x, _ in pairs)
    m[:, 4] = 0.2  # pays nobody
    r = np.full(5, 0.2)
    for _ in range(30):
        r = 0.15 / 5 + 0.85 * m @ r
    assert [got[i] for i in range(5)] == pytest.approx(list(r), abs=1e-12) and sum(got.values()) == pytest.approx(1.0)


def test_replay_writes_every_row_in_order_with_nulls(spark, folder):
    df = given_rows(spark).orderBy("tx_id").limit(300).withColumn("lat", F.lit(float("nan")))
    topics.replay(df, "text", path=f"{folder}/out")
    lines = [r["value"] for r in spark.read.text(f"{folder}/out").collect()]
    first = json.loads(lines[0])
    assert len(lines) == 300 and first["lat"] is None and "label" in first and first["attributes"] is None
    topics.replay(df, "parquet", limit=10, path=f"{folder}/few")
    few = spark.read.parquet(f"{folder}/few")
    oldest = {r["tx_id"] for r in history.first_by_time(df, 10).collect()}
    assert few.columns == ["key", "value"] and {json.loads(r["value"])["tx_id"] for r in few.collect()} == oldest


def test_unreadable_messages_are_set_aside(spark):
    text = spark.createDataFrame([('{"tx_id":"a","ts_ms":5}',), ("nonsense",), ('{"tx_id":',), (None,)], "raw string")
    events = topics.parse_events(text)
    assert [r["tx_id"] for r in topics.good_events(events).collect()] == ["a"]
    assert topics.quarantined(events).count() == 3


def test_profile_versions_and_latest(spark):
    rows = [("t1", "u", 1, "US"), ("t2", "u", 2, "US"), ("t3", "u", 3, "DE"), ("t4", "u", 9, None), ("t5", "v", 1, "FR")]
    df = spark.createDataFrame(rows, "tx_id string, user_id string, ts_ms long, country string")
    out = history.profile_versions(df, "user_id", ["country"]).orderBy("user_id", "valid_from").collect()
    assert [(r["user_id"], r["country"], r["valid_from"], r["valid_to"], r["is_current"]) for r in out] == [
        ("u", "US", 1, 3, False), ("u", "DE", 3, 9, False), ("u", None, 9, None, True), ("v", "FR", 1, None, True)]
    assert {r["tx_id"] for r in history.latest_per_key(df, "user_id").collect()} == {"t4", "t5"}


def test_deduplicate_keeps_the_first(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "x"), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    assert {tuple(r) for r in history.deduplicate(df, ["k"], ["t"]).collect()} == {("a", 1, "x"), ("b", 5, None)}


def test_replay_in_slices_follows_time(spark, folder):
    import os

    df = given_rows(spark).orderBy("tx_id").limit(400)
    topics.replay(df, "parquet", slice_ms=4 * 86_400_000, path=f"{folder}/sliced")
    names = sorted((f for f in os.listdir(f"{folder}/sliced") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/sliced/{f}"))
    assert spark.read.parquet(f"{folder}/sliced").count() == 400
    last = [json.loads(r["value"])["ts_ms"] for r in spark.read.parquet(f"{folder}/sliced/{names[-1]}").collect()]
    first = [json.loads(r["value"])["ts_ms"] for r in spark.read.parquet(f"{folder}/sliced/{names[0]}").collect()]
    assert max(first) < min(last)
