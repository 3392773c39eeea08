"""Brand families against a sequential pass, and the cases of freshness and receipts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from namewake.operators import insights, ledger


def families(labels, reference, words, size, least, top):
    runs = lambda label: {label[i : i + size] for i in range(len(label) - size + 1)}
    held = {}
    for label in labels:
        for root in runs(label):
            held.setdefault(root, set()).add(label)
    order = sorted(((-len(m), r) for r, m in held.items() if len(m) >= least and not any(r[i] == r[i + 1] == r[i + 2] for i in range(size - 2))))[:top]
    taken, out = set(), set()
    for n, root in order:
        if any(root in w for w in words) or any(root[:i] in words and root[i:] in words for i in range(3, 7)):
            continue
        if sum(root in runs(r) for r in reference) / max(1, len(reference)) > 0.3 * -n / max(1, len(labels)) + 3 / max(1, len(reference)):
            continue
        mine = held[root] - taken
        if len(mine) >= least:
            taken |= mine
            out |= {(root, label) for label in mine}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_brand_families_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    cores = ["zanquolab", "mirtovexa", "brandwyrm", "goldenpipe", "vexabrandw"]
    labels = {rng.choice(["", "my", "the", "x"]) + rng.choice(cores) + rng.choice(["", "shop", "hub", rng.choice(cores)[:5], str(rng.randint(0, 30))]) for _ in range(150)}
    reference = {"goldenpipe" + str(i) for i in range(40)} | {f"other{i:05d}" for i in range(60)}
    words = ["golden", "pipe", "hub", "shop"]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = insights.brand_families(frame(labels, "label"), frame(reference, "label"), frame(words, "entry"), top=60).collect()
    wanted = families(labels, reference, words, 9, 6, 60)
    assert wanted and {(r.root, r.label) for r in got} == wanted
    assert insights.brand_families(frame([], "label"), frame([], "label"), frame([], "entry")).count() == 0


def test_freshness_by_hand(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).withColumns({c.split()[0]: F.col(c.split()[0]).cast("timestamp_ntz" if "_at" in c else "date") for c in schema.split(", ") if "_at" in c or c.startswith("day")})
    imports = lambda days: frame([(d, f"{d} 23:00:00") for d in days], "day string, imported_at string")
    days = [f"2024-03-0{i}" for i in range(1, 10)]
    none, clean = frame([], "name string, dirty_at string"), frame([], "name string, day string, checked boolean, admitted_at string")
    told = lambda *parts: {r.part: r.status for r in insights.freshness(*parts, now).collect()}
    assert told(imports(days), clean, none) == {"movement": "ok", "backlog": "ok", "assessments": "ok", "verdict": "ok"}
    assert told(imports([d for d in days if not d.endswith("7")]), clean, none)["verdict"] == "stale"  # a gap
    assert told(imports(days[:-1]), clean, none)["movement"] == "stale" and told(imports([]), clean, none)["movement"] == "stale"
    late = lambda day, admitted: frame([("a", day, False, admitted), ("b", "2024-03-02", True, None)], "name string, day string, checked boolean, admitted_at string")
    assert told(imports(days), late("2024-03-09", None), none)["backlog"] == "stale"  # since its import
    assert told(imports(days), late("2024-03-09", "2024-03-10 09:00:00"), none) == {"movement": "ok", "backlog": "degraded", "assessments": "ok", "verdict": "degraded"}
    assert told(imports(days), late("2024-03-09", "2024-03-10 11:30:00"), none)["verdict"] == "ok"
    assert told(imports(days), clean, frame([("a", "2024-03-10 10:00:00")], "name string, dirty_at string"))["assessments"] == "stale"


def test_ingest_keeps_all_batches_of_a_day(spark):
    source, target, progress = (ledger.shared_path(spark, n) for n in ("source", "target", "progress"))
    rows = lambda *labels: spark.createDataFrame([("2024-01-05", x) for x in labels], "day string, label string").withColumn("day", F.col("day").cast("date"))
    for part in (rows("a", "b"), rows("c"), rows("a")):
        part.write.mode("append").parquet(source)
        ledger.ingest_days(spark, source, "day date, label string", target, progress)
    ledger.ingest_days(spark, source, "day date, label string", target, progress)  # nothing new
    assert sorted(r.label for r in spark.read.parquet(target).collect()) == ["a", "a", "b", "c"]


def test_labels_grow_with_the_tables(spark):
    from namewake.sources import market

    small, large = (market.names(spark, f"/root/testdata/sf{sf}").select("label").distinct().count() for sf in ("0.001", "0.1"))
    assert large > 10 * small


def test_the_receipt_of_a_day_of_many_rows(spark):
    import hashlib

    part = lambda label: int(hashlib.sha256(f"{label}\x1fcom".encode()).hexdigest()[:12], 16)
    heavy = max((f"label{i}" for i in range(50)), key=part)
    n = (1 << 63) // part(heavy) + 2  # the plain sum is just too large for a long
    days = spark.range(n).select(F.lit("2024-01-05").cast("date").alias("day"), F.lit(heavy).alias("label"), F.lit("com").alias("zone"))
    got = ledger.receipt(days, ["label", "zone"]).first()
    assert got.n == n and got.digest == (n * part(heavy) + (1 << 63)) % (1 << 64) - (1 << 63) < 0
    table, receipts = (ledger.shared_path(spark, name) for name in ("days", "receipts"))
    assert [ledger.receive(spark, table, receipts, rows, ["label", "zone"]).first().verdict for rows in (days, days, days.limit(n - 1))] == ["new", "same", "refused"]
