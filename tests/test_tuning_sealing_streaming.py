import hashlib
import json

from graphloom.operators import tuning
from graphloom.sources import sealing
from graphloom.streaming import ingest


def macro_f1(rows, lo, hi):
    said = [tuning.LABELS[0] if s is not None and s >= hi else tuning.LABELS[1] if s is not None and s >= lo else tuning.LABELS[2] if s is not None and s > 0 else tuning.LABELS[3] for _, s in rows]
    gold = [g for g, _ in rows]
    f1 = [2 * sum(a == b == c for a, b in zip(gold, said)) / (gold.count(c) + said.count(c)) for c in set(gold)]
    return sum(f1) / len(f1)


def test_grid_search_equals_brute_force(spark):
    rows = [("a" if i % 3 else "b", tuning.LABELS[i % 4], None if i % 11 == 0 else (i * 7 % 13) / 10) for i in range(60)]
    lows, highs = (0.1, 0.3, 0.6), (0.3, 0.8, 1.1)
    got = {r["system"]: r for r in tuning.grid_search(spark.createDataFrame(rows, "system string, gold string, score double"), lows, highs).collect()}
    assert set(got) == {"a", "b"}
    for system, r in got.items():
        own = [x[1:] for x in rows if x[0] == system]
        scores = {(lo, hi): round(macro_f1(own, lo, hi), 9) for lo in lows for hi in highs if lo < hi}
        assert r["macro_f1"] == max(scores.values()) == scores[r["lo"], r["hi"]]
    assert tuning.grid_search(spark.createDataFrame([], "system string, gold string, score double"), lows, highs).count() == 0


def test_seals(spark, tmp_path):
    for name, text, seal in (("a.yaml", "x", "x"), ("b.yaml", "changed", "y"), ("c.yaml", "z", None)):
        (tmp_path / name).write_text(text)
        if seal:
            (tmp_path / f"{name}.sha256").write_text(f"{hashlib.sha256(seal.encode()).hexdigest()}  {name}\n")
    (tmp_path / "d.yaml.sha256").write_text("00")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in sealing.verify_path(spark, f"{tmp_path}/*.yaml").collect()}
    assert got == {"a.yaml": "VALID", "b.yaml": "CHANGED", "c.yaml": "UNSEALED", "d.yaml": "MISSING"}


def test_streamed_records_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for turn in range(2):
        (tmp_path / "in" / f"{turn}.json").write_text("\n".join(json.dumps({"source": f"s{turn}", "source_id": str(i), "title": "t"}) for i in range(3)))
        ingest.append_records(ingest.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
