"""The change log against a dictionary: replays, folding, hot and NULL keys, empty and unfinished batches."""

from pathlib import Path

from tidemark.streaming.runs import ChangeLog

SCHEMA = "k long, at long, v string"


def held(log):
    return {r["k"]: (r["at"], r["v"], r["batch_id"]) for r in log.read().collect()}


def test_change_log(spark, tmp_path):
    path, batches = str(tmp_path / "log"), []
    batches.append([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")] + [(7, i, f"x{i}") for i in range(50)])
    batches.append([])
    batches.append([(1, 0, "older time, later batch"), (3, 1, "c")])
    batches.append([(2, 5, "d"), (2, 4, "e"), (None, 2, "m")])
    batches.append([(4, 1, "f")])
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for every in (2, 100):
        log = ChangeLog(spark, f"{path}-{every}", "k", "at", frames[0].schema, fold_every=every)
        assert held(log) == {}
        want = {}
        for number, (frame, rows) in enumerate(zip(frames, batches)):
            log(frame, number)
            want |= {k: (at, v, number) for k, at, v in sorted(rows, key=lambda r: r[1])}
            assert held(log) == want
            log(frame, number)  # a replay
            assert held(log) == want and log.read().count() == len(want)
        unfinished = Path(f"{path}-{every}/batch=5")
        unfinished.mkdir()
        (unfinished / "part-0.parquet").write_bytes(b"not yet a file")
        assert held(log) == want
    left = sorted(p.name for p in Path(f"{path}-2").iterdir())
    assert left == ["batch=2", "batch=3", "batch=4", "batch=5", "upto=1", "upto=3"]
